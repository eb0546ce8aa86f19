"""The corpus pipeline: documents to a training order, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and calls one operator on all that the stage before kept; its
result is written and read again as the next stage's documents. All but the last return the columns of
``documents``. Rows may repeat, texts may be null or empty, and the table may be empty; every stage then does
what its operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written
from tallyloom.llm.decontaminate import contaminated, find_leaks
from tallyloom.llm.linededup import dedup_lines
from tallyloom.llm.mixing import training_order
from tallyloom.llm.simhash import similar_documents
from tallyloom.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores at 0.5 or more go."""
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten or more documents go; every document stays, with what is left of its text."""
    out = dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 or more) the document with the smallest id stays."""
    found = similar_documents(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, copied or edited, go."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = leaks.where(contaminated(leaks)).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of what is left: one row for each copy taken, by position."""
    return training_order(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_neardup", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The toxicity stage is a fitted model, which SQL can't express; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
