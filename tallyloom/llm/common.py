"""Column expressions and work tables shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a regular expression class and as text.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def words(column: Column) -> Column:
    """All maximal runs of characters that are not spaces, in order."""
    inner = strip(column)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A lambda variable can't be inlined into the lambdas inside ``body``, so an expensive array is not
    computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as the column ``name``, computed once for each row before later steps.

    A generator keeps the optimiser from merging the expression into what uses it. A Python function must get
    such a plain column where the expression has nested lambdas: Spark may not recognise them as the same
    expression twice, and then fails to extract the function.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


DATABASE = "tallyloom_work"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary folder,
    and the session's settings stay as they are; a cluster must name one that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tallyloom-work")


def written(df: DataFrame, name: str, partitions: tuple[str, ...] = (), buckets: int = 0, key: str = "key") -> DataFrame:
    """``df`` as a Parquet work table in the shared folder: its lineage ends there. With ``buckets`` the table is
    bucketed and sorted by ``key``, one file a bucket if ``df`` is dealt out by it."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_folder(spark).rstrip('/')}/{DATABASE}'")
    table_ = f"{DATABASE}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    writer = writer.partitionBy(*partitions) if partitions else writer
    writer = writer.bucketBy(buckets, key).sortBy(key) if buckets else writer
    writer.saveAsTable(table_)
    out = spark.table(table_)
    out.work_table = table_
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete work tables that no later step reads."""
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.work_table}")


def modest_batches(spark: SparkSession, rows: int = 500, size: str = "32m") -> None:
    """Send at most ``rows`` rows and about ``size`` in an Arrow batch, for texts may be very long.

    This sets the session's configuration; smaller limits stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
