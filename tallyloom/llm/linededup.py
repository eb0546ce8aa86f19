"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of spaces with A-Z lower-cased; keys that stand in at least ``min_docs``
documents lose all their lines. Counts live in runs: tables of ``(key, docs)``, bucketed and sorted by key, all with
the same buckets, so that joins of runs merge bucket with bucket and shuffle nothing. Each new batch is counted,
merge-anti-joins the settled runs (keys that have already reached ``min_docs`` need no more counting) and adds its
own run; ``fanout`` runs of a level are merged to one of the next, and what reaches ``min_docs`` there moves to a
settled run. A store can be saved and opened again for the next batch; rerunning a batch after a failure starts from
its written runs.

Edge cases: a null or empty text is one empty line; lines whose key is empty always stay; every row is a
document of its own for the counts, also where ids repeat or are null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import DATABASE, LOWER, SPACES, UPPER, dropped, modest_batches, shared_folder, table, text_of, written

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
#: Keys of a bucket of the runs, about, and the most buckets (a limit of Spark).
BUCKET_KEYS, MOST_BUCKETS = 1_000_000, 100_000

_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: str) -> bytes:
    """The 128-bit name of a line's key; empty if the key is empty."""
    key = line.strip(SPACES).translate(_FOLD)
    return hashlib.blake2b(key.encode(), digest_size=16).digest() if key else b""


def _keys(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [k for k in dict.fromkeys(map(line_key, t.split("\n"))) if k])


def _keep(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
    out = []
    for t, d in zip(text, drop):
        lines = t.split("\n")
        if d is None or len(d) == 0:
            out.append((t, len(lines), 0))
            continue
        gone = {bytes(k) for k in d}
        kept = [x for x in lines if line_key(x) not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


class LineRuns:
    """The levelled store of line counts: ``levels[i]`` lists runs, ``settled`` the runs of keys at ``min_docs``."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int = 1):
        self.min_docs, self.fanout, self.buckets = min_docs, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``(key)`` rows, one for each document and distinct key."""
        counted = batch.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).repartition(self.buckets, "key")
        for run in self.settled:
            counted = counted.join(run.select("key").hint("merge"), "key", "left_anti")
        self._put(0, self._run(counted))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _run(self, rows: DataFrame) -> DataFrame:
        return written(rows, "line-run", buckets=self.buckets)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = self._run(_merged(runs))
        self.settled.append(self._run(merged.where(F.col("docs") >= self.min_docs)))
        self._put(level + 1, self._run(merged.where(F.col("docs") < self.min_docs)))
        dropped(merged, *runs)

    def frequent(self) -> DataFrame:
        """The keys that stand in at least ``min_docs`` documents."""
        open_runs = [run for level in self.levels for run in level]
        out = [run.select("key") for run in self.settled]
        if open_runs:
            out.append(_merged(open_runs).where(F.col("docs") >= self.min_docs).select("key"))
        union = out[0]
        for x in out[1:]:
            union = union.unionByName(x)
        return union

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write which runs the store has to ``folder``; the runs stay where they are."""
        runs = [(-1, run) for run in self.settled] + [(n, run) for n, level in enumerate(self.levels) for run in level]
        at = lambda run: spark.sql(f"DESCRIBE FORMATTED {run.work_table}").where("col_name = 'Location'").first()["data_type"]
        rows = [(n, run.work_table, at(run), self.min_docs, self.fanout, self.buckets) for n, run in runs]
        spark.createDataFrame(rows, "level int, run string, location string, min_docs int, fanout int, buckets int").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The saved store, ready for the next batch, also in another session."""
        rows = spark.read.parquet(folder).orderBy("level", "run").collect()  # one row a run
        out = cls(rows[0]["min_docs"], rows[0]["fanout"], rows[0]["buckets"])
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_folder(spark).rstrip('/')}/{DATABASE}'")
        for r in rows:
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {r['run']} (key BINARY, docs BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                f"INTO {r['buckets']} BUCKETS LOCATION '{r['location']}'"
            )
            run = spark.table(r["run"])
            run.work_table = r["run"]
            if r["level"] < 0:
                out.settled.append(run)
            else:
                while len(out.levels) <= r["level"]:
                    out.levels.append([])
                out.levels[r["level"]].append(run)
        return out


def _merged(runs: list[DataFrame]) -> DataFrame:
    """The sum of the runs by key: outer joins of equal buckets, which merge and shuffle nothing."""
    out = runs[0]
    for run in runs[1:]:
        both = out.alias("l").join(run.alias("r").hint("merge"), F.expr("l.key = r.key"), "full")
        out = both.select(F.coalesce("l.key", "r.key").alias("key"), (F.coalesce("l.docs", F.lit(0)) + F.coalesce("r.docs", F.lit(0))).alias("docs"))
    return out


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, the columns ``carry``, kept (the text that stays), n_lines, n_dropped."""
    modest_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"), *carry)
    lines = written(
        texts.select("doc_id", F.explode(F.pandas_udf(_keys, "array<binary>")("text")).alias("key")).withColumn(
            "batch", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(batches)).cast("int")
        ),
        "line-keys", ("batch",),
    )
    buckets = min(MOST_BUCKETS, max(1, lines.count() // BUCKET_KEYS))
    runs = LineRuns(min_docs, fanout, buckets)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("key"))
    frequent = written(runs.frequent(), "line-frequent")
    hits = lines.select("doc_id", "key").join(frequent, "key").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
    joined = texts.alias("t").join(hits.alias("h"), F.expr("t.doc_id <=> h.doc_id"), "left").select("t.doc_id", "text", "drop", *carry)
    return joined.withColumn("r", F.pandas_udf(_keep, "kept string, n_lines long, n_dropped long")("text", "drop")).select("doc_id", *carry, "r.*")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_KEY_SQL = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, line, i, {_KEY_SQL} AS key FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
