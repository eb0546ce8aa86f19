"""Sinks: dated snapshots with a store that reads them back, index, trend, merged write-back, Markdown."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.quality import upsert


def write_snapshot(rows: DataFrame, folder: str, as_of: str = "as_of") -> None:
    """One partition for each date; a rerun replaces only its own dates."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(as_of).format("json").save(folder)


def latest(rows: DataFrame, as_of: str = "as_of") -> DataFrame:
    """The rows of the newest snapshot."""
    return rows.join(F.broadcast(rows.agg(F.max(as_of).alias(as_of))), as_of)  # one row


def snapshot(parties: DataFrame, scalars: DataFrame, columns: list[str]) -> DataFrame:
    """One nested document: the scalars and the array of parties with the published ``columns`` only."""
    return scalars.crossJoin(parties.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parties")))  # one row each


def index_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(date, headline) by date, new ones win, newest first."""
    return upsert(old, new, "date").orderBy(F.col("date").desc())


def trend(rows: DataFrame, date: str, key: str, value: str) -> DataFrame:
    """One row for each date with the map of ``key`` to the rounded value."""
    return rows.groupBy(date).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.round(value, 2))))).alias("series")).orderBy(date)


def pivoted(rows: DataFrame, date: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """The series as columns for the given keys."""
    return rows.groupBy(date).pivot(key, keys).agg(F.round(F.sum(value), 2))


def store_append(merged: DataFrame, folder: str, date: str = "date", id_: str = "id") -> None:
    """The merged store, newest first within its files."""
    merged.sortWithinPartitions(F.col(date).desc(), id_).write.mode("append").parquet(folder)


def markdown(rows: DataFrame, order: str, columns: list[str], title: str) -> DataFrame:
    """(line): a heading and a table in order; lines come with their place."""
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("line")))).alias("l"))
    return lines.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("document"))


def read_or_none(spark: SparkSession, folder: str, kind: str = "parquet", schema: str | StructType | None = None) -> DataFrame | None:
    """The table in ``folder``; None where there is none yet."""
    reader = spark.read.format(kind)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def upsert_by_date(batch: DataFrame, folder: str, key: str = "id", date: str = "date") -> list:
    """Merge ``batch`` into the Parquet store in ``folder``, partitioned by ``date``; its rows win by ``key``. Returns the
    dates that were written.

    Only the partitions that change are read and written: the batch's dates, and those where its keys stood before.
    They are made whole beside the store first and moved in by one overwrite of just these partitions; a failure before
    that leaves the store as it was, and the same batch again gives the same store. A partition that loses its last
    row is kept as an empty one.
    """
    spark = batch.sparkSession
    columns = [c for c in batch.columns if c != date]
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*batch.columns)).alias("_r")).select("_r.*")  # of a key's rows in a batch, the largest
    old = read_or_none(spark, folder)
    stage = f"{folder.rstrip('/')}_staged_{uuid.uuid4().hex}"
    if old is not None:
        old = old.withColumn(date, F.col(date).cast(batch.schema[date].dataType))
        moved = old.join(fresh.select(key), key, "left_semi").select(date).distinct()
        dates = [r[0] for r in fresh.select(date).distinct().unionByName(moved).distinct().collect()]  # a row a date
        stays = old.where(F.col(date).isin(dates)).join(fresh.select(key), key, "left_anti").select(*batch.columns)
        merged = stays.unionByName(fresh.select(*batch.columns))
    else:
        dates = [r[0] for r in fresh.select(date).distinct().collect()]
        merged = fresh
    merged.repartition(date).sortWithinPartitions(F.col(date).desc(), key).write.parquet(stage)
    ready = spark.read.schema(merged.schema).parquet(stage)
    emptied = set(dates) - {r[0] for r in ready.select(date).distinct().collect()}
    ready.select(*columns, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(folder)
    for day in emptied:
        ready.drop(date).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{date}={day}")
    return sorted(dates)


@dataclass(frozen=True)
class SnapshotStore:
    """Dated documents in ``folder`` that read back: ``documents/as_of=<date>`` (JSON, one nested document a date),
    ``trend/as_of=<date>`` (Parquet), ``index`` (date, headline) and ``latest`` (the newest date)."""

    spark: SparkSession
    folder: str

    def _at(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def write(self, documents: DataFrame, headlines: DataFrame | None = None, date: str = "as_of") -> list[str]:
        """Write documents (``as_of``, parties array<struct<party_id, mean, ..>>, blocs array<struct<bloc, mean, ..>>, ..) by
        date; a date that is there is replaced. The trend of just these dates is made from what was written, then the
        index and, last of all, the pointer, so a reader never follows it to a date that isn't there."""
        documents = documents.withColumn(date, F.col(date).cast("string")).checkpoint()  # they may come out of this store
        write_snapshot(documents, self._at("documents"), date)
        dates = sorted(r[0] for r in documents.select(date).distinct().collect())  # a row a date
        written = self.documents(documents.schema).where(F.col(date).isin(dates))
        points = written.select(date, F.explode("parties").alias("p")).select(date, F.lit("party").alias("kind"), F.col("p.party_id").cast("string").alias("key"), F.round("p.mean", 2).alias("value"))
        points = points.unionByName(written.select(date, F.explode("blocs").alias("b")).select(date, F.lit("bloc").alias("kind"), F.col("b.bloc").alias("key"), F.round("b.mean", 2).alias("value")))
        points.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(self._at("trend"))
        if headlines is not None:
            rows = headlines.select(F.col(date).cast("string").alias("date"), "headline")
            old = self.index()
            rows = rows if old is None else upsert(old.select("date", "headline"), rows, "date")
            rows.coalesce(1).checkpoint().write.mode("overwrite").json(self._at("index"))  # a row a date
        newest = max([*dates, *[d for d in [self.newest()] if d]], default=None)
        if newest is not None:
            self.spark.createDataFrame([(newest,)], "as_of string").coalesce(1).write.mode("overwrite").json(self._at("latest"))
        return dates

    def documents(self, schema: StructType | str | None = None) -> DataFrame:
        """All documents; a filter on ``as_of`` reads only these dates' files."""
        rows = read_or_none(self.spark, self._at("documents"), "json", schema)
        if rows is None:
            raise ValueError(f"no documents in {self.folder}")
        return rows.withColumn("as_of", F.col("as_of").cast("string"))

    def newest(self) -> str | None:
        rows = read_or_none(self.spark, self._at("latest"), "json", "as_of string")
        row = None if rows is None else rows.first()
        return None if row is None else row["as_of"]

    def on(self, date: str | None = None, schema: StructType | str | None = None) -> DataFrame:
        """The document of a date; of the newest one without a date."""
        return self.documents(schema).where(F.col("as_of") == F.lit(date or self.newest()))

    def index(self) -> DataFrame | None:
        """(date, headline), newest first."""
        rows = read_or_none(self.spark, self._at("index"), "json", "date string, headline string")
        return None if rows is None else rows.orderBy(F.col("date").desc())

    def trend(self) -> DataFrame:
        """(as_of, kind, key, value): one row for each date and party or bloc."""
        return self.spark.read.parquet(self._at("trend")).withColumn("as_of", F.col("as_of").cast("string"))

    def before(self, dates: DataFrame, date: str = "as_of") -> DataFrame:
        """(run, party_id, mean) of the day before each of ``dates`` (run, as_of), where there is a document of it."""
        old = read_or_none(self.spark, self._at("trend"))
        if old is None:
            return self.spark.createDataFrame([], "run string, party_id string, mean double")
        old = old.where("kind = 'party'").select(F.date_add(F.col(date).cast("date"), 1).alias(date), F.col("key").alias("party_id"), F.col("value").alias("mean"))
        return dates.select("run", F.col(date).cast("date").alias(date)).join(old, date).select("run", "party_id", "mean")


def top_series(points: DataFrame, most: int = 6, date: str = "as_of", key: str = "key", value: str = "value") -> DataFrame:
    """The series of the ``most`` keys with the largest value on the newest date (ties: the smaller key)."""
    newest = points.agg(F.max(date).alias(date))
    keys = points.join(F.broadcast(newest), date).orderBy(F.col(value).desc(), key).limit(most).select(key)  # one row
    return points.join(F.broadcast(keys), key)  # ``most`` rows
