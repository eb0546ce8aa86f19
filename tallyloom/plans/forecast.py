"""Composite pipelines: weighing, aggregation, forecast, and the daily, scrape and revalidate jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.operators import apportion, quality, weights
from tallyloom.plans import runs
from tallyloom.sources import sinks


@dataclass(frozen=True)
class Forecast:
    """What one forecast returns, all as DataFrames: no stage collects more than scalars."""

    shares: DataFrame
    effects: DataFrame
    central: DataFrame
    draws: DataFrame
    parties: DataFrame
    blocs: DataFrame
    scenarios: DataFrame
    outlook: DataFrame
    sizes: DataFrame


def poll_shares(readings: DataFrame, published: DataFrame, parties: DataFrame | None = None, config: ModelConfig = DEFAULT) -> DataFrame:
    """(poll_id, party_id, share): complete polls by inverting the allocation, with the agreements in ``parties``
    (party_id, partner), others by their seats.

    ``readings``: poll_id, party_id, seats, ord. ``published``: poll_id, party_id, share, below - rows without
    seats (a published share, or a list reported as failing).
    """
    rows = readings.select("poll_id", "party_id", "seats", F.lit(None).cast("double").alias("published"), F.lit(False).alias("below")).unionByName(
        published.join(readings.select("poll_id", "party_id"), ["poll_id", "party_id"], "left_anti").select("poll_id", "party_id", F.lit(None).cast("double").alias("seats"), F.col("share").alias("published"), "below")
    )
    flat = weights.partial_shares(rows, F.col("seats").isNotNull(), F.col("published"), F.col("below"), config)
    seats = readings.withColumn("seats", F.col("seats").cast("double"))
    if parties is not None:
        seats = seats.join(parties.select("party_id", "partner"), "party_id", "left")
    inverted = apportion.invert_seats(seats, config.total_seats, partner=None if parties is None else "partner").select("poll_id", "party_id", F.col("votes").alias("_votes"))
    joined = flat.join(inverted, ["poll_id", "party_id"], "left")
    return joined.select("poll_id", "party_id", F.coalesce(F.col("_votes") * (1 - F.col("wasted")), F.col("share")).alias("share"))


def build_forecast(polls: DataFrame, readings: DataFrame, published: DataFrame, grades: DataFrame, parties: DataFrame, as_of: str, misses: DataFrame | None, social: DataFrame | None, members: DataFrame, blocs: list[str], turnout_bloc: str, leader, unattributed: list[str] = [""], config: ModelConfig = DEFAULT, rounds: int = 12) -> Forecast:  # noqa: B006
    """The whole model as of a day: one run of ``runs.forecast_runs``. ``social`` adds momentum; ``misses`` calibrates;
    both may be left out."""
    one = runs.run_table(polls.sparkSession, {"": {"social": social is not None}}, as_of, config)
    f = build_runs(one, polls, readings, published, grades, parties, misses, social, members, blocs, turnout_bloc, leader, unattributed, config, rounds)
    central = f.central.select("party_id", "share", "bloc", "ord", "partner", "other")
    shares = f.central.select("party_id", F.col("poll_share").alias("share"), "support")
    return Forecast(shares, *[df.drop("run") for df in (f.effects,)], central, *[df.drop("run") for df in (f.draws, f.parties, f.blocs, f.scenarios, f.outlook, f.sizes)])


def build_runs(table: DataFrame, polls: DataFrame, readings: DataFrame, published: DataFrame, grades: DataFrame, parties: DataFrame, misses: DataFrame | None, social: DataFrame | None, members: DataFrame, blocs: list[str], turnout_bloc: str, leader, unattributed: list[str] = [""], config: ModelConfig = DEFAULT, rounds: int = 12) -> runs.Runs:  # noqa: B006
    """The whole model for every row of ``table`` (see ``runs``), from seats as they were published."""
    shares = poll_shares(readings, published, parties, config).checkpoint()
    below = published.where("below").select("poll_id", "party_id", F.col("share").alias("published"))
    return runs.forecast_runs(table, polls, shares, below, grades, parties, misses, social, members, blocs, turnout_bloc, leader, unattributed, config, rounds)


def effective_polls(curated: DataFrame, stored: DataFrame, attributed: Column) -> DataFrame:
    """Curated and stored polls, the stored ones shadowed by curated keys, deduplicated."""
    rest = quality.shadow(stored, curated.where(attributed)).select(*curated.columns)
    return quality.dedupe(curated.unionByName(rest), attributed)


def revalidate(store: DataFrame, log: DataFrame, rules, now: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays in the store, the bounded quarantine log: id, reasons, seen_at)."""
    good, bad = quality.split_valid(quality.reasons(store, rules))
    fresh = bad.select("id", "reasons", now.alias("seen_at"))
    return good.drop("reasons"), quality.quarantine(log, fresh, "id", "seen_at")


def scrape(registry, store: DataFrame, log: DataFrame, rules, now: Column) -> tuple[DataFrame, DataFrame, list]:
    """(merged store, quarantine log, failures): every source fetched by itself and validated once; rejects go to
    the log. Fails only if every source failed."""
    good, bad, failures = registry.collect(store.sparkSession, rules)
    if good is None:
        raise RuntimeError(f"every source failed: {failures}")
    new = quality.merge_new(store, good).select(*store.columns)
    fresh = bad.select("id", "reasons", now.alias("seen_at"))
    return store.unionByName(new), quality.quarantine(log, fresh, "id", "seen_at"), failures


def publish(forecasts: dict[str, Forecast], folder: str, index: DataFrame) -> DataFrame:
    """Write each day's parties as a dated snapshot and return the new index (date, headline)."""
    fresh = None
    for as_of, f in forecasts.items():
        rows = f.parties.withColumn("as_of", F.lit(as_of))
        sinks.write_snapshot(rows, folder)
        head = f.blocs.agg(F.concat_ws(" ", F.max_by("bloc", F.struct("mean", "bloc")), F.lit("first")).alias("headline")).select(F.lit(as_of).cast("date").alias("date"), "headline")
        fresh = head if fresh is None else fresh.unionByName(head)
    return sinks.index_upsert(index, fresh) if fresh is not None else index
