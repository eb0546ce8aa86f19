"""The daily job: forecasts of a day and the days before it, their reports, snapshots, index and trend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.operators import reporting
from tallyloom.plans import forecast
from tallyloom.plans.runs import Runs, day_table
from tallyloom.sources.sinks import SnapshotStore


@dataclass(frozen=True)
class Published:
    """What a job wrote: the runs, (run, date, headline, sections, bullets, json), (run, markdown) and the dates."""

    runs: Runs
    reports: DataFrame
    markdown: DataFrame
    dates: list[str]


def settings_of(runs: Runs) -> DataFrame:
    """run, as_of, days, scale and knobs: a row a run."""
    return runs.central.select("run", "as_of", "days", "scale", "threshold", "social_cap", "social").distinct()


def previous(runs: Runs, store: SnapshotStore | None) -> DataFrame:
    """(run, party_id, mean) of each run's day before: from the runs themselves, else from the store."""
    days = runs.runs.select("run", "as_of")
    kind = dict(runs.parties.dtypes)["party_id"]
    inside = runs.parties.join(days, "run").select(F.date_add("as_of", 1).alias("as_of"), "party_id", "mean").join(days, "as_of").select("run", "party_id", "mean")
    if store is None:
        return inside
    old = store.before(days).select("run", F.col("party_id").cast(kind).alias("party_id"), "mean")
    return inside.unionByName(old.join(inside.select("run").distinct(), "run", "left_anti"))


def reports_of(runs: Runs, names: DataFrame, first_bloc: str, before: DataFrame | None, config: ModelConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(reports, markdown) of every run. ``names``: party_id, name, bloc, ord."""
    known = settings_of(runs)
    facts = reporting.facts(known, runs.parties, runs.blocs, runs.scenarios, runs.outlook, runs.sizes, names, first_bloc, before, config.majority).checkpoint()
    rendered = reporting.render(facts, reporting.template_table(names.sparkSession))
    reports = reporting.documents(known, reporting.headlines(runs.parties, names), rendered).checkpoint()
    return reports, reporting.markdown(reports, facts, runs.parties, names, config.simulations)


def snapshots_of(runs: Runs) -> DataFrame:
    """One nested document for each run: what a reader of the forecast needs, without draws."""
    key = settings_of(runs)
    lists = lambda df, name, *columns: df.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = key.withColumn("as_of", F.col("as_of").cast("string"))
    for part in (
        lists(runs.parties, "parties", "party_id", "share", "poll_share", "trend14d", "mean", "median", "low", "high", "p_seats", "p_largest"), lists(runs.blocs, "blocs", "bloc", "mean", "p_majority"),
        lists(runs.scenarios, "coalitions", "scenario", "plausibility", "probability", "mean"), lists(runs.outlook, "outlook", "winner", "probability"), runs.sizes.select("run", "effective_n", "used"),
    ):
        out = out.join(part, "run", "left")
    return out.drop("run")


def daily_job(store: SnapshotStore, last: str, days: int, names: DataFrame, polls: DataFrame, config: ModelConfig = DEFAULT, **inputs) -> Published:
    """Forecast ``last`` and the ``days`` days before it in one plan, and publish them. ``inputs`` are those of
    ``forecast.build_runs``. A day's movement is against the day before, made here or published earlier; a gap has none.
    """
    table = day_table(store.spark, last, days, inputs.get("social") is not None, config)
    runs = forecast.build_runs(table, polls, config=config, **inputs)
    kept = {name: getattr(runs, name).checkpoint() for name in ("parties", "blocs", "scenarios", "outlook", "sizes")}
    runs = Runs(runs.runs, runs.central, runs.effects, kept["sizes"], runs.draws, kept["parties"], kept["blocs"], kept["scenarios"], kept["outlook"])
    reports, markdown = reports_of(runs, names, inputs["blocs"][0], previous(runs, store), config)
    dates = store.write(snapshots_of(runs), reports.select(F.col("date").alias("as_of"), "headline"))
    for rows, name in ((reports.select("date", "json"), "reports"), (markdown.join(runs.runs.select("run", F.col("as_of").cast("string").alias("date")), "run").select("date", "markdown"), "markdown")):
        rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").text(f"{store.folder.rstrip('/')}/{name}", lineSep="\n")
    return Published(runs, reports, markdown, dates)
