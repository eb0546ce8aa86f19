"""Calibration of averages by past misses, zero-sum centring and bounded momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.functions.scalars import clip

#: Fixed values of the calibration.
AGE_HALF_LIFE, APPROX_WEIGHT, SHRINK, CAP = 1.5, 0.6, 3.0, 2.5
LISTED_SHARE = 0.955


def zero_sum(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``value`` less its mean over the group."""
    return rows.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(*by)))


def miss_summary(misses: DataFrame, group: str = "grp") -> DataFrame:
    """``group``, n, raw, shrunk, applied (capped), sd: the decayed weighted mean of actual - polled.

    Age counts elections back from the newest (dense rank of dates); approximate records weigh less. The
    standard deviation of one record is the size of its miss. ``misses``: date, group, polled, actual, confidence.
    """
    dates = misses.select("date").distinct().withColumn("age", F.dense_rank().over(W.orderBy(F.col("date").desc())) - 1)
    miss = F.col("actual") - F.col("polled")
    w = F.pow(F.lit(0.5), F.col("age") / AGE_HALF_LIFE) * F.when(F.col("confidence") == "firm", 1.0).otherwise(APPROX_WEIGHT)
    per = misses.join(F.broadcast(dates), "date").withColumn("_w", w).withColumn("_m", miss)  # one row an election
    per = per.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("_m") * F.col("_w")) / F.sum("_w")).alias("raw"), F.coalesce(F.stddev_samp("_m"), F.abs(F.avg("_m"))).alias("sd"))
    per = per.withColumn("shrunk", F.col("raw") * F.col("n") / (F.col("n") + SHRINK))
    return per.withColumn("applied", clip(F.col("shrunk"), -CAP, CAP))


def calibrate_groups(misses: DataFrame, blocs: list[str], group: str = "grp") -> DataFrame:
    """``miss_summary`` with ``applied`` centred to sum to zero over ``blocs``, after the cap; other groups keep theirs."""
    per = miss_summary(misses, group)
    inside = F.col(group).isin(blocs)
    mean = F.avg(F.when(inside, F.col("applied"))).over(W.partitionBy())
    return per.withColumn("applied", F.when(inside, F.col("applied") - mean).otherwise(F.col("applied")))


def calibrate_parties(groups: DataFrame, parties: DataFrame, seats: int = DEFAULT.total_seats, extra: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Share adjustments by party, summing to zero: each bloc's seats in proportion to its parties' strength, and
    half of an extra group's for each party it names. ``parties``: ``by``, party_id, bloc, strength, ord."""
    group = W.partitionBy(*by, "bloc")
    part = F.col("strength") / F.sum("strength").over(group)
    rows = parties.withColumn("_part", part).join(groups.select(F.col("grp").alias("bloc"), "applied"), "bloc", "left")
    moved = F.coalesce(F.col("applied") * F.col("_part"), F.lit(0.0))
    if extra:
        more = groups.where(F.col("grp").isin(list(set(extra.values())))).select(F.col("grp").alias("_g"), F.col("applied").alias("_x"))
        which = F.lit(None).cast("string")
        for party, name in extra.items():
            which = F.when(F.col("party_id") == party, name).otherwise(which)
        rows = rows.withColumn("_g", which).join(more, "_g", "left")
        moved = moved + F.coalesce(F.col("_x") / 2, F.lit(0.0))
    rows = rows.withColumn("adjustment", moved * LISTED_SHARE / seats)
    return zero_sum(rows, "adjustment", [*by]).select(*by, "party_id", "bloc", "adjustment")


def calibration_totals(groups: DataFrame, adjustments: DataFrame, blocs: list[str], seats: int = DEFAULT.total_seats) -> DataFrame:
    """One row: implied_sd (mean SD of the blocs as a share) and seats_moved."""
    sd = groups.where(F.col("grp").isin(blocs)).agg((F.avg("sd") * LISTED_SHARE / seats).alias("implied_sd"))
    moved = adjustments.agg(F.sum(F.abs(F.col("adjustment") / LISTED_SHARE * seats)).alias("seats_moved"))
    return sd.crossJoin(moved)  # one row each


def panel(adjustments: DataFrame, least: float = 0.05, seats: int = DEFAULT.total_seats) -> DataFrame:
    """(party_id, moved): the seats that calibration moves to each party, those of ``least`` or more, largest first."""
    rows = adjustments.select("party_id", (F.col("adjustment") / LISTED_SHARE * seats).alias("moved"))
    return rows.where(F.abs("moved") >= least).orderBy(F.col("moved").desc(), "party_id")


def record(misses: DataFrame) -> DataFrame:
    """Past misses (actual - polled), newest first."""
    return misses.select("date", "grp", (F.col("actual") - F.col("polled")).alias("miss"), "confidence").orderBy(F.col("date").desc(), "grp")


def momentum(obs: DataFrame, as_of: Column, key: str = "party_id", represent: Column | None = None, enabled: bool = True, config: ModelConfig = DEFAULT, by: tuple[str, ...] = (), cap_pp: Column | None = None) -> DataFrame:
    """Recent against baseline attention, as a clipped change and a capped, centred share adjustment.

    ``obs``: day, ``key``, volume_share, engagement_share, sentiment. The windows are (as_of - 7, as_of] and
    (as_of - 28, as_of - 7]; both come from one conditional aggregation. ``represent`` scales the adjustment. With
    ``by``, ``as_of`` and ``cap_pp`` may be columns of ``obs`` that are one value for each ``by``.
    """
    age = F.datediff(as_of, "day")
    recent = (age >= 0) & (age < config.social_window_days)
    base = (age >= config.social_window_days) & (age < config.social_baseline_days)

    def attention(window: Column) -> Column:
        mean = lambda c: F.avg(F.when(window, F.col(c)))
        return (0.35 * mean("volume_share") + 0.65 * mean("engagement_share")) * (1 + 0.25 * mean("sentiment"))

    cap = F.lit(float(config.social_cap_pp)) if cap_pp is None else cap_pp
    rows = obs.where(recent | base).groupBy(*by, key).agg(F.first(cap).alias("_cap"), F.coalesce(attention(recent), F.lit(0.0)).alias("recent"), F.coalesce(attention(base), F.lit(0.0)).alias("baseline"))
    change = F.when(F.col("baseline") > 0, clip((F.col("recent") - F.col("baseline")) / F.nullif("baseline", F.lit(0.0)), -0.4, 0.4)).otherwise(0.0)
    rows = rows.withColumn("momentum", change)
    if not enabled:
        return rows.drop("_cap").withColumn("adjustment", F.lit(0.0))
    scale = F.col("_cap") / 100 / 0.4 * (F.lit(0.5) if represent is None else represent)
    return zero_sum(rows.withColumn("adjustment", F.col("momentum") * scale), "adjustment", [*by]).drop("_cap")
