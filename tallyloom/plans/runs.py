"""Many forecasts in one plan: configurations (what-if) and as-of days (backfill, trend) are rows, not loops.

A run is a row of ``runs``: run, as_of, half_life, bloc_sd, party_sd, per_30_days, threshold, social_cap, social
(whether momentum counts). What only depends on part of them is made once for each distinct part, its *basis*
(as_of, half_life, threshold): the weighted average with its house effects. Runs that differ in the other knobs share
it, and the trend of a day reads the basis of the day two weeks before.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.functions.scalars import decay, seed_of, time_multiplier
from tallyloom.operators import calibration, house, montecarlo, weights

BASIS = ["as_of", "half_life", "threshold"]
TREND_DAYS = 14
RUNS = "run string, as_of date, half_life double, bloc_sd double, party_sd double, per_30_days double, threshold double, social_cap double, social boolean"


def run_table(spark: SparkSession, changes: dict[str, dict], as_of, config: ModelConfig = DEFAULT) -> DataFrame:
    """The runs of one day: ``changes`` has each run's knobs that differ from ``config`` (by the columns' names).
    ``as_of`` is a date, or a column of one."""
    base = {
        "half_life": config.half_life_days, "bloc_sd": config.bloc_error_sd, "party_sd": config.party_error_sd, "per_30_days": config.time_inflation_per_30_days,
        "threshold": config.threshold, "social_cap": config.social_cap_pp, "social": False,
    }
    rows = []
    for name, change in changes.items():
        if unknown := change.keys() - base.keys():
            raise ValueError(f"no such knobs: {sorted(unknown)}")
        knobs = {**base, **change}
        rows.append((name, None, *[knobs[k] if k == "social" else float(knobs[k]) for k in base]))
    return spark.createDataFrame(rows, RUNS).withColumn("as_of", F.lit(as_of).cast("date"))


def day_table(spark: SparkSession, last, days: int, social: bool = False, config: ModelConfig = DEFAULT) -> DataFrame:
    """One run for each of the ``days`` days before ``last`` and for ``last``, named by their ISO dates."""
    one = run_table(spark, {"": {"social": social}}, last, config)
    dates = F.explode(F.sequence(F.date_sub("as_of", days), F.col("as_of")))
    return one.withColumn("as_of", dates).withColumn("run", F.col("as_of").cast("string"))


def average_runs(polls: DataFrame, shares: DataFrame, below: DataFrame | None, grades: DataFrame, bases: DataFrame, unattributed: Iterable[str] = ("",), config: ModelConfig = DEFAULT, rounds: int = 12, modes: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(averages, house effects, sizes) of every basis. ``shares``: poll_id, party_id, share. ``below``: poll_id,
    party_id, published - lists reported as failing, or None. ``bases``: the ``BASIS`` columns, a few rows.

    A basis sees the polls up to its day. Of a poll's weight only the recency depends on the basis, and that on the
    poll's day alone, so readings are summed by party and day (with house effects by pollster too) before they meet the bases.
    Only house effects, whose residuals are clipped one by one, take a row for each reading and basis; all bases go
    through the same rounds.
    """
    static = F.col("sample") * F.col("quality") * F.col("mode_weight")
    named = ~F.col("pollster").isin(list(unattributed))
    stand = weights.standing_weights(polls, grades, config, modes)
    stand = stand.select(F.col("id").alias("poll_id"), F.col("date").alias("day"), "pollster", static.alias("static"), (static * F.col("completeness")).alias("kernel"), named.alias("attributed"))
    recency = decay(F.datediff("as_of", "day"), F.col("half_life"))
    at = lambda rows: rows.join(F.broadcast(bases.select(*BASIS)), F.col("day") <= F.col("as_of"))  # noqa: E731  a row a day and knob
    weighed = at(stand.select("day", "pollster", "kernel", "attributed")).withColumn("weight", F.col("kernel") * recency)
    rows = shares.select("poll_id", "party_id", "share").join(stand, "poll_id")
    sums = daily_sums(rows, below, stand, shares, ("pollster",) if rounds else ())
    each = at((sums if rounds else sums.drop("read")).checkpoint())  # read by averages and trends
    value = F.col("value") + F.col("floored") * config.imputed_threshold_share * F.col("threshold")
    effects = None
    if rounds:
        per_pollster = weighed.where("attributed").groupBy(*BASIS, "pollster").agg(F.sum("weight").alias("weight"))
        effects = house.house_effects(at(rows), "share", "kernel", "static", per_pollster, rounds, config, by=tuple(BASIS), half_life=F.col("half_life"))
        each = each.join(effects.select(*BASIS, "pollster", "party_id", "effect"), [*BASIS, "pollster", "party_id"], "left")
        value = value - F.coalesce("effect", F.lit(0.0)) * F.col("read")
    mean = weights.average_of_sums(each.select(*BASIS, "party_id", (value * recency).alias("value"), (F.col("kernel") * recency).alias("weight")), [*BASIS, "party_id"], "value", "weight", config)
    return mean, effects, weights.effective_size(weighed, BASIS)


def daily_sums(rows: DataFrame, below: DataFrame | None, stand: DataFrame, shares: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, party_id, day, kernel, value, read, floored): sums over readings and imputed lists of the weight
    (without recency), of values times weight, of the weight of readings with a share, and of lists that are imputed
    at a part of the threshold. ``rows``: the readings with ``stand``, the polls' weights."""
    kernel, zero, keys = F.col("kernel"), F.lit(0.0), [*by, "party_id", "day"]
    parts = rows.select(*keys, "kernel", (F.col("share") * kernel).alias("value"), F.when(F.col("share").isNotNull(), kernel).otherwise(zero).alias("read"), zero.alias("floored"))
    if below is not None:
        flagged = weights.unread_below(shares, below).join(stand, "poll_id")
        published = F.coalesce(F.col("published") * kernel, zero)
        parts = parts.unionByName(flagged.select(*keys, "kernel", published.alias("value"), zero.alias("read"), F.when(F.col("published").isNull(), kernel).otherwise(zero).alias("floored")))
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("kernel", "value", "read", "floored")])


def trended(mean: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """Averages with ``trend14d``: the share less that of ``days`` days before under the same knobs, 0 without one."""
    before = mean.select(F.date_add("as_of", days).alias("as_of"), "half_life", "threshold", "party_id", F.col("share").alias("_before"))
    rows = mean.join(before, [*BASIS, "party_id"], "left")
    return rows.withColumn("trend14d", F.when(F.col("_before").isNull(), 0.0).otherwise(F.col("share") - F.col("_before"))).drop("_before")


def with_trend(bases: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """The bases and those of ``days`` days before, for ``trended``."""
    return bases.select(*BASIS).unionByName(bases.select(F.date_sub("as_of", days).alias("as_of"), "half_life", "threshold")).distinct()


def central_runs(runs: DataFrame, mean: DataFrame, parties: DataFrame, misses: DataFrame | None, social: DataFrame | None, blocs: list[str], config: ModelConfig = DEFAULT, represent=None, extra: dict[str, str] | None = None) -> DataFrame:
    """(run's columns, party_id, bloc, ord, partner, poll_share, share, other): each run's averages plus momentum
    and calibration, floored, renormalised with the residual (column ``other``) to 1."""
    rows = F.broadcast(runs).join(mean.withColumnRenamed("share", "poll_share"), BASIS)  # runs: a few rows
    rows = rows.join(parties.select("party_id", "bloc", "ord", "partner"), "party_id")
    total = F.sum("poll_share").over(W.partitionBy("run"))
    rows = rows.withColumn("_rest", F.greatest(F.lit(config.residual_floor), 1 - total))
    add = F.lit(0.0)
    if social is not None:
        seen = social.join(F.broadcast(runs.where("social").select("run", "as_of", "social_cap")), (F.col("day") <= F.col("as_of")) & (F.col("day") > F.date_sub("as_of", config.social_baseline_days)))
        moved = calibration.momentum(seen, F.col("as_of"), represent=represent, config=config, by=("run",), cap_pp=F.col("social_cap"))
        rows = rows.join(moved.select("run", "party_id", F.col("adjustment").alias("_social")), ["run", "party_id"], "left")
        add = add + F.coalesce("_social", F.lit(0.0))
    if misses is not None:
        groups = calibration.calibrate_groups(misses, blocs)
        moved = calibration.calibrate_parties(groups, rows.select("run", "party_id", "bloc", "ord", F.col("poll_share").alias("strength")), config.total_seats, extra, ("run",))
        rows = rows.join(moved.select("run", "party_id", F.col("adjustment").alias("_calibration")), ["run", "party_id"], "left")
        add = add + F.coalesce("_calibration", F.lit(0.0))
    raw = F.greatest(F.lit(config.share_floor), F.col("poll_share") + add)
    rows = rows.withColumn("_raw", raw)
    whole = F.sum("_raw").over(W.partitionBy("run")) + F.col("_rest")
    return rows.withColumn("share", F.col("_raw") / whole).withColumn("other", F.col("_rest") / whole).drop("_raw", "_rest", "_social", "_calibration")


def settings(central: DataFrame, simulations: int, config: ModelConfig = DEFAULT) -> DataFrame:
    """``central`` with what ``draw_runs`` reads: the seed of the run's day, number of draws and momentum (so runs that
    differ in other knobs share their random numbers), and the time multiplier of the days to the election."""
    days = F.greatest(F.lit(0), F.datediff(F.lit(config.election_date).cast("date"), F.col("as_of")))
    label = F.concat_ws("|", F.col("as_of").cast("string"), F.lit(str(simulations)), F.when(F.col("social"), "social").otherwise("nosocial"))
    scale = 1 + F.col("per_30_days") * (time_multiplier(days, 1.0) - 1)
    out = central if "seed" in central.columns else central.withColumn("seed", seed_of(label))
    return out.withColumn("days", days).withColumn("scale", scale)


@dataclasses.dataclass(frozen=True)
class Runs:
    """What the runs give, each table with the key ``run``: no stage collects more than scalars."""

    runs: DataFrame
    central: DataFrame
    effects: DataFrame | None
    sizes: DataFrame
    draws: DataFrame
    parties: DataFrame
    blocs: DataFrame
    scenarios: DataFrame
    outlook: DataFrame


def forecast_runs(runs: DataFrame, polls: DataFrame, shares: DataFrame, below: DataFrame, grades: DataFrame, parties: DataFrame, misses: DataFrame | None, social: DataFrame | None, members: DataFrame, blocs: list[str], turnout_bloc: str, leader, unattributed: Iterable[str] = ("",), config: ModelConfig = DEFAULT, rounds: int = 12) -> Runs:
    """The whole model for every run. ``blocs``: in order of their normals; the first is the leader's, the second the
    challenger's, the third supports it."""
    mean, effects, sizes = average_runs(polls, shares, below, grades, with_trend(runs), unattributed, config, rounds)
    central = central_runs(runs, trended(mean), parties, misses, social, blocs, config)
    central = settings(central, config.simulations, config).checkpoint()
    draws = montecarlo.draw_runs(central, ["run"], config.simulations, blocs, turnout_bloc, config).checkpoint()
    by = ("run",)
    seats = montecarlo.summary(draws, by=by)
    seats = central.select("run", "party_id", "share", "poll_share", "trend14d").join(seats, ["run", "party_id"], "left")
    keys = runs.select("run", *BASIS)
    return Runs(
        runs, central, None if effects is None else keys.join(effects, BASIS).drop(*BASIS), keys.join(sizes, BASIS).drop(*BASIS), draws, seats,
        montecarlo.bloc_summary(draws, config.majority, by), montecarlo.scenarios(draws, members, config.majority, by),
        montecarlo.outlook(draws, blocs[0], leader, blocs[1], blocs[2], majority=config.majority, by=by),
    )


def against(summary: DataFrame, base: str, key: str = "party_id", values: tuple[str, ...] = ("mean",)) -> DataFrame:
    """Every run's summary with ``delta_<value>`` against the run ``base``; a key that the base lacks counts from 0."""
    one = summary.where(F.col("run") == base).select(key, *[F.col(v).alias(f"_{v}") for v in values])
    rows = summary.join(F.broadcast(one), key, "left")  # a row a party or bloc
    return rows.withColumns({f"delta_{v}": F.col(v) - F.coalesce(f"_{v}", F.lit(0.0)) for v in values}).drop(*[f"_{v}" for v in values])
