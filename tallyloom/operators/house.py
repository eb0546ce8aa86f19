"""Leave-one-out consensus and source ("house") effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.functions.scalars import clip


#: Days times 1 / half-life that doubles can span on either side of the middle day.
WIDEST = 1000


def kernel_sums(obs: DataFrame, value: str, weight: str, config: ModelConfig = DEFAULT, by: tuple[str, ...] = (), half_life: Column | None = None) -> DataFrame:
    """(``by``, party_id, day, pollster, a, w): for each party and observed day, each pollster's values and weights
    under the kernel 0.5 ** (|days apart| / half-life).

    The kernel is a product of two exponentials on either side of a day, so two running sums over the days of a
    (party, pollster) give it: rows and work are parties * days * pollsters, and no day is joined with another.
    ``obs``: ``by``, party_id, pollster, day; rows without a party or a day are left out. ``half_life`` may be a column
    that is one value for each ``by``. Days of a party further apart than 2 * ``WIDEST`` half-lives raise an error, for
    the factors are doubles.
    """
    half = F.lit(float(config.half_life_days)) if half_life is None else half_life
    keys = [*by, "party_id"]
    rows = obs.where("party_id is not null and day is not null").select(
        *keys, "pollster", "day", half.alias("_half"), (F.col(value) * F.col(weight)).alias("a"), F.col(weight).cast("double").alias("w")
    )
    days, pollsters = rows.select(*keys, "day", "_half").distinct(), rows.select(*keys, "pollster").distinct()
    grid = days.join(pollsters, keys).select(*keys, "pollster", "day", "_half", F.lit(0.0).alias("a"), F.lit(0.0).alias("w"))
    daily = rows.unionByName(grid).groupBy(*keys, "pollster", "day").agg(F.sum("a").alias("a"), F.sum("w").alias("w"), F.first("_half").alias("_half"))
    one = W.partitionBy(*keys, "pollster")
    middle = (F.unix_date(F.min("day").over(one)) + F.unix_date(F.max("day").over(one))) / 2
    far = (F.unix_date("day") - middle) / F.col("_half")
    rise = F.when(F.abs(far) <= WIDEST, F.pow(F.lit(2.0), far)).otherwise(F.raise_error(F.lit("the days span too many half-lives")).cast("double"))
    daily = daily.withColumn("_rise", rise)
    up, down = (one.orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("day"), F.col("day").desc()))

    def kernel(c: str):
        past, future = F.sum(F.col(c) * F.col("_rise")).over(up) / F.col("_rise"), F.sum(F.col(c) / F.col("_rise")).over(down) * F.col("_rise")
        return (past + future - F.col(c)).alias(c)

    return daily.select(*keys, "day", "pollster", kernel("a"), kernel("w"))


def leave_one_out(sums: DataFrame, effects: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, party_id, day, pollster, consensus, weight): what the other pollsters say, less their effects; null
    where no other pollster reports the party."""
    rows = sums
    if effects is not None:
        rows = rows.join(effects.select(*by, "pollster", "party_id", "effect"), [*by, "pollster", "party_id"], "left")
    adjusted = F.col("a") - (F.coalesce("effect", F.lit(0.0)) * F.col("w") if effects is not None else F.lit(0.0))
    group = W.partitionBy(*by, "party_id", "day")
    rows = rows.withColumn("_a", adjusted).withColumn("_n", F.count(F.lit(1)).over(group))
    others_a, others_w = F.sum("_a").over(group) - F.col("_a"), F.sum("w").over(group) - F.col("w")
    return rows.select(*by, "party_id", "day", "pollster", F.when(F.col("_n") > 1, others_a / others_w).alias("consensus"), F.when(F.col("_n") > 1, others_w).alias("weight"))


def effect_step(obs: DataFrame, sums: DataFrame, effects: DataFrame | None, value: str, weight: str, config: ModelConfig = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """One round: the weighted mean of the clipped residuals of each (pollster, party), shrunk by n / (n + k)."""
    consensus = leave_one_out(sums, effects, by)
    joined = obs.join(consensus.drop("weight"), [*by, "party_id", "day", "pollster"]).where(F.col("consensus").isNotNull() & F.col("attributed"))
    r = clip(F.col(value) - F.col("consensus"), -config.residual_clip, config.residual_clip)
    n = F.count(F.lit(1))
    return joined.groupBy(*by, "pollster", "party_id").agg((F.sum(r * F.col(weight)) / F.sum(weight) * n / (n + config.shrink)).alias("effect"), n.alias("n"))


def center(effects: DataFrame, pollster_weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Effects less their mean for each party, weighted by the pollsters' total weights (``by``, pollster, weight)."""
    rows = effects.join(pollster_weights, [*by, "pollster"])
    group = W.partitionBy(*by, "party_id")
    mean = F.sum(F.col("effect") * F.col("weight")).over(group) / F.sum("weight").over(group)
    return rows.withColumn("effect", F.col("effect") - mean).drop("weight")


def house_effects(obs: DataFrame, value: str, kernel_weight: str, residual_weight: str, pollster_weights: DataFrame, rounds: int = 12, config: ModelConfig = DEFAULT, cut_lineage: bool = True, by: tuple[str, ...] = (), half_life: Column | None = None) -> DataFrame:
    """The fixed point after ``rounds`` rounds from zero, centred. The readings are checkpointed once, and so are
    each round's effects (``by`` * pollsters * parties rows): neither is made again, and the plan does not grow.
    With ``by`` (a configuration, a day) each group has its own readings and its own fixed point, all in the same
    rounds."""
    if cut_lineage:
        obs = obs.checkpoint()
    sums = kernel_sums(obs, value, kernel_weight, config, by, half_life)
    if cut_lineage:
        sums = sums.checkpoint()
    effects = None
    for _ in range(rounds):
        effects = effect_step(obs, sums, effects, value, residual_weight, config, by)
        if cut_lineage:
            effects = effects.checkpoint()
    return center(effects, pollster_weights, by)
