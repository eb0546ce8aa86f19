"""Weights of readings, weighted averages, effective sample sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.functions.scalars import decay, ratio


def standing_weights(polls: DataFrame, grades: DataFrame, config: ModelConfig = DEFAULT, modes: dict[str, float] | None = None) -> DataFrame:
    """Polls that aren't excluded, with the four components that no day changes: sample, quality, mode_weight, completeness."""
    modes = config.mode_weights if modes is None else modes
    mode = F.lit(config.default_mode_weight)
    for name, weight in modes.items():
        mode = F.when(F.col("mode") == name, F.lit(weight)).otherwise(mode)
    used = polls.where(~F.coalesce("excluded", F.lit(False))).join(grades, "pollster", "left")
    parts = {
        "sample": F.least(F.lit(1.0), F.coalesce(F.col("sample_size").cast("double"), F.lit(config.default_sample)) / config.reference_sample),
        "quality": F.coalesce("grade", F.lit(config.default_grade)),
        "mode_weight": mode,
        "completeness": F.when(F.col("partial"), F.lit(config.partial_weight)).otherwise(F.lit(1.0)),
    }
    return used.withColumns(parts).drop("grade")


def weigh(polls: DataFrame, as_of: Column, grades: DataFrame, config: ModelConfig = DEFAULT, half_life: Column | float | None = None, modes: dict[str, float] | None = None) -> DataFrame:
    """Polls up to ``as_of`` that aren't excluded, with five components in [0, 1] and their product.

    ``polls``: id, date, pollster, mode, sample_size, partial, excluded. ``grades`` (pollster, grade) is a
    dimension; Spark picks its join. A missing grade, mode or sample size has the default.
    """
    used = standing_weights(polls.where(F.col("date") <= as_of), grades, config, modes)
    weighed = used.withColumn("recency", decay(F.datediff(as_of, "date"), config.half_life_days if half_life is None else half_life))
    return weighed.withColumn("weight", F.col("recency") * F.col("sample") * F.col("quality") * F.col("mode_weight") * F.col("completeness"))


def partial_shares(readings: DataFrame, reported: Column, published: Column, below: Column, config: ModelConfig = DEFAULT) -> DataFrame:
    """Shares of a poll that reports seats for some lists only: seats / all seats * (1 - wasted).

    ``readings``: poll_id, party_id, seats. ``reported`` says which rows are seats; ``published`` is a share
    published for a row that isn't; ``below`` flags rows reported as failing. Wasted votes are a constant, the
    published shares, and a constant for each flagged row without one; capped.
    """
    waste = F.sum(F.when(~reported, F.coalesce(published, F.lit(0.0))).otherwise(0.0)) + config.below_threshold_waste * F.sum(
        F.when(below & ~reported & (F.coalesce(published, F.lit(0.0)) == 0), 1).otherwise(0)
    )
    per_poll = readings.groupBy("poll_id").agg(F.least(F.lit(config.waste_cap), config.unreported_waste + waste).alias("wasted"))
    return readings.where(reported).join(per_poll, "poll_id").withColumn("share", F.col("seats") / config.total_seats * (1 - F.col("wasted")))


def weighted_average(values: DataFrame, by: list[str], value: str, weight: str, config: ModelConfig = DEFAULT) -> DataFrame:
    """``by``, share (floored) and support (sum of weights); groups without weight are left out."""
    return average_of_sums(values.select(*by, (F.col(value) * F.col(weight)).alias("_v"), F.col(weight).alias("_w")), by, "_v", "_w", config)


def average_of_sums(sums: DataFrame, by: list[str], value: str, weight: str, config: ModelConfig = DEFAULT) -> DataFrame:
    """``weighted_average`` of rows that are sums already: ``value`` of values times weights, ``weight`` of weights."""
    out = sums.groupBy(*by).agg(F.sum(value).alias("_v"), F.sum(weight).alias("support"))
    return out.where("support > 0").select(*by, F.greatest(F.lit(config.share_floor), F.col("_v") / F.col("support")).alias("share"), "support")


def with_residual(shares: DataFrame, key: str, label, config: ModelConfig = DEFAULT) -> DataFrame:
    """``shares`` and one row ``label`` for what is missing to 1, at least the floor; raw_sum on every row."""
    total = shares.agg(F.sum("share").alias("raw_sum"))
    rest = total.select(F.lit(label).alias(key), F.greatest(F.lit(config.residual_floor), 1 - F.col("raw_sum")).alias("share"), F.lit(0.0).alias("support"))
    return shares.select(key, "share", "support").unionByName(rest).crossJoin(F.broadcast(total))  # one row


def unread_below(readings: DataFrame, below: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The flagged (poll, party) of ``below`` that have no reading."""
    keys = [*by, "poll_id", "party_id"]
    return below.join(readings.select(*keys), keys, "left_anti")


def impute_below(readings: DataFrame, below: DataFrame, value: str = "share", config: ModelConfig = DEFAULT, by: tuple[str, ...] = (), threshold: Column | None = None) -> DataFrame:
    """Adds a row for each flagged (poll, party) that has no reading, at its published share or a part of the
    threshold. A party that is neither read nor flagged stays absent. ``below``: ``by``, poll_id, party_id, published
    (and what ``threshold`` reads, where it is a column)."""
    keys = [*by, "poll_id", "party_id"]
    floor = config.imputed_threshold_share * (F.lit(config.threshold) if threshold is None else threshold)
    rows = unread_below(readings, below, by).select(*keys, F.coalesce("published", floor).alias(value), F.lit(True).alias("imputed"))
    return readings.select(*keys, value, F.lit(False).alias("imputed")).unionByName(rows)


def effective_size(weights: DataFrame, by: list[str], weight: str = "weight", visible: float = 0.02) -> DataFrame:
    """Kish's effective number, and how many weights are above ``visible``."""
    w = F.col(weight)
    return weights.groupBy(*by).agg(
        F.coalesce(ratio(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)), F.lit(0.0)).alias("effective_n"),
        F.count_if(w > visible).alias("used"),
    )


def contributions(weights: DataFrame, first: str, second: str, weight: str = "weight") -> DataFrame:
    """Weight by ``first``, by ``second`` and in total, in one pass."""
    grouped = weights.groupingSets([[first], [second], []], first, second)
    return grouped.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))


def legend(weights: DataFrame, sources: DataFrame, outlet: str, kind: str = "kind", weight: str = "weight") -> DataFrame:
    """``kind``, n, share: how much of all weight the outlets of each kind of source have. ``sources``: ``outlet``, ``kind``;
    an outlet that isn't there has the kind null."""
    per = weights.groupBy(outlet).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("_w")).join(sources, outlet, "left")
    rows = per.groupBy(kind).agg(F.sum("n").alias("n"), F.sum("_w").alias("_w"))
    return rows.select(kind, "n", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("share"))
