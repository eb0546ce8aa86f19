"""The daily report: headline, sections and bullets from summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.scalars import pct_guard, signed


def movement(today: DataFrame, before: DataFrame, key: str | list[str], value: str, least: float = 0.3) -> DataFrame:
    """``key``, before, now, delta against the exact previous day (0 for a new key); changes under ``least`` go.
    Several days at once: with the day in ``key`` and ``before`` moved on by a day."""
    keys = [key] if isinstance(key, str) else key
    rows = today.select(*keys, F.col(value).alias("now")).join(before.select(*keys, F.col(value).alias("before")), keys, "left")
    rows = rows.withColumn("delta", F.coalesce(F.col("now") - F.col("before"), F.lit(0.0)))
    return rows.where(F.abs("delta") >= least).orderBy(F.abs("delta").desc(), *keys)


def lagged(rows: DataFrame, key: str, date: str, value: str, days: int) -> DataFrame:
    """Every (date, key) with its value exactly ``days`` earlier, by an equi-join on dates: gaps stay gaps."""
    old = rows.select(key, F.date_add(date, days).alias(date), F.col(value).alias("before"))
    return rows.join(old, [key, date], "left").withColumn("delta", F.coalesce(F.col(value) - F.col("before"), F.lit(0.0)))


def at_risk(parties: DataFrame, low: float = 0.02, high: float = 0.97) -> DataFrame:
    """Parties whose chance of a seat is strictly between the bounds, the least first."""
    return parties.where((F.col("p_seats") > low) & (F.col("p_seats") < high)).orderBy("p_seats", "party_id")


def top(rows: DataFrame, by: list[str], score: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of each group with the largest |score|; ``row_number`` under a limit plans a group limit."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.abs(score).desc(), tie)))
    return ranked.where(F.col("rank") <= n)


def report(parties: DataFrame, blocs: DataFrame, scenarios: DataFrame, outlook: DataFrame, changes: DataFrame, majority: int = 61) -> DataFrame:
    """One row: headline, sections (title, body) and bullets.

    All inputs are summaries of a few rows. The movement section is there only if something moved, the
    threshold section only if a party is at risk. The headline depends on the gap of the two largest blocs.
    """
    ranked = blocs.withColumn("_r", F.row_number().over(W.orderBy(F.col("mean").desc(), "bloc")))
    lead = ranked.agg(
        F.max_by("bloc", -F.col("_r")).alias("first"), F.max("mean").alias("m1"), F.max(F.when(F.col("_r") == 2, F.col("mean"))).alias("m2"),
        F.max(F.when(F.col("_r") == 2, F.col("bloc"))).alias("second"), F.max_by("p_majority", -F.col("_r")).alias("p1"),
    )
    lines = lambda df, order, text: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    seat = lambda c: F.format_string("%.1f", c)
    table = lines(parties, F.struct(-F.col("mean"), "party_id"), F.concat_ws(" ", F.col("party_id").cast("string"), seat(F.col("mean")), F.concat(F.lit("("), F.col("low").cast("int").cast("string"), F.lit("-"), F.col("high").cast("int").cast("string"), F.lit(")"))))
    block = lines(blocs, F.struct(-F.col("mean"), "bloc"), F.concat_ws(" ", F.col("bloc"), seat(F.col("mean")), pct_guard(F.col("p_majority"))))
    risk = lines(at_risk(parties), F.struct("p_seats", "party_id"), F.concat_ws(" ", F.col("party_id").cast("string"), pct_guard(F.col("p_seats"))))
    coal = lines(scenarios.orderBy((F.col("probability") * F.col("plausibility")).desc(), "scenario").limit(3), F.struct(-(F.col("probability") * F.col("plausibility")), "scenario"), F.concat_ws(" ", "scenario", pct_guard(F.col("probability"))))
    chief = lines(outlook, F.struct(-F.col("probability"), "winner"), F.concat_ws(" ", "winner", pct_guard(F.col("probability"))))
    moved = lines(changes, F.struct(-F.abs("delta"), F.col("party_id").cast("string")), F.concat_ws(" ", F.col("party_id").cast("string"), signed(F.col("delta"))))
    one = lead
    for name, part in (("parties", table), ("blocs", block), ("risk", risk), ("scenarios", coal), ("outlook", chief), ("movement", moved)):
        one = one.crossJoin(part.withColumnRenamed("t", name))  # one row each
    gap = F.col("m1") - F.col("m2")
    headline = F.when(gap < 1, F.concat_ws(" ", "first", F.lit("and"), "second", F.lit("level"))).otherwise(F.concat_ws(" ", "first", F.lit("leads by"), seat(gap)))
    section = lambda title, body: F.struct(F.lit(title).alias("title"), body.alias("body"))
    sections = F.array_compact(F.array(
        section("Summary", F.concat(F.lit("Majority is "), F.lit(str(majority)))), section("Parties", F.col("parties")), section("Blocs", F.col("blocs")),
        F.when(F.col("movement") != "", section("Movement", F.col("movement"))), F.when(F.col("risk") != "", section("Threshold", F.col("risk"))),
        section("Coalitions", F.col("scenarios")), section("Government", F.col("outlook")), section("Method", F.lit("Weighted average, calibration, simulation")),
    ))
    bullets = F.array(headline, F.concat_ws(" ", "first", F.lit("majority"), pct_guard(F.col("p1"))), F.split("parties", "\n")[0], F.split("outlook", "\n")[0], F.split("scenarios", "\n")[0])
    return one.select(headline.alias("headline"), sections.alias("sections"), bullets.alias("bullets"))
