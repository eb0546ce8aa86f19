"""Counter-based normals, correlated-error draws, and what is read off the draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT, ModelConfig
from tallyloom.functions.scalars import let, time_multiplier, uniform
from tallyloom.operators.apportion import averages_of, pooled_averages

BLOCK = 4096
DRAWS_A_TASK = 20_000


def uniforms(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(n, u): the first ``n`` outputs, each from its place alone."""
    return spark.range(n).select(F.col("id").alias("n"), uniform(seed, F.col("id")).alias("u"))


def normals(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(n, z): the first ``n`` standard normals of the polar method over pairs of uniforms."""
    return normals_of(spark.createDataFrame([(seed,)], "seed long"), n).select("n", "z")


def normals_of(seeds: DataFrame, n: int) -> DataFrame:
    """(seed, n, z): the first ``n`` normals of each of a few seeds (column ``seed``).

    The place of an accepted pair is a prefix count, in two levels: within blocks of pairs, and over blocks.
    A margin of 3 % and 64 pairs above the acceptance rate of pi / 4 is made; too few would raise.
    """
    pairs = math.ceil(n / 2 / (math.pi / 4) * 1.03) + 64
    k, seed = F.col("id"), F.col("seed")
    rows = seeds.sparkSession.range(pairs).crossJoin(F.broadcast(seeds))  # a row a seed
    rows = held(rows.select(seed, k, (uniform(seed, 2 * k) * 2 - 1).alias("u"), (uniform(seed, 2 * k + 1) * 2 - 1).alias("v")))
    rows = rows.withColumn("s", F.col("u") * F.col("u") + F.col("v") * F.col("v")).where("s > 0 and s < 1").withColumn("block", F.floor(k / BLOCK))
    before = W.partitionBy("seed").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    starts = rows.groupBy("seed", "block").agg(F.count(F.lit(1)).alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = rows.withColumn("i", F.row_number().over(W.partitionBy("seed", "block").orderBy("id")) - 1).join(starts, ["seed", "block"])
    at = (F.col("start") + F.col("i")) * 2
    mul = F.sqrt(-2 * F.ln("s") / F.col("s"))
    both = F.array(F.struct(at.alias("n"), (F.col("u") * mul).alias("z")), F.struct((at + 1).alias("n"), (F.col("v") * mul).alias("z")))
    return placed.select("seed", F.inline(both)).where(F.col("n") < n)


def held(rows: DataFrame) -> DataFrame:
    """``rows`` with u and v computed once: a generator keeps the optimiser from repeating the expressions."""
    return rows.select("seed", "id", F.inline(F.array(F.struct("u", "v"))))


def draws(shares: DataFrame, seed: int, simulations: int, blocs: list[str], turnout_bloc: str, days: int, other: float = 0.03, config: ModelConfig = DEFAULT, agreements: bool = True) -> DataFrame:
    """(sim, party_id, bloc, ord, share, qualifies, seats): the draws of one run; see ``draw_runs``."""
    one = shares.select(
        F.lit(0).alias("run"), "party_id", "bloc", "ord", "partner", "share", F.lit(seed).cast("long").alias("seed"), F.lit(float(other)).alias("other"), F.lit(config.bloc_error_sd).alias("bloc_sd"),
        F.lit(config.party_error_sd).alias("party_sd"), time_multiplier(days, config.time_inflation_per_30_days).alias("scale"), F.lit(config.threshold).alias("threshold"),
    )
    return draw_runs(one, ["run"], simulations, blocs, turnout_bloc, config, agreements).drop("run")


def draw_runs(shares: DataFrame, by: list[str], simulations: int, blocs: list[str], turnout_bloc: str, config: ModelConfig = DEFAULT, agreements: bool = True) -> DataFrame:
    """(``by``, sim, party_id, bloc, ord, share, qualifies, seats): the draws of all runs (configurations, days) in one plan.

    ``shares``: ``by``, party_id, share, bloc, ord, partner, and for each run the same values of seed, other (the share
    of no list), bloc_sd, party_sd, scale (the time multiplier) and threshold. Each draw shocks blocs, one bloc's
    turnout and parties, and allocates the house. Normals of a draw are, in order: one for each bloc, the turnout,
    one for each party with a share by ``ord``; so the index of every normal is known, draws are independent rows, and
    runs with the same seed and parties see the same normals (common random numbers). A draw is one row until its
    seats are known, for its lists are few: nothing but the normals is shuffled.
    """
    live = shares.where("share > 0").withColumn("bloc_share", F.sum("share").over(W.partitionBy(*by, "bloc")))
    live = live.withColumn("place", (F.array_position(F.array(*[F.lit(b) for b in blocs]), F.col("bloc")) - 1).cast("int"))
    settings = ["seed", "other", "bloc_sd", "party_sd", "scale", "threshold"]
    listed = F.array_sort(F.collect_list(F.struct("ord", "party_id", "bloc", "partner", "share", "bloc_share", "place")))
    at = lambda l, key: F.array_position(F.transform(l, lambda x: x["party_id"]), key).cast("int") - 1
    mate = lambda l, p, i: let(at(l, p["partner"]), lambda j: F.when((j >= 0) & (j != i) & (F.get(l, j)["partner"] == p["party_id"]), j))
    lists = let(listed, lambda l: F.transform(l, lambda p, i: F.struct(*[p[c].alias(c) for c in ("ord", "party_id", "bloc", "share", "bloc_share", "place")], mate(l, p, i).alias("mate"))))
    runs = live.groupBy(*by).agg(*[F.first(c).alias(c) for c in settings], lists.alias("lists")).withColumn("width", F.size("lists") + len(blocs) + 1).checkpoint()  # a row a run
    most = runs.agg(F.max("width")).first()[0]
    if most is None:
        most = 0
    z = normals_of(runs.select("seed").distinct(), simulations * most).join(F.broadcast(runs.select("seed", "width").distinct()), "seed")  # a row a run at most
    z = z.select("seed", "width", F.floor(F.col("n") / F.col("width")).alias("sim"), (F.col("n") % F.col("width")).alias("k"), "z").where(F.col("sim") < simulations)
    per = z.groupBy("seed", "width", "sim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda x: x["z"]).alias("z"))
    # A draw is few bytes and much work: tasks are dealt by the number of draws, not by bytes.
    tasks = max(shares.sparkSession.sparkContext.defaultParallelism, simulations * runs.count() // DRAWS_A_TASK)
    rows = per.repartition(tasks).join(F.broadcast(runs), ["seed", "width"])  # a row a run

    def votes(p: Column, i: Column) -> Column:
        shock = F.get("z", p["place"]) * F.col("bloc_sd") * F.col("scale") * F.sqrt(F.greatest(F.lit(0.02), p["bloc_share"]) / 0.45)
        shock = shock + F.when(p["bloc"] == turnout_bloc, F.get("z", F.lit(len(blocs))) * config.national_error_sd * 2.5).otherwise(0.0)
        size = F.greatest(F.lit(0.35), F.least(F.lit(1.8), F.sqrt(p["share"] / 0.1)))
        own = F.get("z", i + len(blocs) + 1) * F.col("party_sd") * size * F.col("scale")
        return F.greatest(F.lit(0.0002), p["share"] + shock * p["share"] / p["bloc_share"] + own)

    # What is in no list is a list of its own, the last one, so that it counts towards the threshold's denominator.
    rest = F.greatest(F.lit(0.004), F.col("other"))
    drawn = rows.select(*by, "sim", "lists", "threshold", F.explode(F.array(F.concat(F.transform("lists", votes), F.array(rest)))).alias("_votes"))
    share = let(F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x), lambda total: F.transform("_votes", lambda v: v / total))
    drawn = drawn.select(*by, "sim", "lists", "threshold", F.explode(F.array(share)).alias("_share"))
    passed = F.transform("_share", lambda v: F.when((v >= F.col("threshold")) & (v > 0), v).otherwise(F.lit(0.0)))
    drawn = drawn.select("*", F.explode(F.array(passed)).alias("_passed"))
    if agreements:
        # An agreement needs both lists to name each other and to pass.
        standing = lambda i, j: F.when((F.get("_passed", i) > 0) & (F.get("_passed", j) > 0), j)
        drawn = drawn.select("*", F.explode(F.array(F.transform("lists", lambda p, i: standing(i, p["mate"])))).alias("_mates"))
        seats = pooled_averages(F.col("_passed"), F.col("_mates"), config.total_seats)
    else:
        seats = averages_of(F.col("_passed"), config.total_seats)
    drawn = drawn.select(*by, "sim", "lists", "_share", "_passed", F.explode(F.array(seats)).alias("_seats"))
    each = F.transform("lists", lambda p, i: F.struct(p["party_id"].alias("party_id"), p["bloc"].alias("bloc"), p["ord"].alias("ord"), F.get("_share", i).alias("share"), (F.get("_passed", i) > 0).alias("qualifies"), F.get("_seats", i).alias("seats")))
    return drawn.select(*by, "sim", F.inline(each))


def retained(rows: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` draws of every run, kept for charts; summaries are over all draws."""
    return rows.where(F.col("sim") < most)


def seat_counts(rows: DataFrame, key: str = "party_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``key``, seats, n, largest: how many draws give each number of seats, and in how many of them the party
    is the largest (ties: smaller ord). Counts of chunks of draws add up, so draws can be made and summed in pieces."""
    best = rows.groupBy(*by, "sim").agg(F.max_by(key, F.struct("seats", -F.col("ord"))).alias("best"))
    joined = rows.join(best, [*by, "sim"])
    return joined.groupBy(*by, key, "seats").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") == F.col(key)).alias("largest"))


def summary_of_counts(counts: DataFrame, key: str = "party_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``summary`` from (a union of) ``seat_counts``; the quantiles are exact, for each seat number has its count."""
    q = lambda p: F.percentile("seats", F.lit(p), F.col("n"))
    n, total = F.col("n"), F.sum("n")
    return counts.groupBy(*by, key).agg(
        (F.sum(F.col("seats") * n) / total).alias("mean"), q(0.5).alias("median"), q(0.1).alias("low"), q(0.9).alias("high"),
        (F.sum(F.when(F.col("seats") > 0, n).otherwise(0)) / total).alias("p_seats"), (F.sum("largest") / total).alias("p_largest"),
    )


def summary(rows: DataFrame, key: str = "party_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``key``, mean, median, low and high (exact 10 % and 90 %), p_seats and p_largest (ties: smaller ord)."""
    best = rows.groupBy(*by, "sim").agg(F.max_by(key, F.struct("seats", -F.col("ord"))).alias("best"))
    joined = rows.join(best, [*by, "sim"])
    q = lambda p: F.percentile("seats", F.lit(p))
    return joined.groupBy(*by, key).agg(
        F.avg("seats").alias("mean"), q(0.5).alias("median"), q(0.1).alias("low"), q(0.9).alias("high"),
        F.avg((F.col("seats") > 0).cast("double")).alias("p_seats"), F.avg((F.col("best") == F.col(key)).cast("double")).alias("p_largest"),
    )


def bloc_summary(rows: DataFrame, majority: int = DEFAULT.majority, by: tuple[str, ...] = ()) -> DataFrame:
    """bloc, mean and p_majority over the draws."""
    per = rows.groupBy(*by, "sim", "bloc").agg(F.sum("seats").alias("seats"))
    return per.groupBy(*by, "bloc").agg(F.avg("seats").alias("mean"), F.avg((F.col("seats") >= majority).cast("double")).alias("p_majority"))


def scenarios(rows: DataFrame, members: DataFrame, majority: int = DEFAULT.majority, by: tuple[str, ...] = ()) -> DataFrame:
    """(scenario, plausibility, probability, mean): all scenarios in one pass over the draws.

    ``members``: scenario, plausibility, party_id - one row for each member. A scenario without members in a draw
    has no seats there.
    """
    per = rows.join(members, "party_id").groupBy(*by, "scenario", "plausibility", "sim").agg(F.sum("seats").alias("seats"))
    return per.groupBy(*by, "scenario", "plausibility").agg(F.avg((F.col("seats") >= majority).cast("double")).alias("probability"), F.avg("seats").alias("mean"))


def outlook(rows: DataFrame, first: str, leader, second: str, support: str, credit: float = 0.45, majority: int = DEFAULT.majority, by: tuple[str, ...] = ()) -> DataFrame:
    """(winner, probability): who forms a government, the rest as ``deadlock``.

    In a draw: ``first`` with a majority gives ``leader``; else ``second`` with one gives its largest party; else
    ``second`` with ``support`` gives it ``credit``, the rest to deadlock; else deadlock.
    """
    has = lambda b: F.coalesce(F.sum(F.when(F.col("bloc") == b, F.col("seats"))), F.lit(0))
    best = F.max_by(F.when(F.col("bloc") == second, F.col("party_id")), F.when(F.col("bloc") == second, F.struct("seats", -F.col("ord"))))
    per = rows.groupBy(*by, "sim").agg(has(first).alias("a"), has(second).alias("b"), has(support).alias("c"), best.alias("best"))
    lead = F.lit(leader).cast("string")
    top = F.col("best").cast("string")
    entry = lambda w, p: F.struct(w.alias("winner"), F.lit(float(p)).alias("credit"))
    none = F.lit("deadlock")
    outcome = (
        F.when(F.col("a") >= majority, F.array(entry(lead, 1)))
        .when(F.col("b") >= majority, F.array(entry(top, 1)))
        .when(F.col("b") + F.col("c") >= majority, F.array(entry(top, credit), entry(none, 1 - credit)))
        .otherwise(F.array(entry(none, 1)))
    )
    # The credits of a draw sum to 1, so their sum counts the draws.
    credits_ = per.select(*by, F.inline(outcome)).groupBy(*by, "winner").agg(F.sum("credit").alias("c"))
    return credits_.select(*by, "winner", (F.col("c") / F.sum("c").over(W.partitionBy(*by))).alias("probability"))
