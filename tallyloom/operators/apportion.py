"""Seats from votes: threshold, agreements, largest averages; and votes back from seats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.scalars import let


def qualified(votes: DataFrame, by: list[str], threshold: float | Column, value: str = "votes") -> DataFrame:
    """``share`` of all votes of the group (failing lists included) and ``qualifies``."""
    total = F.sum(value).over(W.partitionBy(*by))
    return votes.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0))).withColumn(
        "qualifies", (F.col("share") >= threshold) & (F.col(value) > 0)
    )


def largest_averages(votes: DataFrame, by: list[str], seats: int | Column, key: str, value: str = "votes", order: str = "ord") -> DataFrame:
    """D'Hondt: ``by``, ``key``, seats, one row for each row of ``votes``.

    Quotients value/k are ranked (ties: larger value, then smaller ``order``) and the first ``seats`` win. With
    V votes, S seats and G lists every winning quotient is at least V / (S + G), so only the first
    ``value * (S + G) / V`` quotients of a list are made: about S + 2G rows in a group instead of S * G.
    """
    group = W.partitionBy(*by)
    house = F.lit(seats) if isinstance(seats, int) else seats
    rows = votes.select(*by, key, value, order, house.alias("_house"))
    rows = rows.withColumn("_all", F.sum(value).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    most = F.least(F.col("_house"), (F.floor(F.col(value) * (F.col("_house") + F.col("_n")) / F.nullif("_all", F.lit(0.0))) + 1).cast("int"))
    tries = rows.where((F.col(value) > 0) & (F.col("_house") > 0)).select(*by, key, value, order, "_house", F.explode(F.sequence(F.lit(1), most)).alias("k"))
    ranked = tries.withColumn("_rank", F.row_number().over(group.orderBy((F.col(value) / F.col("k")).desc(), F.col(value).desc(), F.col(order))))
    won = ranked.where(F.col("_rank") <= F.col("_house")).groupBy(*by, key).agg(F.count(F.lit(1)).cast("int").alias("seats"))
    return votes.select(*by, key).join(won, [*by, key], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))


def allocate(votes: DataFrame, by: list[str], seats: int, threshold: float | Column, key: str = "party_id", value: str = "votes", order: str = "ord", partner: str | None = "partner") -> DataFrame:
    """Threshold, mutual agreements pooled, D'Hondt over pools and then inside them.

    An agreement counts only if both name each other and both qualify. Returns ``by``, ``key``, share,
    qualifies, seats. Batched over any grouping key: a draw, a poll, a day, a scenario.
    """
    base = qualified(votes, by, threshold, value)
    passed = base.where("qualifies")
    if partner is None:
        won = largest_averages(passed, by, seats, key, value, order)
        return base.select(*by, key, "share", "qualifies").join(won, [*by, key], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))
    other = passed.select(*by, F.col(key).alias("_partner"), F.col(partner).alias("_back"))
    named = passed.withColumn("_partner", F.col(partner)).join(other, [*by, "_partner"], "left")
    mutual = (F.col("_back") == F.col(key)) & (F.col("_partner") != F.col(key))
    own, theirs = F.col(key).cast("string"), F.col("_partner").cast("string")
    pooled = named.withColumn("pool", F.when(mutual, F.concat_ws("+", F.least(own, theirs), F.greatest(own, theirs))).otherwise(own))
    pools = pooled.groupBy(*by, "pool").agg(F.sum(value).alias(value), F.min(order).alias(order))
    pool_seats = largest_averages(pools, by, seats, "pool", value, order).withColumnRenamed("seats", "pool_seats")
    inside = pooled.select(*by, "pool", key, value, order).join(pool_seats, [*by, "pool"])
    won = largest_averages(inside, [*by, "pool"], F.col("pool_seats").cast("int"), key, value, order)
    return base.select(*by, key, "share", "qualifies").join(won.drop("pool"), [*by, key], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))


def _averages(x: np.ndarray, seats: int) -> np.ndarray:
    """D'Hondt of one small vector, in order of its rows."""
    q = x[:, None] / np.arange(1, seats + 1)
    order = np.lexsort((np.repeat(np.arange(len(x)), seats), -np.repeat(x, seats), -q.reshape(-1)))[:seats]
    return np.bincount(order // seats, minlength=len(x))


def invert(target: np.ndarray, total: int, rounds: int = 60) -> np.ndarray:
    """A vote vector whose D'Hondt seats are ``target``, for one poll on the driver: scaled by (target + .5) / (got + .5)
    until they match. ``invert_seats`` does all polls of a table."""
    x = target / total
    for i in range(1, rounds + 1):
        live = x > 0
        got = np.zeros(len(x))
        got[live] = _averages(x[live], total)
        if (got == target).all() and i > 3:
            break
        x = x * (target + 0.5) / (got + 0.5)
    return x / x.sum()


def averages_of(votes: Column, seats: int | Column) -> Column:
    """D'Hondt inside a row: the seats of each entry of an array of votes (ties: more votes, then the earlier entry).

    Every entry has at least its quota, rounded down; only the quotients that can win one of the seats that are left
    are ranked, about three an entry. For arrays of a bounded size, such as a poll or a draw.
    """
    house = F.lit(seats) if isinstance(seats, int) else seats

    def won(v: Column, all_: Column) -> Column:
        # A hair is taken off, so that a rounding error of the quota never gives a seat too many.
        sure = F.transform(v, lambda x: F.greatest(F.lit(0), F.floor(x * house / all_ - 1e-9).cast("int")))

        def more(base: Column) -> Column:
            least = lambda x: F.least(house, (F.floor(x * (house + F.size(v)) / all_) + 1).cast("int"))
            one = lambda x, i, k: F.struct((-x / k).alias("q"), (-x).alias("v"), i.alias("i"))
            tries = lambda x, i: F.when((x > 0) & (least(x) > F.get(base, i)), F.transform(F.sequence(F.get(base, i) + 1, least(x)), lambda k: one(x, i, k))).otherwise(F.array().cast("array<struct<q: double, v: double, i: int>>"))
            left = house - F.aggregate(base, F.lit(0), lambda a, x: a + x)
            first = F.transform(F.slice(F.array_sort(F.flatten(F.transform(v, tries))), F.lit(1), left), lambda e: e["i"])
            return let(first, lambda w: F.transform(base, lambda x, i: x + F.size(F.filter(w, lambda e: e == i))))

        return let(sure, more)

    def shared(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.when((t > 0) & (house > 0), won(v, t)).otherwise(F.transform(v, lambda _: F.lit(0))))

    return let(votes, shared)


def first_of_two(a: Column, b: Column, seats: Column) -> Column:
    """The seats of the first of two lists by D'Hondt: it has k or more if its k-th quotient comes before the other's
    that would then be too many (ties: more votes, then the first)."""
    ahead = lambda x, y: (x > y) | ((x == y) & (a >= b))
    ranks = F.when(seats > 0, F.sequence(F.lit(1), seats)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(ranks, lambda k: ahead(a / k, b / (seats - k + 1))))


def pooled_averages(votes: Column, partner: Column, seats: int) -> Column:
    """Seats of each entry where entry i and ``partner[i]`` (its place; null without an agreement) stand as one list:
    D'Hondt over pools, at their first member's place, then inside each pool."""
    second = lambda i: F.coalesce(F.get(partner, i) < i, F.lit(False))
    pools = lambda x: F.transform(x, lambda v, i: F.when(second(i), F.lit(0.0)).otherwise(v + F.coalesce(F.get(x, F.get(partner, i)), F.lit(0.0))))

    def split(x: Column) -> Column:
        def inside(won: Column) -> Column:
            mine = lambda v, i: F.when(F.get(partner, i).isNull(), F.get(won, i)).when(second(i), 0).otherwise(first_of_two(v, F.get(x, F.get(partner, i)), F.get(won, i)))
            return let(F.transform(x, mine), lambda m: F.transform(m, lambda n, i: F.when(second(i), F.get(won, F.get(partner, i)) - F.get(m, F.get(partner, i))).otherwise(n)))

        return let(averages_of(pools(x), seats), inside)

    return let(votes, split)


def invert_seats(readings: DataFrame, total: int, by: str = "poll_id", key: str = "party_id", value: str = "seats", order: str = "ord", partner: str | None = None, rounds: int = 60) -> DataFrame:
    """(``by``, ``key``, ``value``, votes): vote shares whose allocation gives each complete poll's seats (those that
    sum to ``total``), agreements of ``partner`` included where both lists name each other.

    A poll is one row with its lists as arrays; in a round every list is scaled by (target + .5) / (got + .5), and a
    poll that matches stays as it is. The rounds are a fold inside the row, so all polls are fitted at once and
    nothing but the readings is shuffled. Lists with 0 seats keep 0 votes.
    """
    back = F.lit(None).cast(dict(readings.dtypes)[key]) if partner is None else F.col(partner)
    listed = readings.where(F.col(by).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(value).cast("double").alias("s"), back.alias("p")))).alias("_l"), F.sum(value).alias("_sum"))
    listed = listed.where(F.col("_sum") == total)
    place = lambda l, i: F.array_position(F.transform(l, lambda x: x["k"]), i).cast("int") - 1
    mutual = lambda l, x, i: let(place(l, x["p"]), lambda j: F.when((j >= 0) & (j != i) & (F.get(l, j)["p"] == x["k"]) & (x["s"] > 0) & (F.get(l, j)["s"] > 0), j))
    rows = listed.select(by, "_l", F.explode(F.array(F.transform("_l", lambda x, i: mutual(F.col("_l"), x, i)))).alias("_p"))
    target = F.transform("_l", lambda x: x["s"])
    start = F.struct(F.transform(target, lambda x: x / total).alias("x"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        scaled = lambda got: F.struct(F.zip_with(F.zip_with(state["x"], target, lambda x, t: x * (t + 0.5)), got, lambda x, g: x / (g + 0.5)).alias("x"), F.forall(F.zip_with(got, target, lambda g, t: g == t), lambda e: e).alias("done"))
        return F.when(state["done"], state).otherwise(let(pooled_averages(state["x"], F.col("_p"), total), scaled))

    fitted = rows.select(by, "_l", F.explode(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["x"])).alias("_x"))
    every = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x)
    fitted = fitted.select(by, F.inline(F.zip_with("_l", "_x", lambda l, x: F.struct(l["k"].alias(key), l["s"].alias(value), x.alias("_votes")))), every.alias("_all"))
    types = dict(readings.dtypes)
    return fitted.select(by, key, F.col(value).cast(types[value]).alias(value), (F.col("_votes") / F.col("_all")).alias("votes"))


def with_rest(shares: DataFrame, by: list[str], key: str = "party_id", value: str = "votes", order: str = "ord", partner: str = "partner", rest: object = -1) -> DataFrame:
    """Shares and a row ``rest`` for what no list has of 1, which counts towards the threshold's denominator."""
    types = dict(shares.dtypes)
    left = shares.groupBy(*by).agg(F.greatest(F.lit(0.0), 1 - F.sum(value)).alias(value)).where(F.col(value) > 0)
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    rows = left.select(*by, F.lit(rest).cast(types[key]).alias(key), value, F.lit(1 << 30).cast(types[order]).alias(order), null(partner))
    return shares.select(*by, key, value, order, partner).unionByName(rows)


def chamber(seats: DataFrame, key: str, seats_column: str, bloc: str, arcs: int = 5, first_radius: float = 74.0, step: float = 26.0) -> DataFrame:
    """Places of a half-round chamber: arcs hold seats in proportion to their radius (at least one; what rounding is off
    goes by one seat an arc from the outer one inwards), places are ordered by angle and radius, and each party fills a
    contiguous run of them.

    Returns place, arc, angle, ``key``. One small table: a chamber has as many rows as seats.
    """
    every = W.partitionBy()
    runs = seats.where(F.col(seats_column) > 0).withColumn("_end", F.sum(seats_column).over(W.orderBy(bloc, F.col(seats_column).desc(), key).rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("_start", F.col("_end") - F.col(seats_column))
    total = seats.agg(F.sum(seats_column).cast("int").alias("_total"))
    rows = total.select("_total", F.explode(F.sequence(F.lit(0), F.lit(arcs - 1))).alias("arc")).withColumn("_r", F.lit(first_radius) + F.lit(step) * F.col("arc"))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.floor(F.col("_total") * F.col("_r") / F.sum("_r").over(every) + 0.5).cast("int")))
    drift = F.col("_total") - F.sum("_n").over(every)
    rows = rows.withColumn("_n", F.col("_n") + F.when(F.lit(arcs - 1) - F.col("arc") < F.abs(drift), F.signum(drift.cast("double")).cast("int")).otherwise(0))
    spots = rows.where("_n > 0").select("arc", "_r", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    spots = spots.withColumn("angle", F.when(F.col("_n") > 1, F.lit(180.0) * F.col("i") / (F.col("_n") - 1)).otherwise(90.0))
    spots = spots.withColumn("place", F.row_number().over(W.orderBy("angle", "_r")) - 1)
    return spots.join(F.broadcast(runs), (F.col("place") >= F.col("_start")) & (F.col("place") < F.col("_end"))).select("place", "arc", F.round("angle", 6).alias("angle"), key)
