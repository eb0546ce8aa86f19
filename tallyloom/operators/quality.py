"""Validation with reasons, fingerprints, keyed dedup, merge and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reasons(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """``rows`` with the array of the names of all rules whose condition holds (null counts as not)."""
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(condition, F.lit(label)) for label, condition in rules])))


def poll_rules(today: Column, seats: str = "seats", house: int = 120) -> list[tuple[str, Column]]:
    """The rules for a poll with its seats as a map of party to seats."""
    total = F.aggregate(F.map_values(seats), F.lit(0.0), lambda a, x: a + x.cast("double"))
    any_of = lambda test: F.exists(F.map_values(seats), test)
    source = F.lower(F.coalesce("source", F.lit("")))
    return [
        ("missing id", F.coalesce("id", F.lit("")) == ""),
        ("bad date", F.col("date").isNull()),
        ("future date", F.datediff("date", today) > 1),
        (f"seats sum above {house}", total > house),
        ("no seats", total <= 0),
        ("negative seats", any_of(lambda x: x < 0)),
        ("impossible seats 1-3", any_of(lambda x: (x >= 1) & (x <= 3))),
        ("implausible seats above 45", any_of(lambda x: x > 45)),
        ("tiny sample", F.col("sample_size") < 100),
        ("missing source", source == ""),
        ("aggregate page", F.rlike(source, F.lit(r"average|aggregat|poll-of-polls"))),
        ("calculator page", F.rlike(source, F.lit(r"calculator|simulator|swing"))),
    ]


def split_valid(rows: DataFrame, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether ``reasons`` is empty."""
    return rows.where(F.size(name) == 0), rows.where(F.size(name) > 0)


def fingerprint(*parts: Column, entries: Column) -> Column:
    """Parts and the sorted ``key:value`` strings of ``entries``: equal for equal content in any order."""
    return F.concat_ws("|", *parts, F.array_join(F.array_sort(entries), ","))


def completeness(entries: Column, provenance_rank: Column, sample: Column) -> Column:
    """10 points an entry, the rank of the provenance, 1 for a sample size."""
    return 10 * entries + provenance_rank + F.when(F.coalesce(sample, F.lit(0)) > 0, 1).otherwise(0)


def best_per_key(rows: DataFrame, keys: list[str], score: str, order: str = "ord") -> DataFrame:
    """The row with the largest ``score`` of each key (ties: smaller ``order``), null keys together.

    An aggregate with map-side combination, not a window: a key with many rows is never sorted in one task.
    """
    packed = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(packed, F.struct(F.col(score), -F.col(order))).alias("_r")).select("_r.*")


def earliest_per_key(rows: DataFrame, keys: list[str], date: str = "date", order: str = "ord") -> DataFrame:
    """The first sighting of each key; its place is the smallest ``order`` among its rows."""
    packed = F.struct(*rows.columns)
    out = rows.groupBy(*keys).agg(F.min_by(packed, F.struct(F.col(date), F.col(order))).alias("_r"), F.min(order).alias("_first"))
    return out.select("_r.*", "_first").withColumn(order, F.col("_first")).drop("_first")


def dedupe(rows: DataFrame, attributed: Column, article: list[str] = ["source", "print"], score: str = "score", order: str = "ord") -> DataFrame:  # noqa: B006
    """Earliest sighting of an article with the same content; then the best attributed reading by (pollster,
    date); then, for dates without one, the best unattributed reading by (outlet, date). ``newest_first`` gives the stored order."""
    seen = earliest_per_key(rows, article, order=order).withColumn("_a", attributed)
    named = best_per_key(seen.where("_a"), ["pollster", "date"], score, order)
    spare = seen.where(~F.coalesce("_a", F.lit(False))).join(named.select("date").distinct(), "date", "left_anti").select(*seen.columns)
    spare = best_per_key(spare, ["outlet", "date"], score, order)
    return named.unionByName(spare).drop("_a")


def shadow(stored: DataFrame, curated: DataFrame, keys: list[str] = ["pollster", "date"]) -> DataFrame:  # noqa: B006
    """Stored rows whose key no curated row has."""
    return stored.join(curated.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The union by ``key``; new rows win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    packed = F.struct(*old.columns)
    return both.groupBy(key).agg(F.max_by(packed, "_new").alias("_r")).select("_r.*")


def quarantine(log: DataFrame, fresh: DataFrame, key: str, seen: str, most: int = 200) -> DataFrame:
    """The bounded log: fresh rejects replace old entries of the same key; the newest ``most`` stay."""
    old = log.join(fresh.select(key), key, "left_anti").select(*log.columns)
    return fresh.select(*log.columns).unionByName(old).orderBy(F.col(seen).desc(), key).limit(most)


def merge_new(store: DataFrame, incoming: DataFrame, within: str | None = None, id_: str = "id", print_: str = "print", order: str = "ord") -> DataFrame:
    """Incoming rows that are new by id and by fingerprint, in ``order``: a row is taken if no row before it was taken
    with its id or its print, so a row blocked by its print does not claim its id.

    Rows known to the store go by anti-joins. The rest is decided in rounds over all rows at once: a row that is the
    first open one of both its id and its print is taken, and the open rows that share either go; until none is
    open. That gives what the loop in order gives, for no earlier row can still block such a row. Rounds are as many as
    the longest chain of rows that wait for each other. A null id or print equals no other; rows with the same order, id and print are one.
    Ids and prints count for all rows, or, with the column ``within``, among the incoming rows that are equal in it.
    """
    part = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.concat(part, F.lit("="), F.col(c).cast("string")), F.concat(part, F.lit("#"), F.col(order).cast("string")))
    keyed = incoming.withColumns({"_i": name(id_), "_p": name(print_)})
    known = keyed.join(store.select(id_).distinct(), id_, "left_anti").join(store.select(print_).distinct(), print_, "left_anti")
    known = known.dropDuplicates([order, "_i", "_p"]).select(*incoming.columns, "_i", "_p").checkpoint()
    me = F.struct(order, "_i", "_p")
    open_, taken = known.select(F.col(order), "_i", "_p"), None
    while not open_.isEmpty():
        first = [open_.groupBy(k).agg(F.min(me).alias(f"_first{k}")) for k in ("_i", "_p")]
        now = open_.join(first[0], "_i").join(first[1], "_p").where((me == F.col("_first_i")) & (me == F.col("_first_p"))).select(order, "_i", "_p").checkpoint()
        taken = now if taken is None else taken.unionByName(now)
        open_ = open_.join(now.select("_i"), "_i", "left_anti").join(now.select("_p"), "_p", "left_anti").select(order, "_i", "_p").checkpoint()
    if taken is None:
        return known.select(*incoming.columns)
    return known.join(taken, [order, "_i", "_p"], "left_semi").select(*incoming.columns)


def newest_first(rows: DataFrame, date: str = "date", id_: str = "id") -> DataFrame:
    """The stored order: newest date first, then by id."""
    return rows.orderBy(F.col(date).desc(), id_)


def merge_report(store: DataFrame, curated: DataFrame, incoming: DataFrame, rules, attributed: Column, id_: str = "id", print_: str = "print", order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows for the store, rejects with reasons, one row of counts: added, duplicates, shadowed, quarantined, total).

    Valid rows whose (pollster, date) an attributed curated row has are shadowed; of the rest those that ``merge_new``
    leaves out are duplicates. ``total`` is the size of the merged store.
    """
    good, bad = split_valid(reasons(incoming, rules))
    good = good.drop("reasons")
    fresh = shadow(good, curated.where(attributed)).select(*good.columns)
    both = store.select(id_, print_).unionByName(curated.select(id_, print_))
    new = merge_new(both, fresh, None, id_, print_, order).checkpoint()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(good, "_good")
    for df, name in ((fresh, "_fresh"), (new, "added"), (bad, "quarantined"), (store, "_store")):
        counts = counts.crossJoin(count(df, name))  # one row each
    counts = counts.select("added", (F.col("_fresh") - F.col("added")).alias("duplicates"), (F.col("_good") - F.col("_fresh")).alias("shadowed"), "quarantined", (F.col("_store") + F.col("added")).alias("total"))
    return new, bad, counts
