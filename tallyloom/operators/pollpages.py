"""Polls out of pages: tables of polls, and articles that tell one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.scalars import base36, seed_of
from tallyloom.operators import quality, textops
from tallyloom.operators.mentions import mentions, read_polls

#: Words that a poll article has.
POLL_WORDS = "סקר|מנדטים|מנדט"
POLL_TABLE = r"""(?is)(<table[^>]*class="[^"]*wikitable[^"]*".*?</table>)"""


def map_header_cells(headers: DataFrame, needles: DataFrame, aliases: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(``text``, party_id) of each distinct header: the first needle (by ord) that its Latin letters contain, if
    these are three at least; else the one party that it names. Two parties in one header give null."""
    rows = headers.select(text).distinct().withColumn("_k", F.regexp_replace(F.lower(text), "[^a-z]", ""))
    hit = rows.where(F.char_length("_k") >= 3).join(F.broadcast(needles), F.contains(F.col("_k"), F.col("needle"))).groupBy(text).agg(F.min_by("party_id", "ord").alias("_n"))  # a table of constants
    named = mentions(rows, text, aliases).withColumn("_p", F.array_distinct(F.transform("mentions", lambda m: m["party_id"])))
    return named.join(hit, text, "left").select(text, F.coalesce("_n", F.when(F.size("_p") == 1, F.get("_p", 0))).alias("party_id"))


def table_polls(
    pages: DataFrame, needles: DataFrame, aliases: list[tuple[str, str]], pollsters: list[tuple[str, str]], outlets: list[tuple[str, str]],
    prefix: str = "table", id_: str = "url", html: str = "html", least: int = 5, house: int = 120, unknown: str = "unknown", outlet: str = "",
) -> DataFrame:
    """(id, date, pollster, outlet, sample_size, seats, total, partial, source, table, row): the polls in the poll
    tables of ``pages``.

    Of a table's first four header rows (three header cells at least, no data cell) the one that maps the most columns
    counts, the first of equals; under ``least`` columns the table is none. A row (not the first) that is at most two
    cells short gives 4 to 120 seats for each mapped column, the last column of a party; it is a poll if at least
    ``least`` parties sum to no more than the house and its first four cells hold a date. Its pollster and outlet are
    the labels of the first known (lower-case) names in these cells.
    """
    found = textops.cells(pages, id_, html, table=POLL_TABLE).checkpoint()
    at = [id_, "table"]
    heads = textops.header_rows(found, id_).join(found, [*at, "row"]).withColumn("_head", F.concat_ws(" ", "text", "attributes"))
    mapped = heads.join(map_header_cells(heads, needles, aliases, "_head"), "_head", "left").select(*at, "row", "col", "party_id")
    counted = mapped.groupBy(*at, "row").agg(F.count("party_id").alias("_c"), F.max("col").alias("_last"))
    best = counted.groupBy(*at).agg(F.max_by(F.struct("row", "_c", "_last"), F.struct("_c", -F.col("row"))).alias("b")).where(F.col("b._c") >= least)
    best = best.select(*at, F.col("b.row").alias("row"), (F.col("b._last") - 1).alias("_need"))
    columns = mapped.join(best, [*at, "row"]).where("party_id is not null").select(*at, "col", "party_id")
    n = F.regexp_replace("text", "[^0-9.]", "").try_cast("double")
    seat = F.when(F.col("party_id").isNotNull() & n.between(4, 120), F.struct("col", "party_id", F.floor(n + 0.5).cast("int").alias("n")))
    rows = found.where("row > 0").join(columns, [*at, "col"], "left").groupBy(*at, "row").agg(
        F.array_sort(F.collect_list(seat)).alias("_seats"), F.array_sort(F.collect_list(F.when(F.col("col") < 4, F.struct("col", "text")))).alias("_lead"), F.max("col").alias("_max")
    )
    rows = rows.join(best.drop("row"), at).where(F.col("_max") + 1 >= F.col("_need")).withColumn("_cells", F.col("_lead.text"))
    last = F.filter("_seats", lambda x, i: ~F.exists(F.slice("_seats", i + 2, F.size("_seats")), lambda y: y["party_id"] == x["party_id"]))
    rows = rows.withColumn("seats", F.map_from_entries(F.transform(last, lambda x: F.struct(x["party_id"], x["n"])))).withColumn("lead", F.array_join("_cells", " | "))
    total = F.aggregate(F.map_values("seats"), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("total", total).withColumn("date", textops.iso_date(F.col("lead")))
    rows = rows.where((F.size("seats") >= least) & (F.col("total") <= house) & F.col("date").isNotNull())
    first = lambda names, other: F.coalesce(_first_named("_cells", names), F.lit(other))
    rows = rows.withColumn("pollster", first(pollsters, unknown)).withColumn("outlet", first(outlets, outlet))
    return rows.select(
        F.concat_ws("-", F.lit(prefix), F.col("date").cast("string"), textops.slug(F.col("pollster"))).alias("id"), "date", "pollster", "outlet",
        textops.sample_size(F.col("lead")).alias("sample_size"), "seats", "total", (F.col("total") != house).alias("partial"), F.col(id_).alias("source"), "table", "row",
    )


def _first_named(cells: str, names: list[tuple[str, str]]) -> Column:
    """The label of the first name found in the first cell that has one."""
    label = lambda c: F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(F.lower(c), F.lit(n.lower())), F.lit(v)) for n, v in names])
    return F.get(F.filter(F.transform(cells, label), lambda x: x.isNotNull()), 0)


def article_polls(
    pages: DataFrame, aliases: list[tuple[str, str]], rules: list[tuple[str, Column]], today: Column, url: str = "url", html: str = "html", least: int = 6, house: int = 120,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, date, seats, sample_size, source, ``keep``): one poll for each article that tells one: it has a poll word,
    at least ``least`` parties with no more than the house, and breaks no rule."""
    rows = pages.select(url, *keep, textops.strip_html(F.col(html)).alias("_text")).where(F.rlike("_text", F.lit(POLL_WORDS)))
    read = read_polls(mentions(rows, "_text", aliases), [url], least, house).select(url, "seats")
    polls = rows.join(read, url).select(
        F.concat_ws("-", *keep, textops.hebrew_date(F.col("_text"), today).cast("string"), base36(seed_of(F.col(url)))).alias("id"), textops.hebrew_date(F.col("_text"), today).alias("date"), "seats",
        textops.respondents(F.col("_text")).alias("sample_size"), F.col(url).alias("source"), *keep,
    )
    return quality.split_valid(quality.reasons(polls, rules))[0].drop("reasons")


def news_polls(
    sections: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots: DataFrame, aliases: list[tuple[str, str]], rules: list[tuple[str, Column]], today: Column,
    pattern: str = r"^https://", most: int = 12, least: int = 6, source: str = "outlet",
) -> DataFrame:
    """The polls of the articles that section pages link to. ``sections``: ``source``, url, html, place. Links whose
    address fits and whose text, if any, has a poll word are candidates, each once, in order; the first ``most`` of a
    source that robots.txt allows are fetched (``fetch``: (source, url) -> with html) and read."""
    found = textops.links(sections, keep=(source, F.col("place").alias("_page")))
    fits = F.rlike("href", F.lit(pattern)) & ((F.col("text") == "") | F.rlike("text", F.lit(POLL_WORDS)))
    listed = found.where(fits).groupBy(source, "href").agg(F.min(F.struct("_page", "place")).alias("_at"))
    first = F.row_number().over(W.partitionBy(source).orderBy("_at", "href"))
    chosen = listed.withColumn("_rank", first).where(F.col("_rank") <= most).select(source, F.col("href").alias("url"))
    chosen = textops.allowed(chosen, robots)
    return article_polls(fetch(chosen).where("html is not null"), aliases, rules, today, least=least, keep=(source,))
