"""Queries over records and text: quality, keyed dedup, merging, snapshots, HTML and text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import mentions as named
from tallyloom.operators import montecarlo, pollpages, quality, report, textops
from tallyloom.plans import queries_model as model
from tallyloom.plans import views
from tallyloom.plans.queries_model import query
from tallyloom.plans.views import PRELUDE
from tallyloom.session import shared_folder, table
from tallyloom.sources import readers, sinks

DAILY = """dl AS (SELECT ts::DATE AS day, event_type AS k, round(sum(value), 2) AS v FROM events GROUP BY ALL)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("k")).agg(F.round(F.sum("value"), 2).alias("v"))


@query("movement", f"""WITH {DAILY} SELECT a.k, a.day, a.v AS now, b.v AS before, round(coalesce(a.v - b.v, 0), 2) AS delta FROM dl a LEFT JOIN dl b ON a.k = b.k AND a.day = b.day + 1
WHERE abs(coalesce(a.v - b.v, 0)) >= 0.3""", ("day",))
def movement(spark, sf):
    rows = daily(spark, sf)
    out = report.movement(rows, rows.withColumn("day", F.date_add("day", 1)), ["k", "day"], "v")
    return out.select("k", "day", "now", "before", F.round("delta", 2).alias("delta"))


@query("trend14d", f"WITH {DAILY} SELECT a.k, a.day, a.v, b.v AS before, round(coalesce(a.v - b.v, 0), 2) AS delta FROM dl a LEFT JOIN dl b ON a.k = b.k AND a.day = b.day + 14", ("day",))
def trend14d(spark, sf):
    return report.lagged(daily(spark, sf), "k", "day", "v", 14).withColumn("delta", F.round("delta", 2))


@query("lag_prev_day", f"WITH {DAILY} SELECT a.k, a.day, a.v, b.v AS before, round(coalesce(a.v - b.v, 0), 2) AS delta FROM dl a LEFT JOIN dl b ON a.k = b.k AND a.day = b.day + 1", ("day",))
def lag_prev_day(spark, sf):
    return report.lagged(daily(spark, sf), "k", "day", "v", 1).withColumn("delta", F.round("delta", 2))


def poll_maps(spark, sf) -> DataFrame:
    """Polls with their seats as maps, a made-up source, and some faults."""
    seats = views.reading(spark, sf).groupBy("poll_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("party_id").cast("string"), "seats"))).alias("seats"))
    rows = views.poll(spark, sf).join(seats, F.col("id") == F.col("poll_id"))
    source = F.when(F.col("id") % 13 == 0, "").when(F.col("id") % 19 == 0, "https://x.example/Poll-of-Polls").otherwise("https://x.example/a")
    return rows.withColumn("source", source).withColumn("id", F.col("id").cast("string"))


FAULTS = f"""{PRELUDE}, pm AS (SELECT poll_id, sum(seats) AS total, bool_or(seats < 0) AS neg, bool_or(seats BETWEEN 1 AND 3) AS tiny, bool_or(seats > 45) AS big FROM reading GROUP BY poll_id),
px AS (SELECT id, date, sample_size, pm.*, CASE WHEN id % 13 = 0 THEN '' WHEN id % 19 = 0 THEN 'https://x.example/poll-of-polls' ELSE 'https://x.example/a' END AS source FROM poll JOIN pm ON id = poll_id),
pv AS (SELECT id, date, concat_ws('; ', CASE WHEN date_diff('day', DATE '1998-01-01', date) > 1 THEN 'future date' END, CASE WHEN total > 120 THEN 'seats sum above 120' END, CASE WHEN total <= 0 THEN 'no seats' END,
  CASE WHEN neg THEN 'negative seats' END, CASE WHEN tiny THEN 'impossible seats 1-3' END, CASE WHEN big THEN 'implausible seats above 45' END, CASE WHEN sample_size < 100 THEN 'tiny sample' END,
  CASE WHEN source = '' THEN 'missing source' END, CASE WHEN regexp_matches(source, 'average|aggregat|poll-of-polls') THEN 'aggregate page' END) AS reasons FROM px)"""


def judged(spark, sf) -> DataFrame:
    return quality.reasons(poll_maps(spark, sf), quality.poll_rules(F.lit("1998-01-01").cast("date")))


@query("validate_reasons", f"WITH {FAULTS} SELECT id::VARCHAR AS id, reasons FROM pv")
def validate_reasons(spark, sf):
    return judged(spark, sf).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query("revalidate_split", f"WITH {FAULTS} SELECT reasons = '' AS accepted, count(*) AS n FROM pv GROUP BY 1")
def revalidate_split(spark, sf):
    good, bad = quality.split_valid(judged(spark, sf))
    return good.select(F.lit(True).alias("accepted")).unionByName(bad.select(F.lit(False).alias("accepted"))).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query("merge_metrics", f"WITH {FAULTS} SELECT count(*) AS total, count(*) FILTER (reasons <> '') AS quarantined, count(*) FILTER (reasons = '') AS added FROM pv")
def merge_metrics(spark, sf):
    return judged(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("reasons") > 0).alias("quarantined"), F.count_if(F.size("reasons") == 0).alias("added"))


@query("quarantine_topn", f"WITH {FAULTS} SELECT id::VARCHAR AS id, date AS seen_at FROM pv WHERE reasons <> '' ORDER BY date DESC, id::VARCHAR LIMIT 200", ("seen_at",))
def quarantine_topn(spark, sf):
    bad = quality.split_valid(judged(spark, sf))[1].select("id", F.col("date").alias("seen_at"))
    old = bad.where(F.col("id").cast("long") % 2 == 0)
    return quality.quarantine(old, bad.where(F.col("id").cast("long") % 2 == 1), "id", "seen_at")


@query("fingerprint", f"WITH {PRELUDE}, e AS (SELECT poll_id, string_agg(party_id || ':' || seats::INT, ',' ORDER BY party_id || ':' || seats::INT) AS e FROM reading GROUP BY poll_id) SELECT id, date || '|' || pollster || '|' || e AS print FROM poll JOIN e ON id = poll_id")
def fingerprint(spark, sf):
    entries = views.reading(spark, sf).groupBy("poll_id").agg(F.collect_list(F.concat_ws(":", "party_id", F.col("seats").cast("int"))).alias("e"))
    rows = views.poll(spark, sf).join(entries, F.col("id") == F.col("poll_id"))
    return rows.select("id", quality.fingerprint(F.col("date").cast("string"), F.col("pollster"), entries=F.col("e")).alias("print"))


def stored_polls(spark, sf) -> DataFrame:
    rows = views.poll(spark, sf).where("not excluded")
    rank = F.when(F.col("provenance") == "F", 3).when(F.col("provenance") == "O", 2).otherwise(1)
    return rows.select(
        "id", "date", "pollster", F.col("mode").alias("outlet"), F.concat_ws("/", "pollster", (F.col("id") % 500).cast("string")).alias("source"), (F.col("id") % 7).cast("string").alias("print"),
        quality.completeness(F.lit(0), rank, F.col("sample_size")).alias("score"), F.col("id").alias("ord"),
    )


STORED = f"""{PRELUDE}, st AS (SELECT id, date, pollster, mode AS outlet, pollster || '/' || (id % 500) AS source, id % 7 AS print, CASE provenance WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END + CASE WHEN coalesce(sample_size, 0) > 0 THEN 1 ELSE 0 END AS score, id AS ord FROM poll WHERE NOT excluded),
se AS (SELECT *, min(ord) OVER (PARTITION BY source, print) AS o2, row_number() OVER (PARTITION BY source, print ORDER BY date, ord) AS r FROM st),
sn AS (SELECT * REPLACE (o2 AS ord) FROM se WHERE r = 1),
na AS (SELECT * FROM sn WHERE pollster <> 'MACHINERY' QUALIFY row_number() OVER (PARTITION BY pollster, date ORDER BY score DESC, ord) = 1),
sp AS (SELECT * FROM sn WHERE pollster = 'MACHINERY' AND date NOT IN (SELECT date FROM na) QUALIFY row_number() OVER (PARTITION BY outlet, date ORDER BY score DESC, ord) = 1),
dd AS (SELECT id, date, pollster, outlet, ord FROM na UNION ALL SELECT id, date, pollster, outlet, ord FROM sp)"""


@query("dedupe", f"WITH {STORED} SELECT * FROM dd", ("date",))
def dedupe(spark, sf):
    return quality.dedupe(stored_polls(spark, sf), F.col("pollster") != "MACHINERY").select("id", "date", "pollster", "outlet", "ord")


@query("merge_shadow", f"WITH {PRELUDE} SELECT id FROM poll s WHERE NOT excluded AND NOT EXISTS (SELECT 1 FROM poll c WHERE c.excluded AND c.pollster = s.pollster AND c.date = s.date)")
def merge_shadow(spark, sf):
    rows = views.poll(spark, sf)
    return quality.shadow(rows.where("not excluded"), rows.where("excluded")).select("id")


@query("effective_set", f"""WITH {STORED.replace("FROM poll WHERE NOT excluded)", "FROM poll s WHERE excluded OR NOT EXISTS (SELECT 1 FROM poll c WHERE c.excluded AND c.pollster = s.pollster AND c.date = s.date))")} SELECT id, date, pollster FROM dd""", ("date",))
def effective_set(spark, sf):
    every = views.poll(spark, sf)
    stored = quality.shadow(every.where("not excluded"), every.where("excluded"))
    both = every.where("excluded").unionByName(stored.select(*every.columns))
    rank = F.when(F.col("provenance") == "F", 3).when(F.col("provenance") == "O", 2).otherwise(1)
    rows = both.select(
        "id", "date", "pollster", F.col("mode").alias("outlet"), F.concat_ws("/", "pollster", (F.col("id") % 500).cast("string")).alias("source"), (F.col("id") % 7).cast("string").alias("print"),
        quality.completeness(F.lit(0), rank, F.col("sample_size")).alias("score"), F.col("id").alias("ord"),
    )
    return quality.dedupe(rows, F.col("pollster") != "MACHINERY").select("id", "date", "pollster")


def _taken_sql(rounds: int) -> str:
    """CTEs t1, t2, ...: the rows taken in each round of the merge of the CTE ``o0`` (ord, id, print)."""
    out = []
    for k in range(1, rounds + 1):
        out.append(f"t{k} AS MATERIALIZED (SELECT ord, id, print FROM o{k - 1} QUALIFY ord = min(ord) OVER (PARTITION BY id) AND ord = min(ord) OVER (PARTITION BY print))")
        out.append(f"o{k} AS MATERIALIZED (SELECT * FROM o{k - 1} WHERE id NOT IN (SELECT id FROM t{k}) AND print NOT IN (SELECT print FROM t{k}))")
    return ", ".join(out)


#: More rounds than the longest chain of rows that wait for each other in the test tables.
MERGE_ROUNDS = 24


@query("merge_greedy", f"""WITH {STORED}, mr AS MATERIALIZED (SELECT ord, date, date || '/' || ord % 50 AS id, date || '/' || ord % 11 AS print FROM st), so AS (SELECT * FROM mr WHERE ord % 5 = 0),
o0 AS MATERIALIZED (SELECT ord, id, print FROM mr WHERE ord % 5 <> 0 AND id NOT IN (SELECT id FROM so) AND print NOT IN (SELECT print FROM so)), {_taken_sql(MERGE_ROUNDS)}
SELECT t.id, mr.date::VARCHAR AS date, t.print, t.ord FROM ({' UNION ALL '.join(f'SELECT ord, id, print FROM t{k}' for k in range(1, MERGE_ROUNDS + 1))}) t JOIN mr USING (ord)""")
def merge_greedy(spark, sf):
    """New polls by id and fingerprint, in order, by day: a row blocked by its print doesn't claim its id."""
    rows = stored_polls(spark, sf).withColumn("id", F.concat_ws("/", F.col("date").cast("string"), (F.col("ord") % 50).cast("string")))
    rows = rows.withColumn("print", F.concat_ws("/", F.col("date").cast("string"), (F.col("ord") % 11).cast("string")))
    return quality.merge_new(rows.where("ord % 5 = 0"), rows.where("ord % 5 <> 0")).select("id", F.col("date").cast("string").alias("date"), "print", "ord")


@query("merge_conflicts", f"""WITH {PRELUDE}, mr AS MATERIALIZED (SELECT id AS ord, id % 5003 AS id, id * 7919 % 4999 AS print FROM poll WHERE NOT excluded), so AS (SELECT * FROM mr WHERE ord % 11 = 0),
o0 AS MATERIALIZED (SELECT * FROM mr WHERE ord % 11 <> 0 AND id NOT IN (SELECT id FROM so) AND print NOT IN (SELECT print FROM so)), {_taken_sql(MERGE_ROUNDS)}
{' UNION ALL '.join(f'SELECT ord, id, print FROM t{k}' for k in range(1, MERGE_ROUNDS + 1))} UNION ALL SELECT -1, id, print FROM o{MERGE_ROUNDS}""")
def merge_conflicts(spark, sf):
    """New polls by id and fingerprint, in order, where ids and prints tie rows of all days together."""
    rows = views.poll(spark, sf).where("not excluded").select(F.col("id").alias("ord"), (F.col("id") % 5003).alias("id"), (F.col("id") * 7919 % 4999).alias("print"))
    return quality.merge_new(rows.where("ord % 11 = 0"), rows.where("ord % 11 <> 0"))


@query("merge_counts", f"""WITH {FAULTS}, ok AS (SELECT * FROM pv WHERE reasons = ''), me AS (SELECT id AS ord, id % 4001 AS id, id % 17 AS print, pollster, date FROM poll WHERE id IN (SELECT id FROM ok)),
cu AS (SELECT * FROM me WHERE ord % 13 = 0), so AS (SELECT * FROM me WHERE ord % 13 = 1), nw AS (SELECT * FROM me WHERE ord % 13 > 1), fr AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.pollster = nw.pollster AND cu.date = nw.date AND cu.pollster <> 'MACHINERY')),
kn AS (SELECT id, print || '/' || date AS print FROM cu UNION ALL SELECT id, print || '/' || date FROM so), o0 AS MATERIALIZED (SELECT ord, id, print || '/' || date AS print FROM fr WHERE id NOT IN (SELECT id FROM kn) AND print || '/' || date NOT IN (SELECT print FROM kn)), {_taken_sql(MERGE_ROUNDS)}
SELECT *, (SELECT count(*) FROM fr) - added AS duplicates, (SELECT count(*) FROM nw) - (SELECT count(*) FROM fr) AS shadowed, (SELECT count(*) FROM pv WHERE reasons <> '' AND id % 13 > 1) AS quarantined, (SELECT count(*) FROM so) + added AS total
FROM (SELECT {' + '.join(f'(SELECT count(*) FROM t{k})' for k in range(1, MERGE_ROUNDS + 1))} AS added)""")
def merge_counts(spark, sf):
    """The merge's report: added, duplicates, shadowed by curated rows, quarantined, and the store's new size."""
    rows = poll_maps(spark, sf).withColumn("ord", F.col("id").cast("long"))
    rows = rows.select((F.col("ord") % 4001).cast("string").alias("id"), F.concat_ws("/", (F.col("ord") % 17).cast("string"), F.col("date").cast("string")).alias("print"), "ord", "date", "pollster", "seats", "sample_size", "source")
    rules = quality.poll_rules(F.lit("1998-01-01").cast("date"))
    known = quality.split_valid(quality.reasons(rows, rules))[0].drop("reasons")
    return quality.merge_report(known.where("ord % 13 = 1"), known.where("ord % 13 = 0"), rows.where("ord % 13 > 1"), rules, F.col("pollster") != "MACHINERY")[2]


@query("collect_all", f"WITH {PRELUDE} SELECT id % 1000 AS id, min(CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END)::INT AS source_ord FROM poll WHERE coalesce(sample_size, 450) >= 100 GROUP BY 1")
def collect_all(spark, sf):
    registry = readers.Registry()
    rows = views.poll(spark, sf).withColumn("ord", F.col("id"))
    for name, k in (("even", 0), ("odd", 1)):
        registry.register(name, lambda s, k=k: rows.where(F.col("id") % 2 == k).withColumn("id", F.col("id") % 1000))
    good, _, _ = registry.collect(spark, [("tiny sample", F.coalesce("sample_size", F.lit(450)) < 100)])
    return good.select("id", "source_ord")


@query("store_writeback", f"""WITH {PRELUDE}, so AS (SELECT id, strftime(date, '%Y-%m') AS month, sample_size FROM poll WHERE NOT excluded), nw AS (SELECT id, strftime(date + INTERVAL (id % 3 * 20) DAY, '%Y-%m') AS month, sample_size + 1 AS sample_size FROM poll WHERE id % 2 = 0 AND date >= DATE '1999-01-01')
SELECT * FROM nw UNION ALL SELECT * FROM so WHERE id NOT IN (SELECT id FROM nw)""")
def store_writeback(spark, sf):
    """A store by month, and a batch merged into it twice: rows that changed, that moved to another month, and new ones."""
    polls = views.poll(spark, sf)
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    folder = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    sinks.upsert_by_date(polls.where("not excluded").select("id", "sample_size", month("date")), folder, "id", "month")
    later = F.date_add("date", (F.col("id") % 3 * 20).cast("int"))
    batch = polls.where("id % 2 = 0 and date >= date'1999-01-01'").select("id", (F.col("sample_size") + 1).alias("sample_size"), month(later))
    for _ in range(2):
        sinks.upsert_by_date(batch, folder, "id", "month")
    return spark.read.schema("id long, sample_size long, month string").parquet(folder)


@query("trend_top6", """WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey::INT AS party_id, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT party_id FROM v WHERE month = (SELECT max(month) FROM v) ORDER BY value DESC, party_id LIMIT 6) SELECT * FROM v WHERE party_id IN (SELECT party_id FROM k)""")
def trend_top6(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    points = rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_nationkey").cast("int").alias("party_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return sinks.top_series(points, 6, "month", "party_id").select("month", "party_id", "value")


@query("index_upsert", f"WITH {PRELUDE} SELECT date, CASE WHEN bool_or(id % 2 = 1) THEN 'new' ELSE 'old' END AS headline FROM poll GROUP BY date", ("date",))
def index_upsert(spark, sf):
    rows = views.poll(spark, sf)
    old = rows.where("id % 2 = 0").select("date", F.lit("old").alias("headline")).distinct()
    return sinks.index_upsert(old, rows.where("id % 2 = 1").select("date", F.lit("new").alias("headline")).distinct())


@query("trend_pivot", """SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) FILTER (r_name = 'AFRICA'), 2) AS "AFRICA", round(sum(o_totalprice) FILTER (r_name = 'AMERICA'), 2) AS "AMERICA", round(sum(o_totalprice) FILTER (r_name = 'ASIA'), 2) AS "ASIA",
round(sum(o_totalprice) FILTER (r_name = 'EUROPE'), 2) AS "EUROPE", round(sum(o_totalprice) FILTER (r_name = 'MIDDLE EAST'), 2) AS "MIDDLE EAST"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""", ("month",))
def trend_pivot(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(views.party(spark, sf)), F.col("c_nationkey") == F.col("party_id"))
    rows = rows.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), "bloc", "o_totalprice")
    return sinks.pivoted(rows, "month", "bloc", "o_totalprice", model.REGIONS)


@query("poll_pivot", f"WITH {PRELUDE} SELECT poll_id, round(w.weight, 6) AS weight, {', '.join(f'max(seats) FILTER (party_id = {i}) AS p{i}' for i in range(25))} FROM reading JOIN w ON poll_id = id GROUP BY poll_id, w.weight")
def poll_pivot(spark, sf):
    rows = views.reading(spark, sf).join(model.weighed(spark, sf).select("id", "weight"), F.col("poll_id") == F.col("id"))
    out = rows.groupBy("poll_id", F.round("weight", 6).alias("weight")).pivot("party_id", list(range(25))).agg(F.max("seats"))
    return out.select("poll_id", "weight", *[F.col(f"`{i}`").alias(f"p{i}") for i in range(25)])


@query("strip_html", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<sup\b.*?</sup>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{2028}\x{2029}]+', ' ', 'g')) AS text FROM b""")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", textops.strip_html(F.col("html")).alias("text"))


@query("extract_links")
def extract_links(spark, sf):
    return textops.links(table(spark, sf, "pages").select("url", "html"))


@query("link_candidates")
def link_candidates(spark, sf):
    found = textops.links(table(spark, sf, "pages").select("url", "html"))
    return textops.candidates(found, F.lit(r"^https?://"), "[a-z]").select("url", "href")


@query("robots_block", r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, CASE WHEN regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) END AS path FROM pages),
r AS (SELECT DISTINCT origin, substr(path, 1, 3) AS rule FROM u WHERE page_id % 10 = 0)
SELECT page_id, url FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.origin = u.origin AND starts_with(u.path, r.rule))""")
def robots_block(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1)
    rules = pages.where("page_id % 10 = 0").select(F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("origin"), F.substring(F.when(path == "", "/").otherwise(path), 1, 3).alias("rule")).distinct()
    return textops.allowed(pages, rules)


@query("table_cells")
def table_cells(spark, sf):
    """The items of lists as cells: the test pages have no tables."""
    return textops.cells(table(spark, sf, "pages"), "page_id", "html", table=r"(?is)<(?:ul|nav)\b[^>]*>(.*?)</(?:ul|nav)>", row=r"(?is)(.+)", cell=r"(?is)<(?:li|a)\b[^>]*>(.*?)</(?:li|a)>")


NEEDLES = (("home", "h", 0), ("about", "a", 1), ("contact", "c", 2), ("new", "n", 3), ("e", "e", 4))


@query("header_map", rf"""WITH t AS (SELECT DISTINCT substr(text, 1, 12) AS text FROM documents), k AS (SELECT text, lower(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS k FROM t),
n(needle, party_id, ord) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in NEEDLES)})
SELECT k.text, arg_min(party_id, ord) AS party_id FROM k LEFT JOIN n ON contains(k, needle) GROUP BY k.text""")
def header_map(spark, sf):
    needles = spark.createDataFrame(list(NEEDLES), "needle string, party_id string, ord int")
    return textops.map_headers(table(spark, sf, "documents").select(F.substring("text", 1, 12).alias("text")), needles)


@query("header_map_lines")
def header_map_lines(spark, sf):
    """Whole lines of all documents as headers; ``header_map`` is bound by its SQL to the first 12 characters."""
    needles = spark.createDataFrame(list(NEEDLES), "needle string, party_id string, ord int")
    return textops.map_headers(table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("text")), needles)


@query("normalize_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{0591}-\x{05BD}\x{05BF}-\x{05C7}]', '', 'g'), '["''`\x{05F3}\x{05F4}\x{2018}\x{2019}\x{201C}\x{201D}]', '', 'g'), '[\x{05BE}\x{2010}-\x{2015}-]', ' ', 'g'),
'[\s\v\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{2028}\x{2029}]+', ' ', 'g')) AS text FROM documents""")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textops.normalize(F.col("text")).alias("text"))


@query("first_number", r"""WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9]{3})', '\1\2', 'g'), '[0-9]+'), lambda x: CASE WHEN len(x) BETWEEN 3 AND 5 THEN x::INT END), lambda n: n >= 300 AND n <= 20000 AND NOT (n >= 1990 AND n <= 2100)) AS l FROM documents)
SELECT doc_id, l[1] AS n FROM n""")
def first_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textops.sample_size(F.col("text")).alias("n"))


@query("extract_date", r"""SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders""", ("day",))
def extract_date(spark, sf):
    """Dates printed in four ways are read back."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.date_format("o_orderdate", "'on 'dd MMM yyyy'.'")).when(kind == 1, F.date_format("o_orderdate", "MMMM dd, yyyy")).when(kind == 2, F.date_format("o_orderdate", "'x 'yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return rows.select("id", textops.iso_date(text).alias("day"))


ALIASES = [("from the", "from"), ("the", "the"), ("ed", "ed"), ("that", "that"), ("with", "with")]


@query("mentions")
def mentions(spark, sf):
    found = named.mentions(table(spark, sf, "documents").select("doc_id", "text"), "text", ALIASES)
    return found.select("doc_id", F.inline("mentions"))


FIRMS = (("urgent", "Urgent"), ("high", "High"), ("medium", "Medium"), ("low", "Low"))
COLUMNS = (("likud", "a"), ("yashar", "b"), ("together", "c"), ("democrats", "d"), ("shas", "e"))
PRINTED = [f"o_orderkey * {2 * k + 3} % 29" for k in range(5)]


@query("table_polls", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row FROM orders),
p AS (SELECT *, CASE {" ".join(f"WHEN contains(lower(o_orderpriority), '{a}') THEN '{b}'" for a, b in FIRMS)} ELSE 'unknown' END AS pollster, {", ".join(f"({x})::INT AS {c}" for x, (_, c) in zip(PRINTED, COLUMNS))} FROM o)
SELECT o_custkey::VARCHAR AS source, row, 'table-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || pollster AS id, o_orderdate::DATE AS date, pollster, (300 + o_orderkey % 1500)::INT AS sample_size, a, b, c, d, e, a + b + c + d + e AS total, a + b + c + d + e <> 120 AS partial
FROM p WHERE least(a, b, c, d, e) >= 4 AND a + b + c + d + e <= 120""", ("date",))
def table_polls(spark, sf):
    """A page with a table of polls for each customer, printed from the orders, is read back."""
    cell = lambda x: F.concat(F.lit("<td>"), x.cast("string"), F.lit("</td>"))
    printed = [F.date_format("o_orderdate", "d MMM yyyy"), F.col("o_orderpriority"), 300 + F.col("o_orderkey") % 1500, *[F.expr(x) for x in PRINTED]]
    lines = table(spark, sf, "orders").select("o_custkey", F.struct("o_orderkey", F.concat(F.lit("<tr>"), *[cell(x) for x in printed], F.lit("</tr>")).alias("line")).alias("l"))
    head = '<table class="wikitable"><tr>' + "".join(f"<th>{h}</th>" for h in ("Date", "Firm", "Sample", *[n for n, _ in COLUMNS])) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "")
    pages = lines.groupBy(F.col("o_custkey").cast("string").alias("url")).agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))
    needles = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(COLUMNS)], "needle string, party_id string, ord int")
    found = pollpages.table_polls(pages, needles, ALIASES, list(FIRMS), [])
    return found.select("source", "row", "id", "date", "pollster", "sample_size", *[F.col("seats")[c].alias(c) for _, c in COLUMNS], "total", "partial")


@query("report_table", f"""WITH {model.AVERAGE} SELECT '# Shares' || chr(10) || chr(10) || '| party_id | share |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || party_id || ' | ' || printf('%.4f', round(share, 4)) || ' |', chr(10) ORDER BY party_id) AS document FROM avgs""")
def report_table(spark, sf):
    rows = model.party_average(spark, sf).withColumn("share", F.format_string("%.4f", F.round("share", 4)))
    return sinks.markdown(rows, "party_id", ["party_id", "share"], "Shares")


@query("daily_report")
def daily_report(spark, sf):
    """The report over all draws; changes are those of the seats against the central allocation."""
    rows = model.simulated(spark, sf).checkpoint()
    parties = montecarlo.summary(rows)
    central = model.apportion.allocate(model.supplier_votes(spark, sf), [], 120, 0.0325)
    changes = report.movement(parties, central.select("party_id", F.col("seats").cast("double").alias("mean")), "party_id", "mean")
    return report.report(parties, montecarlo.bloc_summary(rows), model.scenario_rows(spark, sf, rows), montecarlo.outlook(rows, "AMERICA", 1, "ASIA", "EUROPE"), changes)


@query("synthetic_series", """WITH p(party_id, base, drift, mood) AS (VALUES ('aa', 0.2, 0.001, 0.1), ('bbb', 0.1, -0.002, -0.2), ('cccc', 0.05, 0.0, 0.0)), t AS (SELECT range AS t FROM range(30))
SELECT (DATE '2026-09-11' - (29 - t)::INT) AS day, party_id, round(greatest(0.001, base + drift * t + sin((t + length(party_id)) * 0.7) * 0.004), 8) AS volume_share,
round(greatest(-1.0, least(1.0, mood + sin(0.4 * t + length(party_id)) * 0.03)), 8) AS sentiment, round(greatest(0.001, base + drift * 0.8 * t + sin((t + length(party_id)) * 0.7) * 0.004), 8) AS engagement_share FROM p, t""", ("day",))
def synthetic_series(spark, sf):
    parties = spark.createDataFrame([("aa", 0.2, 0.001, 0.1), ("bbb", 0.1, -0.002, -0.2), ("cccc", 0.05, 0.0, 0.0)], "party_id string, base double, drift double, mood double")
    out = readers.synthetic_attention(parties, 30, F.lit("2026-09-11").cast("date"))
    return out.select("day", "party_id", *[F.round(c, 8).alias(c) for c in ("volume_share", "sentiment", "engagement_share")])
