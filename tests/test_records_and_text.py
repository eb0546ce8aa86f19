"""Records, text, sources, sinks, streaming and the entry point."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import mentions as named
from tallyloom.operators import quality, report, textops
from tallyloom.plans import catalog, queries_data
from tallyloom.sources import readers, sinks
from tallyloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], " , ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


def test_reasons(spark):
    rows = [("a", dt.date(2026, 9, 1), {"x": 60.0, "y": 60.0}, 800, "https://s"), ("", None, {"x": 150.0}, 50, ""), ("c", dt.date(2030, 1, 1), {"x": 2.0, "y": -1.0}, None, "https://s/Average"), ("d", dt.date(2026, 9, 1), {}, None, "x/calculator")]
    frame = spark.createDataFrame(rows, "id string, date date, seats map<string,double>, sample_size int, source string")
    out = [r.reasons for r in quality.reasons(frame, quality.poll_rules(F.lit("2026-09-10").cast("date"))).collect()]
    assert out[0] == ["implausible seats above 45"]
    assert out[1] == ["missing id", "bad date", "seats sum above 120", "implausible seats above 45", "tiny sample", "missing source"]
    assert out[2] == ["future date", "negative seats", "impossible seats 1-3", "aggregate page"]
    assert out[3] == ["no seats", "calculator page"]


POLL = "id int, date string, pollster string, outlet string, source string, print string, score int, ord int"


def test_dedupe_is_idempotent_and_follows_its_rules(spark):
    rows = [
        (1, "d1", "A", "o1", "u1", "p1", 60, 1), (2, "d1", "A", "o2", "u2", "p2", 112, 2), (3, "d1", "A", "o3", "u3", "p3", 112, 3),
        (4, "d1", "B", "o1", "u4", "p4", 10, 4), (5, "d1", "", "o9", "u5", "p5", 999, 5), (6, "d2", "", "o9", "u6", "p6", 5, 6), (7, "d2", "", "o9", "u7", "p7", 5, 7), (8, "d3", "C", "o1", "u1", "p1", 70, 8),
    ]
    frame = spark.createDataFrame(rows, POLL)
    once = quality.dedupe(frame, F.col("pollster") != "")
    assert {r.id for r in once.collect()} == {2, 4, 6}  # 8 is the article of 1, seen later; 1 is less complete than 2
    assert {r.id for r in quality.dedupe(once, F.col("pollster") != "").collect()} == {2, 4, 6}


def test_merge_blocks_by_id_or_print_in_order(spark):
    store = spark.createDataFrame([("a", "p0")], "id string, print string")
    rows = [("a", "p1", 1, "k"), ("b", "p0", 2, "k"), ("c", "p2", 3, "k"), ("d", "p2", 4, "k"), ("d", "p3", 5, "k"), ("c", "p4", 6, "k")]
    out = quality.merge_new(store, spark.createDataFrame(rows, "id string, print string, ord int, day string"), "day")
    assert sorted((r.id, r.print) for r in out.collect()) == [("c", "p2"), ("d", "p3")]


def test_upsert_quarantine_and_report_parts(spark):
    old, new = (spark.createDataFrame(x, "date string, headline string") for x in ([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d")]))
    assert [tuple(r) for r in sinks.index_upsert(old, new).collect()] == [("3", "d"), ("2", "c"), ("1", "a")]
    log = spark.createDataFrame([(str(i), i) for i in range(300)], "id string, seen_at int")
    fresh = spark.createDataFrame([("5", 1000)], "id string, seen_at int")
    kept = quality.quarantine(log, fresh, "id", "seen_at").collect()
    assert len(kept) == 200 and kept[0].id == "5" and sum(r.id == "5" for r in kept) == 1
    today, before = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 5.0), ("b", 3.0), ("n", 9.0)], [("a", 4.0), ("b", 2.9)]))
    assert [r.k for r in report.movement(today, before, "k", "v").collect()] == ["a"]


def test_html(spark):
    html = '<nav>menu</nav><script>x<y</script><p>A&nbsp;&amp;&#1488;&#33; b<sup>1</sup></p><a class="x" href="/r#f">Go <b>on</b></a><a href="mailto:q">m</a><a href="q.html">q</a>'
    assert one(spark, textops.strip_html(F.col("h")), h=html) == "A &א! b Go on m q"
    found = textops.links(spark.createDataFrame([("https://e.org/d/p.html", html)], "url string, html string")).orderBy("place").collect()
    assert [r.href for r in found] == ["https://e.org/r", "https://e.org/d/q.html"]
    table = "<table><tr><th>Date</th><th>Firm</th><th>Likud</th></tr><tr><td>1 Sep 2026</td><td>F</td><td>24</td></tr></table>"
    cells = textops.cells(spark.createDataFrame([(1, table)], "id int, html string"), "id", "html")
    assert [(r.row, r.col, r.tag, r.text) for r in cells.orderBy("row", "col").collect()][:2] == [(0, 0, "h", "Date"), (0, 1, "h", "Firm")]
    assert [r.row for r in textops.header_rows(cells, "id").collect()] == [0]
    needles = spark.createDataFrame([("likud", "likud", 1), ("date", None, 0)], "needle string, party_id string, ord int")
    assert {r.text: r.party_id for r in textops.map_headers(cells.where("tag = 'h'"), needles).collect()} == {"Date": None, "Firm": None, "Likud": "likud"}
    robots = "User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /private # no\nDisallow:\n"
    assert one(spark, F.to_json(textops.robots_rules(F.col("t"), "tallyloom")), t=robots) == '["/private"]'


@pytest.mark.parametrize("text,day", [("5-7 Sep 2026", "2026-09-07"), ("on September 5, 2026", "2026-09-05"), ("x 2026-09-04 y", "2026-09-04"), ("3/9/2026", "2026-09-03"), ("31/2/2026", None), ("none", None)])
def test_dates(spark, text, day):
    assert one(spark, textops.iso_date(F.col("t")).cast("string"), t=text) == day


def test_hebrew_text(spark):
    assert one(spark, textops.normalize(F.col("t")), t="חד״ש־תע״ל ׁ  ‘x’") == "חדש תעל x"
    assert one(spark, textops.hebrew_date(F.col("t"), F.lit("2020-01-01").cast("date")).cast("string"), t="ביום 5 בספטמבר 2026") == "2026-09-05"
    assert one(spark, textops.sample_size(F.col("t")), t="In 2026, 1,204 adults") == 1204
    aliases = [("הליכוד", "likud"), ("ליכוד", "likud"), ("ישר", "yashar"), ("שס", "shas")]
    texts = ["הליכוד מקבל 24 מנדטים, ישר 22, שס 2", "הליכוד יורד ל 21 מנדטים", "הליכוד יורד ב 4 מנדטים", "הליכוד מאבד 4 מנדטים", "הליכוד. עוד 46 ימים", "הליכוד וכל השאר ביחד 39 מנדטים"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {r.id: r.mentions for r in named.mentions(frame, "t", aliases).collect()}
    assert {p.party_id: p.seats for p in found[0]} == {"likud": 24, "yashar": 22, "shas": None}
    assert [found[i][0].seats for i in range(1, 6)] == [21, None, None, None, None]
    frame = spark.createDataFrame([(1, "הליכוד 24, ישר 22. הליכוד 30")], "id int, t string")
    first = named.first_readings(named.mentions(frame, "t", aliases), ["id"]).collect()
    assert {r.party_id: r.seats for r in first} == {"likud": 24, "yashar": 22}
    assert named.read_polls(named.mentions(frame, "t", aliases), ["id"], least=2).first()["seats"] == {"likud": 24, "yashar": 22}
    spellings = spark.createDataFrame([("a", "X"), ("b", "X"), ("a", "Long Name"), ("b", "Y")], "party_id string, text string")
    assert [(r.text, r.party_id) for r in named.alias_table(spellings).collect()] == [("Long Name", "a"), ("Y", "b")]


def test_sources(spark, tmp_path):
    schema = "a int"
    assert readers.read_json(spark, str(tmp_path / "missing.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    assert readers.read_json(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.read_json(spark, str(tmp_path / "good.json"), schema).count() == 2
    spark.dataSource.register(readers.PageSource)
    page = spark.read.format("survey_pages").option("urls", '["http://127.0.0.1:9/x"]').option("interval", "0").schema("url string, html string, error string")
    assert readers.PageReader({"urls": '["u", "v"]'}).partitions()[1].value == "v"
    assert page.load().columns == ["url", "html", "error"]
    tries = []

    class Refused:
        def __call__(self, request, wait):
            tries.append(1)
            raise readers.urllib.error.HTTPError("u", 404, "no", {}, None)

    with pytest.raises(readers.urllib.error.HTTPError):
        readers.RateLimited(interval=0, opener=Refused()).text("http://h/x")
    assert len(tries) == 1
    registry = readers.Registry()
    registry.register("first", lambda s: s.createDataFrame([(1, 10, 1), (2, 20, 2)], "id int, v int, ord int"))
    registry.register("broken", lambda s: 1 / 0)
    registry.register("second", lambda s: s.createDataFrame([(2, 99, 1), (3, -1, 2)], "id int, v int, ord int"))
    good, bad, failures = registry.collect(spark, [("negative", F.col("v") < 0)])
    assert {(r.id, r.v) for r in good.collect()} == {(1, 10), (2, 20)} and [r.id for r in bad.collect()] == [3] and failures[0][0] == "broken"


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    for day, v in (("2026-01-01", 1.0), ("2026-01-02", 2.0), ("2026-01-01", 3.0)):
        sinks.write_snapshot(spark.createDataFrame([("a", v, day)], "k string, v double, as_of string"), folder)
    rows = spark.read.json(folder)
    assert {(str(r.as_of), r.v) for r in rows.collect()} == {("2026-01-01", 3.0), ("2026-01-02", 2.0)}
    assert [r.v for r in sinks.latest(rows).collect()] == [2.0]
    assert sinks.trend(rows, "as_of", "k", "v").count() == 2


def test_streaming(spark, tmp_path):
    rows = [("p1", "2026-01-01 00:00:00"), ("p1", "2026-01-01 01:00:00"), ("p2", "2026-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "print string, t string").selectExpr("print", "cast(t as timestamp) as seen_at", "1.0 as v")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = ingest.append_store(ingest.new_only(stream), str(tmp_path / "store"), str(tmp_path / "c"))
    assert query.awaitTermination(60)
    assert sorted(r.print for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["p1", "p2"]
    assert "window" in ingest.attention_windows(stream, "seen_at", "print", "v").columns


FAST = ["flagship", "poll_weight", "weighted_average", "dhondt_by_group", "bader_ofer", "house_effects", "calibration", "momentum", "uniforms", "contribution_sets", "dedupe", "validate_reasons", "strip_html", "header_map", "extract_date", "trend_pivot"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    number = lambda rows: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows]
    assert number(norm(got)) == number(norm(want))


def test_header_map_of_whole_lines(spark):
    """Every line of every document is mapped by all its letters, needles after the 12th character too."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    key = lambda x: "".join(c for c in x if c.isalpha()).lower()
    first = lambda k: next((party for needle, party, _ in sorted(queries_data.NEEDLES, key=lambda n: n[2]) if needle in k), None)
    want = {x: first(key(x)) for t in texts for x in t.split("\n")}
    got = {r.text: r.party_id for r in catalog.queries()["header_map_lines"](spark, SF).collect()}
    assert got == want
    assert any(first(key(x[:12])) != party for x, party in want.items())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Column pruning reaches the scan, ranking plans a group limit, and nothing is a cartesian product."""
    plan = lambda df: df._jdf.queryExecution().toString()
    weigh = plan(catalog.queries()["poll_weight"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint" in weigh and "c_acctbal" not in weigh.split("Physical Plan")[1]
    assert "WindowGroupLimit" in plan(catalog.queries()["top_effects"](spark, SF))
    for name in ("dedupe", "kernel_loo", "bader_ofer"):
        assert "CartesianProduct" not in plan(catalog.queries()[name](spark, SF))
