"""The composite pipelines end to end on a small made-up electorate."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.operators import quality
from tallyloom.plans import forecast
from tallyloom.sources import readers

PARTIES = [("a", "left", 0, "b"), ("b", "left", 1, "a"), ("c", "right", 2, None), ("d", "right", 3, None), ("e", "third", 4, None)]


@pytest.fixture(scope="module")
def inputs(spark):
    polls, seats = [], []
    for i in range(12):
        firm = "xyz"[i % 3]
        polls.append((i, dt.date(2026, 9, 1) + dt.timedelta(days=i // 3), firm, "phone", 800, i % 4 == 3, False))
        votes = {"a": 40, "b": 22, "c": 35, "d": 13, "e": 10} if i % 4 != 3 else {"a": 41, "c": 34}
        if firm == "z":
            votes = {**votes, "a": votes["a"] + 3, "c": votes["c"] - 3}
        seats += [(i, p, float(v), n) for n, (p, v) in enumerate(votes.items())]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return dict(
        polls=frame(polls, "id int, date date, pollster string, mode string, sample_size int, partial boolean, excluded boolean"),
        readings=frame(seats, "poll_id int, party_id string, seats double, ord int"),
        published=frame([(3, "e", None, True)], "poll_id int, party_id string, share double, below boolean"),
        grades=frame([("x", 0.9), ("y", 0.8)], "pollster string, grade double"),
        parties=frame(PARTIES, "party_id string, bloc string, ord int, partner string"),
        misses=frame([(dt.date(2022, 11, 1), "left", 60.0, 62.0, "firm"), (dt.date(2022, 11, 1), "right", 50.0, 49.0, "firm")], "date date, grp string, polled double, actual double, confidence string"),
        members=frame([("wide", 0.5, p) for p in "abe"] + [("right", 0.8, p) for p in "cd"], "scenario string, plausibility double, party_id string"),
    )


def test_forecast(spark, inputs, tmp_path):
    config = dataclasses.replace(DEFAULT, simulations=60)
    common = dict(social=None, blocs=["left", "right", "third"], turnout_bloc="third", leader="a", config=config, rounds=2)
    out = forecast.build_forecast(as_of="2026-09-11", **inputs, **common)
    assert sum(r.share for r in out.central.collect()) + out.central.first()["other"] == pytest.approx(1)
    assert out.draws.groupBy("sim").agg(F.sum("seats").alias("s")).where("s > 120").count() == 0  # others may hold seats
    parties = {r.party_id: r for r in out.parties.collect()}
    assert parties["a"].mean > parties["c"].mean > parties["e"].mean and parties["a"].low <= parties["a"].median <= parties["a"].high
    assert sum(r.probability for r in out.outlook.collect()) == pytest.approx(1)
    effects = {(r.pollster, r.party_id): r.effect for r in out.effects.collect()}
    assert effects[("z", "a")] > effects[("x", "a")]
    again = forecast.build_forecast(as_of="2026-09-11", **inputs, **common)
    drawn = lambda f: f.draws.select("sim", "party_id", "seats", F.round("share", 9))  # noqa: E731  sums of doubles depend on their order
    assert drawn(again).exceptAll(drawn(out)).count() == 0
    index = spark.createDataFrame([(dt.date(2026, 9, 10), "old")], "date date, headline string")
    new = forecast.publish({"2026-09-11": out}, str(tmp_path / "s"), index).collect()
    assert [r.date.day for r in new] == [11, 10] and spark.read.json(str(tmp_path / "s")).count() == 5


def test_store_jobs(spark):
    columns = "id string, date string, print string, ord int, v int"
    store = spark.createDataFrame([("a", "d1", "p1", 0, 1), ("bad", "d1", "p9", 1, -1)], columns)
    log = spark.createDataFrame([], "id string, reasons array<string>, seen_at string")
    rules = [("negative", F.col("v") < 0)]
    kept, rejects = forecast.revalidate(store, log, rules, F.lit("now"))
    assert [r.id for r in kept.collect()] == ["a"] and [r.reasons for r in rejects.collect()] == [["negative"]]
    registry = readers.Registry()
    registry.register("one", lambda s: s.createDataFrame([("a", "d1", "p2", 1, 5), ("b", "d1", "p2", 2, 5), ("c", "d1", "p3", 3, -5)], columns))
    registry.register("two", lambda s: 1 / 0)
    merged, quarantine, failures = forecast.scrape(registry, kept, log, rules, F.lit("now"))
    assert sorted(r.id for r in merged.collect()) == ["a", "b"] and [r.id for r in quarantine.collect()] == ["c"] and len(failures) == 1
    empty = readers.Registry()
    empty.register("only", lambda s: 1 / 0)
    with pytest.raises(RuntimeError):
        forecast.scrape(empty, kept, log, rules, F.lit("now"))


def test_effective_polls(spark):
    columns = "id int, date string, pollster string, outlet string, source string, print string, score int, ord int"
    curated = spark.createDataFrame([(1, "d1", "A", "o", "u1", "p1", 100, 0)], columns)
    stored = spark.createDataFrame([(2, "d1", "A", "o", "u2", "p2", 900, 1), (3, "d2", "A", "o", "u3", "p3", 5, 2)], columns)
    out = forecast.effective_polls(curated, stored, F.col("pollster") != "")
    assert {r.id for r in out.collect()} == {1, 3}
    assert quality.split_valid(quality.reasons(curated, []))[1].count() == 0
