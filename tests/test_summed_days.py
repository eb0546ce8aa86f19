"""Days and knobs multiply sums, not readings: the averages against loops, and what the queries over many runs shuffle."""

import datetime as dt

import pytest

from tallyloom.config import DEFAULT
from tallyloom.plans import queries_runs, runs
from tallyloom.plans.queries_model import QUERIES
from tallyloom.session import table
from tests.conftest import SF

DAYS = [dt.date(2026, 9, 1) + dt.timedelta(days=i) for i in range(6)]


def test_averages_of_bases_against_loops(spark):
    """Flagged lists with and without a published share, an empty share, an excluded poll, a poll without a reading."""
    firms = {"x": 0.9, "y": 0.8, "z": DEFAULT.default_grade}
    polls = [(i, DAYS[i // 4], "xyz"[i % 3], "phone", 300 + 100 * (i % 5), i % 4 == 1, i == 6) for i in range(20)]
    shares = [(i, p, None if (i, p) == (4, "b") else 0.1 + 0.01 * ((i * k) % 7)) for i in range(19) for k, p in enumerate("abc", 1) if (i + k) % 5]
    below = [(i, p, None if i % 2 else 0.02) for i in range(20) for p in "ac" if i % 3 == 0]
    bases = [(d, h, t) for d in DAYS for h in (3.0, 14.0) for t in (0.0325, 0.06)]
    frame = spark.createDataFrame
    mean, effects, sizes = runs.average_runs(
        frame(polls, "id long, date date, pollster string, mode string, sample_size long, partial boolean, excluded boolean"), frame(shares, "poll_id long, party_id string, share double"),
        frame(below, "poll_id long, party_id string, published double"), frame([(f, g) for f, g in firms.items() if f != "z"], "pollster string, grade double"), frame(bases, "as_of date, half_life double, threshold double"), rounds=0,
    )
    assert effects is None
    read, wanted, counted = {(i, p) for i, p, _ in shares}, {}, {}
    for day, half, threshold in bases:
        weights = {i: 0.5 ** ((day - d).days / half) * min(1, n / DEFAULT.reference_sample) * firms[f] * DEFAULT.mode_weights.get(m, DEFAULT.default_mode_weight) * (DEFAULT.partial_weight if part else 1) for i, d, f, m, n, part, out in polls if not out and d <= day}
        rows = [(p, x, weights[i]) for i, p, x in shares if i in weights]
        rows += [(p, DEFAULT.imputed_threshold_share * threshold if x is None else x, weights[i]) for i, p, x in below if i in weights and (i, p) not in read]
        for party in {p for p, _, _ in rows}:
            support = sum(w for p, _, w in rows if p == party)
            wanted[day, half, threshold, party] = (max(DEFAULT.share_floor, sum(x * w for p, x, w in rows if p == party and x is not None) / support), support)
        counted[day, half, threshold] = (sum(weights.values()) ** 2 / sum(w * w for w in weights.values()), sum(w > 0.02 for w in weights.values()))
    got = {(r.as_of, r.half_life, r.threshold, r.party_id): (r.share, r.support) for r in mean.collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(v) for k, v in wanted.items())
    assert {(r.as_of, r.half_life, r.threshold): (r.effective_n, r.used) for r in sizes.collect()} == {k: (pytest.approx(n), used) for k, (n, used) in counted.items()}


def shuffled(spark, job) -> int:
    """The rows that ``job`` writes to shuffles."""
    sc = spark.sparkContext
    store, bus, none = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        bus.waitUntilEmpty()
        seq = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (seq.apply(i) for i in range(seq.size()))}

    before = stages().keys()
    job()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["backfill", "daily_reports", "headlines", "snapshot_trend", "what_if_blocs", "headline_strip"])
def test_days_and_knobs_multiply_no_readings(spark, monkeypatch, name):
    """Few draws, so readings are most of the input: a query shuffles a few times its rows, not their product with days."""
    monkeypatch.setattr(queries_runs, "MONTH_SIMS", 2)
    monkeypatch.setattr(queries_runs, "GRID_SIMS", 2)
    rows = sum(table(spark, SF, t).count() for t in ("orders", "customer", "lineitem", "supplier", "events"))
    assert 0 < shuffled(spark, lambda: QUERIES[name](spark, SF).collect()) < 4 * rows
