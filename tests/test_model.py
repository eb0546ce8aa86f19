"""Model operators: seats, weights, effects, calibration, random numbers, draws."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.functions import scalars
from tallyloom.operators import apportion, calibration, house, montecarlo, weights

VOTES = "party_id string, votes double, partner string, ord int"


def seats(spark, votes, house_size, threshold=0.0, partners=None):
    partners = partners or {}
    rows = [(p, float(v), partners.get(p), i) for i, (p, v) in enumerate(votes.items())]
    out = apportion.allocate(spark.createDataFrame(rows, VOTES), [], house_size, threshold)
    return {r.party_id: r.seats for r in out.collect()}


def greedy(votes, n):
    got = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (got[i] + 1), votes[i], -i))
        got[best] += 1
    return got


def test_largest_averages(spark):
    assert seats(spark, {"a": 100, "b": 80, "c": 39}, 6) == {"a": 3, "b": 2, "c": 1}
    assert sum(seats(spark, {"a": 100, "b": 60, "c": 40}, 10).values()) == 10
    assert seats(spark, {"a": 5, "b": 5}, 0) == {"a": 0, "b": 0}
    assert seats(spark, {"a": 0, "b": 0}, 3) == {"a": 0, "b": 0}


def test_threshold_and_cliff(spark):
    got = seats(spark, {"a": 0.5, "b": 0.44, "c": 0.03, "d": 0.03}, 120, 0.0325)
    assert got["c"] == got["d"] == 0 and got["a"] + got["b"] == 120
    assert seats(spark, {"a": 0.9676, "b": 0.0324}, 120, 0.0325)["b"] == 0
    assert seats(spark, {"a": 0.9674, "b": 0.0326}, 120, 0.0325)["b"] >= 3


def test_agreements(spark):
    votes = {"a": 0.46, "b": 0.28, "c": 0.26}
    alone = seats(spark, votes, 120)
    assert seats(spark, votes, 120, partners={"b": "c"}) == alone
    both = seats(spark, votes, 120, partners={"b": "c", "c": "b"})
    assert both["b"] + both["c"] >= alone["b"] + alone["c"] and sum(both.values()) == 120
    small = {"a": 0.5, "b": 0.47, "c": 0.03}
    assert seats(spark, small, 120, 0.0325, {"b": "c", "c": "b"})["c"] == 0


def test_batched_pruned_form_equals_greedy(spark):
    rng = np.random.default_rng(1)
    groups = [(g, p, float(rng.integers(0, 40)), p) for g in range(60) for p in range(int(rng.integers(1, 9)))]
    out = apportion.largest_averages(spark.createDataFrame(groups, "g int, party_id int, votes double, ord int"), ["g"], 17, "party_id").collect()
    got = {(r.g, r.party_id): r.seats for r in out}
    for g in range(60):
        votes = [v for h, _, v, _ in groups if h == g]
        if sum(votes) > 0:
            assert [got[(g, i)] for i in range(len(votes))] == greedy(votes, 17)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=2, max_size=12).filter(lambda x: sum(x) > 0))
def test_inversion_round_trip(target):
    target = np.array(target, float)
    votes = apportion.invert(target, int(target.sum()))
    got = apportion._averages(votes[votes > 0], int(target.sum()))
    assert abs(got - target[votes > 0]).max() <= 1
    assert votes.sum() == pytest.approx(1) and (votes[target == 0] == 0).all()


def polls(spark, rows):
    return spark.createDataFrame(rows, "id int, date date, pollster string, mode string, sample_size int, partial boolean, excluded boolean")


def test_weights(spark):
    d = dt.date
    rows = [(1, d(2026, 9, 11), "A", "phone", 1000, False, False), (2, d(2026, 8, 28), "A", "phone", 1000, False, False), (3, d(2026, 9, 11), "B", "x", None, True, False), (4, d(2026, 9, 11), "A", "phone", 100000, False, False), (5, d(2026, 9, 12), "A", "phone", 1, False, False), (6, d(2026, 9, 1), "A", "phone", 1, False, True)]
    grades = spark.createDataFrame([("A", 0.9)], "pollster string, grade double")
    out = {r.id: r for r in weights.weigh(polls(spark, rows), F.lit("2026-09-11").cast("date"), grades).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[2].recency / out[1].recency == pytest.approx(0.5) and out[4].weight == out[1].weight
    assert (out[3].sample, out[3].quality, out[3].mode_weight, out[3].completeness) == (0.45, 0.6, 0.7, 0.75)


def test_absent_flagged_and_residual(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (2, "a", 0.6)], "poll_id int, party_id string, share double")
    below = spark.createDataFrame([(2, "b", None), (2, "c", 0.01), (1, "b", None)], "poll_id int, party_id string, published double")
    out = {(r.poll_id, r.party_id): (r.share, r.imputed) for r in weights.impute_below(rows, below).collect()}
    assert out == {(1, "a"): (0.5, False), (1, "b"): (0.4, False), (2, "a"): (0.6, False), (2, "b"): (0.8 * 0.0325, True), (2, "c"): (0.01, True)}
    mean = weights.weighted_average(rows.withColumn("w", F.lit(1.0)), ["party_id"], "share", "w")
    full = {r.party_id: r.share for r in weights.with_residual(mean, "party_id", "other").collect()}
    assert full["a"] == pytest.approx(0.55) and full["other"] == pytest.approx(0.05)


def test_kernel_sums_equal_all_pairs_of_days(spark):
    rng = random.Random(5)
    start = dt.date(1990, 1, 1)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), start + dt.timedelta(days=rng.choice([0, 1, 3, 40, 41, 900, 9000])), rng.random(), 1 + rng.random()) for _ in range(60)]
    rows += [("a", "x", None, 1.0, 1.0), (None, "x", start, 1.0, 1.0), rows[0]]
    obs = spark.createDataFrame(rows, "party_id string, pollster string, day date, value double, w double")
    got = {(r.party_id, r.day, r.pollster): (r.a, r.w) for r in house.kernel_sums(obs, "value", "w").collect()}
    known = [r for r in rows if r[0] and r[2]]
    want = {}
    for party, at in {(r[0], r[2]) for r in known}:
        for p, pollster, day, value, w in known:
            if p == party:
                k = 0.5 ** (abs((day - at).days) / DEFAULT.half_life_days) * w
                a, b = want.get((party, at, pollster), (0.0, 0.0))
                want[(party, at, pollster)] = (a + value * k, b + k)
    assert got.keys() == want.keys()
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair, rel=1e-9)
    assert house.kernel_sums(obs.limit(0), "value", "w").count() == 0


def test_house_effects(spark):
    rows = []
    for day in range(4):
        for p in ("x", "y", "z"):
            for party, v in zip("abcd", (0.3, 0.25, 0.25, 0.2) if p != "z" else (0.36, 0.25, 0.25, 0.14)):
                rows.append((f"{p}{day}", party, p, dt.date(2026, 9, 1 + day), v, 1.0, True))
    obs = spark.createDataFrame(rows, "poll_id string, party_id string, pollster string, day date, value double, w double, attributed boolean")
    total = spark.createDataFrame([("x", 4.0), ("y", 4.0), ("z", 4.0)], "pollster string, weight double")
    out = {(r.pollster, r.party_id): r.effect for r in house.house_effects(obs, "value", "w", "w", total, rounds=4).collect()}
    assert out[("z", "a")] > 0.01 and out[("z", "d")] < -0.01
    for party in "abcd":
        assert sum(out[(p, party)] for p in "xyz") == pytest.approx(0, abs=1e-9)
    assert all(abs(e) <= DEFAULT.residual_clip + 0.01 for e in out.values())


#: Published records and results (date, group, polled, actual, confidence).
MISSES = [("2015-03-17", "netanyahu", 53.0, 61.0, "approx"), ("2015-03-17", "change", 50.0, 43.0, "approx"), ("2019-04-09", "netanyahu", 60.0, 65.0, "approx"), ("2019-09-17", "netanyahu", 57.0, 58.0, "approx"), ("2021-03-23", "netanyahu", 53.0, 52.0, "approx"), ("2021-03-23", "arab", 8.0, 10.0, "approx"), ("2022-11-01", "netanyahu", 60.5, 64.0, "firm"), ("2022-11-01", "haredi", 17.25, 18.0, "firm"), ("2022-11-01", "change", 50.0, 46.0, "firm")]


def test_calibration_gives_the_published_numbers(spark):
    rows = spark.createDataFrame(MISSES, "d string, grp string, polled double, actual double, confidence string").withColumn("date", F.to_date("d"))
    out = {r.grp: r.applied for r in calibration.calibrate_groups(rows, ["netanyahu", "change", "arab"]).collect()}
    assert out["netanyahu"] == pytest.approx(1.49093, abs=1e-5)
    assert out["change"] == pytest.approx(-1.84727, abs=1e-5)
    assert out["arab"] == pytest.approx(0.35633, abs=1e-5)
    assert out["haredi"] == pytest.approx(0.1875, abs=1e-9)


def test_random_numbers(spark):
    a, out = 42, []
    for _ in range(50):
        a = (a + 0x6D2B79F5) & scalars.MASK
        t = ((a ^ a >> 15) * (a | 1)) & scalars.MASK
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & scalars.MASK)) & scalars.MASK
        out.append((t ^ t >> 14) / 4294967296)
    assert [r.u for r in montecarlo.uniforms(spark, 42, 50).orderBy("n").collect()] == out
    z = np.array([r.z for r in montecarlo.normals(spark, 42, 50_000).collect()])
    assert len(z) == 50_000 and abs(z.mean()) < 0.02 and 0.98 < z.std() < 1.02
    for text in ("", "a", "2026-11-21|20000|nosocial"):
        assert spark.range(1).select(scalars.seed_of(F.lit(text)).alias("s")).first()["s"] == scalars.seed_from_string(text)


#: Published central shares of 2026-11-21, in the order of the parties, with bloc and agreement partner.
CENTRAL = [
    ("likud", 0.18309281370506206, "netanyahu", "religious-zionism"), ("yashar", 0.16112954704403654, "change", "byachad"), ("byachad", 0.09742674631134236, "change", "yashar"),
    ("democrats", 0.06923251215616422, "change", "yisrael-beiteinu"), ("yisrael-beiteinu", 0.059195867571741154, "change", "democrats"), ("shas", 0.05786131797516153, "netanyahu", "utj"),
    ("utj", 0.06061692989743349, "netanyahu", "shas"), ("otzma", 0.05970564389480804, "netanyahu", None), ("religious-zionism", 0.04903527889616675, "netanyahu", "likud"),
    ("amcha", 0.03616395556209474, "netanyahu", None), ("reservists", 0.03510407758698597, "change", None), ("joint-list", 0.07426729056134061, "arab", "raam"), ("raam", 0.05232290341166898, "arab", "joint-list"),
]


def test_draws_give_the_published_forecast(spark):
    """All 20,000 published draws: the generator, the shocks, the allocation and the summaries."""
    rows = spark.createDataFrame([(p, s, b, i, q) for i, (p, s, b, q) in enumerate(CENTRAL)], "party_id string, share double, bloc string, ord int, partner string")
    seed = scalars.seed_from_string("2026-11-21|20000|nosocial")
    draws = montecarlo.draws(rows, seed, 20_000, ["netanyahu", "change", "arab"], "arab", 0, other=0.004845115425993716).checkpoint()
    likud = {r.party_id: r for r in montecarlo.summary(draws).collect()}["likud"]
    assert likud.mean == pytest.approx(23.095, abs=0.002) and (likud.low, likud.high) == (20, 26)
    assert likud.p_largest == pytest.approx(0.8471, abs=0.0005)
    blocs = {r.bloc: r for r in montecarlo.bloc_summary(draws).collect()}
    assert blocs["netanyahu"].mean == pytest.approx(53.6266, abs=0.002) and blocs["arab"].mean == pytest.approx(15.4081, abs=0.002)
    assert blocs["change"].p_majority == pytest.approx(0.00895, abs=0.0005)
    who = {r.winner: r.probability for r in montecarlo.outlook(draws, "netanyahu", "likud", "change", "arab").collect()}
    assert who["deadlock"] == pytest.approx(0.534242499999935, abs=0.001) and who["yashar"] == pytest.approx(0.42171249999990457, abs=0.001)
    assert sum(who.values()) == pytest.approx(1)
    assert draws.groupBy("sim").agg(F.sum("seats").alias("s")).where("s <> 120").count() == 0


def test_momentum_is_capped_and_centred(spark):
    rows = [(dt.date(2026, 9, 11) - dt.timedelta(days=k), p, v * (2 if p == "a" and k < 7 else 1), 0.0, v) for k in range(28) for p, v in (("a", 0.2), ("b", 0.3), ("c", 0.5))]
    obs = spark.createDataFrame(rows, "day date, party_id string, volume_share double, sentiment double, engagement_share double")
    out = {r.party_id: r for r in calibration.momentum(obs, F.lit("2026-09-11").cast("date")).collect()}
    assert out["a"].momentum > 0 and abs(sum(r.adjustment for r in out.values())) < 1e-12
    off = calibration.momentum(obs, F.lit("2026-09-11").cast("date"), enabled=False).collect()
    assert {r.adjustment for r in off} == {0.0}


def test_percentages(spark):
    cases = {1.0: "100%", 0.99885: ">99%", 0.0: "0%", 0.0012: "<1%", 0.542: "54%"}
    rows = spark.createDataFrame([(p,) for p in cases], "p double").select("p", scalars.pct_guard(F.col("p")).alias("t"), scalars.signed(F.col("p") - 0.5).alias("s")).collect()
    assert {r.p: r.t for r in rows} == cases
    assert {r.p: r.s for r in rows}[0.0] == "−0.5"
