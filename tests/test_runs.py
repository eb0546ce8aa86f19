"""Runs as rows: a grid, or many days, gives what one run at a time gives."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.functions.scalars import seed_from_string
from tallyloom.operators import montecarlo
from tallyloom.plans import forecast, runs
from tests.test_forecast import inputs  # noqa: F401

CONFIG = dataclasses.replace(DEFAULT, simulations=80)
KEYS = dict(blocs=["left", "right", "third"], turnout_bloc="third", leader="a", config=CONFIG, rounds=2)


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def social(spark):
    days = [dt.date(2026, 8, 15) + dt.timedelta(days=i) for i in range(28)]
    return spark.createDataFrame([(d, p, 0.2 + 0.01 * i * (p == "a"), 0.2 - 0.004 * i * (p == "c"), 0.1) for i, d in enumerate(days) for p in "abcde"], "day date, party_id string, volume_share double, engagement_share double, sentiment double")


def test_grid_equals_single_runs(spark, inputs):  # noqa: F811
    knobs = {"base": {}, "short": {"half_life": 5}, "wild": {"bloc_sd": 0.05, "party_sd": 0.03, "per_30_days": 0.9}, "bar": {"threshold": 0.09}, "loud": {"social": True, "social_cap": 3}}
    common = {**inputs, "social": social(spark), **KEYS}
    grid = forecast.build_runs(runs.run_table(spark, knobs, "2026-09-11", CONFIG), **common)
    drawn = grid.draws.checkpoint()
    names = {"half_life": "half_life_days", "bloc_sd": "bloc_error_sd", "party_sd": "party_error_sd", "per_30_days": "time_inflation_per_30_days", "social_cap": "social_cap_pp", "threshold": "threshold"}
    for name, change in knobs.items():
        config = dataclasses.replace(CONFIG, **{names[k]: v for k, v in change.items() if k != "social"})
        one = forecast.build_forecast(as_of="2026-09-11", **{**common, "config": config, "social": common["social"] if change.get("social") else None})
        mine = lambda df: df.where(F.col("run") == name)  # noqa: B023, E731
        assert rows(mine(grid.central), "party_id", "share", "other") == rows(one.central, "party_id", "share", "other"), name
        assert rows(mine(drawn), "sim", "party_id", "seats") == rows(one.draws, "sim", "party_id", "seats"), name
        assert rows(mine(grid.effects), "pollster", "party_id", "effect") == rows(one.effects, "pollster", "party_id", "effect"), name
    seats = grid.parties.select("run", "party_id", "mean").checkpoint()
    moved = {(r.run, r.party_id): r.delta_mean for r in runs.against(seats, "base").collect()}
    assert all(moved["base", p] == 0 for p in "abcde") and moved["loud", "a"] > 0 > moved["loud", "c"]
    assert any(moved["bar", p] for p in "abcde")
    with pytest.raises(ValueError):
        runs.run_table(spark, {"x": {"speed": 3}}, "2026-09-11")


def test_wider_errors_widen_seats(spark, inputs):  # noqa: F811
    """More error gives more spread, no error none; the same run again gives the same draws."""
    table = runs.run_table(spark, {"none": {"bloc_sd": 0, "party_sd": 0}, "some": {}, "more": {"bloc_sd": 0.08, "party_sd": 0.04}}, "2026-09-11", CONFIG)
    out = forecast.build_runs(table, **inputs, social=None, **{**KEYS, "rounds": 0})
    spread = {r.run: r.s for r in out.draws.where("party_id = 'a'").groupBy("run").agg(F.stddev("seats").alias("s")).collect()}
    assert spread["none"] < 1 < spread["some"] < spread["more"]


def test_days_equal_single_days_and_trend(spark, inputs):  # noqa: F811
    table = runs.day_table(spark, "2026-09-18", 16, config=CONFIG)
    out = forecast.build_runs(table, **inputs, social=None, **KEYS)
    central = {(r.run, r.party_id): r for r in out.central.collect()}
    days = sorted({d for d, _ in central})
    assert days[0] == "2026-09-02" and days[-1] == "2026-09-18" and len(days) == 17
    for day in ("2026-09-02", "2026-09-17"):
        one = forecast.build_forecast(as_of=day, **inputs, social=None, **KEYS)
        assert rows(out.central.where(F.col("run") == day), "party_id", "share", "other") == rows(one.central, "party_id", "share", "other")
        assert rows(out.draws.where(F.col("run") == day), "sim", "party_id", "seats") == rows(one.draws, "sim", "party_id", "seats")
    # The readings begin on 1 September, so days up to the 14th have nothing two weeks before.
    assert all(r.trend14d == 0 for (d, _), r in central.items() if d < "2026-09-15")
    for p in "ac":
        assert central["2026-09-17", p].trend14d == pytest.approx(central["2026-09-17", p].poll_share - central["2026-09-03", p].poll_share)


def test_seeds_and_counts(spark):
    label = spark.createDataFrame([("2026-09-11", 1.0, True, dt.date(2026, 9, 11), 0.3)], "x string, share double, social boolean, as_of date, per_30_days double")
    assert runs.settings(label, 4000).first().seed == seed_from_string("2026-09-11|4000|social")
    draws = spark.createDataFrame([(s, p, (s * (3 + p)) % 7, p) for s in range(40) for p in range(3)], "sim long, party_id int, seats int, ord int")
    halves = montecarlo.seat_counts(draws.where("sim < 17")).unionByName(montecarlo.seat_counts(draws.where("sim >= 17")))
    columns = ("party_id", "mean", "median", "low", "high", "p_seats", "p_largest")
    assert rows(montecarlo.summary_of_counts(halves), *columns) == rows(montecarlo.summary(draws), *columns)
    assert montecarlo.retained(draws, 5).count() == 15
