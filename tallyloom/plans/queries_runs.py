"""Queries over many runs at once: the what-if grid, and every day of a month with its two-week trend."""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.operators import montecarlo, reporting
from tallyloom.plans import daily, runs, views
from tallyloom.plans.queries_model import MISSES, REGIONS, draw_runs_sql, misses, query, r6, scenario_members
from tallyloom.plans.views import MODES, PRELUDE
from tallyloom.session import shared_folder, table
from tallyloom.sources.sinks import SnapshotStore

#: The knobs one by one, at both ends of their range, and together.
KNOBS: dict[str, dict] = {
    "base": {}, "half-life 7": {"half_life": 7}, "half-life 45": {"half_life": 45}, "bloc error 0": {"bloc_sd": 0}, "bloc error 3 pp": {"bloc_sd": 0.03},
    "party error 0.2 pp": {"party_sd": 0.002}, "party error 3 pp": {"party_sd": 0.03}, "no time factor": {"per_30_days": 0}, "time factor 100 %": {"per_30_days": 1},
    "threshold 0": {"threshold": 0}, "threshold 6 %": {"threshold": 0.06}, "momentum": {"social": True}, "momentum 3 pp": {"social": True, "social_cap": 3},
    "all": {"half_life": 28, "bloc_sd": 0.02, "party_sd": 0.02, "per_30_days": 0.5, "threshold": 0.05, "social": True, "social_cap": 1.5},
}
GRID_SIMS, MONTH, MONTH_SIMS, AHEAD = 4000, 30, 500, 30


def attention(spark: SparkSession, sf: str, last: dt.date) -> DataFrame:
    """Attention by nation (of users), moved so that its newest day is ``last``."""
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 25).cast("int").alias("party_id"), "value")
    newest = events.agg(F.max("day")).first()[0]
    moved = F.lit((last - newest).days if newest else 0)
    per = events.groupBy(F.date_add("day", moved).alias("day"), "party_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.avg("value").alias("m"))
    day = W.partitionBy("day")
    return per.select("day", "party_id", (F.col("n") / F.sum("n").over(day)).alias("volume_share"), (F.col("v") / F.sum("v").over(day)).alias("engagement_share"), F.least(F.lit(1.0), F.col("m") / 1000).alias("sentiment"))


def inputs(spark, sf):
    polls = views.poll(spark, sf)
    last = polls.agg(F.max("date")).first()[0]
    shares = views.reading(spark, sf).select("poll_id", "party_id", (F.col("seats") / 1000).alias("share"))
    return polls, shares, last


def rounded(central: DataFrame) -> DataFrame:
    """Shares rounded, so that the draws of both sides start from the same numbers."""
    return central.withColumns({c: F.round(c, 8) for c in ("share", "other")})


def drawn(spark, sf, table_, polls, shares, last, sims, social=None) -> tuple[DataFrame, DataFrame]:
    """(central, draws) of the runs, the averages without house effects."""
    config = dataclasses.replace(DEFAULT, simulations=sims, election_date=str(last + dt.timedelta(days=AHEAD)))
    mean, _, _ = runs.average_runs(polls, shares, None, views.grades(spark), runs.with_trend(table_), config=config, rounds=0, modes=MODES)
    central = runs.central_runs(table_, runs.trended(mean), views.party(spark, sf), misses(spark, sf), social, REGIONS, config)
    central = runs.settings(rounded(central), sims, config).checkpoint()
    return central, montecarlo.draw_runs(central, ["run"], sims, REGIONS, "ASIA", config)


def grid(spark, sf) -> DataFrame:
    polls, shares, last = inputs(spark, sf)
    return drawn(spark, sf, runs.run_table(spark, KNOBS, last), polls, shares, last, GRID_SIMS, attention(spark, sf, last))[1]


def _values() -> str:
    base = {"half_life": 14.0, "bloc_sd": 0.028, "party_sd": 0.011, "per_30_days": 0.3, "threshold": 0.0325, "social_cap": 0.6, "social": False}
    return ", ".join("(" + ", ".join([f"'{name}'", *[f"{'TRUE' if v else 'FALSE'}" if isinstance(v, bool) else f"{float(v)}::DOUBLE" for v in {**base, **change}.values()]]) + ")" for name, change in KNOBS.items())


def _seed_sql(label: str) -> str:
    """The 32-bit hash of an ASCII label."""
    return f"list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({label}, ''), lambda x: ascii(x)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT)::BIGINT"


def central_sql(rows: str, sims: int) -> str:
    """CTE ``ct``, the central shares of the runs in the CTE ``rn`` (run, as_of and the knobs); ``rows`` says which of
    their averages' days there are (a CTE ``av`` of as_of, half_life)."""
    return f"""{PRELUDE}, {MISSES}, ev AS (SELECT (ts::DATE + date_diff('day', (SELECT max(ts)::DATE FROM events), (SELECT d FROM newest))::INTEGER)::DATE AS day, (user_id % 25)::INT AS party_id, value FROM events),
ep AS (SELECT day, party_id, count(*) AS n, sum(value) AS v, avg(value) AS m FROM ev GROUP BY ALL),
eo AS (SELECT day, party_id, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS vol, v / sum(v) OVER (PARTITION BY day) AS eng, least(1.0, m / 1000) AS sen FROM ep),
{rows},
st AS (SELECT *, sample * quality * mode_weight * completeness AS fixed FROM weighed),
me AS MATERIALIZED (SELECT as_of, half_life, party_id, greatest(0.0005, sum(seats / 1000 * fixed * pow(0.5, date_diff('day', date, as_of) / half_life)) / sum(fixed * pow(0.5, date_diff('day', date, as_of) / half_life))) AS mean
  FROM reading JOIN st ON poll_id = id JOIN av ON date <= as_of GROUP BY ALL HAVING sum(fixed * pow(0.5, date_diff('day', date, as_of) / half_life)) > 0),
ma AS (SELECT run, party_id, as_of, social_cap,
  (0.35 * avg(vol) FILTER (date_diff('day', day, as_of) < 7) + 0.65 * avg(eng) FILTER (date_diff('day', day, as_of) < 7)) * (1 + 0.25 * avg(sen) FILTER (date_diff('day', day, as_of) < 7)) AS late,
  (0.35 * avg(vol) FILTER (date_diff('day', day, as_of) >= 7) + 0.65 * avg(eng) FILTER (date_diff('day', day, as_of) >= 7)) * (1 + 0.25 * avg(sen) FILTER (date_diff('day', day, as_of) >= 7)) AS early
  FROM rn JOIN eo ON day <= as_of AND day > as_of - 28 WHERE social GROUP BY ALL),
mv AS (SELECT run, party_id, CASE WHEN coalesce(early, 0) > 0 THEN greatest(-0.4, least(0.4, (coalesce(late, 0) - early) / early)) ELSE 0 END * social_cap / 100 / 0.4 * 0.5 AS x FROM ma),
mo AS (SELECT run, party_id, x - avg(x) OVER (PARTITION BY run) AS moved FROM mv),
jn AS (SELECT rn.*, me.party_id, me.mean, bloc, ord, partner FROM rn JOIN me USING (as_of, half_life) JOIN party USING (party_id)),
cl AS (SELECT run, party_id, coalesce(applied * mean / sum(mean) OVER (PARTITION BY run, bloc), 0) * 0.955 / 120 AS x FROM jn LEFT JOIN mz ON bloc = grp),
cm AS (SELECT run, party_id, x - avg(x) OVER (PARTITION BY run) AS calibrated FROM cl),
rw AS (SELECT jn.*, greatest(0.0005, mean + coalesce(moved, 0) + calibrated) AS raw, greatest(0.005, 1 - sum(mean) OVER (PARTITION BY run)) AS rest FROM jn JOIN cm USING (run, party_id) LEFT JOIN mo USING (run, party_id)),
ct AS MATERIALIZED (SELECT * EXCLUDE (raw, rest), round(raw / (sum(raw) OVER (PARTITION BY run) + rest), 8) AS share, round(rest / (sum(raw) OVER (PARTITION BY run) + rest), 8) AS other, 1 + per_30_days * days / 30 AS scale,
  {_seed_sql(f"strftime(as_of, '%Y-%m-%d') || '|{sims}|' || CASE WHEN social THEN 'social' ELSE 'nosocial' END")} AS seed FROM rw)"""


GRID = f"""{central_sql(f"rn AS (SELECT run, d AS as_of, {AHEAD} AS days, half_life, bloc_sd, party_sd, per_30_days, threshold, social_cap, social FROM newest, (VALUES {_values()}) v(run, half_life, bloc_sd, party_sd, per_30_days, threshold, social_cap, social)), av AS (SELECT DISTINCT as_of, half_life FROM rn)", GRID_SIMS)},
{draw_runs_sql(GRID_SIMS)}"""


@query("what_if_grid", f"""WITH {GRID}, su AS (SELECT run, party_id, avg(seats) AS mean, quantile_cont(seats, 0.1)::DOUBLE AS low, quantile_cont(seats, 0.9)::DOUBLE AS high, avg((seats > 0)::INT) AS p_seats FROM dr GROUP BY ALL)
SELECT su.run, su.party_id, round(su.mean, 6) AS mean, su.low, su.high, round(su.p_seats, 6) AS p_seats, round(su.mean - coalesce(b.mean, 0), 6) AS delta_mean, round(su.p_seats - coalesce(b.p_seats, 0), 6) AS delta_p_seats
FROM su LEFT JOIN su b ON b.run = 'base' AND b.party_id = su.party_id""")
def what_if_grid(spark, sf):
    """Each configuration's seats and chances for each party, against the base run on the same random numbers."""
    by = ("run",)
    out = runs.against(montecarlo.summary_of_counts(montecarlo.seat_counts(grid(spark, sf), by=by), by=by), "base", "party_id", ("mean", "p_seats"))
    return out.select("run", "party_id", r6("mean").alias("mean"), "low", "high", *[r6(c).alias(c) for c in ("p_seats", "delta_mean", "delta_p_seats")])


@query("what_if_blocs", f"""WITH {GRID}, b AS (SELECT run, sim, bloc, sum(seats) AS seats FROM dr GROUP BY ALL), su AS (SELECT run, bloc, avg(seats) AS mean, avg((seats >= 61)::INT) AS p_majority FROM b GROUP BY ALL)
SELECT su.run, su.bloc, round(su.mean, 6) AS mean, round(su.p_majority, 6) AS p_majority, round(su.mean - coalesce(b.mean, 0), 6) AS delta_mean FROM su LEFT JOIN su b ON b.run = 'base' AND b.bloc = su.bloc""")
def what_if_blocs(spark, sf):
    out = runs.against(montecarlo.bloc_summary(grid(spark, sf), by=("run",)), "base", "bloc")
    return out.select("run", "bloc", r6("mean").alias("mean"), r6("p_majority").alias("p_majority"), r6("delta_mean").alias("delta_mean"))


BACKFILL = f"""{central_sql(f"rn AS (SELECT strftime(a.as_of, '%Y-%m-%d') AS run, a.as_of, {AHEAD} + date_diff('day', a.as_of, d) AS days, 14.0::DOUBLE AS half_life, 0.028::DOUBLE AS bloc_sd, 0.011::DOUBLE AS party_sd, 0.3::DOUBLE AS per_30_days, 0.0325::DOUBLE AS threshold, 0.6::DOUBLE AS social_cap, TRUE AS social FROM (SELECT d, (d - range::INTEGER)::DATE AS as_of FROM newest, range({MONTH + 1})) a), av AS (SELECT as_of, half_life FROM rn UNION SELECT (as_of - 14)::DATE, half_life FROM rn)", MONTH_SIMS)},
{draw_runs_sql(MONTH_SIMS)}"""


@query("backfill", f"""WITH {BACKFILL}, su AS (SELECT run, party_id, avg(seats) AS mean, avg((seats > 0)::INT) AS p_seats FROM dr GROUP BY ALL)
SELECT ct.run AS as_of, ct.party_id, ct.share, round(ct.mean, 6) AS poll_share, round(CASE WHEN b.mean IS NULL THEN 0 ELSE ct.mean - b.mean END, 6) + 0.0 AS trend14d, round(su.mean, 6) AS mean, round(p_seats, 6) AS p_seats
FROM ct JOIN su USING (run, party_id) LEFT JOIN me b ON b.as_of = ct.as_of - 14 AND b.half_life = ct.half_life AND b.party_id = ct.party_id""")
def backfill(spark, sf):
    """Every day of a month: shares, the change in two weeks, seats and the chance of any, in one plan."""
    polls, shares, last = inputs(spark, sf)
    central, rows = drawn(spark, sf, runs.day_table(spark, last, MONTH, True), polls, shares, last, MONTH_SIMS, attention(spark, sf, last))
    seats = montecarlo.summary(rows, by=("run",))
    out = central.select("run", "party_id", "share", "poll_share", "trend14d").join(seats, ["run", "party_id"])
    return out.select(F.col("run").alias("as_of"), "party_id", "share", r6("poll_share").alias("poll_share"), (r6("trend14d") + 0.0).alias("trend14d"), *[r6(c).alias(c) for c in ("mean", "p_seats")])


def month(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(central, party summaries, bloc summaries) of every day of the month."""
    polls, shares, last = inputs(spark, sf)
    central, rows = drawn(spark, sf, runs.day_table(spark, last, MONTH, True), polls, shares, last, MONTH_SIMS, attention(spark, sf, last))
    rows = rows.checkpoint()
    return central, montecarlo.summary(rows, by=("run",)), montecarlo.bloc_summary(rows, by=("run",))


def _text_sql(x: str) -> str:
    return f"regexp_replace(printf('%.1f', round({x}, 1)), '\\.0$', '')"


@query("headlines", f"""WITH {BACKFILL}, su AS (SELECT run, party_id, avg(seats) AS mean FROM dr GROUP BY ALL),
rk AS (SELECT run, name, mean, row_number() OVER (PARTITION BY run ORDER BY mean DESC, ord) AS r FROM su JOIN party USING (party_id)),
tw AS (SELECT a.run, a.name AS a, b.name AS b, a.mean AS x, b.mean AS y FROM rk a JOIN rk b ON a.run = b.run AND a.r = 1 AND b.r = 2)
SELECT run AS date, CASE WHEN x - y < 1 THEN a || ' and ' || b || ' are level, ' || {_text_sql("x")} || ' to ' || {_text_sql("y")} || ' seats' ELSE a || ' leads with ' || {_text_sql("x")} || ' seats, ' || {_text_sql("x - y")} || ' before ' || b END AS headline FROM tw""")
def headlines(spark, sf):
    """Each day's headline: the index of the archive."""
    return reporting.headlines(month(spark, sf)[1], views.party(spark, sf)).select(F.col("run").alias("date"), "headline")


@query("snapshot_trend", f"""WITH {BACKFILL}, su AS (SELECT run, party_id, avg(seats) AS mean FROM dr GROUP BY ALL), bs AS (SELECT run, sim, bloc, sum(seats) AS seats FROM dr GROUP BY ALL)
SELECT run AS as_of, 'party' AS kind, party_id::VARCHAR AS key, round(mean, 2) AS value FROM su UNION ALL SELECT run, 'bloc', bloc, round(avg(seats), 2) FROM bs GROUP BY run, bloc""")
def snapshot_trend(spark, sf):
    """Every day's document written, read back, and the trend made from what was read."""
    central, parties, blocs = month(spark, sf)
    lists = lambda df, name, *columns: df.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    documents = lists(parties, "parties", "party_id", "mean", "p_seats").join(lists(blocs, "blocs", "bloc", "mean", "p_majority"), "run").withColumnRenamed("run", "as_of")
    store = SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    store.write(documents)
    return store.trend().select("as_of", "kind", "key", "value")


@query("headline_strip", f"""WITH {GRID}, su AS (SELECT run, party_id, avg(seats) AS mean FROM dr GROUP BY ALL), bs AS (SELECT run, sim, bloc, sum(seats) AS seats FROM dr GROUP BY ALL), bm AS (SELECT run, bloc, avg(seats) AS mean FROM bs GROUP BY ALL),
pg AS (SELECT run, list(mean ORDER BY mean DESC) AS l FROM su GROUP BY run), bg AS (SELECT run, list(mean ORDER BY mean DESC) AS l FROM bm GROUP BY run), sc AS (SELECT run, max(scale) AS scale FROM ct GROUP BY run)
SELECT run, round((scale - 1) * 100, 4) AS inflation_pct, round(pg.l[1] - pg.l[2], 6) AS party_gap, round(bg.l[1] - bg.l[2], 6) AS bloc_gap FROM sc JOIN pg USING (run) JOIN bg USING (run)""")
def headline_strip(spark, sf):
    """Each configuration's strip: how much the distance inflates errors, and the gaps of the first two parties and blocs."""
    polls, shares, last = inputs(spark, sf)
    central, rows = drawn(spark, sf, runs.run_table(spark, KNOBS, last), polls, shares, last, GRID_SIMS, attention(spark, sf, last))
    rows = rows.checkpoint()
    gap = lambda df, name: df.groupBy("run").agg(F.sort_array(F.collect_list("mean"), False).alias("l")).select("run", (F.get("l", F.lit(0)) - F.get("l", F.lit(1))).alias(name))  # noqa: E731  a party or bloc a row
    by = ("run",)
    out = central.groupBy("run").agg(((F.max("scale") - 1) * 100).alias("inflation_pct"))
    out = out.join(gap(montecarlo.summary_of_counts(montecarlo.seat_counts(rows, by=by), by=by), "party_gap"), "run").join(gap(montecarlo.bloc_summary(rows, by=by), "bloc_gap"), "run")
    return out.select("run", F.round("inflation_pct", 4).alias("inflation_pct"), r6("party_gap").alias("party_gap"), r6("bloc_gap").alias("bloc_gap"))


@query("daily_reports")
def daily_reports(spark, sf):
    """Every day's report as JSON and Markdown: sections filled from the day's facts, movement against the day before."""
    polls, shares, last = inputs(spark, sf)
    table_ = runs.day_table(spark, last, MONTH, True)
    config = dataclasses.replace(DEFAULT, simulations=MONTH_SIMS, election_date=str(last + dt.timedelta(days=AHEAD)))
    mean, _, sizes = runs.average_runs(polls, shares, None, views.grades(spark), runs.with_trend(table_), config=config, rounds=0, modes=MODES)
    central = runs.settings(runs.central_runs(table_, runs.trended(mean), views.party(spark, sf), misses(spark, sf), attention(spark, sf, last), REGIONS, config), MONTH_SIMS, config).checkpoint()
    draws = montecarlo.draw_runs(central, ["run"], MONTH_SIMS, REGIONS, "ASIA", config).checkpoint()
    by = ("run",)
    seats = central.select("run", "party_id", "share", "poll_share", "trend14d").join(montecarlo.summary(draws, by=by), ["run", "party_id"]).checkpoint()
    keys = table_.select("run", *runs.BASIS)
    every = runs.Runs(
        table_, central, None, keys.join(sizes, runs.BASIS).drop(*runs.BASIS), draws, seats, montecarlo.bloc_summary(draws, by=by), montecarlo.scenarios(draws, scenario_members(spark, sf), by=by),
        montecarlo.outlook(draws, "AMERICA", 1, "ASIA", "EUROPE", by=by),
    )
    reports, markdown = daily.reports_of(every, views.party(spark, sf), "AMERICA", daily.previous(every, None), config)
    return reports.join(markdown, "run").select("date", "headline", "json", "markdown")
