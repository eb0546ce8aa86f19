"""Queries over the model's operators: weights, averages, seats, effects, calibration, draws."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.functions.scalars import pct_guard, probability_word
from tallyloom.operators import apportion, calibration, house, montecarlo, report, reporting, weights
from tallyloom.plans import views
from tallyloom.plans.views import MODES, PRELUDE
from tallyloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query and its SQL; the columns ``dates`` are ISO text on both sides."""

    def keep(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(spark, sf)
            return out.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else out

        QUERIES[name] = run
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return keep


def r6(c):
    """Rounded alike on both sides: sums of doubles depend on their order."""
    return F.round(c, 6)


def weighed(spark: SparkSession, sf: str, half_life: float | None = None) -> DataFrame:
    polls = views.poll(spark, sf)
    return weights.weigh(polls, views.last_date(polls), views.grades(spark), half_life=half_life, modes=MODES)


@query("poll_weight", f"WITH {PRELUDE} SELECT id, round(recency, 6) AS recency, round(sample, 6) AS sample, quality, mode_weight, completeness, round(weight, 6) AS weight FROM w")
def poll_weight(spark, sf):
    return weighed(spark, sf).select("id", r6("recency").alias("recency"), r6("sample").alias("sample"), "quality", "mode_weight", "completeness", r6("weight").alias("weight"))


@query("partial_shares", f"""WITH {PRELUDE}, x AS (
  SELECT poll_id, least(0.12, 0.035 + sum(CASE WHEN seats >= 5 AND seats < 8 THEN seats / 1000.0 ELSE 0.0 END) + 0.02 * sum(CASE WHEN seats < 5 THEN 1 ELSE 0 END)) AS wasted FROM reading GROUP BY poll_id)
SELECT poll_id, party_id, round(seats / 120 * (1 - wasted), 6) AS share FROM reading JOIN x USING (poll_id) WHERE seats >= 8""")
def partial_shares(spark, sf):
    rows = views.reading(spark, sf)
    seats = F.col("seats")
    out = weights.partial_shares(rows, seats >= 8, F.when(seats >= 5, seats / 1000.0), seats < 5)
    return out.select("poll_id", "party_id", r6("share").alias("share"))


def party_average(spark, sf) -> DataFrame:
    rows = views.reading(spark, sf).join(weighed(spark, sf).select(F.col("id").alias("poll_id"), "weight"), "poll_id")
    return weights.weighted_average(rows.withColumn("value", F.col("seats") / 1000), ["party_id"], "value", "weight")


AVERAGE = f"""{PRELUDE}, avgs AS (
  SELECT party_id, greatest(0.0005, sum(seats / 1000 * weight) / sum(weight)) AS share, sum(weight) AS support
  FROM reading JOIN w ON poll_id = id GROUP BY party_id HAVING sum(weight) > 0)"""


@query("weighted_average", f"""WITH {AVERAGE}, t AS (SELECT sum(share) AS raw_sum FROM avgs)
SELECT party_id, round(share, 6) AS share, round(support, 4) AS support, round(raw_sum, 6) AS raw_sum FROM avgs, t
UNION ALL SELECT -1, round(greatest(0.005, 1 - raw_sum), 6), 0.0, round(raw_sum, 6) FROM t""")
def weighted_average(spark, sf):
    out = weights.with_residual(party_average(spark, sf), "party_id", -1)
    return out.select("party_id", r6("share").alias("share"), F.round("support", 4).alias("support"), r6("raw_sum").alias("raw_sum"))


@query("below_threshold_impute", """WITH r AS (SELECT l_orderkey AS poll_id, s_nationkey AS party_id, sum(l_quantity) AS seats FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
k AS (SELECT poll_id, party_id, round(seats / 1000, 6) AS share, FALSE AS imputed FROM r WHERE seats >= 5),
b AS (SELECT DISTINCT poll_id, party_id FROM r WHERE seats < 5 UNION SELECT DISTINCT poll_id, 0 FROM r WHERE seats > 45)
SELECT * FROM k UNION ALL SELECT poll_id, party_id, 0.026, TRUE FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.poll_id = b.poll_id AND k.party_id = b.party_id)""")
def below_threshold_impute(spark, sf):
    rows = views.reading(spark, sf)
    kept = rows.where("seats >= 5").select("poll_id", "party_id", (F.col("seats") / 1000).alias("share"))
    flagged = rows.where("seats < 5").select("poll_id", "party_id").unionByName(rows.where("seats > 45").select("poll_id", F.lit(0).alias("party_id"))).distinct()
    out = weights.impute_below(kept, flagged.withColumn("published", F.lit(None).cast("double")))
    return out.select("poll_id", "party_id", r6("share").alias("share"), "imputed")


@query("effective_n", f"WITH {PRELUDE} SELECT pollster, round(pow(sum(weight), 2) / sum(weight * weight), 4) AS effective_n, count(*) FILTER (weight > 0.02) AS used FROM w GROUP BY pollster")
def effective_n(spark, sf):
    return weights.effective_size(weighed(spark, sf), ["pollster"]).select("pollster", F.round("effective_n", 4).alias("effective_n"), "used")


def nation_votes(spark, sf, by_year: bool = False) -> DataFrame:
    lines, orders, customer = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    keys = [F.year("o_orderdate").alias("year")] if by_year else []
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    votes = joined.groupBy(*keys, F.col("c_nationkey").cast("int").alias("party_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("votes"))
    return votes.join(F.broadcast(views.party(spark, sf)), "party_id")  # 25 rows


VOTES = """v AS (SELECT c_nationkey::INT AS party_id, round(sum(l_extendedprice), 2) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""
YEARLY = VOTES.replace("SELECT c_nationkey", "SELECT year(o_orderdate)::INT AS year, c_nationkey").replace("GROUP BY 1", "GROUP BY 1, 2")


@query("dhondt", f"""WITH {VOTES}, q AS (SELECT party_id, row_number() OVER (ORDER BY votes / k DESC, votes DESC, party_id) AS r FROM v, generate_series(1, 120) g(k))
SELECT v.party_id, count(q.party_id) AS seats FROM v LEFT JOIN q ON v.party_id = q.party_id AND r <= 120 GROUP BY 1""")
def dhondt(spark, sf):
    return apportion.largest_averages(nation_votes(spark, sf), [], 120, "party_id")


@query("dhondt_by_group", f"""WITH {YEARLY}, q AS (SELECT year, party_id, row_number() OVER (PARTITION BY year ORDER BY votes / k DESC, votes DESC, party_id) AS r FROM v, generate_series(1, 120) g(k))
SELECT v.year, v.party_id, count(q.party_id) AS seats FROM v LEFT JOIN q ON v.party_id = q.party_id AND v.year = q.year AND r <= 120 GROUP BY 1, 2""")
def dhondt_by_group(spark, sf):
    return apportion.largest_averages(nation_votes(spark, sf, True), ["year"], 120, "party_id")


def supplier_votes(spark, sf) -> DataFrame:
    lines, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    votes = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").cast("int").alias("party_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("votes"))
    return votes.join(F.broadcast(views.party(spark, sf)), "party_id")


SUPPLIED = "sv AS (SELECT s_nationkey::INT AS party_id, round(sum(l_extendedprice), 2) AS votes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


@query("threshold_filter", f"WITH {SUPPLIED} SELECT party_id, round(votes / sum(votes) OVER (), 6) AS share, votes / sum(votes) OVER () >= 0.0325 AS qualifies FROM sv")
def threshold_filter(spark, sf):
    return apportion.qualified(supplier_votes(spark, sf), [], 0.0325).select("party_id", r6("share").alias("share"), "qualifies")


def allocation_sql(votes: str, by: str, seats: int, threshold: float | str, tight: bool = False) -> str:
    """CTEs ``alloc`` (by, party_id, share, qualifies, seats) over the CTE ``votes`` (by, party_id, votes, ord, partner).
    ``tight`` leaves out quotients under all votes / (seats + lists), none of which can win, for many groups."""
    part = f"PARTITION BY {by}" if by else ""
    pre = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    inner = f"pooled JOIN ps USING ({pre}pool), generate_series(1, {seats}) g(k) WHERE k <= n"
    if tight:
        inner = f"(SELECT *, unnest(generate_series(1, n)) AS k FROM pooled JOIN ps USING ({pre}pool))"
    tried = f"pools, generate_series(1, {seats}) g(k)"
    if tight:
        tried = f"(SELECT *, unnest(generate_series(1, least({seats}, floor(votes * ({seats} + count(*) OVER ({part})) / sum(votes) OVER ({part})) + 1)::BIGINT)) AS k FROM pools)"
    return f"""base AS (SELECT *, CASE WHEN sum(votes) OVER ({part}) > 0 THEN votes / sum(votes) OVER ({part}) ELSE 0 END AS share FROM {votes}),
ok AS (SELECT * FROM base WHERE share >= {threshold} AND votes > 0),
pooled AS (SELECT a.*, CASE WHEN b.partner = a.party_id AND b.party_id <> a.party_id THEN least(a.party_id::VARCHAR, b.party_id::VARCHAR) || '+' || greatest(a.party_id::VARCHAR, b.party_id::VARCHAR) ELSE a.party_id::VARCHAR END AS pool
  FROM ok a LEFT JOIN ok b ON {on}a.partner = b.party_id),
pools AS (SELECT {pre}pool, sum(votes) AS votes, min(ord) AS ord FROM pooled GROUP BY {pre}pool),
pq AS (SELECT {pre}pool, row_number() OVER ({part} ORDER BY votes / k DESC, votes DESC, ord) AS r FROM {tried}),
ps AS (SELECT {pre}pool, count(*) AS n FROM pq WHERE r <= {seats} GROUP BY {pre}pool),
iq AS (SELECT {pre}pool, party_id, n, row_number() OVER (PARTITION BY {pre}pool ORDER BY votes / k DESC, votes DESC, ord) AS r FROM {inner}),
si AS (SELECT {pre}party_id, count(*) AS seats FROM iq WHERE r <= n GROUP BY {pre}party_id),
alloc AS (SELECT {('base.' + by + ',') if by else ''} base.party_id, base.share, base.share >= {threshold} AND base.votes > 0 AS qualifies, coalesce(si.seats, 0)::INT AS seats FROM base LEFT JOIN si USING ({pre}party_id))"""


PARTIES = """pt AS (SELECT n_nationkey::INT AS party_id, n_nationkey::INT AS ord, r_name AS bloc, CASE WHEN n_nationkey IN (3, 24) THEN NULL ELSE xor(n_nationkey, 1) END::INT AS partner FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("bader_ofer", f"""WITH {SUPPLIED}, {PARTIES}, vv AS (SELECT sv.party_id, votes, ord, partner FROM sv JOIN pt USING (party_id)), {allocation_sql("vv", "", 120, 0.0325)}
SELECT party_id, round(share, 6) AS share, qualifies, seats FROM alloc""")
def bader_ofer(spark, sf):
    return apportion.allocate(supplier_votes(spark, sf), [], 120, 0.0325).select("party_id", r6("share").alias("share"), "qualifies", "seats")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Decayed weighted average -> threshold -> agreements -> seats."""
    votes = party_average(spark, sf).select("party_id", F.round("share", 6).alias("votes")).join(F.broadcast(views.party(spark, sf)), "party_id")
    return apportion.allocate(votes, [], DEFAULT.total_seats, DEFAULT.threshold).select("party_id", r6("share").alias("share"), "qualifies", "seats")


query("flagship", f"""WITH {AVERAGE}, vv AS (SELECT a.party_id, round(share, 6) AS votes, ord, partner FROM avgs a JOIN party USING (party_id)), {allocation_sql("vv", "", 120, 0.0325)}
SELECT party_id, round(share, 6) AS share, qualifies, seats FROM alloc""")(flagship)


def observations(spark, sf) -> DataFrame:
    """All readings: party_id, pollster, day, value, weights; one pollster is unattributed."""
    rows = weighed(spark, sf).withColumns({
        "static": F.col("sample") * F.col("quality") * F.col("mode_weight"), "kernel": F.col("sample") * F.col("quality") * F.col("mode_weight") * F.col("completeness")
    })
    return views.reading(spark, sf).join(rows, F.col("poll_id") == F.col("id")).select(
        "poll_id", "party_id", "pollster", F.col("date").alias("day"), (F.col("seats") / 1000).alias("value"), "static", "kernel", "weight", (F.col("pollster") != "MACHINERY").alias("attributed")
    )


def _kernel_sql(c: str) -> str:
    """The kernel's sum of a column by running sums over the days before and after."""
    return f"sum({c} * e) OVER up / e + sum({c} / e) OVER down * e - {c} AS {c}"


OBS = f"""{PRELUDE}, obs AS MATERIALIZED (
  SELECT poll_id, party_id, pollster, date AS day, seats / 1000 AS value, sample * quality * mode_weight AS static, sample * quality * mode_weight * completeness AS kernel, weight, pollster <> 'MACHINERY' AS attributed
  FROM reading JOIN w ON poll_id = id),
src AS (SELECT party_id, pollster, day, sum(value * kernel) AS a, sum(kernel) AS w FROM obs GROUP BY ALL),
kd AS (SELECT party_id, pollster, day, coalesce(a, 0) AS a, coalesce(src.w, 0) AS w, pow(2.0, date_diff('day', DATE '1995-06-01', day) / 14.0) AS e
  FROM (SELECT DISTINCT party_id, day FROM obs) JOIN (SELECT DISTINCT party_id, pollster FROM obs) USING (party_id) LEFT JOIN src USING (party_id, pollster, day)),
ks AS MATERIALIZED (SELECT party_id, pollster, day, {_kernel_sql('a')}, {_kernel_sql('w')} FROM kd
  WINDOW up AS (PARTITION BY party_id, pollster ORDER BY day), down AS (PARTITION BY party_id, pollster ORDER BY day DESC))"""


@query("kernel_loo", f"""WITH {OBS}
SELECT i.party_id, i.day, i.pollster, round(sum(j.a) / sum(j.w), 6) AS consensus, round(sum(j.w), 4) AS weight
FROM ks i LEFT JOIN ks j ON i.party_id = j.party_id AND i.day = j.day AND i.pollster <> j.pollster GROUP BY ALL""", ("day",))
def kernel_loo(spark, sf):
    out = house.leave_one_out(house.kernel_sums(observations(spark, sf), "value", "kernel"))
    return out.select("party_id", "day", "pollster", r6("consensus").alias("consensus"), F.round("weight", 4).alias("weight"))


def _effect_sql(name: str, before: str | None) -> str:
    a = "j.a" if before is None else "j.a - coalesce(e.effect, 0) * j.w"
    join = "" if before is None else f"LEFT JOIN {before} e ON e.pollster = j.pollster AND e.party_id = j.party_id"
    return f"""{name}_c AS (SELECT i.party_id, i.day, i.pollster, sum({a}) / sum(j.w) AS consensus FROM ks i JOIN ks j ON i.party_id = j.party_id AND i.day = j.day AND i.pollster <> j.pollster {join} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT o.pollster, o.party_id, sum(greatest(-0.03, least(0.03, value - consensus)) * static) / sum(static) * count(*) / (count(*) + 3.0) AS effect, count(*) AS n
  FROM obs o JOIN {name}_c c ON o.party_id = c.party_id AND o.day = c.day AND o.pollster = c.pollster WHERE o.attributed GROUP BY ALL)"""


@query("house_effect_step", f"WITH {OBS}, {_effect_sql('h1', None)} SELECT pollster, party_id, round(effect, 6) AS effect, n FROM h1")
def house_effect_step(spark, sf):
    obs = observations(spark, sf)
    out = house.effect_step(obs, house.kernel_sums(obs, "value", "kernel"), None, "value", "static")
    return out.select("pollster", "party_id", r6("effect").alias("effect"), "n")


ROUNDS = 12


@query("house_effects", f"""WITH {OBS}, {', '.join(_effect_sql(f'h{i}', f'h{i - 1}' if i > 1 else None) for i in range(1, ROUNDS + 1))}, pw AS (SELECT pollster, sum(weight) AS w FROM w GROUP BY pollster)
SELECT z.pollster, party_id, round(effect - sum(effect * w) OVER (PARTITION BY party_id) / sum(w) OVER (PARTITION BY party_id), 6) AS effect, n FROM h{ROUNDS} z JOIN pw ON z.pollster = pw.pollster""")
def house_effects(spark, sf):
    total = weighed(spark, sf).groupBy("pollster").agg(F.sum("weight").alias("weight"))
    out = house.house_effects(observations(spark, sf), "value", "kernel", "static", total, ROUNDS)
    return out.select("pollster", "party_id", r6("effect").alias("effect"), "n")


@query("zero_sum_center", f"WITH {VOTES}, {PARTIES} SELECT party_id, bloc, round(votes / 1000 - avg(votes / 1000) OVER (PARTITION BY bloc), 3) AS residual FROM v JOIN pt USING (party_id)")
def zero_sum_center(spark, sf):
    rows = nation_votes(spark, sf).withColumn("residual", F.col("votes") / 1000)
    return calibration.zero_sum(rows, "residual", ["bloc"]).select("party_id", "bloc", F.round("residual", 3).alias("residual"))


def misses(spark, sf) -> DataFrame:
    """Yearly averages of even orders ("polled") and odd orders ("actual") by region."""
    orders, customer, party = table(spark, sf, "orders"), table(spark, sf, "customer"), views.party(spark, sf)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(party), F.col("c_nationkey") == F.col("party_id"))
    odd = F.col("o_orderkey") % 2 == 1
    rows = rows.groupBy(F.make_date(F.year("o_orderdate"), F.lit(11), F.lit(1)).alias("date"), F.col("bloc").alias("grp")).agg(
        (F.avg(F.when(~odd, F.col("o_totalprice"))) / 5000).alias("polled"), (F.avg(F.when(odd, F.col("o_totalprice"))) / 5000).alias("actual")
    )
    return rows.where("polled is not null and actual is not null").withColumn("confidence", F.when(F.year("date") % 2 == 0, "firm").otherwise("approx"))


MISSES = """ms AS (SELECT make_date(year(o_orderdate), 11, 1) AS date, r_name AS grp, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 5000 AS polled, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) / 5000 AS actual
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
mw AS (SELECT *, actual - polled AS m, pow(0.5, (dense_rank() OVER (ORDER BY date DESC) - 1) / 1.5) * CASE WHEN year(date) % 2 = 0 THEN 1.0 ELSE 0.6 END AS w FROM ms WHERE polled IS NOT NULL AND actual IS NOT NULL),
mg AS (SELECT grp, count(*) AS n, sum(m * w) / sum(w) AS raw, coalesce(stddev_samp(m), abs(avg(m))) AS sd FROM mw GROUP BY grp),
mc AS (SELECT grp, n, raw, sd, greatest(-2.5, least(2.5, raw * n / (n + 3.0))) AS capped FROM mg),
mz AS (SELECT *, capped - avg(capped) OVER () AS applied FROM mc)"""
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("calibration", f"WITH {MISSES} SELECT grp, n, round(raw, 6) AS raw, round(sd, 6) AS sd, round(applied, 6) AS applied FROM mz")
def calibration_groups(spark, sf):
    out = calibration.calibrate_groups(misses(spark, sf), REGIONS)
    return out.select("grp", "n", r6("raw").alias("raw"), r6("sd").alias("sd"), r6("applied").alias("applied"))


@query("calibration_parties", f"""WITH {MISSES}, {SUPPLIED}, {PARTIES}, a AS (
  SELECT pt.party_id, bloc, coalesce(applied * votes / sum(votes) OVER (PARTITION BY bloc), 0) * 0.955 / 120 AS adj FROM sv JOIN pt USING (party_id) LEFT JOIN mz ON bloc = grp)
SELECT party_id, bloc, round(adj - avg(adj) OVER (), 8) AS adjustment FROM a""")
def calibration_parties(spark, sf):
    groups = calibration.calibrate_groups(misses(spark, sf), REGIONS)
    rows = supplier_votes(spark, sf).withColumn("strength", F.col("votes"))
    return calibration.calibrate_parties(groups, rows).select("party_id", "bloc", F.round("adjustment", 8).alias("adjustment"))


@query("calibration_totals", f"""WITH {MISSES}, {SUPPLIED}, {PARTIES}, a AS (
  SELECT coalesce(applied * votes / sum(votes) OVER (PARTITION BY bloc), 0) * 0.955 / 120 AS adj FROM sv JOIN pt USING (party_id) LEFT JOIN mz ON bloc = grp), b AS (SELECT adj - avg(adj) OVER () AS adj FROM a)
SELECT (SELECT round(avg(sd) * 0.955 / 120, 8) FROM mz) AS implied_sd, round(sum(abs(adj / 0.955 * 120)), 6) AS seats_moved FROM b""")
def calibration_total(spark, sf):
    groups = calibration.calibrate_groups(misses(spark, sf), REGIONS)
    parties = calibration.calibrate_parties(groups, supplier_votes(spark, sf).withColumn("strength", F.col("votes")))
    return calibration.calibration_totals(groups, parties, REGIONS).select(F.round("implied_sd", 8).alias("implied_sd"), r6("seats_moved").alias("seats_moved"))


def attention(spark, sf) -> DataFrame:
    per = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("party_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.avg("value").alias("m"))
    day = W.partitionBy("day")
    return per.select("day", "party_id", (F.col("n") / F.sum("n").over(day)).alias("volume_share"), (F.col("v") / F.sum("v").over(day)).alias("engagement_share"), F.least(F.lit(1.0), F.col("m") / 1000).alias("sentiment"))


@query("momentum", """WITH p AS (SELECT ts::DATE AS day, event_type AS party_id, count(*) AS n, sum(value) AS v, avg(value) AS m FROM events GROUP BY ALL),
o AS (SELECT day, party_id, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS vol, v / sum(v) OVER (PARTITION BY day) AS eng, least(1.0, m / 1000) AS sen, date_diff('day', day, DATE '2024-01-30') AS age FROM p),
g AS (SELECT party_id,
  coalesce((0.35 * avg(vol) FILTER (age BETWEEN 0 AND 6) + 0.65 * avg(eng) FILTER (age BETWEEN 0 AND 6)) * (1 + 0.25 * avg(sen) FILTER (age BETWEEN 0 AND 6)), 0) AS recent,
  coalesce((0.35 * avg(vol) FILTER (age BETWEEN 7 AND 27) + 0.65 * avg(eng) FILTER (age BETWEEN 7 AND 27)) * (1 + 0.25 * avg(sen) FILTER (age BETWEEN 7 AND 27)), 0) AS baseline FROM o WHERE age BETWEEN 0 AND 27 GROUP BY party_id),
m AS (SELECT *, CASE WHEN baseline > 0 THEN greatest(-0.4, least(0.4, (recent - baseline) / baseline)) ELSE 0 END AS momentum FROM g)
SELECT party_id, round(recent, 6) AS recent, round(baseline, 6) AS baseline, round(momentum, 6) AS momentum, round(momentum * 0.015 * 0.5 - avg(momentum * 0.015 * 0.5) OVER (), 8) AS adjustment FROM m""")
def momentum(spark, sf):
    out = calibration.momentum(attention(spark, sf), F.lit("2024-01-30").cast("date"))
    return out.select("party_id", *[r6(c).alias(c) for c in ("recent", "baseline", "momentum")], F.round("adjustment", 8).alias("adjustment"))


def _uniform_sql(source: str) -> str:
    return f"""s1 AS (SELECT n, (42 + (n + 1) * 1831565813) % 4294967296 AS s FROM {source}),
s2 AS (SELECT n, ((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296)::BIGINT AS t FROM s1),
s3 AS (SELECT n, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT) AS t FROM s2),
un AS (SELECT n, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM s3)"""


@query("uniforms", f"WITH g AS (SELECT range AS n FROM range(10000)), {_uniform_sql('g')} SELECT n, round(u, 10) AS u FROM un")
def uniform_numbers(spark, sf):
    return montecarlo.uniforms(spark, 42, 10_000).select("n", F.round("u", 10).alias("u"))


def _normal_sql(pairs: int) -> str:
    return f"""g AS (SELECT range AS n FROM range({2 * pairs})), {_uniform_sql('g')},
pr AS (SELECT a.n // 2 AS k, a.u * 2 - 1 AS u, b.u * 2 - 1 AS v FROM un a JOIN un b ON b.n = a.n + 1 WHERE a.n % 2 = 0),
ac AS (SELECT *, u * u + v * v AS s, row_number() OVER (ORDER BY k) - 1 AS j FROM pr WHERE u * u + v * v > 0 AND u * u + v * v < 1),
nz AS (SELECT 2 * j AS n, u * sqrt(-2 * ln(s) / s) AS z FROM ac UNION ALL SELECT 2 * j + 1, v * sqrt(-2 * ln(s) / s) FROM ac)"""


@query("normals", f"WITH {_normal_sql(7000)} SELECT n, round(z, 8) AS z FROM nz WHERE n < 10000")
def normal_numbers(spark, sf):
    return montecarlo.normals(spark, 42, 10_000).select("n", F.round("z", 8).alias("z"))


SIMS, DAYS = DEFAULT.simulations, 30


def simulated(spark, sf) -> DataFrame:
    """All draws over nations by supplied revenue, which sums to 0.97."""
    votes = supplier_votes(spark, sf)
    total = F.sum("votes").over(W.partitionBy())
    shares = votes.select("party_id", F.round(F.col("votes") / total * 0.97, 8).alias("share"), "bloc", "ord", "partner")
    return montecarlo.draws(shares, 42, SIMS, REGIONS, "ASIA", DAYS)


#: Lists, blocs and the turnout: the most normals that a draw takes.
WIDTH = 25 + len(REGIONS) + 1


def draw_runs_sql(sims: int) -> str:
    """CTE ``dr`` (rs, run, sim, party_id, bloc, ord, share, qualifies, seats): the draws of the CTE ``ct`` (run, party_id,
    bloc, ord, partner, share, other, seed, bloc_sd, party_sd, scale, threshold)."""
    blocs = ", ".join(f"('{b}', {i})" for i, b in enumerate(REGIONS))
    pairs = math.ceil(sims * WIDTH / 2 / (math.pi / 4) * 1.03) + 64
    return f"""bl(bloc, place) AS (VALUES {blocs}),
lv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) AS slot, sum(share) OVER (PARTITION BY run, bloc) AS bs, count(*) OVER (PARTITION BY run) + {len(REGIONS) + 1} AS width, dense_rank() OVER (ORDER BY run) - 1 AS no FROM ct JOIN bl USING (bloc) WHERE share > 0),
g AS (SELECT seed, range AS n FROM (SELECT DISTINCT seed FROM lv), range({2 * pairs})),
s1 AS (SELECT seed, n, (seed + (n + 1) * 1831565813) % 4294967296 AS s FROM g),
s2 AS (SELECT seed, n, ((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296)::BIGINT AS t FROM s1),
s3 AS (SELECT seed, n, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT) AS t FROM s2),
pr AS (SELECT seed, n // 2 AS k, min(xor(t, t >> 14) / 4294967296.0::DOUBLE) FILTER (n % 2 = 0) * 2 - 1 AS u, min(xor(t, t >> 14) / 4294967296.0::DOUBLE) FILTER (n % 2 = 1) * 2 - 1 AS v FROM s3 GROUP BY 1, 2),
ac AS MATERIALIZED (SELECT *, u * u + v * v AS s, row_number() OVER (PARTITION BY seed ORDER BY k) - 1 AS j FROM pr WHERE u * u + v * v > 0 AND u * u + v * v < 1),
nz AS (SELECT seed, 2 * j AS n, u * sqrt(-2 * ln(s) / s) AS z FROM ac UNION ALL SELECT seed, 2 * j + 1, v * sqrt(-2 * ln(s) / s) FROM ac),
zz AS MATERIALIZED (SELECT seed, width, n // width AS sim, list(z ORDER BY n) AS z FROM nz JOIN (SELECT DISTINCT seed, width FROM lv) USING (seed) WHERE n < width * {sims} GROUP BY ALL),
dv AS (SELECT no * {sims} + sim AS rs, run, sim, party_id, bloc, ord, partner, threshold, greatest(0.004, other) AS rest,
    greatest(0.0002, share + (z[place + 1] * bloc_sd * scale * sqrt(greatest(0.02, bs) / 0.45) + CASE WHEN bloc = 'ASIA' THEN z[{len(REGIONS) + 1}] * 0.006 * 2.5 ELSE 0 END) * share / bs
    + z[{len(REGIONS) + 1} + slot] * party_sd * greatest(0.35, least(1.8, sqrt(share / 0.1))) * scale) AS raw FROM lv JOIN zz USING (seed, width)),
dn AS MATERIALIZED (SELECT rs, run, sim, party_id, bloc, ord, partner, threshold, raw / (sum(raw) OVER (PARTITION BY rs) + rest) AS votes FROM dv),
du AS (SELECT * FROM dn UNION ALL SELECT rs, run, sim, -1, NULL, 1073741824, NULL, threshold, 1 - sum(votes) FROM dn GROUP BY rs, run, sim, threshold),
{allocation_sql("du", "rs", 120, "threshold", True)},
dr AS (SELECT dn.rs, dn.run, dn.sim, dn.party_id, bloc, ord, a.share, qualifies, seats FROM alloc a JOIN dn ON a.rs = dn.rs AND a.party_id = dn.party_id)"""


def _draw_sql(sims: int = SIMS, days: int = DAYS) -> str:
    return f"""{SUPPLIED}, {PARTIES}, ct AS (SELECT 0 AS run, party_id, bloc, ord, partner, round(votes / sum(votes) OVER () * 0.97, 8) AS share, 0.03 AS other, 42 AS seed, 0.028 AS bloc_sd, 0.011 AS party_sd, {1 + 0.3 * days / 30} AS scale, 0.0325 AS threshold FROM sv JOIN pt USING (party_id)),
{draw_runs_sql(sims)}"""


DRAWS = _draw_sql()


@query("mc_draws", f"WITH {DRAWS} SELECT sim, party_id, round(share, 6) AS share, qualifies, seats FROM dr WHERE sim < 2000")
def mc_draws(spark, sf):
    """The retained sample of all draws."""
    return montecarlo.retained(simulated(spark, sf)).select("sim", "party_id", r6("share").alias("share"), "qualifies", "seats")


@query("mc_summary", f"""WITH {DRAWS}, b AS (SELECT sim, party_id FROM (SELECT sim, party_id, row_number() OVER (PARTITION BY sim ORDER BY seats DESC, ord) AS r FROM dr) WHERE r = 1)
SELECT dr.party_id, round(avg(seats), 6) AS mean, quantile_cont(seats, 0.5)::DOUBLE AS median, quantile_cont(seats, 0.1)::DOUBLE AS low, quantile_cont(seats, 0.9)::DOUBLE AS high,
  round(avg((seats > 0)::INT), 6) AS p_seats, round(avg((b.party_id = dr.party_id)::INT), 6) AS p_largest FROM dr JOIN b USING (sim) GROUP BY 1""")
def mc_summary(spark, sf):
    """Quantiles from seat counts, which add up over pieces of the draws."""
    out = montecarlo.summary_of_counts(montecarlo.seat_counts(simulated(spark, sf)))
    return out.select("party_id", r6("mean").alias("mean"), "median", "low", "high", r6("p_seats").alias("p_seats"), r6("p_largest").alias("p_largest"))


@query("mc_blocs", f"WITH {DRAWS}, b AS (SELECT sim, bloc, sum(seats) AS seats FROM dr GROUP BY ALL) SELECT bloc, round(avg(seats), 6) AS mean, round(avg((seats >= 61)::INT), 6) AS p_majority FROM b GROUP BY bloc")
def mc_blocs(spark, sf):
    return montecarlo.bloc_summary(simulated(spark, sf)).select("bloc", r6("mean").alias("mean"), r6("p_majority").alias("p_majority"))


SCENARIOS = (("east", 0.8, ("ASIA", "MIDDLE EAST")), ("west", 0.5, ("AMERICA", "EUROPE")), ("south", 0.3, ("AFRICA", "AMERICA", "ASIA")))


@query("scenario_prob", f"""WITH {DRAWS}, sc(scenario, plausibility, bloc) AS (VALUES {", ".join(f"('{s}', {p}, '{b}')" for s, p, bs in SCENARIOS for b in bs)}),
b AS (SELECT scenario, plausibility, sim, sum(seats) AS seats FROM dr JOIN sc USING (bloc) GROUP BY ALL)
SELECT scenario, round(avg((seats >= 61)::INT), 6) AS probability, round(avg(seats), 6) AS mean FROM b GROUP BY scenario""")
def scenario_prob(spark, sf):
    return scenario_rows(spark, sf, simulated(spark, sf)).select("scenario", r6("probability").alias("probability"), r6("mean").alias("mean"))


def scenario_members(spark, sf) -> DataFrame:
    sets = spark.createDataFrame([(s, p, list(b)) for s, p, b in SCENARIOS], "scenario string, plausibility double, blocs array<string>")
    return sets.select("scenario", "plausibility", F.explode("blocs").alias("bloc")).join(views.party(spark, sf), "bloc").select("scenario", "plausibility", "party_id")


def scenario_rows(spark, sf, rows: DataFrame) -> DataFrame:
    return montecarlo.scenarios(rows, scenario_members(spark, sf))


@query("pm_outlook", f"""WITH {DRAWS}, s AS (SELECT sim, coalesce(sum(seats) FILTER (bloc = 'AMERICA'), 0) AS a, coalesce(sum(seats) FILTER (bloc = 'ASIA'), 0) AS b, coalesce(sum(seats) FILTER (bloc = 'EUROPE'), 0) AS c FROM dr GROUP BY sim),
l AS (SELECT sim, party_id FROM (SELECT sim, party_id, row_number() OVER (PARTITION BY sim ORDER BY seats DESC, ord) AS r FROM dr WHERE bloc = 'ASIA') WHERE r = 1),
o AS (SELECT CASE WHEN a >= 61 THEN '1' WHEN b >= 61 OR b + c >= 61 THEN l.party_id::VARCHAR ELSE 'deadlock' END AS winner, CASE WHEN a >= 61 OR b >= 61 THEN 1.0 WHEN b + c >= 61 THEN 0.45 ELSE 1.0 END AS credit FROM s LEFT JOIN l USING (sim)
  UNION ALL SELECT 'deadlock', 0.55 FROM s WHERE a < 61 AND b < 61 AND b + c >= 61)
SELECT winner, round(sum(credit)::DOUBLE / {SIMS}, 6) AS probability FROM o GROUP BY winner""")
def pm_outlook(spark, sf):
    return montecarlo.outlook(simulated(spark, sf), "AMERICA", 1, "ASIA", "EUROPE").select("winner", r6("probability").alias("probability"))


@query("contribution_sets", f"WITH {PRELUDE} SELECT mode, pollster, grouping(mode, pollster)::BIGINT AS gid, count(*) AS n, round(sum(weight), 4) AS weight FROM w GROUP BY GROUPING SETS ((mode), (pollster), ())")
def contribution_sets(spark, sf):
    return weights.contributions(weighed(spark, sf), "mode", "pollster").withColumn("weight", F.round("weight", 4))


#: The outlets' kinds of source; one outlet has none.
KINDS = {"1-URGENT": "press", "2-HIGH": "press", "3-MEDIUM": "broadcast", "4-NOT SPECIFIED": "archive"}


@query("source_legend", f"""WITH {PRELUDE}, kd(mode, kind) AS (VALUES {", ".join(f"('{m}', '{k}')" for m, k in KINDS.items())})
SELECT kind, count(*) AS n, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS share FROM w LEFT JOIN kd USING (mode) GROUP BY kind""")
def source_legend(spark, sf):
    kinds = spark.createDataFrame(list(KINDS.items()), "mode string, kind string")
    return weights.legend(weighed(spark, sf), kinds, "mode").withColumn("share", r6("share"))


@query("calibration_panel", f"""WITH {MISSES}, {SUPPLIED}, {PARTIES}, a AS (
  SELECT pt.party_id, coalesce(applied * votes / sum(votes) OVER (PARTITION BY bloc), 0) * 0.955 / 120 AS adj FROM sv JOIN pt USING (party_id) LEFT JOIN mz ON bloc = grp), m AS (SELECT party_id, (adj - avg(adj) OVER ()) / 0.955 * 120 AS moved FROM a)
SELECT party_id, round(moved, 6) AS moved FROM m WHERE abs(moved) >= 0.05""")
def calibration_panel(spark, sf):
    groups = calibration.calibrate_groups(misses(spark, sf), REGIONS)
    rows = calibration.calibrate_parties(groups, supplier_votes(spark, sf).withColumn("strength", F.col("votes")))
    return calibration.panel(rows).select("party_id", r6("moved").alias("moved"))


@query("calibration_record", f"WITH {MISSES} SELECT date, grp, round(m, 6) AS miss, CASE WHEN year(date) % 2 = 0 THEN 'firm' ELSE 'approx' END AS confidence FROM mw", ("date",))
def calibration_record(spark, sf):
    return calibration.record(misses(spark, sf)).withColumn("miss", r6("miss"))


@query("risk_bands", f"""WITH {DRAWS}, p AS (SELECT party_id, avg((seats > 0)::INT) AS p FROM dr GROUP BY 1), b(band, low, high) AS (VALUES ('report', 0.02, 0.97), ('site', 0.01, 0.999), ('bar', 0.02, 0.97), ('table', 0.02, 0.98))
SELECT band, party_id, round(p, 6) AS p_seats FROM p JOIN b ON p > low AND p < high""")
def risk_bands(spark, sf):
    """The parties at risk by each reader's band."""
    chances = montecarlo.summary_of_counts(montecarlo.seat_counts(simulated(spark, sf))).checkpoint()
    bands = [report.at_risk(chances, *band).withColumn("band", F.lit(name)) for name, band in reporting.RISK_BANDS.items()]
    return functools.reduce(DataFrame.unionByName, bands).select("band", "party_id", r6("p_seats").alias("p_seats"))


@query("top_effects", f"""WITH {PRELUDE}, e AS (SELECT pollster, party_id, round(avg(seats), 6) - 25 AS effect FROM reading JOIN poll ON poll_id = id GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pollster ORDER BY abs(effect) DESC, party_id) AS rank FROM e) WHERE rank <= 5""")
def top_effects(spark, sf):
    rows = views.reading(spark, sf).join(views.poll(spark, sf), F.col("poll_id") == F.col("id")).groupBy("pollster", "party_id").agg((F.round(F.avg("seats"), 6) - 25).alias("effect"))
    return report.top(rows, ["pollster"], "effect", 5, "party_id").withColumn("rank", F.col("rank").cast("long"))


@query("pct_guard", """WITH p AS (SELECT doc_id, quality / 1.0 AS a, (doc_id % 1001) / 1000.0 AS p FROM labels), q AS (SELECT doc_id, p, floor(p * 100 + 0.5)::INT AS w FROM p)
SELECT doc_id, CASE WHEN p <= 0 THEN '0%' WHEN p >= 1 THEN '100%' WHEN w >= 100 THEN '>99%' WHEN w <= 0 THEN '<1%' ELSE w || '%' END AS text,
CASE WHEN p >= 0.95 THEN 'almost certain' WHEN p >= 0.8 THEN 'very likely' WHEN p >= 0.6 THEN 'likely' WHEN p >= 0.55 THEN 'leaning' WHEN p >= 0.45 THEN 'even' WHEN p >= 0.35 THEN 'leaning against' WHEN p >= 0.2 THEN 'unlikely' WHEN p >= 0.05 THEN 'very unlikely' ELSE 'remote' END AS word FROM q""")
def guarded(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", ((F.col("doc_id") % 1001) / F.lit(1000.0)).alias("p"))
    return rows.select("doc_id", pct_guard(F.col("p")).alias("text"), probability_word(F.col("p")).alias("word"))


@query("chamber_layout", f"""WITH {SUPPLIED}, {PARTIES}, cs AS (SELECT sv.party_id, votes / sum(votes) OVER () * 0.97 AS votes, ord, partner FROM sv JOIN pt USING (party_id)),
vv AS (SELECT * FROM cs UNION ALL SELECT -1, 1 - sum(votes), 1073741824, NULL FROM cs), {allocation_sql("vv", "", 120, 0.0325)},
wn AS (SELECT a.party_id, bloc, seats, sum(seats) OVER (ORDER BY bloc, seats DESC, a.party_id ROWS UNBOUNDED PRECEDING) AS stop FROM alloc a JOIN pt USING (party_id) WHERE seats > 0),
ar AS (SELECT arc, 74 + 26.0::DOUBLE * arc AS r, (SELECT sum(seats) FROM wn) AS total FROM range(5) t(arc)),
ro AS (SELECT *, greatest(1, floor(total * r / sum(r) OVER () + 0.5))::INT AS n0 FROM ar),
rs AS (SELECT *, (n0 + CASE WHEN 4 - arc < abs(total - sum(n0) OVER ()) THEN sign(total - sum(n0) OVER ()) ELSE 0 END)::INT AS n FROM ro),
sp AS (SELECT arc::INT AS arc, r, CASE WHEN n > 1 THEN 180.0::DOUBLE * i / (n - 1) ELSE 90.0 END AS angle FROM (SELECT *, unnest(range(n)) AS i FROM rs)),
pl AS (SELECT *, (row_number() OVER (ORDER BY angle, r) - 1)::INT AS place FROM sp)
SELECT place, arc, round(angle, 6) AS angle, party_id FROM pl JOIN wn ON place >= stop - seats AND place < stop""")
def chamber_layout(spark, sf):
    """The chamber of the central shares, with what no list has as a list of its own."""
    votes = supplier_votes(spark, sf)
    shares = votes.withColumn("votes", F.col("votes") / F.sum("votes").over(W.partitionBy()) * 0.97)
    won = apportion.allocate(apportion.with_rest(shares, []), [], 120, 0.0325).join(views.party(spark, sf).select("party_id", "bloc"), "party_id")
    return apportion.chamber(won, "party_id", "seats", "bloc")


def sweep_votes(spark, sf, half_lives) -> DataFrame:
    polls = views.poll(spark, sf)
    rows = polls.crossJoin(F.broadcast(spark.createDataFrame([(float(h),) for h in half_lives], "half_life double")))  # a few configurations
    rows = weights.weigh(rows, views.last_date(polls), views.grades(spark), half_life=F.col("half_life"), modes=MODES)
    rows = views.reading(spark, sf).join(rows.select(F.col("id").alias("poll_id"), "half_life", "weight"), "poll_id")
    return weights.weighted_average(rows.withColumn("value", F.col("seats") / 1000), ["half_life", "party_id"], "value", "weight")


@query("what_if_sweep", f"""WITH {PRELUDE}, hl(half_life) AS (VALUES (7.0::DOUBLE), (14.0), (28.0)),
sw AS (SELECT half_life, party_id, greatest(0.0005, sum(seats / 1000 * pow(0.5, greatest(date_diff('day', date, newest.d), 0) / half_life) * sample * quality * mode_weight * completeness) / sum(pow(0.5, greatest(date_diff('day', date, newest.d), 0) / half_life) * sample * quality * mode_weight * completeness)) AS share
  FROM reading JOIN weighed ON poll_id = id CROSS JOIN hl CROSS JOIN newest GROUP BY ALL),
vv AS (SELECT half_life, s.party_id, round(share, 6) AS votes, ord, partner FROM sw s JOIN party USING (party_id)), {allocation_sql("vv", "half_life", 120, 0.0325)}
SELECT half_life, a.party_id, seats, seats - b.base AS delta FROM alloc a JOIN (SELECT party_id, seats AS base FROM alloc WHERE half_life = 14) b USING (party_id)""")
def what_if_sweep(spark, sf):
    votes = sweep_votes(spark, sf, (7, 14, 28)).select("half_life", "party_id", F.round("share", 6).alias("votes")).join(F.broadcast(views.party(spark, sf)), "party_id")
    won = apportion.allocate(votes, ["half_life"], 120, 0.0325).select("half_life", "party_id", "seats")
    base = won.where("half_life = 14").select("party_id", F.col("seats").alias("base"))
    return won.join(base, "party_id").select("half_life", "party_id", "seats", (F.col("seats") - F.col("base")).alias("delta"))


@query("ipf_inversion")
def ipf_inversion(spark, sf):
    seats = apportion.largest_averages(nation_votes(spark, sf, True), ["year"], 120, "party_id").withColumn("ord", F.col("party_id")).withColumn("seats", F.col("seats").cast("double"))
    out = apportion.invert_seats(seats, 120, "year")
    again = apportion.largest_averages(out.withColumn("ord", F.col("party_id")), ["year"], 120, "party_id").withColumnRenamed("seats", "again")
    return out.join(again, ["year", "party_id"]).select("year", "party_id", "seats", r6("votes").alias("votes"), (F.col("again") - F.col("seats")).cast("int").alias("error"))


@query("ipf_agreements", f"""WITH mv AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey::INT AS party_id, round(sum(l_extendedprice), 2) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
{PARTIES}, vv AS (SELECT month, mv.party_id, votes, ord, partner FROM mv JOIN pt USING (party_id)), {allocation_sql("vv", "month", 120, 0.0325, True)}
SELECT month, party_id, seats, 0 AS error FROM alloc WHERE month IN (SELECT month FROM alloc GROUP BY month HAVING sum(seats) = 120)""")
def ipf_agreements(spark, sf):
    """Every month's seats back to votes with the agreements, and to seats again: the round trip has no error."""
    lines, orders, customer = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    votes = joined.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_nationkey").cast("int").alias("party_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("votes"))
    party = views.party(spark, sf)
    seats = apportion.allocate(votes.join(F.broadcast(party), "party_id"), ["month"], 120, 0.0325).select("month", "party_id", "seats").checkpoint()  # 25 rows of parties
    out = apportion.invert_seats(seats.join(F.broadcast(party), "party_id"), 120, "month", partner="partner")
    again = apportion.allocate(out.join(F.broadcast(party), "party_id"), ["month"], 120, 0.0).select("month", "party_id", F.col("seats").alias("again"))
    return out.join(again, ["month", "party_id"]).select("month", "party_id", F.col("seats").cast("int").alias("seats"), (F.col("again") - F.col("seats")).cast("int").alias("error"))
