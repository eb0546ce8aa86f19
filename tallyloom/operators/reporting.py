"""Reports from data: a table of sentences with placeholders, joined to a table of facts.

``facts`` makes one row for each run: a map of names to text, and lists that are made of one small sentence for each
row (a party at risk, a change, a coalition) in order. ``render`` fills the sentences of every section, leaves out those
whose condition is not a fact of the run, and puts them together by ordered aggregation; ``documents`` and ``markdown``
write that as JSON and as Markdown. All tables have a few rows for each run, and all runs are rendered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.scalars import long_date

#: The bands of a chance that make a party "at risk" in the report, on the site, in a bar and in a table.
RISK_BANDS = {"report": (0.02, 0.97), "site": (0.01, 0.999), "bar": (0.02, 0.97), "table": (0.02, 0.98)}
#: What counts as a change of seats in the report and the simulator, and as an effect, a chance, a correction.
LEAST = {"movement": 0.3, "what_if": 0.1, "effect": 0.001, "chance": 0.001, "calibration": 0.05}

#: (section, sentence, condition, text): sections and sentences in order. A sentence stands if its condition is empty or
#: names a fact of the run; a section without a sentence is left out.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("State of play", "", "On {date}, {days} days before the election, the forecast rests on {used} polls with a weight that counts, worth {effective} full polls."),
    ("State of play", "", "{first} has {first_seats} seats on average (80 % between {first_low} and {first_high}), {second} has {second_seats} ({second_low} to {second_high})."),
    ("State of play", "", "{first} is the largest party with a chance of {first_largest}, {second} with {second_largest}."),
    ("State of play", "", "The largest party need not form the government: that takes {majority} supporters."),
    ("Blocs", "", "{blocs}."),
    ("Blocs", "", "No bloc has a majority and no support from outside decides it in {deadlock} of the draws."),
    ("Threshold", "risk", "{risk_count} parties may pass or fail the threshold of {threshold}: {risk}."),
    ("Threshold", "risk", "{risk_first_bloc} of them belong to {first_bloc}; a list that fails loses all its seats, and its votes count for the others."),
    ("Movement", "moved", "Since {before}: {moved}."),
    ("Movement", "still", "Nothing moved by {least} seats or more since {before}."),
    ("Coalitions", "coalitions", "{coalitions}."),
    ("Coalitions", "coalitions", "Arithmetic and plausibility are kept apart: the first is counted, the second is judged."),
    ("Government", "leader", "Most likely to lead: {leader}, {leader_chance}."),
    ("Government", "others", "Then {others}."),
    ("Government", "", "Undecided: {deadlock}."),
    ("Limits", "", "Errors are taken as {inflation} times those of election day, for the distance."),
    ("Limits", "social", "Momentum moves a party by {social_cap} points at most."),
    ("Limits", "no_social", "Momentum does not count in this forecast."),
    ("Limits", "", "An error that all polls share is in no interval."),
)

#: The bullets of the summary card: condition and text.
BULLETS: tuple[tuple[str, str], ...] = (
    ("", "{first} {first_seats}, {second} {second_seats}"), ("", "{bloc_lines}"), ("", "Undecided: {deadlock}"),
    ("risk", "{risk_count} parties at the threshold"), ("no_risk", "No party at the threshold"),
)


def seats_text(x: Column) -> Column:
    """One decimal, without ``.0``."""
    return F.regexp_replace(F.format_string("%.1f", F.round(x, 1)), r"\.0$", "")


def percent(x: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(x * 100, digits)), F.lit("%"))


def _whole(x: Column) -> Column:
    return F.round(x).cast("int").cast("string")


def _listed(rows: DataFrame, name: str, order: list[Column], text: Column, between: str) -> DataFrame:
    """(run, name): the texts of a run's rows in order, joined."""
    items = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), text.alias("t"))))
    return rows.groupBy("run").agg(F.array_join(F.transform(items, lambda x: x["t"]), between).alias(name))


def ranked(parties: DataFrame) -> DataFrame:
    """Parties of each run with their place by mean seats (ties: the party that is listed first)."""
    return parties.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy(F.col("mean").desc(), "ord")))


def headlines(parties: DataFrame, names: DataFrame) -> DataFrame:
    """(run, headline): the first party and its lead, or that two are level (less than a seat apart)."""
    rows = ranked(parties.join(F.broadcast(names.select("party_id", "name", "ord")), "party_id")).where("place <= 2")  # a row a party
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    two = rows.groupBy("run").agg(at("name", 1).alias("a"), at("name", 2).alias("b"), at("mean", 1).alias("x"), at("mean", 2).alias("y"))
    lead = F.concat(F.col("a"), F.lit(" leads with "), seats_text(F.col("x")), F.lit(" seats"), F.coalesce(F.concat(F.lit(", "), seats_text(F.col("x") - F.col("y")), F.lit(" before "), F.col("b")), F.lit("")))
    level = F.concat(F.col("a"), F.lit(" and "), F.col("b"), F.lit(" are level, "), seats_text(F.col("x")), F.lit(" to "), seats_text(F.col("y")), F.lit(" seats"))
    return two.select("run", F.when(F.col("x") - F.col("y") < 1, level).otherwise(lead).alias("headline"))


def facts(runs: DataFrame, parties: DataFrame, blocs: DataFrame, scenarios: DataFrame, outlook: DataFrame, sizes: DataFrame, names: DataFrame, first_bloc: str, before: DataFrame | None = None, majority: int = 61, months: list[str] | None = None) -> DataFrame:
    """(run, facts): a map of the names in the templates to their text; a fact that isn't so is absent.

    ``runs``: run, as_of, days, scale, threshold, social_cap, social. ``parties``: run, party_id, share, mean, low, high,
    p_seats, p_largest. ``blocs``: run, bloc, mean, p_majority. ``names``: party_id, name, bloc, ord. ``before``: run
    (of the day it is for), party_id, mean - the previous day's, without rows where there is none.
    """
    named = ranked(parties.join(F.broadcast(names.select("party_id", "name", "bloc", "ord")), "party_id"))  # a row a party
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    top = []
    for k, who in ((1, "first"), (2, "second")):
        top += [at("name", k).alias(who), seats_text(at("mean", k)).alias(f"{who}_seats"), _whole(at("low", k)).alias(f"{who}_low"), _whole(at("high", k)).alias(f"{who}_high"), percent(at("p_largest", k)).alias(f"{who}_largest")]
    low, high = RISK_BANDS["report"]
    risky = named.where((F.col("p_seats") > low) & (F.col("p_seats") < high))
    none = (F.coalesce("winner", F.lit("")) == "deadlock")
    leaders = outlook.where(~none & (F.col("probability") > LEAST["chance"])).withColumn("place", F.row_number().over(W.partitionBy("run").orderBy(F.col("probability").desc(), "winner")))
    leaders = leaders.join(F.broadcast(names.select(F.col("party_id").cast("string").alias("winner"), F.col("name").alias("_name"))), "winner", "left").withColumn("who", F.coalesce("_name", "winner"))
    paths = scenarios.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy((F.col("probability") * F.col("plausibility")).desc(), "scenario"))).where("place <= 3")
    line = F.concat("bloc", F.lit(" "), seats_text(F.col("mean")), F.lit(" seats, majority "), percent(F.col("p_majority"), 1))
    card = F.concat("bloc", F.lit(": "), seats_text(F.col("mean")), F.lit(" ("), percent(F.col("p_majority"), 1), F.lit(")"))
    parts = [
        named.groupBy("run").agg(*top),
        _listed(blocs, "blocs", [-F.col("mean"), F.col("bloc")], line, "; "), _listed(blocs, "bloc_lines", [-F.col("mean"), F.col("bloc")], card, ", "),
        _listed(risky, "risk", [F.col("p_seats"), F.col("ord")], F.concat("name", F.lit(" "), percent(F.col("share"), 1), F.lit(" of the votes, chance "), percent(F.col("p_seats"))), "; "),
        risky.groupBy("run").agg(F.count(F.lit(1)).cast("string").alias("risk_count"), F.count_if(F.col("bloc") == first_bloc).cast("string").alias("risk_first_bloc")),
        _listed(paths, "coalitions", [F.col("place")], F.concat("scenario", F.lit(": "), seats_text(F.col("mean")), F.lit(" seats, majority "), percent(F.col("probability"), 1), F.lit(", plausibility "), F.format_string("%.2f", "plausibility")), "; "),
        leaders.where("place = 1").select("run", F.col("who").alias("leader"), percent(F.col("probability"), 1).alias("leader_chance")),
        _listed(leaders.where("place between 2 and 4"), "others", [F.col("place")], F.concat("who", F.lit(" "), percent(F.col("probability"), 1)), ", "),
        outlook.groupBy("run").agg(percent(F.coalesce(F.sum(F.when(none, F.col("probability"))), F.lit(0.0)), 1).alias("deadlock")),
        sizes.select("run", F.col("used").cast("string").alias("used"), F.format_string("%.1f", F.round("effective_n", 1)).alias("effective")),
    ]
    rows = runs.select(
        "run", long_date(F.col("as_of"), months).alias("date"), F.col("days").cast("string").alias("days"), F.format_string("%.2f", F.round("scale", 2)).alias("inflation"), percent(F.col("threshold"), 2).alias("threshold"),
        F.when(F.col("social"), "yes").alias("social"), F.when(~F.col("social"), "yes").alias("no_social"), seats_text(F.col("social_cap")).alias("social_cap"),
        F.lit(str(majority)).alias("majority"), F.lit(first_bloc).alias("first_bloc"), F.lit(str(LEAST["movement"])).alias("least"), F.date_sub("as_of", 1).alias("_before"),
    )
    for part in parts:
        rows = rows.join(part, "run", "left")
    if before is not None:
        old = before.select("run", "party_id", F.col("mean").alias("_old"))
        moves = named.join(old, ["run", "party_id"], "left").withColumn("delta", F.coalesce(F.col("mean") - F.col("_old"), F.lit(0.0))).where(F.abs("delta") >= LEAST["movement"])
        signed = F.concat(F.when(F.col("delta") > 0, "+").otherwise("-"), F.format_string("%.1f", F.round(F.abs("delta"), 1)))
        rows = rows.join(_listed(moves, "moved", [-F.abs("delta"), F.col("ord")], F.concat("name", F.lit(" "), signed), ", "), "run", "left")
        rows = rows.join(before.select("run", F.lit(True).alias("_seen")).distinct(), "run", "left")
        rows = rows.withColumn("before", F.when(F.col("_seen"), long_date(F.col("_before"), months))).withColumn("moved", F.when(F.col("_seen"), F.col("moved"))).withColumn("still", F.when(F.col("_seen") & F.col("moved").isNull(), "yes")).drop("_seen")
    rows = rows.withColumn("no_risk", F.when(F.col("risk").isNull(), "yes")).drop("_before")
    names_ = [c for c in rows.columns if c != "run"]
    every = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in names_]))
    return rows.select("run", F.map_filter(every, lambda k, v: v.isNotNull()).alias("facts"))


def template_table(spark: SparkSession, templates=TEMPLATES, bullets=BULLETS) -> DataFrame:
    """(ord, kind, section, condition, text): the sentences of the sections and the bullets, in order."""
    rows = [(i, "section", *t) for i, t in enumerate(templates)] + [(i, "bullet", "", *b) for i, b in enumerate(bullets)]
    return spark.createDataFrame(rows, "ord int, kind string, section string, condition string, text string")


def filled(text: Column, values: Column) -> Column:
    """``text`` with every ``{name}`` replaced by its fact (nothing, if it has none)."""
    holes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1))
    return F.aggregate(holes, text, lambda t, h: F.replace(t, F.concat(F.lit("{"), h, F.lit("}")), F.coalesce(values[h], F.lit(""))))


def render(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """(run, sections array<struct<title, body>>, bullets array<string>) in the order of the templates."""
    rows = facts.crossJoin(F.broadcast(templates))  # some twenty sentences
    rows = rows.where((F.col("condition") == "") | F.map_contains_key("facts", F.col("condition")))
    rows = rows.select("run", "kind", "section", "ord", filled(F.col("text"), F.col("facts")).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"])
    sections = rows.where("kind = 'section'").groupBy("run", "section").agg(F.min("ord").alias("o"), F.array_join(texts, " ").alias("body"))
    sections = sections.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("section").alias("title"), "body"))), lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body"))).alias("sections"))
    bullets = rows.where("kind = 'bullet'").groupBy("run").agg(texts.alias("bullets"))
    return sections.join(bullets, "run", "left")


def documents(runs: DataFrame, headlines: DataFrame, rendered: DataFrame) -> DataFrame:
    """(run, date, headline, sections, bullets, json): the report of each run, and its JSON."""
    rows = runs.select("run", F.col("as_of").cast("string").alias("date")).join(headlines, "run").join(rendered, "run")
    return rows.withColumn("json", F.to_json(F.struct("date", "headline", "sections", "bullets")))


def markdown(reports: DataFrame, facts: DataFrame, parties: DataFrame, names: DataFrame, simulations: int) -> DataFrame:
    """(run, markdown): title, headline, sections and the table of seats, parties by mean seats."""
    rows = ranked(parties.join(F.broadcast(names.select("party_id", "name", "ord")), "party_id"))
    cells = F.concat_ws(" | ", "name", percent(F.col("share"), 1), seats_text(F.col("mean")), F.concat(_whole(F.col("low")), F.lit("-"), _whole(F.col("high"))), percent(F.col("p_seats")))
    table = _listed(rows, "_table", [F.col("place")], F.concat(F.lit("| "), cells, F.lit(" |")), "\n")
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["body"], F.lit("\n"))), "\n")
    out = reports.join(facts, "run").join(table, "run")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Daily report, "), F.col("facts")["date"]), F.lit(""), F.concat(F.lit("**"), F.col("headline"), F.lit("**")), F.lit(""),
        F.concat(F.lit("_"), F.col("facts")["days"], F.lit(" days to go, "), F.coalesce(F.col("facts")["used"], F.lit("0")), F.lit(f" polls, {simulations:,} draws_")), F.lit(""), body,
        F.lit("## Seats"), F.lit(""), F.lit("| Party | Votes | Seats (mean) | 80 % | Chance of seats |"), F.lit("| --- | --- | --- | --- | --- |"), F.col("_table"), F.lit(""),
    )
    return out.select("run", text.alias("markdown"))
