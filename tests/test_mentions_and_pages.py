"""Party names and seats in Hebrew text, addresses of links, polls out of tables and articles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars
from tallyloom.operators import pollpages, textops
from tallyloom.operators.mentions import ADVERB_VERBS, ADVERBS, GLUED, Names, alias_table, mentions, read_polls

ALIASES = [
    ("הליכוד", "likud"), ("ליכוד", "likud"), ("ישר", "yashar"), ("ביחד", "byachad"), ("בנט ולפיד", "byachad"), ("לפיד ובנט", "byachad"), ("הדמוקרטים", "democrats"),
    ("ישראל ביתנו", "yisrael-beiteinu"), ("עוצמה יהודית", "otzma"), ("יהדות התורה", "utj"), ("שס", "shas"), ("הרשימה המשותפת", "joint-list"), ("המשותפת", "joint-list"),
    ("חדש תעל", "joint-list"), ("הציונות הדתית", "religious-zionism"), ("הציונות הדתית זהות", "religious-zionism"), ("זהות", "religious-zionism"), ("רעם", "raam"),
]
FULL = 'הליכוד מקבל 24 מנדטים, ישר 22, ביחד 15, הדמוקרטים 11, ישראל ביתנו 9, עוצמה יהודית 9, יהדות התורה 8, ש"ס 7, הרשימה המשותפת 7, הציונות הדתית 4, רע"ם 4'
SEATS = {
    "likud": 24, "yashar": 22, "byachad": 15, "democrats": 11, "yisrael-beiteinu": 9, "otzma": 9, "utj": 8, "shas": 7, "joint-list": 7, "religious-zionism": 4, "raam": 4,
}
READINGS = [
    ("הליכוד מקבל 24 מנדטים", {"likud": 24}), ("ישר 22", {"yashar": 22}), ("ביחד – 15", {"byachad": 15}), (FULL, SEATS), ("ישר, הליכוד 24", {"likud": 24}), ("הליכוד 2", {}), ("הליכוד 130", {}),
    ("הליכוד. הבחירות ייערכו בעוד 46 ימים", {}), ("הליכוד מאבד 4 מנדטים", {}), ("הליכוד יורד ב 4 מנדטים", {}), ("ישר מתחזק ב 2 מנדטים", {}), ("ביחד נחלש ב 5 מנדטים", {}),
    ("הליכוד עם פער של 4 מנדטים", {}), ("הליכוד מוביל ב 5 מנדטים לעומת ישר", {}), ("ישר מובילה עם 25 מנדטים", {"yashar": 25}), ("הליכוד יורד ל 21 מנדטים", {"likud": 21}),
    ("ביחד עולה ל 15 מנדטים", {"byachad": 15}), ("הדמוקרטים מתחזקים ל 11 מנדטים", {"democrats": 11}), ('ש"ס עומדת על 7 מנדטים', {"shas": 7}), ("הליכוד עומד על 21 מנדטים", {"likud": 21}),
    ("ישר מגיעה ל 24 מנדטים", {"yashar": 24}), ("ש״ס, שקיבלה בשנת 2022 יחד 11 מנדטים", {"shas": 11}), ('הליכוד וש"ס ביחד 39 מנדטים', {}), ("הרשימה המשותפת ורעם רצות ביחד 10 מנדטים", {}),
    ("ביחד בראשות בנט ולפיד מקבלת 15 מנדטים", {"byachad": 15}), ("ביחד 14 מנדטים", {"byachad": 14}), ("מפלגת בנט ולפיד 15 מנדטים", {"byachad": 15}), ("לפיד ובנט 15 מנדטים", {"byachad": 15}),
    ("כשהליכוד 25 מנדטים", {"likud": 25}), (None, {}), ("", {}),
]


def test_readings_of_sentences(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READINGS)], "i int, text string")
    got = {r.i: r.mentions for r in mentions(rows, "text", ALIASES).collect()}
    for i, (text, wanted) in enumerate(READINGS):
        found = {}
        for m in got[i]:
            if m.seats is not None:
                found.setdefault(m.party_id, m.seats)
        assert found == wanted, text


def test_names_in_text():
    names = lambda t: [p for _, _, p in Names(tuple(ALIASES)).spans(t)]
    assert names("העלייה בליכוד נמשכת") == ["likud"] and names("שהליכוד יקבל יותר") == ["likud"]
    assert names("הציונות הדתית זהות מקבלת 4 מנדטים") == ["religious-zionism"]
    assert names("חדש תעל מקבלת 6 מנדטים") == ["joint-list"] and names("המשותפתיים") == []


def test_polls_of_texts(spark):
    rows = spark.createDataFrame([(1, FULL), (2, "הליכוד 24, ישר 22"), (3, None)], "id int, text string")
    got = read_polls(mentions(rows, "text", ALIASES), ["id"]).collect()
    assert [(r.id, r.seats, r.total) for r in got] == [(1, SEATS, 120)]


@pytest.mark.parametrize("base,href,wanted", [
    ("https://a.b/c/d/e.html", "../x.html", "https://a.b/c/x.html"), ("https://a.b/c/d", "./y", "https://a.b/c/y"), ("https://a.b/c/d?z=1", "?q=1", "https://a.b/c/d?q=1"),
    ("https://a.b", "x", "https://a.b/x"), ("https://a.b/c/", "/x/../y/./z#f", "https://a.b/y/z"), ("https://a.b/c/", "//H.i/j", "https://h.i/j"), ("https://a.b/c/d", "..", "https://a.b/"),
    ("https://a.b/c/d", "#top", "https://a.b/c/d"), ("https://a.b/", "mailto:x@y", None), ("https://a.b/", "https://c.d", "https://c.d/"), ("https://a.b/c", "../../x/", "https://a.b/x/"),
    ("https://a.b/c", "x?u=../y", "https://a.b/x?u=../y"),
])
def test_addresses(spark, base, href, wanted):
    row = spark.createDataFrame([(base, href)], "b string, h string")
    assert row.select(textops.resolved(F.col("b"), F.col("h")).alias("x")).first().x == wanted


NEEDLES = [("likud", "likud", 0), ("yashar", "yashar", 1), ("together", "byachad", 2), ("democrats", "democrats", 3), ("shas", "shas", 4)]


def test_polls_of_tables(spark):
    head = "".join(f"<th>{x}</th>" for x in ("Date", "Firm", "Likud", "Yashar", '<a title="Together (Israel)">Tog.</a>', "Democrats", "שס", "Other"))
    line = lambda *x: "<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>"
    table = "<table class='x'><tr><td>1</td></tr></table>" + '<table class="wikitable sortable"><tr><th>a</th><th>Likud</th><th>b</th></tr><tr>' + head + "</tr>"
    table += line("9-11 Sep 2026", "Direct Polls", "24", "22", "15<sup>[1]</sup>", "11", "9", "1,003")
    table += line("no date", "Direct", "24", "22", "15", "11", "9", "") + line("1 Sep 2026", "Midgam", "60", "50", "15", "11", "9", "")
    table += line("2 Sep 2026", "Midgam", "24", "22", "15", "3", "9", "") + line("3 Sep 2026", "Midgam") + "</table>"
    pages = spark.createDataFrame([("https://w/x", table), ("https://w/y", None), ("https://w/z", "")], "url string, html string")
    needles = spark.createDataFrame(NEEDLES, "needle string, party_id string, ord int")
    got = pollpages.table_polls(pages, needles, ALIASES, [("direct", "Direct Polls")], [("channel 12", "N12")]).collect()
    assert [(r.id, str(r.date), r.pollster, r.total, r.partial, r.seats) for r in got] == [
        ("table-2026-09-11-Direct-Polls", "2026-09-11", "Direct Polls", 81, True, {"likud": 24, "yashar": 22, "byachad": 15, "democrats": 11, "shas": 9})
    ]


def test_polls_of_articles(spark):
    section = "<a href='/1'>סקר חדש</a><a href='/2'>ספורט</a><a href='/3'></a><a href='/4'>סקר</a><a href='/1#x'>סקר שוב</a><a href='/no/5'>סקר</a>"
    sections = spark.createDataFrame([("n", "https://s.x/", section, 0)], "outlet string, url string, html string, place int")
    robots = spark.createDataFrame([("https://s.x", "/no/")], "origin string, rule string")
    body = f"<script>x</script><p>סקר: פורסם ב-9 בספטמבר 2026. 503 משיבים. {FULL}</p>"
    articles = spark.createDataFrame([("https://s.x/1", body), ("https://s.x/3", "אין"), ("https://s.x/4", "סקר: הליכוד 24"), ("https://s.x/no/5", body), ("https://s.x/2", body)], "url string, html string")
    asked = []

    def fetch(urls):
        asked.extend(r.url for r in urls.collect())
        return urls.join(articles, "url")

    got = pollpages.news_polls(sections, fetch, robots, ALIASES, [("few", F.col("sample_size") < 100)], F.lit("2026-01-01").cast("date")).collect()
    assert sorted(asked) == ["https://s.x/1", "https://s.x/3", "https://s.x/4"]
    mark = scalars.seed_from_string("https://s.x/1")
    digits = ""
    while mark:
        mark, d = divmod(mark, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert [(r.id, str(r.date), r.sample_size, r.seats) for r in got] == [(f"n-2026-09-09-{digits}", "2026-09-09", 503, SEATS)]


def test_hash_of_units(spark):
    texts = ["", "abc", "שלום", "😀x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.seed_of(F.col("t")).alias("h")).collect()
    assert all(r.h == scalars.seed_from_string(r.t) for r in rows)


def test_entities_keep_low_bits(spark):
    got = spark.createDataFrame([("a&#1488;b&#65;&#65601;",)], "h string").select(textops.strip_html(F.col("h")).alias("t")).first().t
    assert got == "aאbAA"


def slow_spans(text, aliases):
    """Every name at every place, long ones first, each if its neighbours allow it and no better one has its letters."""
    before, after = r"[\s,.:;()א-ת]", r"[\s,.:;()\-–—0-9]"
    hits = []
    for rank, (name, party) in enumerate(sorted(aliases, key=lambda a: -len(a[0]))):
        for at in range(len(text)):
            end = at + len(name)
            word = text[:at].rsplit(" ", 1)[-1]
            if text[at:end] == name and (at == 0 or re.match(before, text[at - 1])) and (end == len(text) or re.match(after, text[end])) and (len(word) <= 2 or word in GLUED):
                hits.append((rank, at, end, name, party))
    kept = []
    for _, at, end, name, party in sorted(hits):
        if any(a < end and at < b for a, b, _ in kept):
            continue
        clause = re.split(r"[.,;|]", text[:at])[-1]
        if name in ADVERBS and (re.search(rf"({ADVERB_VERBS})\s*$", clause) or any(at - len(clause) <= a < at for a, _, _ in kept)):
            continue
        kept.append((at, end, party))
    return sorted(kept)


def test_names_against_all_places():
    rng = random.Random(8)
    names = Names(tuple(ALIASES))
    automaton = names.automaton()
    pieces = [a for a, _ in ALIASES] + ["ו", "ש", "כשה", "ב", " ", ", ", ". ", "24", " מנדטים", "רצות ", "מצטרפים", "abc", "-", "|", "בינוני"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        assert names.spans(text, automaton) == slow_spans(text, ALIASES), text
    assert Names(()).spans("הליכוד") == [] and names.spans("") == []


def test_aliases_of_a_table(spark):
    """Names come out of the table of spellings: normalised, and none that two parties share."""
    spellings = spark.createDataFrame([("likud", "הליכוד"), ("shas", 'ש"ס'), ("a", "כולנו"), ("b", "כולנו"), ("utj", "יהדות-התורה"), ("utj", "יהדות התורה"), ("x", "")], "party_id string, text string")
    table = alias_table(spellings)
    assert dict(Names.of(table).aliases) == {"הליכוד": "likud", "שס": "shas", "יהדות התורה": "utj"}
    rows = spark.createDataFrame([(1, 'הליכוד 24, ש"ס 7, כולנו 9, יהדות התורה 8'), (2, None)], "i int, text string")
    got = {r.i: [(m.party_id, m.seats) for m in r.mentions] for r in mentions(rows, "text", spellings).collect()}
    assert got == {1: [("likud", 24), ("shas", 7), ("utj", 8)], 2: []}
