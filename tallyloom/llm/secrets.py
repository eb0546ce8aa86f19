"""Secret scans: patterns of three kinds plus Shannon entropy in sliding windows.

Patterns give the base spans. The method adds spans of kind ``entropy``: candidate strings are maximal runs of
key characters; a window of ``WINDOW`` characters slides over the candidate, its character counts change by one in
and one out, and the entropy follows from the change of ``sum c*log2(c)``. Each character class (hex, letters and
digits, base64) judges the windows that lie in it. A candidate with a window above its class's threshold is a span,
unless the allow-list suppresses it (identifiers, digests and alphabets that are no secrets) or a base span overlaps it.

Matches are marked in the text by a character the patterns can't match, so ``split`` gives their places; texts
without a match stop at one scan of each pattern. Everything stays in the JVM. No pattern repeats a group, for
Java's matcher goes one call deeper with each repetition and a long candidate would end the stack.

Edge cases: a null or empty text has no spans; rows with the same id are separate; an empty table gives no
rows; other columns are ignored. Places count code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import bind, table, text_of

#: The base patterns by kind, in the order in which kinds are listed.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX_RUN = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan, and the classes: name, characters, least bits for a window of WINDOW.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = (
    ("hex", "0123456789abcdef", 3.0),
    ("alnum", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.9),
    ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.9),
)
#: Candidates that are no secrets: UUIDs, documented example keys and alphabets; and paths of plain words, which are
#: those without any of these signs (a foreign character, an empty word, a capital that doesn't begin a word).
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|abcdefghij|0123456789",
)
NOT_PLAIN = r"[^A-Za-z_/=+-]|^[_/=+-]|[_/=+-]$|[_/=+-][_/=+-]|[A-Za-z][A-Z]|[A-Z](?![a-z])"

#: Counters of a window: so many in a 64-bit word, of so many bits each (a count is at most WINDOW).
PACKED, COUNT_BITS = 12, 5
#: Parts of a split text whose places are summed in one go.
PARTS = 256

_MARK = "\x01"


def _marked(t: Column, pattern: str) -> Column:
    """(start, text) of every leftmost match of ``pattern``, not overlapping, in order."""
    clean = F.translate(t, _MARK, "\x02")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)

    def run(first: Column, sizes: Column) -> Column:
        """``first``, and it plus the sums of ``sizes`` so far."""
        return F.aggregate(sizes, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def places(p: Column) -> Column:
        # Prefix sums in two levels, so that an array grows to PARTS at most in one place.
        cuts = F.transform(F.sequence(F.lit(0), (F.size(p) - 1).cast("int"), F.lit(PARTS)), lambda i: F.transform(F.slice(p, i + 1, PARTS), F.char_length))
        totals = lambda c: F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        starts = bind(cuts, lambda c: bind(run(F.lit(0), totals(c)), lambda base: F.flatten(F.transform(c, lambda x, i: F.slice(run(F.get(base, i), x), 1, F.size(x))))))
        return bind(starts, lambda at: F.filter(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.struct(F.get(at, i).alias("start"), x.alias("text")))), lambda m: m.isNotNull()))

    return F.when(F.rlike(t, F.lit(pattern)), bind(parts, places)).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["text"])).alias("end")))


def window_entropies(s: Column, alphabets: list[str]) -> Column:
    """For each alphabet the largest entropy of a window of ``WINDOW`` characters of ``s`` that are all in it.

    One pass for all: the state holds the counts of the window's characters, packed into 64-bit words, the sum of
    c*log2(c), and for each alphabet the length of the run that ends here and the best so far. A step adds one to the
    count of the character that comes and takes one from that of the character that leaves.
    """
    every = "".join(dict.fromkeys("".join(alphabets)))
    logs = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)])
    ones = F.array(*[F.lit(1 << COUNT_BITS * i).cast("long") for i in range(PACKED)])
    words_ = len(every) // PACKED + 1
    g = lambda c: F.get(logs, c)
    word, one = (lambda c: F.floor(c / PACKED).cast("int")), (lambda c: F.get(ones, c % PACKED))
    shift = lambda n, c: F.call_function("shiftright", F.get(n, word(c)), c % PACKED * COUNT_BITS)
    count = lambda n, c: shift(n, c).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    add = lambda n, c, by: F.transform(n, lambda w, k: F.when(k == word(c), w + by * one(c)).otherwise(w))
    inside = [F.array(*[F.lit(i > 0 and every[i - 1] in a) for i in range(len(every) + 1)]) for a in alphabets]
    places = F.transform(F.split(s, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(every), c)))
    state = lambda n, total, runs, best: F.struct(n.alias("n"), total.alias("sum"), runs.alias("run"), best.alias("best"))

    def best(p: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            new, old = F.get(p, i), F.get(p, i - WINDOW)
            out = bind(count(a["n"], old), lambda c: F.struct(add(a["n"], old, F.lit(-1)).alias("n"), (a["sum"] - g(c) + g(c - 1)).alias("sum")))
            left = F.when(i >= WINDOW, out).otherwise(F.struct(a["n"].alias("n"), a["sum"].alias("sum")))

            def after(x: Column) -> Column:
                total = bind(count(x["n"], new), lambda c: x["sum"] - g(c) + g(c + 1))
                runs = F.array(*[F.when(F.get(has, new), F.get(a["run"], k) + 1).otherwise(F.lit(0)) for k, has in enumerate(inside)])

                def judged(y: Column) -> Column:
                    bits = F.lit(math.log2(WINDOW)) - y["sum"] / WINDOW
                    most = F.array(*[F.when(F.get(y["run"], k) >= WINDOW, F.greatest(F.get(a["best"], k), bits)).otherwise(F.get(a["best"], k)) for k in range(len(inside))])
                    return state(add(x["n"], new, F.lit(1)), y["sum"], y["run"], most)

                return bind(F.struct(total.alias("sum"), runs.alias("run")), judged)

            return bind(left, after)

        zero = state(F.array_repeat(F.lit(0).cast("long"), words_), F.lit(0.0), F.array(*[F.lit(0) for _ in inside]), F.array(*[F.lit(0.0) for _ in inside]))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), zero, step, lambda a: a["best"])

    return bind(places, best)


def window_entropy(s: Column, alphabet: str) -> Column:
    """The largest entropy of a window of ``WINDOW`` characters of ``s`` that are all in ``alphabet``."""
    return F.get(window_entropies(s, [alphabet]), 0)


def _secret(s: Column) -> Column:
    allowed = ~F.rlike(s, F.lit(NOT_PLAIN))
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(s, F.lit(pattern))
    limits = F.array(*[F.lit(least) for _, _, least in CLASSES])
    dense = bind(window_entropies(s, [a for _, a, _ in CLASSES]), lambda e: F.exists(F.zip_with(e, limits, lambda x, y: x >= y), lambda x: x))
    return F.when(allowed, F.lit(False)).otherwise(dense)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, base and spans (arrays of start, kind, end in order; kind as a place in
    ``KINDS``)."""
    t = F.col("text")
    assign = F.filter(_marked(t, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 1)) >= 6)
    found = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id",
        F.array_sort(
            F.concat(_spans(assign, 0), _spans(_marked(t, ACCESS), 1), _spans(_marked(t, HEX_RUN), 2))
        ).alias("base"),
        F.filter(_marked(t, CANDIDATE), lambda m: _secret(m["text"])).alias("dense"),
    )
    found = found.withColumn("base", F.filter("base", lambda s: (s["kind"] != 1) | (s["end"] - s["start"] >= 20)))
    clear = F.filter(_spans(F.col("dense"), 3), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def _joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def _found_sql(name: str, pattern: str, group: str = "") -> str:
    """Matches of ``pattern`` in ``src``: doc_id, s (start), e (end), m (the match), found like the main path's marks."""
    pattern = pattern.replace("'", "''")
    return f"""{name}_p AS (
  SELECT doc_id, unnest(p) AS m, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM src WHERE regexp_matches(t, '{pattern}'))
), {name} AS (
  SELECT doc_id, m, e - length(m) AS s, e FROM (SELECT *, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM {name}_p) WHERE i % 2 = 0{group}
)"""


_HEX, _ALNUM = "^[0-9a-f]+$", "^[0-9a-zA-Z]+$"
ORACLE_SQL = f"""
WITH src AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
{_found_sql("a0", ASSIGN, " AND length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 1)) >= 6")},
{_found_sql("a1", ACCESS, " AND length(m) >= 20")},
{_found_sql("a2", "[0-9a-f]+", " AND length(m) >= 24")},
{_found_sql("c3", "[A-Za-z0-9+/_=-]{20,}")},
base AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, s, e FROM a0 UNION ALL SELECT doc_id, 1, 'access', s, e FROM a1 UNION ALL SELECT doc_id, 2, 'hex', s, e FROM a2
), cand AS (
  SELECT * FROM c3 WHERE NOT regexp_matches(m, '{ALLOWED[0]}') AND NOT regexp_matches(m, '{ALLOWED[1]}')
    AND NOT regexp_full_match(m, '[A-Za-z]?[a-z]+([-_/=+][A-Za-z]?[a-z]+)*')
), win AS (
  SELECT doc_id, s, e, substr(m, i::BIGINT, {WINDOW}) AS w FROM (SELECT *, unnest(generate_series(1, length(m) - {WINDOW - 1})) AS i FROM cand)
), dense AS (
  SELECT doc_id, s, e FROM win
  GROUP BY doc_id, s, e HAVING bool_or(list_aggregate(string_split(w, ''), 'entropy') >= CASE WHEN regexp_matches(w, '{_HEX}') THEN {CLASSES[0][2]} ELSE {CLASSES[2][2]} END)
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT doc_id, 3, 'entropy', s, e FROM dense d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = d.doc_id AND b.s < d.e AND d.s < b.e)
), one AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN one USING (doc_id)
"""
