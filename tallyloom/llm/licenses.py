"""License scans by diagonal voting.

All rolling word k-grams of all documents are hashed and joined to the k-grams of license templates. A match at
word ``i`` of the document and ``j`` of a template votes for the diagonal ``i - j``. Votes are counted by
(document, template, diagonal); diagonals at most ``MERGE`` apart, whose words touch, become one span (words
inserted or left out shift the diagonal); a span is verified when the template words it covers are enough, and
dense enough within it. Of verified spans over the same words only the one that covers most stays, for licenses share
paragraphs.

One pass over the texts finds the words, the places of the base phrases, and the k-grams whose bit is set in a map of
the templates' k-grams (2 ** MAP_BITS bits, whatever their number; it lets a few others through). Only these are
written and joined. Templates are a table ``(label, text)``; the default one is ``license_texts.TEMPLATES``.

Base labels come from short phrases and always stay.

Edge cases: a null or empty text has no words and no labels; rows with the same or a null id are scanned each by
itself; templates of under k words and null ones match nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, bind, table, text_of, written
from tallyloom.llm.license_texts import TEMPLATES

#: Characters between words (after A-Z are lower-cased), phrases and their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

K = 4
MERGE = 3
LEAST_COVER = 0.6
LEAST_WORDS = 20
LEAST_DENSITY = 0.5
MAP_BITS = 18


def license_words(t: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return F.filter(F.split(ascii_lower(t), BETWEEN), lambda w: w != "")


def _grams(w: Column, k: int = K) -> Column:
    names = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(k)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, names).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """The (label, text) pairs as the table that the scan takes."""
    return spark.createDataFrame([tuple(t) for t in templates], "label string, text string")


def template_grams(templates: DataFrame, k: int = K) -> DataFrame:
    """template, label, n_template (words), gram, j: one row for each k-gram of each template, as a work table."""
    rows = templates.select("label", license_words(text_of()).alias("w")).where("label is not null").distinct()
    named = rows.select(F.monotonically_increasing_id().alias("template"), "label", F.size("w").alias("n_template"), _grams(F.col("w"), k).alias("g"))
    return written(named.select("template", "label", "n_template", F.posexplode("g").alias("j", "gram")), "license-grams")


def _map(grams: DataFrame) -> Column:
    """The bit map of ``gram`` as a constant array of 64-bit words; its parts are joined by ``bit_or`` in Spark."""
    bit = F.col("gram").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    set_ = grams.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    known = {r["at"]: r["bits"] for r in set_.collect()}  # 2 ** (MAP_BITS - 6) rows at most
    return F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(1 << (MAP_BITS - 6)))), ",").cast("array<bigint>")


def _set(map_: Column, gram: Column) -> Column:
    word = F.get(map_, F.shiftright(gram.bitwiseAND(F.lit((1 << MAP_BITS) - 1)), 6).cast("int"))
    return F.call_function("shiftright", word, gram.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _phrase(w: Column, number: int, parts: list[str]) -> Column:
    def hit(x: Column, i: Column) -> Column:
        same = x == parts[0]
        for j, part in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(w, i + j) == part, F.lit(False))
        return F.when(same, F.struct(i.alias("at"), F.lit(number).alias("label")))

    return F.filter(F.transform(w, hit), lambda s: s.isNotNull())


def _places(w: Column) -> Column:
    """(place, label number) of each phrase, where its words stand consecutively."""
    return F.concat(*[_phrase(w, n, phrase.split(" ")) for n, (phrase, _) in enumerate(PHRASES)])


def scanned(docs: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """row, doc_id, n_words, base (places of phrases) and hits (place and gram, for the join): one pass, as a work
    table. Texts without the last word of a phrase skip the search for phrases."""
    t = ascii_lower(text_of())
    none = F.array().cast("array<struct<at:int,label:int>>")
    known = _map(grams)

    def found(w: Column) -> Column:
        base = F.when(F.contains(t, F.lit("license")), _places(w)).otherwise(none)
        at = lambda g: F.filter(F.transform(g, lambda x, i: F.when(_set(known, x), F.struct(i.alias("i"), x.alias("gram")))), lambda h: h.isNotNull())
        return F.struct(F.size(w).cast("long").alias("n_words"), base.alias("base"), bind(_grams(w, k), at).alias("hits"))

    rows = docs.select("doc_id", bind(license_words(text_of()), found).alias("f"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.*"), "license-rows")


def template_spans(rows: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """Verified spans: row, label, first_word, last_word (exclusive), covered, cover, density."""
    every = rows.where(F.size("hits") > 0).select("row", F.inline("hits"))
    votes = every.join(grams, "gram").groupBy("row", "template", "label", "n_template", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.min("i").alias("first"), (F.max("i") + k).alias("last"), F.collect_set("j").alias("js"),
    )
    order = W.partitionBy("row", "template").orderBy("diagonal", "first")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > MERGE) | (F.col("first") > F.lag("last").over(order) + k)
    runs = votes.withColumn("run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(order))
    spans = runs.groupBy("row", "template", "label", "n_template", "run").agg(
        F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("js")))).alias("js")
    )
    covered = F.aggregate(
        F.transform("js", lambda j, i: F.least(F.lit(k), F.coalesce(F.get("js", i + 1) - j, F.lit(k)))), F.lit(0), lambda a, x: a + x
    )
    spans = spans.withColumn("covered", covered).select(
        "row", "label", "first_word", "last_word", "covered", (F.col("covered") / F.col("n_template")).alias("cover"),
        F.least(F.lit(1.0), F.col("covered") / (F.col("last_word") - F.col("first_word"))).alias("density"),
    )
    enough = (F.col("cover") >= LEAST_COVER) | (F.col("covered") >= LEAST_WORDS)
    return spans.where(enough & (F.col("density") >= LEAST_DENSITY))


def _better(t: Column, s: Column) -> Column:
    """Whether span ``t`` says more about the words of ``s``: it has over half of them, and covers more words of its
    template (or as many, of a shorter one). Licenses share paragraphs; the one that fits them best is named."""
    shared = F.least(t["last_word"], s["last_word"]) - F.greatest(t["first_word"], s["first_word"])
    more = (t["covered"] > s["covered"]) | ((t["covered"] == s["covered"]) & (t["cover"] > s["cover"]))
    return (2 * shared > s["last_word"] - s["first_word"]) & more


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, k: int = K) -> DataFrame:
    """One row for each document: doc_id, n_words, base (places), spans (verified), score."""
    grams = template_grams(template_table(docs.sparkSession) if templates is None else templates, k)
    rows = scanned(docs, grams, k)
    spans = template_spans(rows, grams, k).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "first_word", "last_word", "cover", "covered"))).alias("spans"))
    spans = spans.select("row", F.filter("spans", lambda s: ~F.exists("spans", lambda t: _better(t, s))).alias("spans"))
    spans = spans.withColumn("best", F.array_max(F.transform("spans", lambda s: s["cover"])))
    joined = rows.select("row", "doc_id", "n_words", "base").join(spans, "row", "left")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return joined.select("doc_id", "n_words", "base", "spans", F.least(F.lit(1.0), score).alias("score"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(label) for _, label in PHRASES])
    base = F.transform("base", lambda p: F.get(names, p["label"]))
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.round("score", 9).alias("score"),
    )
