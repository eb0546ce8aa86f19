"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into pieces of at most ``PIECE`` words, every ``PIECE // 2`` words, so a passage copied out of a
long item is judged by itself: any ``3 * PIECE // 4`` consecutive words of an item fill more than half of a piece.
All n-grams of all documents (of 4 words; of 3 for pieces under ``SHORT`` words; the whole piece if it is shorter)
are looked up among those of the pieces: first in a bit map of fixed size, which lets a few others through, then by a
join. The hits give the document frequency of each n-gram. A seed is an n-gram that is rare for its piece: at most
``COMMON`` documents have it, or at most ``RATIO`` times as many as have the piece's median n-gram - so an item
leaked into a large part of the corpus keeps its seeds. It must be rare among pieces too: at most ``SHARED`` of them
have it, or at most ``RATIO`` times as many as have the piece's median n-gram. So a phrase that begins every item
proposes none of them; where it fills over half of a piece the median is as frequent, and it stays a seed, for then
it reaches ``LEAST`` by itself. A seed at word i of the document and j of the piece proposes
the passage around i - j; overlapping proposals merge, and each passage that has enough of the piece's words is
aligned with it by Smith-Waterman over words. The score is the best alignment over a perfect one; at ``LEAST`` the
document is contaminated.

Only ids, hits and the words of documents with hits are written; no text is shuffled, and what is broadcast (the bit
map) has a fixed size, however large the benchmark is.

Edge cases: a null or empty text has no hits and is clean; items without words match nothing; items with the same id,
or null ids, are items of their own; rows with the same id are judged each; empty tables give no rows, or clean
documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import held, modest_batches, table, text_of, written

N, SHORT, SHORT_N = 4, 30, 3
PIECE = 64
COMMON = 1000
SHARED = 100
RATIO = 10
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: The bit map of item n-grams has 2 ** MAP_BITS bits (8 MB); each n-gram sets two.
MAP_BITS = 26

MATCHES = "array<struct<item_id: long, score: double, start: int, end: int>>"


def word_names(text: Column) -> Column:
    """64-bit names of the lower-cased runs of letters and digits."""
    inner = F.regexp_replace(F.lower(text), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")
    split = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[^\p{L}\p{M}\p{N}]+"))
    return F.transform(split, lambda x: F.xxhash64(x))


def gram_names(names: np.ndarray, n: int) -> np.ndarray:
    """The names of all runs of ``n`` of ``names`` (unsigned)."""
    out = names[: len(names) - n + 1].copy()
    for k in range(1, n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(29)) ^ names[k : len(names) - n + 1 + k]
    out = out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
    return out ^ (out >> np.uint64(32))


def gram_size(length: int) -> int:
    """Words of the n-grams of a piece of ``length`` words."""
    return min(length, SHORT_N if length < SHORT else N)


def pieces(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, unit, words): the pieces of every test item; ``item`` and ``unit`` number them."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_names(text_of()).alias("w")).distinct()
    items = written(rows.where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()), "leak-items")
    last = F.size("w") - PIECE
    starts = F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(PIECE // 2)), F.array(last))))
    cut = items.select("item", "item_id", "w", F.explode(starts).alias("from")).select("item", "item_id", F.slice("w", F.col("from") + 1, PIECE).alias("words"))
    return written(cut.withColumn("unit", F.monotonically_increasing_id()), "leak-pieces")


def _piece_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for unit, words in batch.itertuples(index=False):
            w = np.asarray(words, dtype=np.int64).view(np.uint64)
            g = gram_names(w, gram_size(len(w)))
            yield pd.DataFrame({"unit": unit, "n": gram_size(len(w)), "j": np.arange(len(g)), "gram": g.view(np.int64)})


def _bits(grams: np.ndarray, map_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each n-gram in the map."""
    return grams >> np.uint64(64 - map_bits), (grams >> np.uint64(6)) & np.uint64((1 << map_bits) - 1)


def gram_map(grams: DataFrame, map_bits: int) -> np.ndarray:
    """The bit map as 64-bit words; its parts are joined by ``bit_or`` in Spark, 2 ** (map_bits - 6) rows at most."""
    def bits(gram: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(_bits(gram.to_numpy(np.int64).view(np.uint64), map_bits), axis=1).view(np.int64)))

    each = grams.select(F.explode(F.pandas_udf(bits, "array<long>")("gram")).alias("b"))
    set_ = each.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").cast("int").bitwiseAND(F.lit(63)))).alias("bits")).toPandas()
    out = np.zeros(max(1, 1 << (map_bits - 6)), np.uint64)
    out[set_["at"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _candidates(shared, sizes: list[int], map_bits: int):
    def run(names: pd.Series) -> pd.DataFrame:
        known = shared.value
        length = np.array([len(x) for x in names], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in names]).view(np.uint64) if len(names) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(names)), length)
        found = []
        for n in sizes:
            if len(flat) < n:
                continue
            g = gram_names(flat, n)
            hit = np.ones(len(g), bool)
            for b in _bits(g, map_bits):
                hit &= (known[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
            hit = np.nonzero(hit)[0]
            hit = hit[owner[hit] == owner[hit + n - 1]]
            found.append(np.stack([owner[hit], g[hit].view(np.int64), hit - begin[owner[hit]]], axis=1))
        rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cut = np.searchsorted(rows[:, 0], np.arange(len(names) + 1))
        out = []
        for i, x in enumerate(names):
            own = rows[cut[i] : cut[i + 1]]
            out.append((x, own[:, 1], own[:, 2]) if len(own) else ([], [], []))
        return pd.DataFrame(out, columns=["names", "grams", "at"])

    return F.pandas_udf(run, "names array<long>, grams array<long>, at array<int>")


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of ``item`` in ``passage`` and the place where it ends."""
    step = -GAP * np.arange(len(passage) + 1)
    before, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(before[:-1] + np.where(passage == word, MATCH, MISMATCH), 0)
        row = np.maximum(row, before + GAP)
        row = np.maximum.accumulate(row + step) - step  # gaps along the passage
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        before = row
    return best, end


def passages(starts: np.ndarray, size: int, length: int) -> Iterator[tuple[int, int]]:
    """(first, last) words of the merged proposals of a piece of ``size`` words in a document of ``length`` words."""
    slack = max(4, size // 4)
    starts = np.unique(starts)
    cut = np.nonzero(np.diff(starts) > size + 2 * slack)[0] + 1
    for part in np.split(starts, cut):
        yield max(0, int(part[0]) - slack), min(length, int(part[-1]) + size + slack)


def judge(words: np.ndarray, piece: np.ndarray, starts: np.ndarray, least: float) -> tuple[float, int, int]:
    """The best score of ``piece`` in the proposed passages of a document, and its first and last word there. A
    passage with too few of the piece's words to reach ``least`` isn't aligned."""
    best, where = 0, (0, 0)
    need = least * len(piece)
    for lo, hi in passages(starts, len(piece), len(words)):
        passage = words[lo:hi]
        if np.isin(piece, passage).sum() < need:
            continue
        score, end = align(passage, piece)
        if score > best:
            _, back = align(passage[:end][::-1], piece[::-1])
            best, where = score, (lo + end - back, lo + end)
    return best / (MATCH * len(piece)), *where


def _aligned(names: pd.Series, proposals: pd.Series) -> pd.Series:
    out = []
    for w, asked in zip(names, proposals):
        best: dict[int, dict] = {}
        w = np.asarray(w, dtype=np.int64).view(np.uint64)
        for p in asked:
            score, start, end = judge(w, np.asarray(p["words"], dtype=np.int64).view(np.uint64), np.asarray(p["starts"]), LEAST)
            if score > best.get(p["item"], {"score": 0.0})["score"]:
                best[p["item"]] = {"item_id": p["item_id"], "score": score, "start": start, "end": end}
        out.append(list(best.values()))
    return pd.Series(out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """One row for each document: doc_id, matches (array of item_id, score and word range, best first)."""
    spark = docs.sparkSession
    modest_batches(spark)
    units = pieces(benchmark)
    grams = written(units.select("unit", "words").mapInPandas(_piece_grams, "unit long, n int, j int, gram long"), "leak-grams")
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most N of them
    shared = spark.sparkContext.broadcast(gram_map(grams, map_bits))
    named = held(docs.select("doc_id", text_of().alias("text")), "names", word_names(F.col("text"))).select("doc_id", "names")
    looked = named.select("doc_id", _candidates(shared, sizes, map_bits)("names").alias("h"))
    hits = written(looked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h.*"), "leak-hits")
    listed = hits.where(F.size("grams") > 0)
    # Rows of a common gram are counted before they meet, and AQE splits the joins below.
    counted = listed.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    having = grams.select("unit", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("uf"))
    known = grams.join(having.join(counted, "gram", "left"), "gram").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = [F.greatest(F.lit(float(least)), RATIO * F.percentile(c, F.lit(0.5))).alias(f"most_{c}") for c, least in (("df", COMMON), ("uf", SHARED))]
    limits = known.dropDuplicates(["unit", "gram"]).groupBy("unit").agg(*rare)
    seeds = known.join(limits, "unit").where("df between 1 and most_df and uf <= most_uf").select("gram", "unit", "j")
    places = listed.select("row", F.inline(F.arrays_zip("grams", "at"))).withColumnRenamed("grams", "gram")
    met = places.join(seeds, "gram").groupBy("row", "unit").agg(F.collect_set(F.col("at") - F.col("j")).alias("starts"))
    asked = met.join(units, "unit").groupBy("row").agg(F.collect_list(F.struct("item", "item_id", "words", "starts")).alias("proposals"))
    judged = listed.select("row", "names").join(asked, "row").select("row", F.pandas_udf(_aligned, MATCHES)("names", "proposals").alias("matches"))
    order = lambda x, y: F.when(x["score"] != y["score"], F.signum(y["score"] - x["score"])).otherwise(F.coalesce(F.signum(x["item_id"] - y["item_id"]), F.lit(0.0))).cast("int")
    out = hits.select("row", "doc_id").join(judged, "row", "left")
    return out.select("doc_id", F.array_sort(F.coalesce("matches", F.array().cast(MATCHES)), order).alias("matches"))


def contaminated(leaks: DataFrame, least: float = LEAST) -> Column:
    return F.exists("matches", lambda m: m["score"] >= least)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.filter("matches", lambda m: m["score"] >= LEAST)
    first = F.get(hits, 0)
    return leaks.select(
        "doc_id", contaminated(leaks).alias("contaminated"), F.size(hits).cast("long").alias("n_items"), first["item_id"].alias("best_item"),
        F.coalesce(F.get(F.transform("matches", lambda m: m["score"]), 0), F.lit(0.0)).alias("best_score"), first["start"].alias("first_word"), first["end"].alias("last_word"),
    )
