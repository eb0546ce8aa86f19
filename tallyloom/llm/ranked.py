"""Ranked lexical search over a two-level quantised index.

The index has one row for each document: its terms (64-bit names), each term's impact as one byte, rounded up
(level one), and the exact integers (occurrences and length factor, level two). An impact is what one unit of a
term's weight adds to the score, ``10**9 * tf div (1000 * tf + 12 * m)``, under 10**6; a byte ``b`` says that it is at
most ``b * STEP`` and more than ``(b - 1) * STEP``. So the bytes alone bound a score from both sides.

A search reads the index twice for each block of queries (at most about ``ENTRIES`` terms, so what a task holds has
a bound):

1. Level one: every task keeps each query's ``k`` largest lower bounds. The k-th largest of all tasks' bounds is a
   score that the k-th best document reaches.
2. Every document whose upper bound reaches the k-th lower bound is scored exactly, in integers, from level two.
   A task sends its ``k`` best documents a query; copies, however many, tie and the smaller ids stay.

Names of terms are 64-bit hashes: two terms of a query and a document are taken as one with a chance of about 5e-20 a
pair. With ``vocabulary`` only terms that may be in it are indexed (a bit map of fixed size lets a few others
through); document lengths, counts and weights are over all terms and documents in any case.

Edge cases: a null or empty text, or one without a term, has no terms, counts in no statistic and is never a
result; a query without a term that a document has gives no rows; queries with the same id and text are one, with the
same id and other texts are ranked each; rows with the same id are ranked each; a null doc_id ranks behind equal
scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, held, modest_batches, table, text_of, written
from tallyloom.llm.decontaminate import MAP_BITS, _bits, gram_map

#: The characters between terms, after A-Z are lower-cased; the scale and constants of the score.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_PERCENT, WEIGHT_UNIT = 1_000_000_000, 1000, 12, 25, 1000

TOP = 20
#: Impacts are under 10**6; 255 steps of this size cover them.
STEP = 3922
#: About how many (query, term) pairs one block of queries has.
ENTRIES = 100_000
#: Pairs of a document and a query that a task scores exactly at once.
PAIRS = 10_000
_LAST = 2**63 - 1


def term_names(text: Column) -> Column:
    """64-bit names of the terms of a text, in order."""
    return F.transform(F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != ""), lambda w: F.xxhash64(w))


@dataclass(frozen=True)
class Index:
    """``rows``: doc_id, m (length factor), terms, impact (byte - 128), tf; and the documents and terms there are."""

    rows: DataFrame
    documents: int
    terms: int


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _counted(known):
    """doc_id, n, and the distinct terms of each text with their counts; ``known`` is a bit map of terms or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else known.value
        for batch in batches:
            names, owner = _flat(batch.column("names"))
            n = np.bincount(owner, minlength=batch.num_rows)
            if bits is not None:
                stays = np.ones(len(names), bool)
                for b in _bits(names.view(np.uint64), MAP_BITS):
                    stays &= (bits[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
                names, owner = names[stays], owner[stays]
            order = np.lexsort((names, owner))
            names, owner = names[order], owner[order]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
            at = np.nonzero(new)[0]
            ends = np.cumsum(np.bincount(owner[at], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), _lists(names[at], ends, pa.int64()), _lists(np.diff(np.append(at, len(names))), ends, pa.int32())],
                names=["doc_id", "n", "terms", "tf"],
            )

    return run


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """The index of ``docs`` (doc_id, text), of the terms in ``vocabulary`` (column ``term``: names) or of all."""
    spark = docs.sparkSession
    modest_batches(spark)
    known = None if vocabulary is None else spark.sparkContext.broadcast(gram_map(vocabulary.select(F.col("term").alias("gram")), MAP_BITS))  # 8 MB
    named = held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), "names", term_names(F.col("text"))).select("doc_id", "names")
    counted = written(named.mapInArrow(_counted(known), "doc_id long, n long, terms array<long>, tf array<int>"), "rank-counts")
    size = counted.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    m = F.expr(f"{100 - LENGTH_PERCENT}L + ({LENGTH_PERCENT}L * n * {size['n']}L) div {max(1, size['l'])}L")
    impact = f"transform(tf, x -> cast(({_impact('x', 'm')} + {STEP - 1}) div {STEP} - 128 as tinyint))"
    rows = counted.withColumn("m", m).select("doc_id", "m", "terms", F.expr(impact).alias("impact"), "tf")
    return Index(written(rows, "rank-index"), size["n"], size["l"])


def _impact(tf: str, m: str) -> str:
    return f"({SCALE}L * {tf}) div ({TF_UNIT}L * {tf} + {LENGTH_UNIT}L * {m})"


def query_terms(queries: DataFrame) -> DataFrame:
    """item (a number for each distinct id and text), item_id, term, often: as a work table."""
    rows = queries.select("item_id", text_of().alias("text")).distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", term_names(F.col("text")).alias("w"))
    each = written(rows, "rank-queries").select("item", "item_id", F.explode("w").alias("term"))
    return written(each.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("often")), "rank-query-terms")


def weighted(terms: DataFrame, index: Index) -> DataFrame:
    """item, item_id, term, weight (times its repeats) of the query terms that a document has and that weigh anything."""
    wanted = terms.select("term").distinct()
    df = index.rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted, "term")
    w = F.floor(F.lit(float(WEIGHT_UNIT)) * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").select("item", "item_id", "term", "df", w.alias("w"), (w * F.col("often")).alias("weight")).where("w > 0")


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1, ... in one array."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Block:
    """A block of queries: the terms (sorted names) and weights, by term and by query. Terms of many queries, or of
    many documents, are multiplied as a dense matrix; the others posting by posting."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray, documents: int):
        self.size = int(query.max()) + 1
        self.names, column = np.unique(term, return_inverse=True)
        order = np.lexsort((query, column))
        self.query, self.weight = query[order], weight[order]
        self.at = np.searchsorted(column[order], np.arange(len(self.names) + 1))
        frequency = np.zeros(len(self.names), np.int64)
        frequency[column] = df
        dense = (np.diff(self.at) * 32 >= self.size) | (frequency * 16 >= documents)
        self.dense = np.full(len(self.names), -1)
        self.dense[dense] = np.arange(dense.sum())
        self.matrix = np.zeros((int(dense.sum()), self.size))
        inside = dense[column]
        self.matrix[self.dense[column[inside]], query[inside]] = weight[inside]
        order = np.lexsort((column, query))
        self.columns, self.weights = column[order], weight[order]
        self.begin = np.searchsorted(query[order], np.arange(self.size + 1))

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, where in the lists) of the batch's postings of this block's terms."""
        names, owner = _flat(batch.column("terms"))
        if not len(names):
            return owner, owner, owner
        column = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        at = np.nonzero(self.names[column] == names)[0]
        return owner[at], column[at], at

    def sums(self, rows: int, doc: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        """documents x queries: the sums of weight * value."""
        place = self.dense[column]
        inside = place >= 0
        values = np.zeros((rows, len(self.matrix)))
        values[doc[inside], place[inside]] = value[inside]
        out = values @ self.matrix
        doc, column, value = doc[~inside], column[~inside], value[~inside]
        first, last = self.at[column], self.at[column + 1]
        part, size = _ranges(first, last), last - first
        key = np.repeat(doc, size) * self.size + self.query[part]
        return out + np.bincount(key, np.repeat(value, size) * self.weight[part], minlength=rows * self.size).reshape(out.shape)

    def exact(self, pairs: tuple[np.ndarray, np.ndarray], doc: np.ndarray, column: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """The integer scores of (document, query) pairs, ``PAIRS`` at a time: copies may bring very many."""
        if not len(pairs[0]) or not len(doc):
            return np.zeros(len(pairs[0]), np.int64)
        key = doc * len(self.names) + column
        order = np.argsort(key)
        key, impact = key[order], impact[order]
        return np.concatenate([self._exact(*(p[i : i + PAIRS] for p in pairs), key, impact) for i in range(0, len(pairs[0]), PAIRS)])

    def _exact(self, d: np.ndarray, q: np.ndarray, key: np.ndarray, impact: np.ndarray) -> np.ndarray:
        part = _ranges(self.begin[q], self.begin[q + 1])
        size = self.begin[q + 1] - self.begin[q]
        asked = np.repeat(d, size) * len(self.names) + self.columns[part]
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        gain = np.where(key[at] == asked, impact[at], 0) * self.weights[part]
        return np.add.reduceat(gain, np.cumsum(size) - size)


#: Sums of doubles are exact up to 2 ** 53; beyond, bounds keep this much room.
_ROOM = 1e-9


def _lower(shared, k: int):
    """For each query of the block, the task's ``k`` largest lower bounds above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.zeros((k, block.size))
        for batch in batches:
            doc, column, at = block.postings(batch)
            b = _flat(batch.column("impact"))[0][at].astype(np.int64) + 128
            bounds = block.sums(batch.num_rows, doc, column, np.maximum(0, (b - 1) * STEP + 1).astype(float)) * (1 - _ROOM)
            both = np.concatenate([best, bounds])
            best = np.partition(both, len(both) - k, axis=0)[-k:]
        rank, query = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best[rank, query], pa.float64())], names=["query", "bound"])

    return run


def _best(shared, kth: np.ndarray, k: int):
    """For each query of the block, the task's ``k`` best documents, scored exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        query, score, doc_id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        unknown = np.empty(0, bool)
        for batch in batches:
            doc, column, at = block.postings(batch)
            b = _flat(batch.column("impact"))[0][at].astype(np.int64) + 128
            bounds = block.sums(batch.num_rows, doc, column, (b * STEP).astype(float)) * (1 + _ROOM)
            pairs = np.nonzero((bounds >= kth) & (bounds > 0))
            tf = _flat(batch.column("tf"))[0][at].astype(np.int64)
            m = batch.column("m").to_numpy()[doc]
            points = block.exact(pairs, doc, column, SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * m))
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)[pairs[0]]
            ids = ids.fill_null(_LAST).to_numpy()[pairs[0]]
            query, score, doc_id, unknown = (np.concatenate(x) for x in ((query, pairs[1]), (score, points), (doc_id, ids), (unknown, null)))
            order = np.lexsort((unknown, doc_id, -score, query))
            order = order[score[order] > 0]
            first = np.searchsorted(query[order], query[order])
            order = order[np.arange(len(order)) - first < k]
            query, score, doc_id, unknown = query[order], score[order], doc_id[order], unknown[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, pa.int64(), mask=unknown)], names=["query", "score", "doc_id"]
        )

    return run


def search(index: Index, queries: DataFrame, k: int = TOP, terms: DataFrame | None = None, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: each query's ``k`` best documents. ``terms``: ``query_terms(queries)``, if there."""
    spark = queries.sparkSession
    modest_batches(spark)
    entries_ = written(weighted(query_terms(queries) if terms is None else terms, index), "rank-weights")
    blocks = max(1, -(-entries_.count() // entries))
    entries_ = entries_.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    kind = queries.schema["item_id"].dataType.simpleString()
    found = None
    for number in range(blocks):
        mine = entries_.where(F.col("block") == number).select("item", "term", "weight", "df").toPandas()  # about ``entries`` rows
        if mine.empty:
            continue
        items, query = np.unique(mine["item"].to_numpy(np.int64), return_inverse=True)
        shared = spark.sparkContext.broadcast(Block(query, mine["term"].to_numpy(np.int64), mine["weight"].to_numpy(np.int64), mine["df"].to_numpy(np.int64), index.documents))
        bounds = index.rows.select("terms", "impact").mapInArrow(_lower(shared, k), "query int, bound double")
        order = W.partitionBy("query").orderBy(F.col("bound").desc())
        reached = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("query", "bound").toPandas()  # a row a query
        kth = np.zeros(len(items))
        kth[reached["query"].to_numpy(np.int64)] = reached["bound"]
        best = index.rows.select("doc_id", "m", "terms", "impact", "tf").mapInArrow(_best(shared, kth, k), "query int, score long, doc_id long")
        order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        numbers = spark.createDataFrame(list(enumerate(items.tolist())), "query int, item long")
        named = entries_.select("item", "item_id").distinct().join(numbers, "item")
        part = written(ranked.join(named, "query").select("item_id", "rank", "doc_id", "score"), "rank-results")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    terms = query_terms(items)
    return search(build_index(table(spark, sf_dir, "documents"), terms), items, terms=terms)


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), z AS (
  SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM t WHERE len(w) > 0
), p AS (
  SELECT doc_id, term, 75 + (25 * len(w) * nd) // nt AS m, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, w, unnest(w) AS term FROM t), z GROUP BY doc_id, term, len(w), nd, nt
), v AS (
  SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, z WHERE term IN (SELECT term FROM q) GROUP BY term, nd
), r AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN p USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
"""
