"""Toxicity by the nearest labelled examples under TF-IDF cosine over all their words.

Fitting: up to ``examples`` labelled rows (half of each class, the smallest MD5 of the id; texts of more than
``LONGEST`` characters are not drawn) with distinct texts become the index. Every word of every example is a term.
Words are runs of letters,
marks, digits and underscores, lower-cased; Spark splits and names them (64-bit hashes), so Python and the driver only
see arrays of numbers: no text and no dictionary of words.
A term weighs ``(1 + ln count) * idf * rf``: IDF counts all documents of the table, and the relevance frequency
``rf = log2(2 + toxic / max(1, other))`` counts the examples of either class that have the term. No term is left
out; ``relevance=False`` sets rf to 1.

Scoring: the index is inverted. A term's postings stand in order of the examples, cut into blocks of ``BLOCK``
examples, and each (term, block) keeps its largest weight; a term of more than 1 in ``FREQUENT`` examples has its
postings as one row of weights instead. The bound of a block is what the frequent terms give there at most, plus the
sum over the other terms of query weight times the term's maximum; blocks are scored in order of their bounds, in
growing batches, until the next bound can't reach the k-th best, so the k nearest are exact. Votes are weighted by cosine and by the class's share of all
labels, shrunk to the prior, and mapped to a probability by isotonic regression over the examples' own leave-one-out
votes. The nearest examples and their cosines are the evidence.

Edge cases: a null or empty text, or one without a word of any example, has no neighbours and scores the share of
toxic labels among such examples; labels that are null, repeated (the largest counts) or without a document are left
out; without any labelled row, scores are 0; a null id is not held out; rows with the same id are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import dropped, held, modest_batches, table, text_of, written

#: Bounds of the labelled sample: rows, and characters of one text.
EXAMPLES, LONGEST = 4000, 200_000
NEIGHBOURS = 25
BLOCK = 256
FREQUENT = 8
SHRINK = 0.5
FOLDS = 5
EVIDENCE = 3

_APART = r"[^\p{L}\p{M}\p{N}_]+"


def term_names(text: Column) -> Column:
    """64-bit names of the words of a text, in order."""
    return F.array_remove(F.transform(F.split(F.lower(text), _APART), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def known_terms(terms: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``terms`` (rising) of the names of a text that stand there, rising, and how often each comes."""
    found, often = np.unique(np.asarray(names, dtype=np.int64), return_counts=True)
    if not len(terms):
        return found[:0], often[:0]
    places = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    known = terms[places] == found
    return places[known], often[known]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1, ... in one array."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


@dataclass(frozen=True)
class Index:
    """Examples (ids, labels, class weights), names of terms (rising) with their factor (idf * rf), and the inverted
    index: the blocks (number, largest weight, and where their postings (example, weight) begin and end) of term t are
    ``block_at[t]:block_at[t + 1]``; ``row[t]`` is the row of a frequent term in ``rows``, else -1."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    terms: np.ndarray
    factor: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    top: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    prior: float
    silent: float
    steps: np.ndarray
    levels: np.ndarray

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.factor[places]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, places: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact k nearest examples with a cosine above 0 (ties: the earlier example), and their cosines."""
        row = self.row[places]
        seldom = row < 0
        base = q[~seldom] @ self.rows[row[~seldom]]
        if skip >= 0:
            base[skip] = 0.0
        first, last = self.block_at[places[seldom]], self.block_at[places[seldom] + 1]
        entries, mine = _ranges(first, last), np.repeat(q[seldom], last - first)
        blocks = self.block[entries]
        least = base.reshape(-1, BLOCK)
        bounds = least.max(axis=1) + np.bincount(blocks, self.top[entries] * mine, minlength=len(least))
        order = np.argsort(-bounds, kind="stable")
        scores, kth, done, step = np.zeros(len(base)), 0.0, 0, 4
        while done < len(order) and bounds[order[done]] > 0 and bounds[order[done]] >= kth - 1e-9:
            # Blocks that can't reach the k-th best any more needn't be scored with the batch.
            batch = order[done : done + step]
            batch = batch[bounds[batch] >= kth - 1e-9]
            chosen = np.zeros(len(bounds), bool)
            chosen[batch] = True
            part = np.nonzero(chosen[blocks])[0]
            begin, end = self.begin[entries[part]], self.end[entries[part]]
            posts = _ranges(begin, end)
            scores += np.bincount(self.example[posts], self.weight[posts] * np.repeat(mine[part], end - begin), minlength=len(scores))
            scores.reshape(-1, BLOCK)[batch] += least[batch]
            done, step = done + step, 16 * step
            if skip >= 0:
                scores[skip] = 0.0
            kth = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        near = np.nonzero(scores >= kth)[0] if kth > 0 else np.nonzero(scores > 0)[0]
        near = near[np.lexsort((near, -scores[near]))][:k]
        return near, scores[near]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * self.weights[near]
        shrink = SHRINK * float(self.weights.mean())
        return float(((w * self.labels[near]).sum() + shrink * self.prior) / (w.sum() + shrink))

    def judge(self, places: np.ndarray, counts: np.ndarray) -> tuple[float, list[int], list[float]]:
        """The score of a text by its known terms, and its evidence: the ids of the nearest examples and their cosines."""
        near, cosine = self.nearest(places, self.vector(places, counts)) if len(places) else (places, places)
        if not len(near):
            return self.silent, [], []
        score = float(np.interp(self.vote(near, cosine), self.steps, self.levels)) if len(self.steps) else self.prior
        return score, self.ids[near[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (mean x of each pool, its level), both rising."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _sample(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(name, doc_id, toxic, text) of at most ``examples`` training rows with distinct texts (``name``); labels by class."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = [known.where(F.col("toxic") == c).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(examples // 2) for c in (0, 1)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select("doc_id", text_of().alias("text")).where(F.char_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")  # at most ``examples`` rows
    texts = texts.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("name")).agg(F.min_by(F.struct("doc_id", "toxic", "text"), "doc_id").alias("r"))
    return texts.select("name", "r.*"), sizes


def term_table(docs: DataFrame, terms: np.ndarray, carry: list[str]) -> DataFrame:
    """(_row, p, n) for each document: its columns ``carry``, the places of its known terms and how often each comes.
    A written table, so that texts are split into words once."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known_terms(shared.value, x) for x in names], columns=["p", "n"])

    row = F.struct(*carry) if carry else F.struct(F.lit(None).alias("_"))
    named = held(docs.select(row.alias("_row"), text_of().alias("_t")), "_n", term_names(F.col("_t")))
    return written(named.select("_row", F.pandas_udf(run, "p array<int>, n array<int>")("_n").alias("c")).select("_row", "c.*"), "toxic-terms")


def document_counts(found: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How many documents of a term table have each of ``size`` terms, and how many documents there are. Each task counts
    all it reads and sends one row for each term it met; term ``size`` stands for the documents themselves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for places in batch["p"]:
                total[places] += 1
            total[-1] += len(batch)
        met = np.nonzero(total)[0]
        yield pd.DataFrame({"p": met, "n": total[met]})

    counted = found.select("p").mapInPandas(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[counted["p"].to_numpy()] = counted["n"].to_numpy()
    return out[:-1], int(out[-1])


def _counted(names: pd.Series) -> pd.DataFrame:
    """The distinct names of each text, rising, and how often each comes."""
    return pd.DataFrame([np.unique(np.asarray(x, dtype=np.int64), return_counts=True) for x in names], columns=["terms", "often"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, relevance: bool = True, carry: tuple[str, ...] = ()) -> tuple[Index, DataFrame] | None:
    """The index over the labelled sample and the term table of ``docs``; None without labelled rows."""
    modest_batches(docs.sparkSession)
    sample, sizes = _sample(docs, labels, examples)
    count = F.pandas_udf(_counted, "terms array<long>, often array<int>")
    named = held(sample, "names", term_names(F.col("text"))).select("toxic", "doc_id", "name", count("names").alias("c"))
    rows = named.select("toxic", "doc_id", "name", "c.*").toArrow()  # at most ``examples`` rows of numbers
    if not rows.num_rows:
        return None
    rows = rows.sort_by([(c, "ascending") for c in ("toxic", "doc_id", "name")])  # a class's examples share blocks
    names = pc.list_flatten(rows["terms"]).to_numpy()
    terms = np.unique(names)
    ends = np.cumsum(pc.list_value_length(rows["terms"]).to_numpy())[:-1]
    places, often = np.searchsorted(terms, names).astype(np.int32), pc.list_flatten(rows["often"]).to_numpy()
    counts = list(zip(np.split(places, ends), np.split(often, ends)))
    found = term_table(docs, terms, list(carry))
    df, total = document_counts(found, len(terms))
    ids, classes = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
    return build(ids, classes, counts, sizes, terms, df, total, relevance), found


def build(ids: np.ndarray, labels: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], sizes: dict[int, int], names: np.ndarray, df: np.ndarray, total: int, relevance: bool) -> Index:
    """The index of examples with these terms (rising) and their counts; ``sizes`` counts all labels by class."""
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(p) for p, _ in counts])
    term, often = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
    factor = np.log((1 + total) / (1 + df)) + 1
    if relevance:
        toxic = np.bincount(term, labels[owner], minlength=len(names))
        factor *= np.log2(2 + toxic / np.maximum(1, np.bincount(term, minlength=len(names)) - toxic))
    weight = (1 + np.log(often)) * factor[term]
    weight /= np.sqrt(np.bincount(owner, weight * weight, minlength=len(ids)))[owner]
    blocks = -(-len(ids) // BLOCK)
    row = np.full(len(names), -1)
    frequent = np.nonzero(np.bincount(term, minlength=len(names)) * FREQUENT > len(ids))[0]
    row[frequent] = np.arange(len(frequent))
    rows = np.zeros((len(frequent), blocks * BLOCK))
    often_ = row[term] >= 0
    rows[row[term[often_]], owner[often_]] = weight[often_]
    owner, term, weight = owner[~often_], term[~often_], weight[~often_]
    order = np.lexsort((owner, term))
    owner, term, weight = owner[order], term[order], weight[order]
    block = owner // BLOCK
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    begin = np.nonzero(new)[0]
    share = np.array([sizes.get(c, 0) / max(1, int((labels == c).sum())) for c in (0, 1)])
    weights = share[labels]
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    quiet = np.array([len(p) == 0 for p, _ in counts])
    silent = float((weights * labels)[quiet].sum() / weights[quiet].sum()) if quiet.any() else prior
    index = Index(
        ids, labels, weights, names, factor, owner.astype(np.int32), weight, np.searchsorted(term[begin], np.arange(len(names) + 1)), block[begin],
        np.maximum.reduceat(weight, begin) if len(begin) else weight, begin, np.append(begin[1:], len(term)), row, rows, prior, silent, np.empty(0), np.empty(0),
    )
    votes = []
    for e, (p, n) in enumerate(counts):
        if len(p):
            votes.append((e, index.vote(*index.nearest(p, index.vector(p, n), skip=e))))
    if not votes:
        return index
    e, x = np.array([v[0] for v in votes]), np.array([v[1] for v in votes])
    steps, levels = isotonic(x, labels[e].astype(float), weights[e])
    return Index(**{**vars(index), "steps": steps, "levels": levels})


def _scores(index: Index, spark: SparkSession):
    shared = spark.sparkContext.broadcast({f.name: getattr(index, f.name) for f in fields(index)})  # at most ``examples`` rows

    def run(places: pd.Series, counts: pd.Series) -> pd.DataFrame:
        known = Index(**shared.value)
        return pd.DataFrame([known.judge(p, n) for p, n in zip(places, counts)], columns=["score", "evidence", "cosines"])

    return F.pandas_udf(run, "score double, evidence array<long>, cosines array<double>")


def _scored(docs: DataFrame, labels: DataFrame, examples: int, relevance: bool, carry: list[str]) -> DataFrame:
    """``_row``: the columns ``carry`` of ``docs``; ``_s``: score, evidence, cosines. Nothing is shuffled."""
    fitted = fit(docs, labels, examples, relevance, tuple(carry))
    if fitted is None:
        none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"), F.array().cast("array<double>").alias("cosines"))
        return docs.select(F.struct(*carry).alias("_row"), none.alias("_s"))
    index, found = fitted
    return found.select("_row", _scores(index, docs.sparkSession)("p", "n").alias("_s"))


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, relevance: bool = True) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted, evidence (ids of the nearest examples),
    cosines."""
    scored = _scored(docs.select("doc_id", "text"), labels, examples, relevance, ["doc_id"]).select("_row.doc_id", "_s.*")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, relevance: bool = True) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, all columns as they are and nothing shuffled.

    Texts are split into words twice, to count documents and to score them: so no text is in a work table, and the
    term table goes as soon as it is counted.
    """
    fitted = fit(docs, labels, examples, relevance)
    if fitted is None:
        return docs
    index, found = fitted
    dropped(found)
    shared = docs.sparkSession.sparkContext.broadcast({f.name: getattr(index, f.name) for f in fields(index)})  # at most ``examples`` rows

    def run(names: pd.Series) -> pd.Series:
        known = Index(**shared.value)
        return pd.Series([known.judge(*known_terms(known.terms, x))[0] for x in names], dtype="float64")

    named = held(docs.select(F.struct(*docs.columns).alias("_row"), text_of().alias("_t")), "_n", term_names(F.col("_t")))
    return named.select("_row", F.pandas_udf(run, "double")("_n").alias("_s")).where("_s < 0.5").select("_row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
