"""Language of texts and of their words by a linear-chain conditional random field.

Words are the maximal runs of letters of the lower-cased text; each gets one language. A word's score for a language
adds up its affixes (first 1-3 and last 1-4 letters), its letter 2- and 3-grams, and whether it stands in the
lexicon of any language; a learned matrix scores the step from one word's language to the next's, so text that
switches languages is cut where the words say so. Forward-backward over the whole text gives each word's
probabilities; a text's language is the one with the largest part of its letters, and that part is its score.

* Lexicon: the ``LEXICON`` words that most training documents' words are, for each language, counted over all
  training documents by Spark.
* Weights: fitted by AdaGrad on the likelihood of mixed sequences, cut from a bounded sample of the training
  documents: ``EXAMPLES`` a language (the smallest MD5 of the id, at most ``LONGEST`` characters). A sequence strings
  stretches of several languages together, which teaches the steps between languages.
* Everything in tasks is vectorised over a batch. Forward-backward cuts texts into blocks: the blocks' transfer
  matrices are made side by side, chained along each text, and give every block its start and end, so a very long
  text costs no more a word than short ones.

N-grams are hashed to ``2 ** HASH_BITS`` rows of weights; what is broadcast has a size bound by the number of
languages.

Edge cases: a text that is null or without a letter is ``und`` with score 0; without any training document all are
``und``; ties take the language that comes first by code point; a null id is not held out and teaches nothing; a null
or empty lang teaches nothing; rows with the same id are judged each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import modest_batches, table, text_of

#: Bounds of the fitted sample: documents a language, and characters of one text.
EXAMPLES, LONGEST = 200, 50_000
LEXICON = 3000
HASH_BITS = 16
FOLDS, HELD = 4, 2
#: Training: passes over the sample, words of a stretch (mean), stretches of a sequence, words of a step, rate.
PASSES, STRETCH, MIXED, STEP_WORDS, RATE = 3, 40, 4, 4000, 0.15
#: Characters whose features are made at once; words of a block of forward-backward, and its matrices' size in numbers.
SLICE, BLOCK, MATRICES = 1_000_000, 32, 8_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_PREFIXES, _SUFFIXES, _GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


@dataclass(frozen=True)
class Words:
    """The words of a text or a batch of texts: places of the first letter and past the last one, the rows of weights
    of their letters (two n-grams a letter) and affixes (0: none, its weights stay zero), and their names."""

    start: np.ndarray
    stop: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    affixes: np.ndarray
    names: np.ndarray

    def taken(self, rows: np.ndarray) -> Words:
        """The words ``rows``, in that order."""
        size = (self.stop - self.start)[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows] - ends + size, size)
        return Words(self.start[rows], self.stop[rows], self.grams[at], ends - size, self.affixes[rows], self.names[rows])


def _row(hashes: np.ndarray, tag: int) -> np.ndarray:
    """Rows 1 .. 2 ** HASH_BITS - 1 of the weights."""
    x = (hashes + np.uint64(tag)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.maximum(x >> np.uint64(64 - HASH_BITS), np.uint64(1)).astype(np.int64)


def find_words(points: np.ndarray) -> Words:
    """The words of lower-cased code points; neighbours in ``points`` that belong to two texts must be cut by a
    character that is no letter."""
    mask = letters()[points]
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    size = stop - start
    first = np.cumsum(size) - size
    c = points[mask].astype(np.uint64) + np.uint64(1)
    within = np.arange(len(c)) - np.repeat(first, size)
    left = np.repeat(size, size) - within
    ahead = [c]  # ahead[k - 1][i]: the hash of the k letters from i on, right where a word has that many
    for k in range(1, max(_GRAMS + _PREFIXES + _SUFFIXES)):
        ahead.append(ahead[-1] * _P + np.concatenate([c[k:], np.zeros(min(k, len(c)), np.uint64)]))
    grams = np.stack([np.where(left >= n, _row(ahead[n - 1], n), 0) for n in _GRAMS], axis=1)
    affixes = [np.where(size >= n, _row(ahead[n - 1][first], 16 + n), 0) for n in _PREFIXES]
    affixes += [np.where(size >= n, _row(ahead[n - 1][np.maximum(first + size - n, 0)], 32 + n), 0) for n in _SUFFIXES]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) if len(size) else 0, _P)]), dtype=np.uint64)
    spread = (c ^ (c >> np.uint64(7))) * np.uint64(0x94D049BB133111EB)
    names = np.add.reduceat((spread ^ (spread >> np.uint64(32))) * powers[within], first) if len(first) else np.empty(0, np.uint64)
    return Words(start, stop, grams, first, np.stack(affixes, axis=1), names.view(np.int64))


def _slices(points: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SLICE`` characters that end where no word goes on."""
    low = 0
    while low < len(points):
        high = min(len(points), low + SLICE)
        while high < len(points) and letters()[points[high - 1]] and letters()[points[high]]:
            high += 1
        yield low, high
        low = high


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts in one array, each followed by a line end, and where each begins."""
    low = [t.lower() for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    return np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "replace"), np.uint32), begin


@dataclass(frozen=True)
class Model:
    """Languages (rising), weights of n-grams and affixes, lexicon (sorted names; which languages have each), weights
    of the lexicon features (a row for each language, and one for words in none), and steps between languages."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    listed: np.ndarray
    lexical: np.ndarray
    steps: np.ndarray

    def known(self, names: np.ndarray) -> np.ndarray:
        """Lexicon features of words: one for each language, and one for none."""
        out = np.zeros((len(names), self.listed.shape[1]), np.float32)
        if not len(self.lexicon):
            return out
        at = np.minimum(np.searchsorted(self.lexicon, names), len(self.lexicon) - 1)
        hit = self.lexicon[at] == names
        out[hit] = self.listed[at[hit]]
        out[~hit, -1] = 1
        return out

    def scores(self, w: Words) -> np.ndarray:
        """words x languages: the sums of the features' weights."""
        if not len(w.start):
            return np.zeros((0, len(self.languages)))
        per_letter = self.weights[w.grams[:, 0]]
        for k in range(1, w.grams.shape[1]):
            per_letter = per_letter + self.weights[w.grams[:, k]]
        out = np.add.reduceat(per_letter, w.first).astype(np.float64)
        for k in range(w.affixes.shape[1]):
            out += self.weights[w.affixes[:, k]]
        return out + self.known(w.names) @ self.lexical


def forward_backward(scores: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, before, after) of words whose texts have ``sizes`` (each at least 1) words: ``before`` is the
    forward vector of the word before (even at a text's begin), ``after`` is what follows times the word itself.

    A word's vector is the one before, times ``exp(steps)``, times ``exp(scores)``; all vectors are scaled.
    """
    n, k = scores.shape
    x = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(steps)
    length = max(BLOCK, -(-n * k * k // MATRICES))
    blocks = -(-sizes // length)
    begin, first = np.cumsum(sizes) - sizes, np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(begin, blocks) + number * length
    words = np.minimum(length, np.repeat(sizes, blocks) - number * length)
    order = np.argsort(-words, kind="stable")
    active = np.searchsorted(-words[order], -np.arange(words.max()), side="left")  # blocks of more than i words
    rows = [at[order[:a]] + i for i, a in enumerate(active)]
    moved = np.repeat(np.eye(k)[None], len(at), axis=0)
    for a, r in zip(active, rows):
        m = (moved[:a].reshape(-1, k) @ t).reshape(-1, k, k) * x[r][:, None, :]
        moved[:a] = m / m.sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(moved)
    back[order] = moved
    start, end = np.full((len(at), k), 1 / k), np.full((len(at), k), 1 / k)
    texts = np.argsort(-blocks, kind="stable")
    more = [texts[: np.searchsorted(-blocks[texts], -j, side="left")] for j in range(1, int(blocks.max()))]  # texts of more than j blocks
    for j, d in enumerate(more, 1):
        v = np.matmul(start[first[d] + j - 1][:, None, :], back[first[d] + j - 1])[:, 0]
        start[first[d] + j] = v / v.sum(axis=1, keepdims=True)
    for j, d in reversed(list(enumerate(more, 1))):
        v = np.matmul(back[first[d] + j], end[first[d] + j][:, :, None])[:, :, 0]
        end[first[d] + j - 1] = v / v.sum(axis=1, keepdims=True)
    before, here, after = np.empty((n, k)), np.empty((n, k)), np.empty((n, k))
    v = start[order]
    for a, r in zip(active, rows):
        before[r] = v[:a]
        u = (v[:a] @ t) * x[r]
        v[:a] = here[r] = u / u.sum(axis=1, keepdims=True)
    v = end[order]
    for a, r in reversed(list(zip(active, rows))):
        here[r] *= v[:a]
        after[r] = x[r] * v[:a]
        u = after[r] @ t.T
        v[:a] = u / u.sum(axis=1, keepdims=True)
    return here / here.sum(axis=1, keepdims=True), before, after


def _joined(parts: list[Words]) -> Words:
    shift = np.cumsum([0] + [len(p.grams) for p in parts[:-1]])
    return Words(*[np.concatenate([getattr(p, f.name) + (s if f.name == "first" else 0) for p, s in zip(parts, shift)]) for f in fields(Words)])


def train(texts: list[str], labels: np.ndarray, languages: list[str], lexicon: np.ndarray, listed: np.ndarray) -> Model:
    """The model fitted on texts whose languages are ``labels`` (numbers)."""
    k = len(languages)
    model = Model(languages, np.zeros((1 << HASH_BITS, k), np.float32), lexicon, listed, np.zeros((k + 1, k)), 2.0 * np.eye(k))
    parts, owner = [], []
    for text, label in zip(texts, labels):
        words = find_words(code_points([text])[0])
        if len(words.start):
            parts.append(words)
            owner.append(np.full(len(words.start), label))
    if not parts:
        return model
    words, label = _joined(parts), np.concatenate(owner)
    change = np.concatenate([[0], np.cumsum([len(p.start) for p in parts])])
    rng = np.random.default_rng(11)
    squares = [np.full(a.shape, 1e-6, a.dtype) for a in (model.weights, model.lexical, model.steps)]
    for _ in range(PASSES):
        cuts = np.unique(np.concatenate([change, np.cumsum(rng.geometric(1 / STRETCH, size=max(1, 2 * len(label) // STRETCH)))]))
        cuts = cuts[cuts <= len(label)]
        stretch = rng.permutation(len(cuts) - 1)
        size = np.diff(cuts)[stretch]
        # Every MIXED stretches make a sequence; sequences of about STEP_WORDS words make a step.
        sequence = np.arange(len(stretch)) // MIXED
        step = (np.cumsum(size) - size) // STEP_WORDS
        step = step[np.searchsorted(sequence, sequence)]
        for one in np.unique(step):
            mine = np.nonzero(step == one)[0]
            at = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in stretch[mine]])
            sizes = np.bincount(sequence[mine] - sequence[mine[0]], size[mine]).astype(np.int64)
            _learn(model, squares, words.taken(at), label[at], sizes)
    return model


def _learn(model: Model, squares: list[np.ndarray], words: Words, label: np.ndarray, sizes: np.ndarray) -> None:
    """One AdaGrad step on the log-likelihood of sequences, in place."""
    k = len(model.languages)
    marginal, before, after = forward_backward(model.scores(words), sizes, model.steps)
    gap = -marginal
    gap[np.arange(len(label)), label] += 1
    at = np.repeat(np.arange(len(label)), words.stop - words.start)
    weights = np.zeros_like(model.weights)
    for c in range(k):
        for column, source in [(words.grams[:, g], gap[at, c]) for g in range(words.grams.shape[1])] + [(words.affixes[:, g], gap[:, c]) for g in range(words.affixes.shape[1])]:
            weights[:, c] += np.bincount(column, source, minlength=len(weights))
    weights[0] = 0
    lexical = model.known(words.names).T @ gap
    t = np.exp(model.steps)
    expected = t * (before.T @ (after / ((before @ t) * after).sum(axis=1, keepdims=True)))
    begin = np.cumsum(sizes) - sizes
    inner = np.setdiff1d(np.arange(len(label)), begin)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    opened = before[begin] * t[:, label[begin]].T  # the state before the first word is not observed
    np.add.at(seen.T, label[begin], opened / opened.sum(axis=1, keepdims=True))
    for value, square, gradient in zip((model.weights, model.lexical, model.steps), squares, (weights, lexical, seen - expected)):
        square += gradient * gradient
        value += (RATE * gradient / np.sqrt(square)).astype(value.dtype)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, name, n): the words of each language in a part of the texts."""
    for batch in batches:
        language = batch.column("lang").to_numpy(zero_copy_only=False)
        points, begin = code_points(batch.column("text").to_pylist())
        for low, high in _slices(points):
            words = find_words(points[low:high])
            owner = language[np.searchsorted(begin, words.start + low, side="right") - 1]
            order = np.lexsort((words.names, owner))
            owner, names = owner[order], words.names[order]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
            at = np.nonzero(new)[0]
            n = np.diff(np.append(at, len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(owner[at], pa.int32()), pa.array(names[at], pa.int64()), pa.array(n, pa.int64())], names=["lang", "name", "n"])


def fit(docs: DataFrame, teaches: Column, examples: int = EXAMPLES, lexicon: int = LEXICON) -> Model | None:
    """The model of the documents (doc_id, text, lang) where ``teaches`` holds; None if there are none."""
    spark = docs.sparkSession
    modest_batches(spark)
    good = docs.where(F.coalesce(teaches, F.lit(False)) & (F.coalesce("lang", F.lit("")) != "") & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    languages = sorted(r["lang"] for r in good.select("lang").distinct().collect())  # a row a language
    if not languages:
        return None
    numbers = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    good = good.withColumn("lang", numbers[F.col("lang")])
    counts = good.select("lang", "text").mapInArrow(_word_counts, "lang int, name long, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.col("n").desc(), "name")
    listed = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= lexicon).select("lang", "name").toPandas()  # ``lexicon`` rows a language
    names, at = np.unique(listed["name"].to_numpy(np.int64), return_inverse=True)
    has = np.zeros((len(names), len(languages) + 1), np.float32)
    has[at, listed["lang"].to_numpy(np.int64)] = 1
    # The sample is drawn by ids before any text moves.
    ids = good.where((F.char_length("text") <= LONGEST) & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    order = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    drawn = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= examples).select("doc_id", "lang")
    rows = good.where(F.char_length("text") <= LONGEST).join(F.broadcast(drawn), ["doc_id", "lang"])  # ``examples`` ids a language
    sample = sorted((r["lang"], r["doc_id"], r["text"]) for r in rows.toLocalIterator())
    return train([t for _, _, t in sample], np.array([n for n, _, _ in sample], np.int64), languages, names, has)


def _judged(shared):
    """doc_id, lang_pred, score, spans (language, first and past the last character, of each run of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32())])
        named = pa.array(model.languages, pa.string())
        for batch in batches:
            points, begin = code_points(batch.column("text").to_pylist())
            start, stop, scores = [], [], []
            for low, high in _slices(points):
                words = find_words(points[low:high])
                start.append(words.start + low)
                stop.append(words.stop + low)
                scores.append(model.scores(words))
            rows = batch.num_rows
            start, stop = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (start, stop))
            owner = np.searchsorted(begin, start, side="right") - 1
            count = np.bincount(owner, minlength=rows)
            share = np.zeros((rows, len(model.languages)))
            runs, ends = np.empty(0, np.int64), np.zeros(rows + 1, np.int32)
            label = np.empty(0, np.int64)
            if len(start):
                marginal = forward_backward(np.concatenate(scores), count[count > 0], model.steps)[0]
                size = (stop - start)[:, None]
                for c in range(share.shape[1]):
                    share[:, c] = np.bincount(owner, marginal[:, c] * size[:, 0], minlength=rows)
                label = marginal.argmax(axis=1)
                new = np.ones(len(start), bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                runs = np.nonzero(new)[0]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[runs], minlength=rows))]).astype(np.int32)
            past = np.append(runs[1:], len(start))
            spans = pa.StructArray.from_arrays(
                [named.take(pa.array(label[runs])), pa.array(start[runs] - begin[owner[runs]], pa.int32()), pa.array(stop[past - 1] - begin[owner[runs]] if len(runs) else runs, pa.int32()), pa.array(past - runs, pa.int32())],
                fields=list(span),
            )
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            lang = np.where(total > 0, np.array(model.languages, object)[best], "und")
            score = np.where(total > 0, share.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), spans)],
                names=["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: the language of each text, and the runs of words of one language
    (places in characters of the lower-cased text). Nothing is shuffled."""
    modest_batches(docs.sparkSession)
    kind = "array<struct<lang: string, start: int, stop: int, n_words: int>>"
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(kind).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model)})  # 2 ** HASH_BITS rows and the lexicon
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_judged(shared), f"doc_id {id_kind}, held_out boolean, lang_pred string, score double, spans {kind}")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD))
    other = F.aggregate(F.filter("spans", lambda s: s["lang"] != F.col("lang_pred")), F.lit(0), lambda a, s: a + s["n_words"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_runs"), other.cast("long").alias("n_other_words"))
