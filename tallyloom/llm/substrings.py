"""Substring dedup by recompression.

A text is a sequence of word names (64-bit hashes). Rounds rename runs of one symbol and then pairs (a symbol
of the left half of the alphabet followed by one of the right half); a new name is the hash of what it stands
for, so equal substrings get equal names in every document without a dictionary. A round only touches symbols
of at most its length, so whether a symbol ends at a place depends on ``REACH`` words to either side: inside
two equal substrings the symbols, and so their borders, are the same.

Each window of ``WINDOW`` words is known by the least context name of the symbol borders at least ``REACH``
words inside it (or by its own name where there are none: then it lies in one long run). Consecutive windows
known by the same name form a stretch. Spark then works on stretches:

1. Names that stand in one document only are dropped.
2. A stretch with the same words as one in a smaller document is covered whole.
3. Stretches that share a name with different words are taken apart, once for each distinct stretch, into
   windows, and the smallest document of each window is found: this gives the exact ends.

Covered words go. Everything is judged on the input. Groups are only reduced by aggregates and joined back, so
a group of copies never meets in one task; each stage ends in a written table.

Edge cases: a null or empty text has no words; texts under ``WINDOW`` words keep all; rows with the same id
don't cover each other; a null id counts as larger than all others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, dropped, held, modest_batches, table, text_of, words, written

WINDOW = 50
#: Rounds of recompression: what is renamed, and the longest symbols (in words) that take part.
ROUNDS = (("run", 1), ("pair", 1), ("pair", 1), ("run", 2), ("pair", 2), ("pair", 2), ("pair", 3))
REACH = sum(longest for _, longest in ROUNDS)

_LAST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def borders(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places where a symbol begins after all rounds. ``first`` is true where a text begins."""
    at, name, size, head = np.arange(len(names)), names, np.ones(len(names), np.int64), first
    for k, (what, longest) in enumerate(ROUNDS):
        if len(at) < 2:
            break
        active = size <= longest
        joint = active[:-1] & active[1:] & ~head[1:]
        if what == "run":
            joint &= name[:-1] == name[1:]
            if not joint.any():
                continue
        else:
            side = (_mix(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
            joint &= ~side[:-1] & side[1:]
        keep = np.concatenate([[True], ~joint])
        starts = np.nonzero(keep)[0]
        count = np.diff(np.append(starts, len(at)))
        left = name[starts]
        if what == "run":
            fresh = np.where(count > 1, _mix(left * np.uint64(3) + count.astype(np.uint64)), left)
        else:
            right = name[np.minimum(starts + 1, len(at) - 1)]
            fresh = np.where(count > 1, _mix(_mix(left) * np.uint64(5) + right), left)
        at, head, name, size = at[starts], head[starts], fresh, np.add.reduceat(size, starts)
    return at


class Stretches:
    """The stretches of a batch of texts: text number, key, name (of the words) and first and last window."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        total = int(begin[-1])
        self.begin = begin
        flat = np.concatenate(texts).astype(np.int64).view(np.uint64) if total else np.empty(0, np.uint64)
        long = np.nonzero(sizes >= WINDOW)[0]
        empty = np.empty(0, np.int64)
        self.text, self.key, self.name, self.start, self.stop = empty, empty, empty, empty, empty
        if not len(long):
            return
        first = np.zeros(total, bool)
        first[begin[:-1][sizes > 0]] = True
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, _BASE)]).astype(np.uint64))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, _BACK)]).astype(np.uint64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(flat) * powers[:-1], dtype=np.uint64)])
        self.more = np.concatenate([[np.uint64(0)], np.cumsum(_mix(flat ^ _BASE) * powers[:-1], dtype=np.uint64)])

        own = np.repeat(np.arange(len(texts)), sizes)
        at = borders(flat, first)
        at = at[(at - REACH >= begin[own[at]]) & (at + REACH <= begin[own[at] + 1])]
        context = np.full(total, _NONE)
        context[at] = self.named(at - REACH, at + REACH)
        width = WINDOW - 2 * REACH + 1
        low, done = context, 1  # low[p]: the least context among p .. p + done - 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low, np.concatenate([low[step:], np.full(step, _NONE)]))
            done += step
        valid = np.repeat(begin[1:], sizes) - np.arange(total) >= WINDOW
        start = np.nonzero(valid)[0]
        key = low[start + REACH]
        bare = key == _NONE
        key[bare] = self.named(start[bare], start[bare] + WINDOW)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
        head = np.nonzero(new)[0]
        self.start, self.stop = start[head], start[np.append(head[1:], len(start)) - 1] + 1
        self.text, self.key = own[self.start], key[head].view(np.int64)
        self.name = self.named(self.start, self.stop + WINDOW - 1, True).view(np.int64)

    def named(self, a: np.ndarray, b: np.ndarray, more: bool = False) -> np.ndarray:
        """The name of the words a .. b-1, wherever they stand."""
        sums = self.more if more else self.sums
        return _mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def of(self, text: int) -> slice:
        return slice(*np.searchsorted(self.text, [text, text + 1]))


def word_names(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def _pairs(names: pd.Series) -> pd.Series:
    """Distinct (key, name) of the stretches of each text, flat: key, name, key, name, ..."""
    s = Stretches(list(names))
    out = []
    for i in range(len(names)):
        cut = s.of(i)
        pairs = np.stack([s.key[cut], s.name[cut]], axis=1)
        out.append(np.unique(pairs, axis=0).reshape(-1) if len(pairs) else pairs.reshape(-1))
    return pd.Series(out)


def _member(pairs: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which rows of ``pairs`` stand in ``flat`` (pairs, one after the other)."""
    return np.isin(np.ascontiguousarray(pairs).view("S16").reshape(-1), np.ascontiguousarray(flat, dtype=np.int64).view("S16"))


def _window_names(s: Stretches, start: np.ndarray) -> np.ndarray:
    return np.stack([s.named(start, start + WINDOW).view(np.int64), s.named(start, start + WINDOW, True).view(np.int64)], axis=1)


def _starts(s: Stretches, rows: np.ndarray) -> np.ndarray:
    """The places of all windows of the stretches ``rows``."""
    count = s.stop[rows] - s.start[rows]
    return np.repeat(s.start[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(rows) else np.empty(0, np.int64)


def _windows(names: pd.Series, wanted: pd.Series) -> pd.Series:
    """Distinct window names of the wanted stretches of each text, flat."""
    s = Stretches(list(names))
    out = []
    for i, want in enumerate(wanted):
        cut = s.of(i)
        rows = np.nonzero(_member(np.stack([s.key[cut], s.name[cut]], axis=1), want))[0] + cut.start
        found = _window_names(s, _starts(s, rows))
        out.append(np.unique(found, axis=0).reshape(-1) if len(found) else found.reshape(-1))
    return pd.Series(out)


def _kept(text: pd.Series, names: pd.Series, whole: pd.Series, single: pd.Series) -> pd.DataFrame:
    listed = [w is not None and len(w) > 0 or x is not None and len(x) > 0 for w, x in zip(whole, single)]
    s = Stretches([n if use else np.empty(0, np.int64) for n, use in zip(names, listed)])
    out = []
    for i, (t, use) in enumerate(zip(text, listed)):
        w = re.findall(WORD, t)
        if not use:
            out.append((" ".join(w), len(w), 0))
            continue
        cut, edge = s.of(i), np.zeros(len(w) + 1, np.int64)
        gone = np.zeros(cut.stop - cut.start, bool)
        if whole.iloc[i] is not None:
            gone = _member(np.stack([s.key[cut], s.name[cut]], axis=1), whole.iloc[i])
        begin = s.begin[i]
        np.add.at(edge, s.start[cut][gone] - begin, 1)
        np.add.at(edge, s.stop[cut][gone] + WINDOW - 1 - begin, -1)
        if single.iloc[i] is not None:
            start = _starts(s, np.nonzero(~gone)[0] + cut.start)
            start = start[_member(_window_names(s, start), single.iloc[i])] - begin
            np.add.at(edge, start, 1)
            np.add.at(edge, start + WINDOW, -1)
        stays = np.cumsum(edge)[:-1] == 0
        kept = [x for x, y in zip(w, stays) if y]
        out.append((" ".join(kept), len(w), len(w) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])


def _exploded(df: DataFrame, flat: str, a: str, b: str) -> DataFrame:
    """(doc, a, b) rows of a flat list of pairs."""
    pair = F.transform(F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)), lambda i: F.struct(F.get(flat, i).alias(a), F.get(flat, i + 1).alias(b)))
    return df.where(F.size(flat) > 0).select("doc", F.inline(pair))


def _flat(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """One row for each doc with its pairs in one flat list."""
    return df.groupBy("doc").agg(F.flatten(F.collect_list(F.array(a, b))).alias(to))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, kept (words that stay, joined by a space), n_words, n_removed."""
    modest_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), text_of().alias("text"))
    longs = "array<long>"
    named = held(texts, "names", word_names(F.col("text")))
    parsed = named.select("doc", F.pandas_udf(_pairs, longs)("names").alias("flat"))
    rows = written(_exploded(parsed, "flat", "key", "name"), "sub-stretches")
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc", "name") for n, f in (("min", F.min), ("max", F.max))]
    shared = rows.groupBy("key").agg(*ends).where("min_doc < max_doc").select("key", (F.col("min_name") < F.col("max_name")).alias("mixed"))
    near = written(rows.join(shared, "key"), "sub-shared")
    dropped(rows)
    first = near.groupBy("key", "name", "mixed").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    covered = near.join(first.where("least < most").select("key", "name", "least"), ["key", "name"]).where("doc > least")
    whole = written(_flat(covered, "key", "name", "whole"), "sub-whole")
    wanted = _flat(first.where("mixed").select(F.col("least").alias("doc"), "key", "name"), "key", "name", "want")
    open_texts = held(texts.select("doc", "text").join(wanted, "doc"), "names", word_names(F.col("text")))
    cut = open_texts.select("doc", F.pandas_udf(_windows, longs)("names", "want").alias("flat"))
    windows = written(_exploded(cut, "flat", "a", "b"), "sub-windows")
    dropped(near)
    least = windows.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("a", "b", "least")
    single = written(_flat(windows.join(least, ["a", "b"]).where("doc > least"), "a", "b", "single"), "sub-single")
    dropped(windows)
    joined = held(texts.join(whole, "doc", "left").join(single, "doc", "left"), "names", word_names(F.col("text")))
    udf = F.pandas_udf(_kept, "kept string, n_words long, n_removed long")
    return joined.select("doc_id", udf("text", "names", "whole", "single").alias("r")).select("doc_id", "r.*")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), c AS (
  SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id
), e AS (
  SELECT doc_id, i FROM c
), p AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), m AS (
  SELECT p.doc_id, p.i, p.x, e.i AS hit FROM p ASOF LEFT JOIN e ON p.doc_id = e.doc_id AND p.i >= e.i
), s AS (
  SELECT doc_id, count(*) FILTER (hit IS NOT NULL AND i < hit + 50) AS gone,
         string_agg(CASE WHEN hit IS NULL OR i >= hit + 50 THEN x END, ' ' ORDER BY i) AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
