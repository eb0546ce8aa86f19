"""Language ID, ranked search and the filter audit against brute force, with nulls, empty and long texts, ties, repeats."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import audit, langid, ranked
from tests.llm.test_operators import FOLD, SCHEMA, WORD, docs, lots, none  # noqa: F401

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


# Filter audit


def brute_audit(rows, labels):
    good, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    documents = []
    for i, t, _, source, *_ in rows:
        text = t or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        documents.append((source or "", fails, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for part in {d[0] for d in documents}:
            left = [d for d in documents if d[0] == part]
            every, gone = left, []
            for step, f in enumerate(order, 1):
                removed, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in every), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {(part, order, step, *v, total[part, order[step - 1]]) for (part, order, step), v in out.items()}


def test_audit(spark, docs, none):  # noqa: F811
    rows = [r[:4] for r in lots()]
    more = [(200, "Many Words Here " * 80, "en", "s1"), (201, "many words here " * 80, "en", ""), (202, "a$b " + " ".join(f"x{k}" for k in range(300)), "en", None), (202, "a$b " + " ".join(f"x{k}" for k in range(300)), "en", None), (None, "many words here " * 80, "en", "s2"), (90, "many words here " * 80, "en", "s2")]
    frame = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(1)).repartition(3)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(202, 0, 1), (202, 1, None), (None, 1, 1), (9999, 1, 1), (90, None, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = audit.filter_audit(frame, known)
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows + more, labels)
    assert [dict(out.dtypes)[c] for c in columns] == ["string", "string", "int"] + ["bigint"] * 7
    assert audit.filter_audit(none, known).count() == 0
    bare = audit.filter_audit(frame, known.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    # Shapley values of a part add up to 120 times what any order removes.
    for r in out.groupBy("part", "filter_order").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect():
        assert r.s == 120 * r.r


def test_audit_of_other_filters(spark, docs):  # noqa: F811
    """Any filters, in all their orders, under their own letters."""
    none_ = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit.audit(audit.cells(docs, none_, {"X": "m.n_words < 3"}), "XE")
    assert {r.filter_order for r in out.collect()} == {"XE", "EX"}


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute_search(rows, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, text in dict.fromkeys(queries):
        scored = []
        for i, c in counted:
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((score, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return Counter(out)


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"t{i}" for i in range(150)] + ["The", "the", "Ünï", "x_y", "a-b", "1,2"]
    weight = 1 / np.arange(1, len(vocab) + 1)
    make = lambda n: " ".join(rng.choice(vocab, n, p=weight / weight.sum()))
    rows = [(i, make(int(rng.integers(1, 120)))) for i in range(160)]
    rows += [(i, rows[5][1]) for i in range(300, 460)] + [(500, None), (501, ""), (502, " -- !!"), (503, make(8000)), (None, rows[5][1]), (None, make(30)), (7, rows[5][1]), (7, rows[7][1])]
    queries = [(q, make(int(rng.integers(1, 40)))) for q in range(12)] + [(12, rows[5][1]), (13, None), (14, "nowhere at all"), (15, "t0 t0 T0 t1"), (15, "t0 t0 T0 t1"), (15, "t3"), (None, "t2 t9")]
    return rows, queries


@pytest.mark.parametrize("entries", [ranked.ENTRIES, 60])
def test_search(spark, entries):
    rows, queries = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, n int").repartition(5)
    asked = spark.createDataFrame([(*q, 1) for q in queries], "item_id long, text string, item int")
    want = brute_search(rows, queries, 20)
    for vocabulary in (None, ranked.query_terms(asked)):
        index = ranked.build_index(frame, vocabulary)
        assert (index.documents, index.terms) == (sum(bool(terms(t)) for _, t in rows), sum(len(terms(t)) for _, t in rows))
        out = ranked.search(index, asked, entries=entries)
        assert Counter(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect())) == want
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_without_rows(spark):
    rows, queries = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    index = ranked.build_index(frame)
    assert ranked.search(index, asked.limit(0)).count() == 0
    assert ranked.search(ranked.build_index(frame.limit(0)), asked).count() == 0
    assert index.rows.count() == len(rows)  # every row is indexed


def test_bounds_hold(spark):
    """A byte's bounds hold the impact, at both ends."""
    rows = [(1, "a " * 1000), (2, "a"), (3, "b " * 5 + "c " * 30_000)]
    index = ranked.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in index.rows.collect():
        for tf, b in zip(r.tf, r.impact):
            exact = ranked.SCALE * tf // (1000 * tf + 12 * r.m)
            assert (b + 128 - 1) * ranked.STEP < exact <= (b + 128) * ranked.STEP or exact == 0 == b + 128


# Language ID


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    sizes, k = np.array([1, 4, 6, 2]), 3
    scores, steps = rng.normal(size=(13, k)), rng.normal(size=(k, k))
    got = langid.forward_backward(scores, sizes, steps)[0]
    begin = 0
    for n in sizes:
        weight = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            start = sum(np.exp(steps[i, path[0]]) for i in range(k)) / k
            p = start * np.exp(sum(scores[begin + i, s] for i, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            weight[range(n), path] += p
        assert np.allclose(got[begin : begin + n], weight / weight.sum(axis=1, keepdims=True))
        begin += n


def test_long_texts_equal_one_block():
    """Texts of many blocks, and of one: the same marginals."""
    rng = np.random.default_rng(2)
    scores, steps, sizes = rng.normal(size=(5000, 4)), rng.normal(size=(4, 4)), np.array([4200, 3, 797])
    got = langid.forward_backward(scores, sizes, steps)
    keep = langid.BLOCK
    try:
        langid.BLOCK = 10_000
        whole = langid.forward_backward(scores, sizes, steps)
    finally:
        langid.BLOCK = keep
    assert all(np.allclose(a, b) for a, b in zip(got[:1], whole[:1]))


def test_words_and_features():
    text = "Foo-bar x ÉÀ1z_q"
    points, begin = langid.code_points([text, "", "foo"])
    words = langid.find_words(points)
    found = [("".join(map(chr, points[a:b]))) for a, b in zip(words.start, words.stop)]
    assert found == ["foo", "bar", "x", "éà", "z", "q", "foo"] and begin.tolist() == [0, len(text) + 1, len(text) + 2, len(text) + 6]
    assert words.names[0] == words.names[-1] and len(set(words.names.tolist())) == 6
    again = words.taken(np.array([6, 1]))
    assert (again.grams[:3] == words.grams[:3]).all() and (again.affixes[0] == words.affixes[0]).all()
    empty = langid.find_words(langid.code_points(["", "12 !"])[0])
    assert len(empty.start) == 0 and len(empty.names) == 0


def test_slices_do_not_change_words():
    text = ["abc déf " * 40, "x" * 300, "end"]
    points, _ = langid.code_points(text)
    whole = langid.find_words(points)
    keep = langid.SLICE
    try:
        langid.SLICE = 17
        parts = [(a, langid.find_words(points[a:b])) for a, b in langid._slices(points)]
    finally:
        langid.SLICE = keep
    assert np.concatenate([w.start + a for a, w in parts]).tolist() == whole.start.tolist()
    assert np.concatenate([w.names for _, w in parts]).tolist() == whole.names.tolist()


def test_gradient(monkeypatch):
    """One learning step moves the weights along the slope of the likelihood, by finite differences."""
    rng = np.random.default_rng(4)
    words = langid.find_words(langid.code_points(["ab cd ab ef gh ab cd"])[0])
    label, sizes = rng.integers(0, 2, 7), np.array([3, 4])
    model = langid.Model(["p", "q"], np.zeros((1 << langid.HASH_BITS, 2), np.float32), np.unique(words.names)[:2], np.eye(3, dtype=np.float32)[:2], rng.normal(size=(3, 2)) * 0.1, rng.normal(size=(2, 2)))

    def likelihood(steps, lexical):
        m = langid.Model(model.languages, model.weights, model.lexicon, model.listed, lexical, steps)
        s, total, begin = m.scores(words), 0.0, 0
        for n in sizes:
            def weigh(path):
                return np.log(np.exp(steps[:, path[0]]).mean()) + sum(s[begin + i, x] for i, x in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))  # noqa: B023
            every = [weigh(p) for p in itertools.product(range(2), repeat=int(n))]
            total += weigh(label[begin : begin + n]) - np.logaddexp.reduce(every)
            begin += n
        return total

    def slope(which, i, j, h=1e-5):
        values = []
        for sign in (1, -1):
            a = {"steps": model.steps.copy(), "lexical": model.lexical.copy()}
            a[which][i, j] += sign * h
            values.append(likelihood(**a))
        return (values[0] - values[1]) / (2 * h)

    want = {w: np.array([[slope(w, i, j) for j in range(2)] for i in range(getattr(model, w).shape[0])]) for w in ("steps", "lexical")}
    squares = [np.zeros(a.shape) for a in (model.weights, model.lexical, model.steps)]
    before = {w: getattr(model, w).copy() for w in want}
    monkeypatch.setattr(langid, "RATE", 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        langid._learn(model, squares, words, label, sizes)
    for w, k in (("lexical", 1), ("steps", 2)):
        assert np.allclose(np.sqrt(squares[k]), np.abs(want[w]), atol=1e-5)
        moved = np.nan_to_num(getattr(model, w) - before[w])
        assert (np.sign(np.round(moved, 3)) == np.sign(np.round(want[w], 6))).all()


@pytest.fixture(scope="module")
def model(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def test_held_out_accuracy(spark, model):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    truth = {r.doc_id: r.lang for r in frame.select("doc_id", "lang").collect()}
    held = [i for i in truth if crc(i) % 4 == 2]
    assert out.keys() == truth.keys() and all(out[i].held_out == (crc(i) % 4 == 2) for i in truth)
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_code_switching(spark, model):
    """Stretches of held-out texts of two languages: most words get their own language, and spans cover all words."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("char_length(text) between 400 and 3000").collect() if crc(r.doc_id) % 4 == 2]
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        by[r.lang].append(re.findall(r"[^\W\d_]+", r.text.lower()))
    mixed, truth = [], []
    for k, (a, b) in enumerate(itertools.permutations(sorted(by), 2)):
        x, y = by[a][0][:40], by[b][0][:30]
        mixed.append((k, " ".join(x + y + x[:15])))
        truth.append([a] * len(x) + [b] * len(y) + [a] * len(x[:15]))
    right = total = 0
    for r in langid.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect():
        got = [s.lang for s in r.spans for _ in range(s.n_words)]
        text = dict(mixed)[r.doc_id]
        assert len(got) == len(truth[r.doc_id]) == sum(len(re.findall(r"[^\W\d_]+", text[s.start : s.stop])) for s in r.spans)
        right += sum(a == b for a, b in zip(got, truth[r.doc_id]))
        total += len(got)
    assert right / total >= 0.95


def test_language_edges(spark, docs, none, model):  # noqa: F811
    out = langid.identify(docs, model).collect()
    assert Counter(str(r.doc_id) for r in out) == Counter(str(r[0]) for r in lots())
    letters = {i: bool(re.search(r"[^\W\d_]", t or "")) for i, t, *_ in lots() if i is not None}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) and (r.score > 0) == letters[r.doc_id] for r in out if r.doc_id is not None)
    assert all(not r.held_out for r in out if r.doc_id is None)
    assert langid.identify(none, model).count() == 0
    teaches = F.col("doc_id") % 2 == 0
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), teaches) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    one = langid.fit(docs, teaches)  # a single language
    assert one.languages == ["en"] and {r.lang_pred for r in langid.identify(docs, one).collect()} == {"en", "und"}
    again = langid.fit(docs.repartition(5), teaches)
    assert np.array_equal(one.lexicon, again.lexicon) and np.allclose(one.steps, again.steps)
