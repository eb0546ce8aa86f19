"""Benchmark items that all begin alike: copies are found, documents that only quote the beginning pair with no item."""

import time

import numpy as np
import pytest

from tallyloom.llm import decontaminate as dec


def _names(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [np.array(r.w, dtype=np.int64).view(np.uint64) for r in rows.orderBy("i").select(dec.word_names(F.col("text")).alias("w")).collect()]


@pytest.mark.parametrize("head, tail", [(15, 25), (20, 10)])
def test_templated_items(spark, head, tail):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(3000)]
    prompt = [f"p{i}" for i in range(head)]
    items = [" ".join(prompt + list(rng.choice(vocab, tail))) for _ in range(150)]
    docs = []
    for i in range(60):
        body = list(rng.choice(vocab, 80))
        if i % 3 == 0:  # an item, one word in eight changed
            copied = items[i].split()
            for k in rng.choice(len(copied), len(copied) // 8, replace=False):
                copied[k] = "changed"
            body[40:40] = copied
        elif i % 3 == 1:  # only the beginning of all items
            body[40:40] = prompt
        docs.append(" ".join(body))
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, unit string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, gram string")
    got = {(r.doc_id, m.item_id) for r in dec.find_leaks(frame, bench).collect() for m in r.matches if m.score >= dec.LEAST}
    d, q = _names(spark, docs), _names(spark, items)
    want = {(i, j) for i, x in enumerate(d) for j, y in enumerate(q) if dec.align(x, y)[0] >= dec.LEAST * dec.MATCH * len(y)}
    assert want and got <= want
    assert len(got & want) >= 0.9 * len(want)
    assert {(i, i) for i in range(0, 60, 3)} <= got


def test_many_templated_items_stay_linear(spark):
    rng = np.random.default_rng(9)
    prompt = " ".join(f"p{i}" for i in range(15))
    vocab = np.array([f"w{i}" for i in range(20000)])
    items = [(j, prompt + " " + " ".join(rng.choice(vocab, 25))) for j in range(5000)]
    docs = [(i, " ".join(rng.choice(vocab, 100)) + " " + (items[i][1] if i % 50 == 0 else prompt)) for i in range(1000)]
    began = time.time()
    out = dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    print("seconds for 5,000 items and 1,000 documents:", round(time.time() - began))
    assert sorted(r.doc_id for r in out if any(m.score >= dec.LEAST for m in r.matches)) == list(range(0, 1000, 50))
    assert sum(len(r.matches) for r in out) < 2000  # each pair that was judged and shared a word; not documents by items
