"""Stages of the pipeline leave no work table with texts, terms or fingerprints behind, and their rows are right."""

from collections import Counter

import numpy as np

from tallyloom.llm import simhash, toxicity
from tallyloom.llm.common import DATABASE


def tables(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    return {r.tableName for r in spark.sql(f"SHOW TABLES IN {DATABASE}").collect()}


def test_toxic_rows_go_and_no_text_is_kept(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(vocab, 40), *(["vile", "awful", "nasty"] if i % 4 == 0 else [])]), f"s{i % 3}") for i in range(200)]
    # An id with two texts, of which one is toxic, a row twice, null ids, null and empty texts.
    rows += [(0, rows[1][1], "s0"), (4, rows[4][1], "s9"), (None, rows[8][1], None), (None, rows[9][1], "s1"), (None, rows[8][1], "s1"), (300, None, "s1"), (300, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    index, found = toxicity.fit(docs, marks, carry=("doc_id", "text", "source"))
    score = {(r._row.doc_id, r._row.text): index.judge(np.array(r.p, np.int64), np.array(r.n, np.int64))[0] for r in found.collect()}
    before = tables(spark)
    out = toxicity.without_toxic(docs, marks)
    got = out.collect()
    assert out.columns == docs.columns
    assert Counter(map(tuple, got)) == Counter(r for r in rows if score[r[0], r[1]] < 0.5)
    assert 0 < len(got) < len(rows) and any(d == 0 for d, *_ in got) and not any(d == 4 for d, *_ in got)
    assert not tables(spark) - before
    assert toxicity.without_toxic(docs, marks.limit(0)).count() == len(rows)
    assert toxicity.without_toxic(docs.limit(0), marks).count() == 0


def test_near_duplicates_leave_ids_only(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(500)], 80)) for _ in range(20)]
    frame = spark.createDataFrame([(i, texts[i % 20]) for i in range(60)], "doc_id long, text string")
    before = tables(spark)
    found = simhash.similar_documents(frame)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i % 20) for i in range(60)}
    left = tables(spark) - before
    assert [sorted(spark.table(f"{DATABASE}.{t}").columns) for t in left] == [["component_id", "doc_id"]]
