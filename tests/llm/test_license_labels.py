"""Each license template as a document gets its own label, whole or altered."""

import numpy as np

from tallyloom.llm import licenses
from tallyloom.llm.license_texts import TEMPLATES


def test_own_labels_only(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label, text in TEMPLATES:
        w = text.split()
        altered = list(w)
        for k in rng.choice(len(w), len(w) // 10, replace=False):
            altered[k] = "zzz"
        rows += [(len(rows), label, "whole", text), (len(rows) + 1, label, "altered", " ".join(altered)), (len(rows) + 2, label, "inside", "some words before " * 9 + text + " and others after" * 9)]
    two = TEMPLATES[0][1] + " then " * 30 + TEMPLATES[-1][1]
    rows.append((len(rows), "both", "two", two))
    frame = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: {s.label for s in r.spans or []} for r in licenses.scan_licenses(frame).collect()}
    wrong = [(label, kind, got[i]) for i, label, kind, _ in rows if kind in ("whole", "inside") and got[i] != {label}]
    assert not wrong
    altered = [got[i] == {label} for i, label, kind, _ in rows if kind == "altered"]
    print("altered templates with their own label only:", sum(altered), "of", len(altered))
    assert np.mean(altered) >= 0.75
    assert got[rows[-1][0]] == {TEMPLATES[0][0], TEMPLATES[-1][0]}
