"""Seats back to votes with agreements, and the merge by id and print, against the loops in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import apportion, quality


def averages(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if votes else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (won[i] + 1), votes[i], -i))
        if votes[best] <= 0:
            break
        won[best] += 1
    return won


def pooled(votes, partner, seats):
    first = [i if partner[i] is None else min(i, partner[i]) for i in range(len(votes))]
    pools = sorted(set(first))
    won = averages([sum(v for v, f in zip(votes, first) if f == p) for p in pools], seats)
    out = [0] * len(votes)
    for p, n in zip(pools, won):
        inside = [i for i, f in enumerate(first) if f == p]
        for i, k in zip(inside, averages([votes[i] for i in inside], n)):
            out[i] = k
    return out


def inverted(target, partner, total):
    x = [t / total for t in target]
    for _ in range(60):
        got = pooled(x, partner, total)
        x = [v * (t + 0.5) / (g + 0.5) for v, t, g in zip(x, target, got)]
        if got == target:
            break
    return [v / sum(x) for v in x]


def test_inversion_with_agreements(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for poll in range(30):
        n = int(rng.integers(2, 13))
        partner = [None] * n
        order = rng.permutation(n)
        for a, b in zip(order[::2], order[1::2]):
            if rng.random() < 0.7:
                partner[a], partner[b] = int(b), int(a)
        target = pooled(list(rng.dirichlet(np.ones(n)) + 0.001), partner, 120)
        if poll % 4 == 0:
            target[0], target[1] = 0, target[0] + target[1]
        asked = [None if partner[i] is None or target[i] == 0 or target[partner[i]] == 0 else partner[i] for i in range(n)]
        want[poll] = inverted(target, asked, 120)
        rows += [(poll, f"p{i}", target[i], i, None if partner[i] is None else f"p{partner[i]}") for i in range(n)]
    rows += [(90, "p0", 50, 0, "p1"), (90, "p1", 40, 1, "p0"), (None, "p0", 120, 0, None), (91, "p0", 70, 0, "p1"), (91, "p1", 50, 1, "p2"), (92, "p0", 120, 0, "p0")]
    frame = spark.createDataFrame(rows, "poll_id int, party_id string, seats int, ord int, partner string")
    out = {(r.poll_id, r.party_id): r for r in apportion.invert_seats(frame, 120, partner="partner").collect()}
    assert {p for p, _ in out} == {*range(30), 91, 92}  # 90 is not complete, null is no poll
    for poll, votes in want.items():
        for i, v in enumerate(votes):
            assert out[poll, f"p{i}"].votes == pytest.approx(v, abs=1e-9)
    back = apportion.allocate(spark.createDataFrame([(k[0], k[1], r.votes) for k, r in out.items()], "poll_id int, party_id string, votes double").join(frame.select("poll_id", "party_id", "ord", "partner", F.col("seats").alias("target")), ["poll_id", "party_id"]), ["poll_id"], 120, 0.0)
    again = {(r.poll_id, r.party_id): r.seats for r in back.collect()}
    assert all(abs(again[k] - r.seats) <= 1 for k, r in out.items())
    assert apportion.invert_seats(frame.limit(0), 120, partner="partner").count() == 0


def test_averages_of_a_row(spark):
    rows = [([40.0, 40.0, 20.0], 5), ([1.0, 1.0], 1), ([0.0, 0.0], 4), ([3.0, 0.0, 1.0], 0), ([], 3), ([5.0, 4.0, 3.0, 3.0], 7)]
    frame = spark.createDataFrame(rows, "v array<double>, n int")
    for r in frame.select("v", "n", apportion.averages_of(F.col("v"), F.col("n")).alias("s")).collect():
        assert list(r.s) == averages(r.v, r.n)


def merged(store, rows):
    ids, prints, kept = {i for i, _ in store}, {p for _, p in store}, []
    for o, i, p in sorted(rows):
        if (i is None or i not in ids) and (p is None or p not in prints):
            ids.add(i)
            prints.add(p)
            kept.append((o, i, p))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda n: None if rng.random() < 0.05 else int(rng.integers(n))
    rows = [(o, pick(60), pick(45)) for o in range(150)]
    store = [(int(rng.integers(60)), int(rng.integers(45))) for _ in range(6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "ord int, id int, print int, more string").repartition(3)
    old = spark.createDataFrame(store, "id int, print int")
    out = quality.merge_new(old, frame)
    assert out.columns == ["ord", "id", "print", "more"]
    assert sorted((r.ord, r.id, r.print) for r in out.collect()) == merged(store, rows)


def test_merge_chain_and_edges(spark):
    """A chain in which each row waits for the one before; repeated rows; empty tables."""
    chain = [(k, (k + 1) // 2, k // 2) for k in range(12)]
    frame = spark.createDataFrame(chain + [chain[0]], "ord int, id int, print int")
    none = frame.select("id", "print").limit(0)
    assert sorted((r.ord, r.id, r.print) for r in quality.merge_new(none, frame).collect()) == merged([], chain)
    assert quality.merge_new(frame, frame.limit(0)).count() == 0 and quality.merge_new(frame, frame).count() == 0


def test_merge_report(spark):
    columns = "ord int, id string, print string, date string, pollster string, v int"
    incoming = spark.createDataFrame([(1, "a", "p1", "d1", "A", 1), (2, "a", "p2", "d2", "B", 1), (3, "b", "p1", "d3", "B", 1), (4, "c", "p4", "d9", "A", 1), (5, "d", "p5", "d1", "C", -1), (6, "s", "p6", "d1", "C", 1)], columns)
    curated = spark.createDataFrame([(0, "z", "pz", "d9", "A", 1)], columns)
    store = spark.createDataFrame([(0, "s", "ps", "d0", "A", 1)], columns)
    new, bad, counts = quality.merge_report(store, curated, incoming, [("negative", F.col("v") < 0)], F.col("pollster") != "")
    assert [r.id for r in new.collect()] == ["a"] and [r.id for r in bad.collect()] == ["d"]
    assert counts.first().asDict() == {"added": 1, "duplicates": 3, "shadowed": 1, "quarantined": 1, "total": 2}
    assert [r.ord for r in quality.newest_first(incoming).collect()] == [4, 3, 2, 1, 5, 6]
