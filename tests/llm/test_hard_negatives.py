"""Hard negatives against all scores."""

import math

import numpy as np

from skeinwork.llm import hard_negatives
from skeinwork.llm.hard_negatives import MultiIndex

SCHEMA = "vec_id long, label int, embedding array<float>, q string, tie int, rank int"


def brute(rows):
    good = {}
    for i, label, vector, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        good[i, label, q] = None
    out = []
    for i, label, q in good:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), j, lab) for j, lab, r in good if len(r) == len(q) and (j, lab, r) != (i, label, q))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(inside)]
    return sorted(out)


def table(seed, n=1500):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(0, 4)), (middles[int(rng.integers(0, 6))] + rng.normal(size=12) * 0.3).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[100][2]) for i in range(60)]  # copies of an anchor, under its label and another
    rows += [(n + 100 + i, 2, [round(x, 1) for x in rows[200 + i % 3][2]]) for i in range(60)]
    rows += [rows[100], rows[100], rows[7], (300, None, rows[1][2]), (None, 1, rows[1][2]), (400, 1, None), (500, 1, [None, *rows[1][2][1:]])]
    rows += [(600, 1, [float("nan")] * 12), (700, 1, [float("inf")] * 12), (800, 1, [0.0] * 12), (900, 2, []), (901, 2, []), (902, 3, [])]
    rows += [(5000, 1, [1.0, 2.0]), (5001, 1, [0.5, 0.5]), (5002, 2, [0.5, 0.25]), (5003, 2, [-1.0, 0.0])]
    return [(*r, "x", 1, 2) for r in rows]


def test_negatives(spark):
    rows = [r for r in table(1) if r[0] not in (600, 700, 800, 400, 300, 500, 900) or r[1] is None or r[2] is None or len(r[2]) != 12 or r[0] >= 600]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    wanted = brute(rows)
    assert sorted(map(tuple, found)) == wanted and len({r[0] for r in wanted}) > 10


def test_blocks_of_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 1)
    rows = table(2)
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_no_rows(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_walk_visits_every_cell_once_by_falling_bounds():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(20, 10))[np.arange(3000) % 20] * 100 + rng.normal(size=(3000, 10)) * 5).astype(np.int64)
    index = MultiIndex(np.arange(3000), np.zeros(3000, np.int64), np.zeros(3000, np.int64), vectors)
    assert index.side > 5
    anchor = vectors[5]
    seen, bounds = [], [np.inf]
    for rows, bound in index.visits(anchor.astype(float)):
        assert (index.scores(rows, anchor) <= bounds[-1]).all()
        seen += rows.tolist()
        bounds.append(bound)
    assert sorted(seen) == list(range(3000)) and bounds == sorted(bounds, reverse=True)
    near = [r for rows, _ in index.visits(anchor.astype(float), 0.0) for r in rows.tolist()]
    assert set(np.flatnonzero(index.whole @ anchor <= 0)) <= set(near) and len(near) < 3000


def test_a_search_stops_early_where_vectors_cluster():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16)) * 200
    vectors = np.floor(middles[np.arange(8000) % 40] + rng.normal(size=(8000, 16)) * 5).astype(np.int64)
    index = MultiIndex(np.arange(8000), np.zeros(8000, np.int64), np.zeros(8000, np.int64), vectors)
    scored = []
    index.scores = lambda rows, anchor: scored.append(rows.size) or MultiIndex.scores(index, rows, anchor)
    rows, scores = index.positives(0, 0, 0, vectors[0], 5)
    every = np.sort(vectors[1:] @ vectors[0])[::-1]
    assert scores.tolist() == every[:5].tolist() and sum(scored) < 2500


def test_large_components_are_scored_whole():
    vectors = np.array([[2**40, 1], [2**40, 3], [2**62, 2**62]], np.int64)
    index = MultiIndex(np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64), vectors)
    at = np.argsort(index.ids)
    assert index.scores(at, np.array([1, 2**12])).tolist() == [2**40 + 2**12, 2**40 + 3 * 2**12, 2**63 - 1]
