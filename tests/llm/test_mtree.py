import math

import numpy as np
from pyspark.sql import functions as F

from twinfold.llm import mtree


def plain_top(rows, k, every):
    """All pairs."""
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in clean:
        if q % every == 0:
            scores = [(sum(a * b for a, b in zip(clean[q], clean[c])), c) for c in clean if c != q]
            scores.sort(key=lambda s: (-s[0], s[1]))
            out += [(q, r + 1, c, s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_tree_search_is_exact_and_leaves_out_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (12, 16))
    rows = np.floor(centres[rng.integers(12, size=4000)] + rng.normal(0, 20, (4000, 16)))
    space = mtree.Space(16, float((rows**2).sum(axis=1).max()))
    tree = mtree.Tree(space, rows, [[i, 5000 + i] for i in range(4000)], space.lifted(rows[:1])[0])
    asked = np.arange(0, 4000, 200)
    together = tree.search_all(rows[asked].astype(np.int64), 11, np.full(len(asked), -math.inf))
    assert together == [tree.search(rows[q], 11, -math.inf) for q in asked]
    for q in range(0, 4000, 200):
        tree.computed = 0
        scores = sorted(((int(s), i + d) for i, s in enumerate(rows @ rows[q]) for d in (0, 5000)), key=lambda s: (-s[0], s[1]))
        assert tree.search(rows[q], 11, -math.inf) == scores[:11]
        assert tree.search(rows[q], 11, float(scores[4][0])) == [s for s in scores[:11] if s[0] >= scores[4][0]]
        assert tree.computed < 6000  # of two searches of 4000 rows
    same = mtree.Tree(mtree.Space(2, 8.0), np.full((1, 2), 2.0), [[1, 2, 3]], np.array([2.0, 2.0, 0.0]))
    assert same.search(np.array([1.0, 1.0]), 2, -math.inf) == [(4, 1), (4, 2)]


def test_ties_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(mtree, "ROWS_PER_PIVOT", 60)
    monkeypatch.setattr(mtree, "ROWS_PER_TREE", 25)
    monkeypatch.setattr(mtree, "QUERIES_PER_TASK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=3) / 8]) for i in range(200)]
    rows += [(i, [0.25, 0.5, -0.125]) for i in range(200, 330)]
    rows += [(400, None), (None, [0.5, 0.5, 0.5]), (401, [1.0, None, 1.0]), (402, [math.nan, 0.0, 0.0]), (403, [math.inf, 0.0, 0.0]), (404, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in mtree.top_k(df, k=7, every=20).collect())
    clean = [(i, v if v != [] else [0.0, 0.0, 0.0]) for i, v in rows]
    assert got == plain_top(clean, 7, 20)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(few, k=10, every=100).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert mtree.top_k(df.limit(0)).count() == 0


def test_scores_beyond_floating_point_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.uniform(-1e6, 1e6, size=5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in mtree.top_k(df, k=10, every=100).collect())
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    wanted = []
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)
        wanted += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:10])]
    assert got == sorted(wanted) and max(abs(s) for *_, s in wanted) > 2**60
