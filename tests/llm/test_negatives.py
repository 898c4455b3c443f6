"""Mined negatives against brute force: clustered vectors, copies, ties, odd rows; and against their SQL."""
import math
import random

import numpy as np
import pytest

import __spark_entry__ as ent
from oracle_check import compare, duck
from tessera.llm import negatives
from tessera.llm.queries import F

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v long, region int"


def plain(rows, anchor, top=5, shift=True):
    d = max((len(e) for _, e, _ in rows if e is not None), key=lambda n: sum(e is not None and len(e) == n for _, e, _ in rows), default=0)
    one = {}
    for i, e, la in rows:
        if i is None or la is None or e is None or len(e) != d or any(x is None or not math.isfinite(x) for x in e):
            continue
        la = (la + 1) % 10 if shift and i % 7 == 0 else la
        one[i] = min(one.get(i, (la, e)), (la, e))
    whole = {i: (la, [math.floor(256 * x) for x in e]) for i, (la, e) in one.items()}
    out = []
    for a, (la, q) in whole.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, e)) for i, (_, e) in whole.items() if i != a}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:top]      # noqa: E731
        for p in best([i for i in score if whole[i][0] == la]):
            for r, n in enumerate(best([i for i in score if whole[i][0] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]])):
                out.append((a, p, r + 1, n, score[p], score[n]))
    return sorted(out)


def mined(spark, rows, anchor, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = negatives.mine(df, anchor, relabel=lambda i, la: F.when(i % 7 == 0, (la + 1) % 10).otherwise(la), **how)
    return sorted(tuple(r) for r in got.collect())


def clustered(seed, n=900, d=12, groups=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))
    x[n // 2: n // 2 + n // 4] = x[n // 2]                       # a quarter are copies
    x[:20] = np.round(x[:20])                                     # ties
    return [(int(i), [float(z) for z in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block,regions", [(4096, 256), (60, 5), (7, 256)])
def test_mine(spark, monkeypatch, block, regions):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "REGIONS", regions)
    rows = clustered(block)
    rng = random.Random(1)
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5001, rows[1][1], None), (5002, [None] * 12, 1), (5003, [math.inf] * 12, 1),
             (5004, [math.nan] * 12, 1), (5005, [0.0] * 12, 1), (5006, [1.0], 1), (5007, [], 2), (30, rows[40][1], 3), (30, rows[30][1], rows[30][2]),
             (5010, [-x for x in rows[2][1]], 0), (-50, rows[5][1], 9), (-7, [1e4 * rng.random() for _ in range(12)], 1)]
    got = mined(spark, rows, lambda i: i % 10 == 0)
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_large_components_are_exact(spark):
    """Sums beyond 2^53 are whole numbers still."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(1 << 22)) + rng.random() for _ in range(6)], i % 3) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1) for i in range(20)]
    assert mined(spark, rows, lambda i: i % 5 == 0) == plain(rows, lambda i: i % 5 == 0)


def test_small_tables(spark):
    assert mined(spark, [], lambda i: i % 2 == 0) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)], lambda i: i % 2 == 0) == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.5], 2), (3, [0.5, 0.0], 2), (4, [0.0, 0.0], 1)]
    assert mined(spark, few, lambda i: i % 2 == 0) == plain(few, lambda i: i % 2 == 0)


def test_nodes_are_skipped():
    """In clustered vectors a search opens few leaves, and every node's bounds hold."""
    rows = clustered(3, n=3000, groups=40)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    tree = negatives.CoverTree(np.arange(len(x)), np.array([la for *_, la in rows]), x)
    opened = []
    for q in x[::100]:
        scores = {}
        tree.search(q, -np.inf, np.inf, np.ones(len(x), bool), 5, scores)
        opened.append(sum(len(v) for k, v in scores.items() if k != "bounds"))
        least, most = scores["bounds"]
        for node, (leaf, below) in enumerate(tree.below):
            if leaf:
                s = x[tree.below[node][1]] @ q
                assert s.max() <= most[node] and s.min() >= least[node] and len(below)
    assert np.median(opened) < len(x) / 3


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert " MATCH " in compare(spark, duck(sf), sf, "op13_negatives", ent.queries()["op13_negatives"], ent.oracle_sql()["op13_negatives"])
