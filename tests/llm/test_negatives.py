"""Hard negatives against brute force, over clustered and random vectors, in many rounds and few."""

import itertools
import random

import numpy as np
import pytest

from tracelake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, copies string, block string, q string, aid string"


def plain(rows):
    """The contract, row by row."""
    kept = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    width = max((len(q) for _, _, q in kept), default=0)
    q = np.array([v + [0] * (width - len(v)) for _, _, v in kept], np.int64).reshape(len(kept), width)
    out = []
    for i, (anchor, label, _) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = (q @ q[i]).tolist()
        order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-scores[j], kept[j][0] is None, kept[j][0] or 0))
        for p in [j for j in order if kept[j][1] == label][:5]:
            fit = [j for j in order if kept[j][1] != label and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]][:10]
            out += [(anchor, kept[p][0], r, kept[j][0], scores[p], scores[j]) for r, j in enumerate(fit, 1)]
    return sorted(map(repr, out))


def rows_of(rnd, n, spread, dims=12):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(centres)], rnd.randrange(4)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def result(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("spread, options", [(0.05, {"block_rows": 16, "cell_rows": 8, "first_rows": 20, "tile_anchors": 2}), (1.0, {"block_rows": 64, "cell_rows": 20, "first_rows": 50, "growth": 2}), (0.3, {})])
def test_brute_force(spark, spread, options):
    rows = rows_of(random.Random(int(spread * 100)), 600, spread)
    assert result(negatives.mine(frame(spark, rows), **options)) == plain(rows)


def test_odd_rows(spark):
    rnd = random.Random(9)
    rows = rows_of(rnd, 150, 0.5)
    rows += [rows[5]] * 30 + [rows[100]] * 3 + [(None, rows[7][1], 1), (None, rows[7][1], 2)]
    rows += [(300, None, 1), (400, [], 2), (500, [1.0, float("nan")], 1), (600, [1.0, None], 1), (700, [float("inf")], 1), (800, [1.0] * 12, None), (900, [0.5] * 7, 2), (1000, [0.0] * 12, 1), (-100, [-1.0] * 12, 0)]
    rows += [(2000 + i, rows[3][1], i % 3) for i in range(40)]
    assert result(negatives.mine(frame(spark, rows), first_rows=30, cell_rows=10, block_rows=16)) == plain(rows)
    assert negatives.mine(frame(spark, rows).filter("false")).count() == 0
    assert negatives.mine(frame(spark, rows).filter("vec_id = 100")).count() == 0


def test_cells_come_by_falling_bound():
    rnd = np.random.default_rng(2)
    index = negatives.Index((rnd.normal(size=(7, 3)), rnd.normal(size=(5, 3))), (rnd.random(7), rnd.random(5)), np.ones((7, 5), np.int64), 10)
    anchor = rnd.normal(size=6)
    seen = list(index.visit(anchor))
    assert sorted((i, j) for _, _, i, j in seen) == list(itertools.product(range(7), range(5)))
    (up1, _), (up2, _) = index.bounds(anchor)
    assert all(a >= b for (a, *_), (b, *_) in itertools.pairwise(seen))
    assert all(abs(u - up1[i] - up2[j]) < 1e-9 for u, _, i, j in seen)


def test_far_cells_are_not_visited(spark):
    """Tight clusters: the certified search ends long before all rows are seen."""
    rows = rows_of(random.Random(3), 2000, 0.01)
    placed, index = negatives.build(negatives.scaled(frame(spark, rows)), 16, 8)
    one = placed.filter("vec_id = 100").selectExpr("rid AS aid", "q", "0L AS visited", "0L AS upto", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high")
    first = negatives.plan(one, index, 64, 4).first()
    assert first["bound"] is not None and first["visited"] < 700
