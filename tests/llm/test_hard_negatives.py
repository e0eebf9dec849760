import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmeter.llm.hard_negatives import Cells, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    v = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for i, x, label in v:
        if i % every:
            continue
        score = [(-sum(p * q for p, q in zip(x, y)), j, other) for j, y, other in v if len(y) == len(x)]
        same = sorted((s, j) for s, j, other in score if other == label and j != i)[:5]
        for s, j in same:
            inside = sorted((t, k) for t, k, other in score if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(seed, n=900, d=16):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, d))
    x = centre[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, d))
    return [(i, [float(c) for c in np.float32(v / np.linalg.norm(v))], int(r.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 97, "block_anchors": 3}])
def test_equals_brute_force(spark, sizes):
    rows = clustered(1)
    assert mined(spark, rows, **sizes) == brute(rows)


def test_hot_copies_ties_and_odd_rows(spark):
    """A third of the rows are one vector under one label; ids repeat, components are missing or not finite, lengths differ."""
    rows = clustered(2, 300)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(200)]
    rows += [(2000 + i, [0.5] * 16, i % 4) for i in range(60)] + [rows[0], rows[3], (50, rows[7][1], 9)]
    rows += [(None, rows[1][1], 1), (3000, None, 1), (3050, rows[1][1], None), (3100, [None] + rows[1][1][1:], 1), (3150, [math.nan] + rows[1][1][1:], 1)]
    rows += [(3200, [math.inf] * 16, 1), (3250, [1.0, 2.0], 1), (3251, [1.0, 1.5], 1), (3252, [0.9, 1.0], 2), (3300, [], 1), (3301, [], 1), (3302, [], 2)]
    assert mined(spark, rows, shard_rows=100, block_anchors=4) == brute(rows)


def test_empty_and_clashing(spark):
    rows = clustered(3, 120)
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.withColumns({c: F.lit(c) for c in ("row", "shard", "block", "anchor", "score", "id", "n", "vector", "scores", "p")})
    assert sorted(map(tuple, hard_negatives(more, F.col("vec_id") % 50 == 0).collect())) == brute(rows)
    assert hard_negatives(docs.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives(docs, F.lit(False)).collect() == []


def test_too_long_vectors_raise(spark):
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)])


def test_search_stops_early_where_cells_are_apart():
    """On clustered rows the bounds certify the answer before all cells are visited, and the answer is that of a scan."""
    r = np.random.default_rng(4)
    centre = np.zeros((40, 16))
    centre[np.arange(40), np.arange(40) % 16] = 100.0
    centre[np.arange(40), (np.arange(40) * 7 + 3) % 16] += 60.0
    x = np.floor(centre[r.integers(0, 40, 20_000)] + r.normal(size=(20_000, 16)))
    labels = r.integers(0, 5, len(x))
    cells = Cells(x, np.arange(len(x)), labels)
    seen = 0
    for i in range(0, 2000, 100):
        score, ids = cells.best(x[i], i, labels[i], 5)
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if labels[j] == labels[i] and j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(score, ids)] == want
        for rows, bound in cells.gulps(x[i]):
            seen += len(rows)
            if bound < score[-1]:
                break
    assert seen < 0.6 * 20 * len(x)
