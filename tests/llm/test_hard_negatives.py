"""Hard negatives against brute force, with ties, nulls, repeated rows, odd lengths and clashing columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slatewise.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, id string, _shelf int, _block int, rank int"


def plain(rows, positives, negatives, low, high, scale, is_anchor):
    rows = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    out = []
    for a, (i, v, y) in enumerate(rows):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(x * z for x, z in zip(v, w)), j, label) for b, (j, w, label) in enumerate(rows) if b != a]
        for p, pid, _ in order([s for s in scored if s[2] == y])[:positives]:
            inside = order([s for s in scored if s[2] != y and low * p <= 100 * s[0] <= high * p])[:negatives]
            out += [(i, pid, r, n, p, s) for r, (s, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shelf, block", [(8192, 2048), (40, 3)])
def test_against_brute_force(spark, monkeypatch, shelf, block):
    monkeypatch.setattr(hard_negatives, "SHELF_ROWS", shelf)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 4)
    rng = random.Random(21)
    rows = [(i, [rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0, 2.25]) for _ in range(3)], rng.randrange(3)) for i in range(150)]
    rows += [rows[10], rows[20], rows[20], (200, None, 1), (210, [1.0, None, 2.0], 1), (220, [math.inf, 0.0, 0.0], 1), (230, [math.nan] * 3, 0),
             (240, [1.0, 1.0, 1.0], None), (None, [2.25, 2.25, 2.25], 1), (None, [2.25, 2.25, 2.25], 2), (250, [], 1), (260, [1.0], 2),
             (270, [1e8, -3e8, 2e8], 0), (290, [1e8, -3e8, 2e8], 0), (300, [1e8, -2e8, 1e8], 1), (None, [1.0, 1.0, 1.0], 1),
             (-30, [-2.0, 2.25, 1.0], 7), (280, [0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    found = hard_negatives.mine(table, anchor=F.col("id") % 10 == 0, positives=3, negatives=4, scale=4)
    want = plain(rows, 3, 4, 30, 90, 4, lambda i: i % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) > 100
    assert any(r[1] is None for r in want) and any(r[4] > 2 ** 53 for r in want)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine(table.filter("vec_id = 10").limit(1)).count() == 0


def test_the_search_stops_early_and_keeps_ties():
    rng = np.random.default_rng(22)
    values = np.round(rng.normal(size=(4000, 2)) * 40)
    table = pa.table({"row": np.arange(4000), "label": rng.integers(0, 4, 4000), "id": pa.array(rng.permutation(4000)),
                      "vector": pa.array([v.tolist() for v in values / 256], pa.list_(pa.float64()))})
    shelf = hard_negatives.Shelf(table, 256, 2)
    assert (shelf.values == values).all()
    for anchor in (np.array([3.0, -2.0]), np.array([0.0, 5.0]), np.array([0.0, 0.0])):
        allowed, scores = shelf.labels != 1, values @ anchor
        windows = [(-math.inf, math.inf), (0, 90), (50, 40), (100, 101)]
        found, scored = hard_negatives.search(shelf, anchor, allowed, windows, 7)
        for (low, high), (places, got) in zip(windows, found):
            inside = [p for p in range(4000) if allowed[p] and low <= scores[p] <= high]
            assert places.tolist() == sorted(inside, key=lambda p: (-scores[p], shelf.ids[p]))[:7] and (scores[places] == got).all()
    top, scored = hard_negatives.search(shelf, np.array([3.0, -2.0]), shelf.labels >= 0, [(-math.inf, math.inf)], 7)
    assert scored < 400


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30], 1), (2, [1e30], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="OverflowError"):
        hard_negatives.mine(table).collect()
