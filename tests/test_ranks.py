import random

import numpy as np
from pyspark.sql import functions as F

from slatewise.operators.intervals import followed, preceding
from slatewise.operators.ranks import bounded_tail, quantiles, ranked, tail_bounds


def skewed(spark, n=3000, seed=1):
    """A third of all rows under one key."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", i, rng.random() * 1000) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, pos long, x double")


def test_ranked_equals_row_number(spark):
    rows, df = skewed(spark)
    out = ranked(df, ["key"], [F.col("x")], F.floor(F.col("x") / 50), total="size")
    got = {(r.key, r.pos): (r["rank"], r["size"]) for r in out.collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((x, p) for k, p, x in rows if k == key)
        for n, (_, p) in enumerate(mine, 1):
            assert got[(key, p)] == (n, len(mine))


def test_tail_is_exact_with_gaps(spark):
    rows, df = skewed(spark)
    quota = 37
    kept = {(r.key, r.pos) for r in bounded_tail(df, "key", "pos", quota, 100).collect()}
    bounds = {r.key: r for r in tail_bounds(df, "key", "pos", quota, 100).collect()}
    expected = set()
    for key in {r[0] for r in rows}:
        mine = sorted((p for k, p, _ in rows if k == key), reverse=True)
        expected |= {(key, p) for p in mine[:quota]}
        assert bounds[key].tail_capped == (len(mine) > quota)
        assert bounds[key].lowest_position == mine[:quota][-1] and bounds[key].highest_position == mine[0]
    assert kept == expected


def test_quantiles_interpolate(spark):
    rows, df = skewed(spark)
    out = {(r.key, r.fraction): r.quantile for r in quantiles(df, ["key"], "x", [0.5, 0.95, 1.0]).collect()}
    for key in {r[0] for r in rows}:
        values = [x for k, _, x in rows if k == key]
        for q in (0.5, 0.95, 1.0):
            assert abs(out[(key, q)] - np.quantile(values, q)) < 1e-3


def test_follow_up_equals_brute_force(spark):
    rng = random.Random(3)
    point = lambda: ("hot" if rng.random() < 0.4 else f"u{rng.randrange(20)}", rng.randrange(0, 5000))
    probes, events = [point() for _ in range(600)], [point() for _ in range(600)]
    as_df = lambda rows, name: spark.createDataFrame(rows, f"user string, {name}_s long").withColumn(name, F.timestamp_seconds(f"{name}_s"))
    for seconds in (1, 60, 700):
        hit = followed(as_df(probes, "t"), as_df(events, "w"), ["user"], "t", "w", seconds)
        expected = sorted(p for p in probes if any(u == p[0] and p[1] < w < p[1] + seconds for u, w in events))
        assert sorted((r.user, r.t_s) for r in hit.collect()) == expected
        links = preceding(as_df(events, "w"), as_df(probes, "t"), ["user"], "w", "t", seconds)
        expected = sorted((u, w, t) for u, w in events for v, t in probes if u == v and w - seconds <= t < w)
        assert sorted((r.user, r.w_s, r.t_s) for r in links.collect()) == expected
