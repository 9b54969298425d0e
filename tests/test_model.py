import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slatewise.operators import blocks, ease, interactions, krylov, metrics
from slatewise.plans import model_queries

ROWS = [(1, "a", 6, 1), (1, "b", 5, 1), (1, "c", None, 1), (2, "a", 8, 1), (2, "d", 8, 1), (2, "e", 6, 1), (3, "b", 9, 1), (3, "d", 7, 1),
        (4, "a", 5, 1), (5, "e", 6, 1)]


@pytest.fixture(scope="module")
def data(spark):
    pairs = spark.createDataFrame(ROWS, "user_id long, movie_id string, rating int, watch_count long")
    return pairs, spark.createDataFrame([(m, f"Movie {m}") for m in "abcdef"], "movie_id string, title string")


def dense(rows=ROWS, names="abcdef", penalty=2.0):
    users = sorted({r[0] for r in rows})
    x = np.zeros((len(users), len(names)))
    for u, m, r, w in rows:
        x[users.index(u), names.index(m)] = (r is None and w > 0) or (r is not None and r >= 6)
    return x


@pytest.mark.parametrize("tile, limit", [(2048, 100), (2048, 0), (2, 0), (3, 0)])
def test_weights_equal_ridge_regressions(spark, data, tile, limit):
    """Each column is the ridge regression of a movie on the other movies, by columns or by tiles of any size."""
    model = ease.fit(*data, 2.0, 6, limit, tile)
    x = dense()
    found = {(r.src_movie, r.dst_movie): r.weight for r in ease.weights(model).collect()}
    for j, dst in enumerate("abcdef"):
        others = [i for i in range(6) if i != j]
        a = x[:, others]
        w = np.linalg.solve(a.T @ a + 2 * np.eye(5), a.T @ x[:, j])
        for i, value in zip(others, w, strict=True):
            assert abs(found.get(("abcdef"[i], dst), 0.0) - value) < 1e-6


def test_recommendations(spark, data):
    model = ease.fit(*data, 2.0, 6)
    slate = lambda df, u: [r.movie_id for r in df.where(F.col("user_id") == u).orderBy("rank").collect()]
    top = ease.recommend(model, k=20)
    assert set(slate(top, 1)) == {"d", "e"} and slate(top, 4) == []
    by_joins = ease.top_k(interactions.exclude_seen(ease.score_users(model.histories.where("liked"), ease.weights(model)), data[0])
                          .join(model.movies, "movie_id").where("abs(score) > 1e-9"), 20)
    key = lambda df: {(r.user_id, r.movie_id, round(r.score, 9)) for r in df.collect()}
    assert key(top.where("abs(score) > 1e-9")) == key(by_joins)
    everyone = ease.recommend_all(model, data[0].select("user_id"), 3)
    assert everyone.where("user_id = 4 and method = 'popularity'").count() == 3
    ad_hoc = spark.createDataFrame([(77, "a", True), (77, "a", True), (77, "zz", True), (77, "b", False)], "user_id long, movie_id string, liked boolean")
    w = {(r.src_movie, r.dst_movie): r.weight for r in ease.weights(model).collect()}
    for row in ease.recommend(model, ad_hoc, 20).collect():
        assert row.movie_id not in ("a", "b") and abs(row.score - w.get(("a", row.movie_id), 0.0)) < 1e-9
    strangers = spark.createDataFrame([(77, "a", True), (78, "zz", True), (79, "d", False)], "user_id long, movie_id string, liked boolean")
    served = ease.recommend_all(model, strangers.select("user_id"), 3, histories=strangers)
    assert {(r.user_id, r.method) for r in served.collect()} == {(77, "ease"), (78, "popularity"), (79, "popularity")}
    assert "d" not in slate(served, 79) and len(slate(served, 78)) == 3


def test_random_catalogue_agrees_across_tiles_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = sorted({(int(u), f"m{int(m):02d}") for u, m in zip(rng.integers(1, 60, 500), rng.integers(0, 40, 500), strict=True)} | {(1, f"m{m:02d}") for m in range(38)})
    full = [(u, m, None, 1) for u, m in rows]
    pairs = spark.createDataFrame(full, "user_id long, movie_id string, rating int, watch_count long")
    movies = spark.createDataFrame([(f"m{n:02d}", "t") for n in range(40)], "movie_id string, title string")
    fees = spark.createDataFrame([(f"m{n:02d}", float(n % 7), "known" if n % 5 else "missing") for n in range(40)], "movie_id string, fee double, fee_status string")
    one, many = ease.fit(pairs, movies, 5.0), ease.fit(pairs, movies, 5.0, likes_limit=0, tile=9)
    penalties = ease.licence_penalties(movies, fees, 0.02)
    read = lambda df: {(r.user_id, r["rank"]): (r.movie_id, round(r.score, 5)) for r in df.collect()}
    a = read(ease.recommend(one, k=5, penalties=penalties))
    b = read(ease.recommend(many, k=5, penalties=penalties))
    monkeypatch.setattr(ease, "USERS_PER_BLOCK", 3)
    monkeypatch.setattr(ease, "WEIGHT_BYTES", 1)
    c = read(ease.recommend(many, k=5, penalties=penalties))
    weight, fee = {(r.src_movie, r.dst_movie): r.weight for r in ease.weights(one).collect()}, {r.movie_id: r.penalty for r in penalties.collect()}
    seen = {u: {m for v, m in rows if v == u} for u, _ in rows}
    plain = {}
    for u, own in seen.items():
        scores = {m: sum(weight.get((i, m), 0.0) for i in own) - fee[m] for m in fee if m not in own}
        for n, m in enumerate(sorted(scores, key=lambda m: (-scores[m], -sum(m in x for x in seen.values()), m))[:5], 1):
            plain[u, n] = (m, round(scores[m], 5))
    assert a == b == c == plain and len(a) > 250


def test_krylov_columns(spark, monkeypatch):
    """Several λ in one run, long lists, hot users and many panels, against the dense inverse."""
    monkeypatch.setattr(krylov, "LONGEST", 4)
    monkeypatch.setattr(krylov, "BLOCK_NUMBERS", 300)
    monkeypatch.setattr(krylov, "CHUNK", 100)
    rng = np.random.default_rng(6)
    x = (rng.random((90, 37)) < 0.15) * 1.0
    x[:, 4] = x[11] = 1.0
    x[3], x[:, 0] = 0.0, x[:, 1]
    owner, idx = np.nonzero(x)
    members = spark.createDataFrame([(int(o) * 13 - 5, int(i)) for o, i in zip(owner, idx)], "owner long, idx int").repartition(7)
    shifts = [8.0, 0.5, 100.0, 8.0]
    found = np.zeros((4, 37, 37))
    for r in krylov.weight_panels(members, 37, shifts).collect():
        part = np.frombuffer(r.data, np.float32).reshape(37, -1)
        found[r.place][:, r.panel * 8:r.panel * 8 + part.shape[1]] = part
        assert r.residual < 1e-8
    for place, shift in enumerate(shifts):
        p = np.linalg.inv(x.T @ x + shift * np.eye(37))
        want = -p / np.diag(p)
        np.fill_diagonal(want, 0)
        assert np.abs(found[place] - want).max() < 1e-6


def test_registered_model_holds_the_whole_catalogue(spark, monkeypatch):
    """More movies than the 2,000 that were once the limit."""
    pairs = spark.range(2100).selectExpr("id as user_id", "lpad(id, 4, '0') as movie_id", "cast(null as int) as rating", "1L as watch_count")
    monkeypatch.setattr(model_queries.i, "movies", lambda *_: pairs.selectExpr("movie_id", "movie_id as title"))
    fitted = []
    monkeypatch.setattr(model_queries.ease, "fit", lambda p, m: fitted.append((p.count(), m.count())))
    model_queries._model(spark, "", pairs)
    assert fitted == [(2100, 2100)]


def test_inverse_keeps_no_old_rounds(spark, tmp_path, monkeypatch):
    stored, live = blocks.settle, []
    monkeypatch.setattr(blocks, "settle", lambda df: live.append(stored(df)) or live[-1])
    a = np.random.default_rng(4).integers(0, 5, (11, 11))
    a = a @ a.T + 3 * np.eye(11, dtype=int)
    entries = spark.createDataFrame([(i, j, int(a[i, j])) for i in range(11) for j in range(i, 11)], "i int, j int, n long")
    found = np.zeros((11, 11))
    for r in blocks.invert(blocks.to_tiles(entries, 11, 0.0, 3), 11, 3).collect():
        part = np.frombuffer(r.data).reshape(-1, min(3, 11 - 3 * r.tj))
        found[3 * r.ti:3 * r.ti + len(part), 3 * r.tj:3 * r.tj + part.shape[1]] = part
    assert np.allclose(found @ a, np.eye(11), atol=1e-8)
    assert live[-1].rdd.getNumPartitions() <= 3 * blocks.tasks(spark)
    path = lambda df: df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert [os.path.exists(path(df)) for df in live] == [False] * (len(live) - 1) + [True]


def test_gram_counts_with_hot_owner(spark):
    rng = np.random.default_rng(2)
    members = sorted({(int(o), int(i)) for o, i in zip(rng.integers(0, 40, 300), rng.integers(0, 25, 300), strict=True)} | {(0, i) for i in range(25)})
    x = np.zeros((40, 25), int)
    for o, i in members:
        x[o, i] = 1
    g = x.T @ x
    for tile in (2048, 7):
        got = {(r.i, r.j): r.n for r in blocks.cooccurrence(spark.createDataFrame(members, "owner long, idx int"), 25, tile).collect()}
        assert got == {(i, j): g[i, j] for i in range(25) for j in range(i, 25) if g[i, j]}


def test_penalties(spark):
    movies = spark.createDataFrame([(m,) for m in "abcde"], "movie_id string")
    raw = spark.createDataFrame([("a", "0.5"), ("b", ""), ("c", "-1"), ("d", "NaN"), ("e", "0")], "movie_id string, license_cost string")
    from slatewise.sources.records import typed_fees
    got = {r.movie_id: r.penalty for r in ease.licence_penalties(movies, typed_fees(raw), 0.1).collect()}
    assert all(abs(got[m] - 0.05) < 1e-12 for m in "abcd") and got["e"] == 0


@pytest.mark.parametrize("held, expected", [
    ([(1, "a", 8), (1, "d", 9), (1, "c", 2), (2, "a", 3)], {"precision_at_k": .5, "recall_at_k": .5, "ndcg_at_k": 1 / (1 + 1 / math.log2(3)),
     "hit_rate_at_k": 1.0, "catalog_coverage": .5, "supported_target_fraction": .5, "users_without_relevant_ratings": 1}),
    ([(1, "c", 8)], {"ndcg_at_k": 1 / math.log2(3), "precision_at_k": .5, "recall_at_k": 1.0}),
    ([(1, "a", 8), (1, "d", 9), (2, "c", 8)], {"recall_at_k": .75})])
def test_ranking_metrics(spark, held, expected):
    recs = spark.createDataFrame([(u, m, n) for u in (1, 2) for n, m in enumerate("ac", 1)], "user_id long, movie_id string, rank int")
    movies = spark.createDataFrame([("a", .5), ("b", .25), ("c", .25), ("d", 0.0)], "movie_id string, popularity double")
    row = metrics.ranking_metrics(recs, spark.createDataFrame(held, "user_id long, movie_id string, rating int"), movies, 2, 7).first()
    for name, value in expected.items():
        assert abs(row[name] - value) < 1e-12


def test_save_and_load(spark, data, tmp_path):
    model = ease.fit(*data, 2.0, 6)
    ease.save_model(model, str(tmp_path / "model"))
    loaded = ease.load_model(spark, str(tmp_path / "model"))
    key = lambda m: sorted((r.src_movie, r.dst_movie, r.weight) for r in ease.weights(m).collect())
    assert key(loaded) == key(model) and loaded.regularization == 2.0
    checks = {r.check: r.passed for r in ease.candidate_checks(loaded, model, data[1], data[1]).collect()}
    assert len(checks) == 6 and all(checks.values())


def test_pairs_of_small_owners_are_counted_without_tiles(spark, monkeypatch):
    """Owners with few items are counted pair by pair, others by tiles, and both add up."""
    rng = np.random.default_rng(5)
    rows = sorted({(int(o), int(m)) for o, m in zip(rng.integers(0, 30, 120), rng.integers(0, 40, 120))} | {(99, m) for m in range(40)})
    members = spark.createDataFrame(rows, "owner long, idx int")
    x = np.zeros((100, 40), int)
    x[[o for o, _ in rows], [m for _, m in rows]] = 1
    given = []
    by_tiles = blocks._by_tiles
    monkeypatch.setattr(blocks, "_by_tiles", lambda m, n, t: given.append({r.owner for r in m.collect()}) or by_tiles(m, n, t))
    found = {(r.i, r.j): r.n for r in blocks.cooccurrence(members, 40, 8).collect()}
    gram = x.T @ x
    assert found == {(i, j): gram[i, j] for i in range(40) for j in range(i, 40) if gram[i, j]}
    assert 99 in given[0] and len(given[0]) < 20


def test_large_models_are_scored_where_they_are_solved(spark, monkeypatch):
    """Weights beyond the stored size are written nowhere, and slates, ties, penalties, summaries and replays stay the same."""
    rng = np.random.default_rng(8)
    full = sorted({(int(u), f"m{int(m):02d}") for u, m in zip(rng.integers(1, 60, 500), rng.integers(0, 40, 500), strict=True)} | {(1, f"m{m:02d}") for m in range(38)})
    pairs = spark.createDataFrame([(u, m, 8 if (u + len(m) + int(m[1:])) % 3 else 2, 1) for u, m in full], "user_id long, movie_id string, rating int, watch_count long")
    movies = spark.createDataFrame([(f"m{n:02d}", "t") for n in range(42)], "movie_id string, title string")
    fees = spark.createDataFrame([(f"m{n:02d}", float(n % 7), "known" if n % 5 else "missing") for n in range(42)], "movie_id string, fee double, fee_status string")
    monkeypatch.setattr(krylov, "CHUNK", 50)
    monkeypatch.setattr(krylov, "BLOCK_NUMBERS", 300)
    strangers = spark.createDataFrame([(77, "m03", True), (77, "m03", True), (78, "zz", True), (79, "m05", False)], "user_id long, movie_id string, liked boolean")

    def found():
        model = ease.fit(pairs, movies, 5.0)
        penalties = ease.licence_penalties(model.movies, fees, 0.02)
        rows = lambda df: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.collect())
        return (rows(ease.recommend(model, k=5, penalties=penalties)), rows(ease.recommend_all(model, pairs.select("user_id"), 50)),
                rows(ease.recommend_all(model, strangers, 3, histories=strangers)), rows(ease.weight_summary(model)),
                rows(ease.policy_replay(model, fees, 0.02, k=4)), rows(ease.weights(model)))

    stored = found()
    monkeypatch.setattr(ease, "STORED_BYTES", 0)
    names, write = [], ease.written
    monkeypatch.setattr(ease, "written", lambda df, name, *more: names.append(name) or write(df, name, *more))
    assert found() == stored and "weights" not in names
    assert len(stored[0]) > 200


def test_slates_cut_again_and_again_keep_ties(monkeypatch):
    """Candidates of many panels, cut whenever they are twice what is kept, against a full sort."""
    rng = np.random.default_rng(3)
    n, width, k, users = 60, 4, 3, 30
    weights = rng.integers(-2, 3, (n, n)).astype(np.float32)
    popularity, penalty = rng.integers(0, 3, n) / 4, np.stack([np.zeros(n), rng.integers(0, 3, n) * 0.5])
    liked = rng.random((users, n)) < 0.2
    slates = ease._Slates(n, width, k, 2)
    row = lambda **values: type("Row", (), values)()
    slates.given(row(kind=ease.PRICES, items=range(n), numbers=[[popularity[i], *penalty[:, i]] for i in range(n)]))
    owner, idx = np.nonzero(liked)
    slates.given(row(kind=ease.PEOPLE, owners=owner * 7, items=idx, flags=np.ones(len(idx), bool)))
    monkeypatch.setattr(ease, "max", lambda *_: 10, raising=False)
    for panel in range(n // width):
        list(slates.panel(panel, 0, weights[:, panel * width:(panel + 1) * width], 0.0))
    got = {(r.policy, r.user_id // 7, r.idx): r.score for part in slates.ended() for r in part.itertuples()}
    want = {}
    for p in range(2):
        for u in range(users):
            score = weights[liked[u]].sum(0) - penalty[p]
            order = [j for j in np.lexsort((np.arange(n), -popularity, -score)) if not liked[u, j]][:k]
            want |= {(p, u, j): score[j] for j in order}
    assert got == want


def test_small_gram_matrix_is_counted_not_solved_by_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(u if u else None, f"m{m}", 10 if rng.random() < 0.6 else 3, 1) for u in range(90) for m in range(6)]
    table = spark.createDataFrame(pairs, "user_id long, movie_id string, rating int, watch_count long").repartition(3)
    movies = spark.createDataFrame([(f"m{m}", "t") for m in range(6)], "movie_id string, title string")
    monkeypatch.setattr(ease.krylov, "weight_panels", lambda *_: (_ for _ in ()).throw(AssertionError("all likes sent to a task")))
    liked = np.array([p[2] == 10 for p in pairs]).reshape(90, 6).astype(float)
    for model in ease.solve(ease.prepare(table, movies, 10), [5.0, 50.0]):
        inverse = np.linalg.inv(liked.T @ liked + model.regularization * np.eye(6))
        want = -inverse / np.diagonal(inverse)
        found = {(r.src_movie, r.dst_movie): r.weight for r in ease.weights(model).collect()}
        assert len(found) == 30 and all(abs(w - want[int(s[1]), int(d[1])]) < 1e-5 for (s, d), w in found.items())
        assert model.panels.where("residual < 1e-9").count() == model.panels.count()


def test_cooccurrence_in_one_tile_over_many_batches(spark):
    rows = [(None if o == 7 else o << 55, i) for o in range(60) for i in range(20) if (o * i + o) % 3]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        members = spark.createDataFrame(rows, "owner long, idx int")
        found = {(r.i, r.j): r.n for r in blocks.cooccurrence(members, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for o, i in rows:
        by.setdefault((o, i if o is None else 0), []).append(i)
    want = {}
    for items in by.values():
        for i in items:
            for j in items:
                if i <= j:
                    want[i, j] = want.get((i, j), 0) + 1
    assert found == want


def test_evaluation_prepares_each_training_once(spark, monkeypatch):
    pairs = [(u, f"m{m}", 10 if (u * m + u) % 3 else 9, 1, ("training", "validation", "test")[(u + m) % 3]) for u in range(20) for m in range(5)]
    parts = spark.createDataFrame(pairs, "user_id long, movie_id string, rating int, watch_count long, part string")
    movies = spark.createDataFrame([(f"m{m}", "t") for m in range(5)], "movie_id string, title string")
    calls, prepare = [], ease.prepare
    monkeypatch.setattr(ease, "prepare", lambda *given: calls.append(given[2]) or prepare(*given))
    assert metrics.offline_evaluation(parts, movies, (2.0, 20.0), (9, 10), 3, 10, (5.0, 10)).count() == 9
    assert sorted(calls) in ([9, 10, 10], [9, 9, 10, 10])


def test_rows_add_up_in_stretches(monkeypatch):
    """Stretches of the block, long lists and owners without any index, whatever the order of the lists, against a dense product."""
    monkeypatch.setattr(krylov, "STRETCH", 16)
    monkeypatch.setattr(krylov, "LONGEST", 5)
    rng = np.random.default_rng(7)
    x = rng.random((25, 150)) < 0.4
    x[3], x[8] = False, True
    owner, index = np.nonzero(x)
    order = rng.permutation(len(owner))
    rows = krylov.Rows(owner[order], index[order], 25)
    assert len(rows.parts) == 10 and any(len(rest) for _, _, rest, _ in rows.parts)
    for columns in (3, 300):
        block = rng.integers(-9, 9, (150, columns)).astype(np.float32)
        assert (rows.sums(block) == x @ block).all() and rows.sums(block).dtype == np.float32
        assert (rows.added(block) == x @ block).all() and (rows.sums(block[:, 1:]) == x @ block[:, 1:]).all()
    assert not krylov.Rows(np.zeros(0, int), np.zeros(0, int), 4).sums(np.ones((2, 3))).any()


def test_residuals_of_the_dense_inverse_are_computed(spark, monkeypatch):
    """Panels made by tiles say what their columns leave, as those solved on their own do, and a wrong inverse shows."""
    rng = np.random.default_rng(9)
    rows = sorted({(int(u), f"m{int(m):02d}") for u, m in zip(rng.integers(1, 30, 400), rng.integers(0, 37, 400), strict=True)})
    pairs = spark.createDataFrame([(u, m, None, 1) for u, m in rows], "user_id long, movie_id string, rating int, watch_count long")
    movies = spark.createDataFrame([(f"m{n:02d}", "t") for n in range(37)], "movie_id string, title string")
    few, many = ({r.panel: r.residual for r in ease.fit(pairs, movies, 5.0, likes_limit=limit, tile=9).panels.collect()} for limit in (10_000, 0))
    assert sorted(few) == sorted(many) and all(0 < r < 1e-8 for r in many.values())
    invert = blocks.invert

    def wrong(tiles, n, tile):
        return blocks._map_tiles(invert(tiles, n, tile), lambda r: blocks._matrix(r.data, min(tile, n - r.tj * tile)) * (1.0 + 0.001 * (r.tj == 4)))

    monkeypatch.setattr(blocks, "invert", wrong)
    monkeypatch.setattr(ease, "WEIGHT_BYTES", 1)
    for panel, residual in ((r.panel, r.residual) for r in ease.fit(pairs, movies, 5.0, likes_limit=0, tile=9).panels.collect()):
        assert abs(residual - 0.001) < 1e-9 if panel == 2 else residual < 1e-8


def test_pairs_are_counted_by_ranges_of_items(spark, monkeypatch):
    """No pair is shuffled: ranges of items, pairs cut into pieces, rows that come twice and both orders, against plain counting."""
    monkeypatch.setattr(blocks, "RANGE_ROWS", 60)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    rng = np.random.default_rng(11)
    rows = sorted({(int(o), int(m)) for o, m in zip(rng.integers(0, 60, 250), rng.integers(0, 45, 250))}) + [(7, 3), (7, 3), (7, 44), (None, 5), (None, 6)]
    members = spark.createDataFrame(rows, "owner long, idx int").repartition(3)
    want = {}
    for o, i in rows:
        for p, j in rows:
            if o is not None and o == p:
                want[i, j] = want.get((i, j), 0) + 1
    monkeypatch.setattr(blocks, "_by_tiles", lambda *_: 1 / 0)
    found = blocks.cooccurrence(members, 45, 2)
    assert {(r.i, r.j): r.n for r in found.collect()} == {p: n for p, n in want.items() if p[0] <= p[1]}
    assert min(df.rdd.getNumPartitions() for df in (found, found.where('i <> j and n > 1'))) > 8 and found.count() == len({p for p in want if p[0] <= p[1]})
    both = blocks.cooccurrence(members, 45, 2, both=True)
    assert {(r.i, r.j): r.n for r in both.collect()} == want and both.count() == len(want)
    monkeypatch.undo()
    for tile in (1, 5, 64):  # by tiles and in one tile
        known = members.where("owner is not null")
        again = blocks.cooccurrence(known.distinct(), 45, tile, both=True)
        upper = {(r.i, r.j): r.n for r in blocks.cooccurrence(known.distinct(), 45, tile).collect()}
        assert {(r.i, r.j): r.n for r in again.collect()} == upper | {(j, i): n for (i, j), n in upper.items()}


def test_best_scores_need_no_table_of_users_by_movies(spark, monkeypatch):
    """Ties, negative weights, weights that cancel out, seen movies and movies without a place, against the plain joins."""
    monkeypatch.setattr(blocks, "RANGE_ROWS", 40)
    monkeypatch.setattr(blocks, "PAIRS", 64)
    rng = np.random.default_rng(12)
    liked = spark.createDataFrame([(int(u) if u else None, int(m)) for u, m in zip(rng.integers(0, 25, 120), rng.integers(0, 30, 120))] + [(3, 70)], "user_id long, movie_id int")
    seen = liked.unionByName(spark.createDataFrame([(int(u), int(m)) for u, m in zip(rng.integers(0, 25, 60), rng.integers(0, 30, 60))], "user_id long, movie_id int"))
    weights = spark.createDataFrame([(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 30, 300), rng.integers(0, 30, 300), rng.integers(-2, 3, 300))],
                                    "src_movie int, dst_movie int, weight long")
    popularity = spark.createDataFrame([(m, (m * 7 % 5) / 4) for m in range(28)], "movie_id int, popularity double")
    order = sorted((-p, m) for m, p in ((m, (m * 7 % 5) / 4) for m in range(28)) if p > 0)
    places = spark.createDataFrame([(m, n) for n, (_, m) in enumerate(order)], "movie_id int, place long")
    slates = lambda scores: sorted((r.user_id or 0, r["rank"], r.movie_id, r.score) for r in ease.top_k(
        interactions.exclude_seen(scores, seen).join(popularity, "movie_id"), 3).collect())
    best = ease.score_users(liked, weights, (3, seen, places))
    plain = slates(ease.score_users(liked, weights))
    assert slates(best) == plain and len(plain) > 60
    assert best.where("movie_id is not null and score > -100").rdd.getNumPartitions() > 8
    assert best.count() < ease.score_users(liked, weights).count()
    users = [pa.array([5]), pa.array([[1]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32()))]
    batch = lambda kind, src, dst, weight, place, user, own, hidden: pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([src], pa.int32()), pa.array([dst], pa.int32()), pa.array([weight], pa.float64()), pa.array([place], pa.int64()), user, own, hidden],
        names=["kind", "src", "dst", "weight", "place", "user_id", "liked", "seen"])
    none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
    parts = [batch(ease.HELD, 1, 2, 2.5, None, *none), batch(ease.HELD, None, 2, None, 0, *none), batch(ease.ASKING, None, None, None, None, *users)]
    for order in ((0, 1, 2), (2, 0, 1), (0, 2, 1)):
        rows = [r for out in ease._best_of_range(iter([parts[i] for i in order]), 0, 4, 4, 3) for r in out.to_pylist()]
        assert rows == [{"user_id": 5, "movie_id": 2, "score": 2.5}]
    users[1] = pa.array([[3]], pa.list_(pa.int32()))  # nothing to add up
    assert not sum(len(out) for out in ease._best_of_range(iter([*parts[:2], batch(ease.ASKING, None, None, None, None, *users)]), 0, 4, 4, 3))


def test_evaluations_are_not_run_together(spark):
    """The rows of the protocol are there when it returns: no joins of several evaluations in one plan."""
    pairs = [(u, f"m{m}", 10 if (u * m + u) % 3 else 9, 1, ("training", "validation", "test")[(u + m) % 3]) for u in range(20) for m in range(5)]
    parts = spark.createDataFrame(pairs, "user_id long, movie_id string, rating int, watch_count long, part string")
    movies = spark.createDataFrame([(f"m{m}", "t") for m in range(5)], "movie_id string, title string")
    found = metrics.offline_evaluation(parts, movies, (2.0, 20.0), (9, 10), 3, 10, (5.0, 10))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Relation" not in plan
    assert sorted((r.stage, r.model) for r in found.collect()) == sorted([("validation", "grid")] * 4 + [(s, m) for s in ("validation", "test") for m in ("baseline", "popularity")] + [("test", "selected")])
