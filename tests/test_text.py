import tracemalloc

import numpy as np
import pandas as pd

from slatewise.functions.scalars import fold_accents
from slatewise.operators import text as tx


def test_similarities_need_no_sums_by_user_and_movie(spark, monkeypatch):
    """Users in several blocks, hot terms, a user without a number, against the join on the term; what is shuffled has a row per user or movie."""
    monkeypatch.setattr(tx, "USERS_TOGETHER", 5)
    rng = np.random.default_rng(9)
    pick = lambda owners, most: sorted({(o, f"w{int(t)}") for o in owners for t in [0, *rng.integers(0, 40, rng.integers(1, most))]}, key=str)
    vectors = [(f"m{m}", t, float(rng.random() + 0.1)) for m, t in pick(range(30), 20)] + [("alone", "nobody asks", 1.0), (None, "w3", 0.5)]
    queries = [(u, t, float(rng.random() + 0.1)) for u, t in pick([*range(17), None], 8)] + [(90, "unknown", 1.0)]
    examples = [(3, "m4"), (3, "m5"), (200, "m1"), (200, "m1"), (201, "no such movie")]
    v = spark.createDataFrame(vectors, "movie_id string, term string, weight double")
    found = tx.text_similarity(spark.createDataFrame(queries, "user_id long, term string, weight double"),
                               spark.createDataFrame(examples, "user_id long, movie_id string"), v)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "movie_id" not in " ".join(line for line in plan.splitlines() if "Aggregate [user_id" in line)
    mixed = {}
    for u, t, w in queries:
        mixed.setdefault(u, {})[t] = w
    for u in (3, 200):
        own = [m for x, m in examples if x == u]
        for m, t, w in vectors:
            if m in own:
                terms = mixed.setdefault(u, {})
                terms[t] = terms.get(t, 0.0) + w * own.count(m) / len(own)
    want = {}
    for u, terms in mixed.items():
        norm = sum(w * w for w in terms.values()) ** 0.5
        for m, t, w in vectors:
            if t in terms:
                want[u, m] = want.get((u, m), 0.0) + terms[t] / norm * w
    got = {(r.user_id, r.movie_id): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want) and len(want) > 400


def test_accents_are_folded_without_copies_of_a_batch():
    """A batch of long texts is not held again for each step."""
    texts = pd.Series(["a" * 1_000_000] * 20 + ["é" * 500_000, None, "ﬁn½ Ünï™"])
    tracemalloc.start()
    try:
        found = fold_accents.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000
    assert found[0] == texts[0] and found[20] == "e" * 500_000 and found[21] is None and found[22] == "fin12 UniTM"
