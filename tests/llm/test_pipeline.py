"""The pipeline on the smallest sample, stage by stage against plain versions."""

import os
import re

import pytest

import corpus_pipeline
from slatewise.llm import texts
from tests.llm.test_operators import plain_jaccard, plain_secrets

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables are not here")
def test_stages(spark):
    docs, kept = texts.table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "stage")
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if name != "packing" else docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    accepted, single, clean, safe, pieces = kept
    labels = {r["doc_id"]: r["quality"] for r in texts.table(spark, DATA, "labels").collect()}
    assert all(i in accepted for i, q in labels.items() if q == 1)
    ids = list(accepted)
    group = {i: i for i in ids}
    links = plain_jaccard([accepted[i] for i in ids])
    for _ in ids:
        for a, b in links:
            group[ids[a]] = group[ids[b]] = min(group[ids[a]], group[ids[b]])
    assert len(single) == len(set(group.values())) and {group[i] for i in single} == set(group.values())
    plain = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    items = [plain(r["text"]) for r in texts.table(spark, DATA, "benchmark").collect()]
    assert set(clean) == {i for i, t in single.items() if not any(x in plain(t) for x in items)}
    assert set(safe) == set(clean) and all(not plain_secrets(t) for t in safe.values())
    assert all(safe[i] == t for i, t in clean.items() if not plain_secrets(t) and "[secret]" not in safe[i])
    assert {p["doc_id"] for p in pieces} == set(safe)
