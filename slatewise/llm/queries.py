"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import (chats, decontaminate, hard_negatives, labelled, language, near_copies, packing, quality_model, quality_rules, repair, secrets, texts,
                           token_count, token_files, toxicity)
from slatewise.session import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function=None, sql: str | None = None):
    if function is None:
        return lambda f: query(f, sql)

    @wraps(function)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, directory)
    QUERIES[function.__name__] = run
    if sql:
        ORACLES[function.__name__] = sql
    return run


@query
def op1_token_counts(spark, directory):
    docs = texts.table(spark, directory, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op2_language(spark, directory):
    docs = texts.table(spark, directory, "documents")
    model = language.fit(docs.filter(labelled.fold() != 0))
    found = language.predict(docs, model)
    return found.select("doc_id", labelled.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op3_near_copies(spark, directory):
    return near_copies.near_copies(texts.table(spark, directory, "documents"))


@query
def op4_quality_rules(spark, directory):
    found = quality_rules.score_rules(texts.table(spark, directory, "documents"))
    return found.select("doc_id", *quality_rules.NAMES, "base_failed", "kept", "zstd_ratio", "bad_chunks", "reason")


@query
def op5_secrets(spark, directory):
    found = secrets.scan(texts.table(spark, directory, "documents"))
    of = lambda k: lambda s: s["kind"] == k
    kinds = [F.size(F.filter("secrets", of(k))).cast("bigint").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    base = secrets.spelled(F.filter("secrets", lambda s: s["kind"] < 3))
    return found.select("doc_id", *kinds, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("secrets")).alias("spans"))


@query
def op6_toxicity(spark, directory):
    docs = texts.table(spark, directory, "documents")
    model = toxicity.fit(docs, texts.table(spark, directory, "labels"))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", labelled.held_out().alias("held_out"), "severity", "grade", "p_toxic", "toxic")


@query
def op7_packing(spark, directory):
    docs = texts.table(spark, directory, "documents")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op8_decontamination(spark, directory):
    return decontaminate.matches(texts.table(spark, directory, "documents"), texts.table(spark, directory, "benchmark"))


@query
def op9_token_files(spark, directory):
    docs = texts.table(spark, directory, "documents")
    files = token_files.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_quality_classifier(spark, directory):
    docs = texts.table(spark, directory, "documents")
    model = quality_model.fit(docs, texts.table(spark, directory, "labels"))
    found = quality_model.predict(docs, model)
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")


@query(sql="""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
  QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives
""")
def op11_hard_negatives(spark, directory):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(texts.table(spark, directory, "embeddings"), label=label, anchor=F.col("id") % 100 == 0)


@query(sql=r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks(mark) AS (VALUES ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<<ROLE>>'), ('<</ROLE>>'), ('<</TURN>>')),
heads AS (SELECT DISTINCT substr(mark, 1, CAST(n AS BIGINT)) AS head FROM marks, range(1, 9) AS r(n) WHERE n < length(mark)),
strings AS (SELECT DISTINCT text AS s FROM given UNION SELECT DISTINCT role FROM given),
guards AS (
  SELECT s, (length(s) - length(replace(s, '␛', ''))) + (SELECT sum((length(s) - length(replace(s, mark, ''))) // length(mark)) FROM marks)
            + (SELECT count(*) FROM heads WHERE ends_with(s, head)) AS n FROM strings),
turns AS (
  SELECT g.*, length(g.text) + t.n + CASE g.role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE 8 + length(g.role) + r.n + 9 + 9 END AS formatted
  FROM given g JOIN guards t ON t.s = g.text JOIN guards r ON r.s = g.role)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op12_chat_format(spark, directory):
    given = texts.table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], given.schema)
    formatted = written(chats.format_chats(given.unionAll(added)), "chats")
    return chats.read_back(formatted).drop("state")


@query
def op13_structure_repair(spark, directory):
    given = texts.table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    audits, mended = repair.repair(repair.damage(given))
    names = [c for c in audits.columns if c != "conv_id"]
    hashed = repair.digests(mended).withColumnRenamed("conv_id", "_hashed")
    whole = audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left").withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct()
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit("") if c == "audit" else F.lit(0).cast("bigint")).alias(c) for c in names),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
