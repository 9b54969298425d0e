"""Folds and bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo `folds`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether the key is in fold 0; rows without a key are not held out."""
    return F.coalesce(fold(key, folds) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, value: str, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS,
           folds: int = 5) -> DataFrame:
    """Texts with labels outside fold 0: _text, _label (0/1), _fold; about `rows` of them, chosen by a hash of the key.

    `rows` bounds the labels that are sent to every task. Rows without key or label are no examples; a key labelled
    twice counts once, with its highest label.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).filter(fold(key, folds) != 0)
    single = usable.groupBy(F.col(key).alias("_key")).agg(F.max(value).cast("int").alias("_label"))
    count = single.count()
    kept = single if count <= rows else single.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int((1 << 30) * rows / count))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(kept), "_key")
    return found.select("_text", "_label", fold("_key", folds).alias("_fold"))
