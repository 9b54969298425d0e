"""Severity of toxicity by cumulative-link ordinal regression.

Hashed words and word stems are the features. The cumulative logits of all grades share one weight vector; ordered
thresholds part the grades. The expected grade is the severity. Labels only say toxic or not, so toxic examples are
graded by the share of their words that mark toxic texts: 1 up to the median of toxic examples, 2 above it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm import labelled
from slatewise.llm.texts import _arrow_schema, map_texts, slices

BUCKETS = 1 << 17
SELECTED = 4096
STEMS = (4, 6)
GRADES = 3
PENALTY = 0.01
ROUNDS = 400

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[dict[int, int], int]:
    """Bucket counts of the lower-cased words of a text and of their stems, and the number of words."""
    words = _WORD.findall(text.lower())
    counts: dict[int, int] = {}
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    for word, n in tally.items():
        for name in (word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)):
            bucket = zlib.crc32(name.encode()) % BUCKETS
            counts[bucket] = counts.get(bucket, 0) + n
    return counts, len(words)


@dataclass
class SeverityModel:
    """Chosen buckets (sorted), their weights, and the ordered thresholds between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def values(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the chosen features in a text: log counts."""
        counts, _ = features(text)
        keys = np.fromiter(counts, np.int64, len(counts))
        place = np.minimum(np.searchsorted(self.buckets, keys), max(len(self.buckets) - 1, 0))
        hit = self.buckets[place] == keys if len(self.buckets) else np.zeros(len(keys), bool)
        return place[hit], np.log1p(np.fromiter(counts.values(), float, len(counts))[hit])

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade for linear scores."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -50, 50)))
        edge = np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))])
        return edge[:, :-1] - edge[:, 1:]


def ordinal_fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised cumulative-logit likelihood (Adam, full batches).

    Thresholds are a first one plus positive steps, so they stay ordered; every grade weighs the same.
    """
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    place = np.concatenate([p for p, _ in rows]) if rows else np.zeros(0, int)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    weight = 1 / np.maximum(np.bincount(grades, minlength=GRADES), 1)[grades]
    weight = weight / weight.sum()
    theta = np.concatenate([np.zeros(size), [0.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, ROUNDS + 1):
        steps = np.exp(theta[size + 1:])
        cuts = theta[size] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(owner, theta[place] * value, len(rows))
        high = np.where(grades < GRADES - 1, sigmoid(cuts[np.minimum(grades, GRADES - 2)] - score), 1.0)
        low = np.where(grades > 0, sigmoid(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance * weight, low * (1 - low) / chance * weight
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(place, (d_high - d_low)[owner] * value, size) + PENALTY / 100 * theta[:size]
        by_cut = -np.bincount(np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, d_high, 0), GRADES - 1)
        by_cut += np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0), GRADES - 1)
        gradient[size] = by_cut.sum()
        gradient[size + 1:] = np.cumsum(by_cut[::-1])[::-1][1:] * steps
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        theta -= 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return theta[:size], theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1:]))])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", value: str = "toxic",
        rows: int = labelled.SAMPLE_ROWS) -> SeverityModel | None:
    """Fit on about `rows` labelled documents outside fold 0; None without both toxic and other examples.

    Spark counts features per class; the driver gets the counts of at most `BUCKETS` buckets and, for each example, the
    few chosen features it has.
    """
    examples = labelled.sample(docs, labels, value, text, key, rows)
    arrow = _arrow_schema(docs.sparkSession, "bucket int, label int, n bigint")

    def count(batches):
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text_, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                found, _ = features(text_ or "")
                total[min(label, 1), list(found)] += 1
                total[min(label, 1), BUCKETS] += 1
        label, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((bucket, label, total[label, bucket]), arrow, strict=True)], schema=arrow)

    counted = examples.mapInArrow(count, "bucket int, label int, n bigint").groupBy("bucket", "label").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, BUCKETS + 1))
    total[counted["label"], counted["bucket"]] = counted["n"]
    clean, toxic = total[:, BUCKETS]
    if not clean or not toxic:
        return None
    share = (total[:, :BUCKETS] + 0.5) / (total[:, BUCKETS:] + 1)
    odds = np.log(share[1] / (1 - share[1])) - np.log(share[0] / (1 - share[0]))
    strength = np.abs(odds) * np.sqrt(total[:, :BUCKETS].sum(0))
    chosen = np.sort(np.argsort(-strength, kind="stable")[:SELECTED])
    chosen = chosen[total[:, chosen].sum(0) > 0]
    marker = set(np.flatnonzero((odds > 3) & (total[1, :BUCKETS] >= 3)).tolist())
    model = SeverityModel(chosen, np.zeros(len(chosen)), np.zeros(GRADES - 1))
    schema = "_label int, place array<int>, value array<double>, marked double"
    arrow2 = _arrow_schema(docs.sparkSession, schema)

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                columns: list[list] = [part.column("_label").to_pylist(), [], [], []]
                for text_ in part.column("_text").to_pylist():
                    place, value_ = model.values(text_ or "")
                    counts, words = features(text_ or "")
                    for column, x in zip(columns[1:], (place.tolist(), value_.tolist(), sum(n for b, n in counts.items() if b in marker) / max(words, 1)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow2, strict=True)], schema=arrow2)

    found = examples.mapInArrow(describe, schema).collect()
    found.sort(key=lambda r: (r["_label"], r["place"], r["value"]))
    marked = np.array([r["marked"] for r in found])
    label = np.array([r["_label"] for r in found])
    middle = np.median(marked[label > 0])
    grades = np.where(label > 0, 1 + (marked > middle), 0)
    model.weights, model.thresholds = ordinal_fit([(np.array(r["place"], int), np.array(r["value"])) for r in found], grades, len(chosen))
    return model


def predict(docs: DataFrame, model: SeverityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            threshold: float = 0.5) -> DataFrame:
    """`keep` with severity (expected grade, 0 to 2), grade (the likeliest), p_toxic and toxic (p_toxic over `threshold`).

    A text without words has no feature: its grade is 0 with severity 0. Without a model every severity is 0. One row per
    input row; only `keep` and the text are read.
    """
    def run(texts, rows):
        severity, grade, chance = [], [], []
        for text_ in texts:
            place, value = model.values(text_) if model and text_ else (np.zeros(0, int), np.zeros(0))
            if not len(place):
                severity.append(0.0), grade.append(0), chance.append(0.0)
                continue
            p = model.chances(np.array([(model.weights[place] * value).sum()]))[0]
            severity.append(float(p @ np.arange(GRADES))), grade.append(int(p.argmax())), chance.append(float(1 - p[0]))
        return [severity, grade, chance]

    out = map_texts(docs, text, run, "severity double, grade int, p_toxic double", keep)
    return out.withColumn("toxic", F.col("p_toxic") > threshold)
