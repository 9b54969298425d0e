"""Quality classifier: Gaussian-kernel ridge on document statistics through random Fourier features, then isotonic calibration."""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm import labelled
from slatewise.llm.quality_rules import repeated_words
from slatewise.llm.texts import _arrow_schema, map_texts, slices
from slatewise.session import written

FEATURES = 512
RIDGE = 1e-3
FIT_TASKS = 16
CALIBRATION_FOLD = 1
_CLASSES = ("upper", "lower", "letter", "digit", "space", "line", "stop", "mark", "symbol", "other")
N_STATISTICS = len(_CLASSES) + 14


@cache
def _classes() -> np.ndarray:
    """Class of every code point, by its Unicode category."""
    kinds = {"Lu": 0, "Lt": 0, "Ll": 1, "Nd": 3, "Zs": 4, "Po": 7, "Pd": 7, "Ps": 7, "Pe": 7, "Pi": 7, "Pf": 7,
             "Sm": 8, "Sc": 8, "Sk": 8, "So": 8, "Pc": 8}
    table = np.array([kinds.get(unicodedata.category(chr(i)), 2 if unicodedata.category(chr(i))[0] in "LM" else 9)
                      for i in range(0x110000)], np.uint8)
    table[[9, 32]], table[10] = 4, 5
    table[[ord(c) for c in ".!?"]] = 6
    table[[ord(c) for c in "#*$%&|<>@^~\\{}[]"]] = 8
    return table


def statistics(text: str, compressor: zstandard.ZstdCompressor) -> np.ndarray:
    """Fixed-length description of a whole text; zeros where a share has no denominator."""
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    out[:10] = np.bincount(kinds, minlength=10) / len(points)
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    changes = np.flatnonzero(np.diff(points)) + 1
    run = np.diff(np.concatenate([[0], changes, [len(points)]])).max()
    out[10:14] = np.log1p(len(data)), np.log1p(len(words)), -(share * np.log2(share)).sum(), np.log1p(run)
    out[14] = len(data) / len(compressor.compress(data))
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tally = Counter(words)
        out[15:21] = (sizes.mean(), sizes.std(), len(tally) / len(words), tally.most_common(1)[0][1] / len(words),
                      repeated_words(words) / len(words), sum(map(str.isupper, words)) / len(words))
        out[21] = sum(w[-1] in "#*$%&|<>" for w in words) / len(words)
    if lines:
        out[22] = 1 - len(set(lines)) / len(lines)
        out[23] = np.log1p(len(text) / len(lines))
    return out


def batch_statistics(texts: list[str]) -> np.ndarray:
    compressor = zstandard.ZstdCompressor(level=3, write_content_size=False)
    return np.array([statistics(t, compressor) for t in texts]).reshape(len(texts), N_STATISTICS)


@dataclass
class QualityModel:
    """Standardisation, random frequencies and phases, ridge weights, and the calibration curve."""

    mean: np.ndarray
    spread: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score in 0..1; a thousandth of the raw score's rank keeps the order within a level."""
        raw = self.raw(x)
        level = np.interp(raw, *self.knots)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -50, 50))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and non-decreasing level of each block, one pseudo-count of the base rate in each."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    base = y.mean()
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate((sums[:, 1] + base) / (sums[:, 2] + 1))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", value: str = "quality",
        rows: int = labelled.SAMPLE_ROWS, seed: int = 11) -> QualityModel | None:
    """Fit on about `rows` labelled documents outside fold 0; fold 1 calibrates. None where there are no labels.

    Spark computes the statistics and sums the normal equations per task (`FIT_TASKS` at most); the driver adds those
    few sums and solves. For the calibration the driver gets one number for each row of fold 1 of the sample.
    """
    examples = labelled.sample(docs, labels, value, text, key, rows).repartition(FIT_TASKS * 4)
    table = written(map_texts(examples, "_text", lambda texts, r: [batch_statistics(texts).tolist()], "x array<double>",
                              ("_label", "_fold")), "statistics")
    train = table.filter(F.col("_fold") != CALIBRATION_FOLD)
    moments = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]), F.count("x")) for i in range(N_STATISTICS)]
    found = train.agg(*moments).first()
    if not found[0][2]:
        return None
    mean, spread = np.array([m[0] for m in found]), np.array([max(m[1], 1e-3) for m in found])
    rng = np.random.default_rng(seed)
    frequency = rng.normal(0, 1 / np.sqrt(N_STATISTICS), (N_STATISTICS, FEATURES))
    model = QualityModel(mean, spread, frequency, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))
    schema = "sums binary"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist())
            if len(x):
                z = np.hstack([model.fourier(x), np.ones((len(x), 1))])
                total += z.T @ np.hstack([z, np.array(batch.column("_label").to_pylist(), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], arrow.field(0).type)], schema=arrow)

    sums = sum(np.frombuffer(r[0]).reshape(FEATURES + 1, FEATURES + 2)
               for r in train.coalesce(FIT_TASKS).mapInArrow(equations, schema).collect())
    left = sums[:, :-1] + RIDGE * found[0][2] / FEATURES * np.diag([*np.ones(FEATURES), 0])
    model.weights = np.linalg.lstsq(left, sums[:, -1], rcond=None)[0]

    def predict(texts, batch):
        return [model.raw(np.array(batch.column("x").to_pylist()).reshape(-1, N_STATISTICS))]

    check = table.filter(F.col("_fold") == CALIBRATION_FOLD).withColumn("_none", F.lit(""))
    pairs = map_texts(check.select("_label", "x", "_none"), "_none", predict, "raw double", ("_label", "x")).select("raw", "_label").collect()
    pairs = np.array(pairs, float).reshape(-1, 2)
    model.knots = isotonic(pairs[:, 0], pairs[:, 1]) if len(pairs) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def predict(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            threshold: float = 0.3) -> DataFrame:
    """`keep` with score (0 to 1) and predicted (1 from `threshold` on).

    A null or empty text is scored by its statistics, which are all 0. Without a model (no labels) every score is 0.5.
    One row per input row; only `keep` and the text are read.
    """
    def run(texts, rows):
        if model is None:
            return [[0.5] * len(texts)]
        return [model.score(batch_statistics(texts))] if texts else [[]]

    out = map_texts(docs, text, run, "score double", keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_accepted(docs: DataFrame, model: QualityModel | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of the rows whose score reaches `threshold`; all rows without a model."""
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for rows in slices(batch, text):
                scores = model.score(batch_statistics([t or "" for t in rows.column(text).to_pylist()]))
                yield rows.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
