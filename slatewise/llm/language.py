"""Language identification with error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed character n-grams is trained from counts
of the whole training table: log odds of a gram in the languages with that bit against the others, each language
weighing the same. A text's margins per bit are decoded to the codeword with the least weighted logistic loss; the
distance to the runner-up flags ambiguous texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.texts import map_texts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
STEEPNESS = 4.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased letters of all texts, the text each belongs to, and the letters of each text.

    Runs of other signs count as one space.
    """
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _letters()[points]
    letters = np.bincount(owner[letter], minlength=len(texts))
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    hashes, owners = [], []
    for n in ORDERS:
        value = np.zeros(max(len(points) - n + 1, 0), np.uint64)
        for i in range(n):
            value = (value * np.uint64(0x100000001B3)) ^ points[i:i + len(value)]
        value = ((value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        inside = owner[:len(value)] == owner[n - 1:n - 1 + len(value)]
        hashes.append(value[inside].astype(np.int32))
        owners.append(owner[:len(value)][inside])
    return np.concatenate(hashes), np.concatenate(owners), letters


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows, -1 or 1): all distinct splits up to six languages, beyond that the best of seeded random codes."""
    if count < 2:
        return np.ones((count, 1))
    if count <= 6:
        return np.array([[1 if (split >> i) & 1 else -1 for split in range(1, 1 << (count - 1))] for i in range(count)])
    bits, rng, best, most = int(np.ceil(10 * np.log2(count))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (count, bits))
        apart = (bits - code @ code.T) // 2
        least = apart[~np.eye(count, dtype=bool)].min()
        if least > most and (abs(code.sum(0)) < count).all():
            best, most = code, least
    return best


@dataclass
class LanguageModel:
    """Learned languages, their codewords, and weights and scale of each bit's classifier."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows with text and lang. Counts are summed on Spark; the driver gets languages x buckets numbers."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).alias("_lang"))

    def count(texts, rows):
        names = rows.column("_lang").to_pylist()
        known = sorted(set(names))
        place = np.array([known.index(n) for n in names])
        bucket, owner, _ = grams(texts)
        total = np.bincount(place[owner] * BUCKETS + bucket, minlength=len(known) * BUCKETS)
        cell = np.flatnonzero(total)
        return [[known[i] for i in cell // BUCKETS], cell % BUCKETS, total[cell]]

    table = _expand(labelled, text, count)
    rows = table.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    code = codewords(len(languages))
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS) if len(languages) else counts
    bits = code.shape[1] if len(languages) else 0
    weights = np.zeros((BUCKETS, bits), np.float32)
    for b in range(bits):
        one, zero = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(zero):
            weights[:, b] = np.log(one.mean(0)) - np.log(zero.mean(0))
    typical = np.abs((counts / np.maximum(counts.sum(1, keepdims=True), 1)) @ weights) if len(languages) else np.zeros((0, bits))
    scale = np.maximum(typical.mean(0), 1e-9) if bits else np.ones(0)
    trust = typical.min(0) / scale if bits else np.ones(0)
    return LanguageModel(languages, code, weights, scale, np.maximum(trust, 0.05))


def _expand(df: DataFrame, text: str, function) -> DataFrame:
    """Like map_texts for functions that return any number of rows."""
    import pyarrow as pa

    from slatewise.llm.texts import _arrow_schema, slices
    schema = "lang string, bucket int, n bigint"
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                columns = function(part.column(text).to_pylist(), part)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each row of margins, its share of the evidence, and the gap to the next."""
    agreement = margins[:, None, :] * model.code[None]
    loss = (np.logaddexp(0, -STEEPNESS * agreement) * model.trust).sum(2)
    best = loss.argmin(1)
    evidence = np.exp(-(loss - loss.min(1, keepdims=True)))
    order = np.sort(loss, 1)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, 1 / evidence.sum(1), gap


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            ambiguous: float = 1.0) -> DataFrame:
    """`keep` with lang_pred, score (0 to 1) and ambiguous (the runner-up's loss is within `ambiguous`).

    A null text, one without letters, and any text under a model that learned no language is 'und' with score 0 and
    ambiguous. One row per input row; only `keep` and the text are read.
    """
    def run(texts, rows):
        names, scores, doubt = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        bucket, owner, letters = grams(texts)
        bits = len(model.scale)
        sums = np.zeros((len(texts), bits))
        for b in range(bits):
            sums[:, b] = np.bincount(owner, model.weights[bucket, b], len(texts))
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        usable = np.flatnonzero(letters > 0)
        if model.languages and len(usable):
            best, score, gap = decode(model, sums[usable] / n[usable, None] / model.scale)
            for i, k, s, g in zip(usable.tolist(), best.tolist(), score.tolist(), gap.tolist()):
                names[i], scores[i], doubt[i] = model.languages[k], s, g < ambiguous
        return [names, scores, doubt]

    return map_texts(docs, text, run, "lang_pred string, score double, ambiguous boolean", keep, limit=1 << 20)
