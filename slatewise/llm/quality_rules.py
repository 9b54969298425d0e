"""Quality rules with compression bands.

zstandard's ratio (bytes in over bytes out) of a whole text grows with repetition and falls towards 1 for random signs.
Both ends are cut by limits that depend on the length, since short texts compress worse, and the same is asked of
fixed chunks, so that a repetitive stretch in a long varied text is seen too.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from slatewise.llm.texts import map_texts

# Limits (bytes from, least ratio, most ratio) for whole texts; the ratio of natural prose lies well inside.
BANDS = ((0, 0.0, 3.0), (256, 1.1, 3.5), (1024, 1.4, 4.0), (4096, 1.5, 4.5), (16384, 1.6, 5.0), (65536, 1.6, 6.0))
CHUNK_BYTES = 4096
CHUNK_LIMITS = (1.35, 6.0)
BAD_CHUNKS = 0.3
LEVEL = 3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier line, and words inside repeated 3-word windows."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    pair = ids[:-1] * size + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, window, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i:len(words) - 2 + i] |= again
    return int(covered.sum())


def ratio(compressor: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(data) / len(compressor.compress(data)) if data else 1.0


def verdict(compressor: zstandard.ZstdCompressor, data: bytes, bands=BANDS, chunk: int = CHUNK_BYTES, limits=CHUNK_LIMITS,
            bad_share: float = BAD_CHUNKS) -> tuple[float, int, bool, str | None]:
    """Ratio, chunks out of limits, kept, and the reason where it is not kept."""
    whole = ratio(compressor, data)
    low, high = next((lo, hi) for start, lo, hi in reversed(bands) if len(data) >= start)
    # The last chunk takes what is left, so no chunk is shorter than the size the limits are for.
    count = max(len(data) // chunk, 1)
    bad = 0
    if count > 1:
        for i in range(count):
            r = ratio(compressor, data[i * chunk:(i + 1) * chunk if i < count - 1 else len(data)])
            bad += not limits[0] <= r <= limits[1]
    reason = ("incompressible" if whole < low else "repetitive" if whole > high
              else "chunks" if bad > bad_share * count else None)
    return whole, bad, reason is None, reason


def score_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with the base counts, base_failed, zstd_ratio, bad_chunks, kept and the reason of a rejection.

    A null or empty text has no words, fails the base rule and has ratio 1. Every input row gives one row, repeated rows
    too; an empty table gives none; only `keep` and the text are read.
    """
    def run(texts, rows):
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        out: list[list] = [[] for _ in range(10)]
        for text_ in texts:
            counts = base_counts(text_)
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            found = verdict(compressor, text_.encode())
            reason = "base" if failed else found[3]
            for column, value in zip(out, (*counts, failed, found[0], found[1], not failed and found[2], reason), strict=True):
                column.append(value)
        return out

    schema = ", ".join(f"{n} bigint" for n in NAMES) + ", base_failed boolean, zstd_ratio double, bad_chunks bigint, kept boolean, reason string"
    return map_texts(docs, text, run, schema, keep)
