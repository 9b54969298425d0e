"""Benchmark decontamination: rare n-grams of an item seed its candidates, Smith-Waterman alignment scores them.

An alignment of at least T (equal words less edits) over an item of n words has at least T + e equal words in at most e + 1
runs for its e edits, so it shares the two-word grams of at least T - 1 places of the item, and covers at most 2 n - T words.
An item's seeds are its rarest grams (by the number of items that hold them), as many as leave fewer than T - 1 places
of the item without one: a match cannot do without a seed, whatever its edits and however often the item leaked. Documents join items on seeds only; of
these pairs all shared grams are counted, and stretches of that length with that many grams are aligned. All others cannot reach T: no match is missed.
The documents are read once and never shuffled. The benchmark is the query set: it is taken in blocks of bounded size, each
sent to the tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.texts import _arrow_schema, slices

GRAM = 2
BLOCK_WORDS = 2_000_000
HITS = 4_000_000
ALIGNED_CELLS = 1 << 18
MARK_BITS = 20
MATCH, MISMATCH, GAP = 1, -1, -1
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Numbers:
    """64-bit numbers of words, looked up in a bounded table."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for i, number in enumerate(found):
                if number is None:
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i].encode("utf-8", "surrogatepass"))
        return np.array(found, np.uint64)


def gram_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(max(len(numbers) - n + 1, 0), np.uint64)
    for i in range(n):
        value = (value ^ numbers[i:i + len(value)]) * _PRIME
        value ^= value >> np.uint64(29)
    return value


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of `item` in each window: score, start and end (exclusive) in the window.

    All windows advance together, one item word per step. Gaps inside a window row are a running maximum.
    """
    width = max(map(len, windows))
    table = np.zeros((len(windows), width), np.uint64)
    inside = np.zeros((len(windows), width), bool)
    for row, window in enumerate(windows):
        table[row, :len(window)] = window
        inside[row, :len(window)] = True
    score = np.zeros((len(windows), width + 1), np.int32)
    begin = np.tile(np.arange(width + 1, dtype=np.int32), (len(windows), 1))
    best, first, last = (np.zeros(len(windows), np.int32) for _ in range(3))
    ramp, at, lane = np.arange(width + 1, dtype=np.int32) * -GAP, np.arange(width + 1, dtype=np.int32), np.arange(len(windows))
    for word in item:
        step = np.where((table == word) & inside, MATCH, MISMATCH)
        fresh, origin = np.zeros_like(score), np.tile(at, (len(windows), 1))
        diagonal, above = score[:, :-1] + step, score[:, 1:] + GAP
        take = np.maximum(diagonal, above)
        positive = take > 0
        fresh[:, 1:][positive] = take[positive]
        origin[:, 1:][positive] = np.where(diagonal >= above, begin[:, :-1], begin[:, 1:])[positive]
        lifted = fresh + ramp
        top = np.maximum.accumulate(lifted, 1)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0), 1)
        gapped = top - ramp
        better = gapped > fresh
        origin = np.where(better, np.take_along_axis(origin, source, 1), origin)
        score, begin = np.where(better, gapped, fresh), origin
        end = score.argmax(1)
        value = score[lane, end]
        improved = value > best
        best[improved], last[improved], first[improved] = value[improved], end[improved], begin[lane, end][improved]
    return list(zip(best.tolist(), first.tolist(), last.tolist()))


def _grouped(keys: np.ndarray, values: np.ndarray):
    """(key, values) of sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    if len(keys):
        yield from ((int(keys[part[0]]), values[part]) for part in np.split(np.arange(len(keys)), cuts))


class Items:
    """A block of benchmark items with their n-grams (items of at most `GRAM` words are one gram of all their words)."""

    def __init__(self, rows: list[tuple], least: float):
        numbers = Numbers()
        self.keys = [key for key, _ in rows]
        self.words = [numbers.of(words_of(text)) for _, text in rows]
        size = np.array([len(w) for w in self.words], np.int64)
        goal = np.array([next((t for t in range(max(1, int(least * n) - 1), n) if t / n >= least), n) for n in size.tolist()], np.int64)
        whole = size <= GRAM
        self.length = np.where(whole, size, np.where(goal > 1, GRAM, 1))
        self.need = np.where(whole, 1, np.where(goal > 1, goal - GRAM + 1, goal))
        self.reach = 2 * size - goal
        grams = [np.unique(gram_hashes(w, g)) if len(w) else w for w, g in zip(self.words, self.length.tolist(), strict=True)]
        self.grams = grams
        shared, held_by = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_counts=True)
        seeds = [self._rarest(w, g, need, shared, held_by) for w, g, need in zip(self.words, self.length.tolist(), self.need.tolist(), strict=True)]
        gram = np.concatenate([np.zeros(0, np.uint64), *seeds])
        item = np.repeat(np.arange(len(seeds)), [len(g) for g in seeds])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item = gram[order], item[order]
        self.mark = np.zeros(1 << MARK_BITS, bool)
        self.mark[self.gram >> np.uint64(64 - MARK_BITS)] = True

    @staticmethod
    def _rarest(words: np.ndarray, n: int, need: int, shared: np.ndarray, held_by: np.ndarray) -> np.ndarray:
        """The rarest grams of an item, so many that fewer than `need` of its places are without one."""
        if not len(words):
            return words
        grams, places = np.unique(gram_hashes(words, n), return_counts=True)
        order = np.argsort(held_by[np.searchsorted(shared, grams)], kind="stable")
        covered = np.cumsum(places[order])
        return grams[order[:int(np.searchsorted(covered, covered[-1] - need + 1)) + 1]]

    def places(self, numbers: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first, end) of all stretches that can hold an item, overlapping ones joined.

        `numbers` are the words of documents one after another, `starts` where each begins and where the last ends.
        """
        out, shift = [], np.uint64(64 - MARK_BITS)
        for n in sorted(set(self.length[self.length > 0].tolist())):
            grams = gram_hashes(numbers, n)
            one = np.ones(len(grams), bool)
            for back in range(1, n):  # grams of two documents
                cut = starts[1:-1] - back
                one[cut[(cut >= 0) & (cut < len(one))]] = False
            at = np.flatnonzero(self.mark[grams >> shift] & one)
            left = np.searchsorted(self.gram, grams[at])
            many = np.searchsorted(self.gram, grams[at], side="right") - left
            if many.sum() > HITS and len(starts) > 2:
                half, out = len(starts) // 2, []
                for part, first in ((starts[:half + 1], 0), (starts[half:], half)):
                    base = int(part[0])
                    out += [(row + first, i, lo + base, hi + base) for row, i, lo, hi in self.places(numbers[base:part[-1]], part - base)]
                return out
            seed = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, row = self.item[seed], np.searchsorted(starts, np.repeat(at, many), side="right") - 1
            own = self.length[item] == n
            pairs = np.unique(item[own] * len(starts) + row[own])
            hits = [self._hits(i, rows, grams, one, starts) for i, rows in _grouped(pairs // len(starts), pairs % len(starts))]
            if hits:
                out += self._stretches(np.repeat([i for i, _ in hits], [len(x) for _, x in hits]), np.concatenate([x for _, x in hits]), n, starts)
        return out

    def _hits(self, item: int, rows: np.ndarray, grams: np.ndarray, one: np.ndarray, starts: np.ndarray) -> tuple[int, np.ndarray]:
        """The item and the places of all its grams in the given documents."""
        spans = [np.arange(starts[r], min(starts[r + 1], len(grams))) for r in rows.tolist()]
        x = np.concatenate(spans)
        own = self.grams[item]
        near = np.minimum(np.searchsorted(own, grams[x]), len(own) - 1)
        return item, x[(own[near] == grams[x]) & one[x]]

    def _stretches(self, item: np.ndarray, x: np.ndarray, n: int, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The stretches with as many different hits (item, x) as each item, all of gram length `n`, needs."""
        stride = int(starts[-1]) + 1
        key = np.sort(item * stride + x)
        item, x = key // stride, key % stride
        last = np.arange(len(key)) + self.need[item] - 1
        at = np.flatnonzero(last < len(key))
        last = last[at]
        row = np.searchsorted(starts, x[at], side="right") - 1
        room = self.reach[item[at]] - n
        kept = (item[last] == item[at]) & (x[last] < starts[row + 1]) & (x[last] - x[at] <= room)
        at, last, row, room = at[kept], last[kept], row[kept], room[kept]
        if not len(at):
            return []
        item, lo, hi = item[at], np.maximum(starts[row], x[last] - room), np.minimum(starts[row + 1], x[at] + room + n)
        fresh = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])]))
        end = np.concatenate([fresh[1:], [len(at)]]) - 1
        return list(zip(row[fresh].tolist(), item[fresh].tolist(), lo[fresh].tolist(), hi[end].tolist(), strict=True))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
            item_text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item: key, item, score, start, end (words of the document).

    The score is the alignment's (1 for equal words, -1 for a replaced, added or missing one) over the item's words; matches
    have at least `least`; items of one or two words must occur whole. The best place of an item in a document is given. Null and empty texts, and items without words,
    match nothing; a null key is carried along; repeated rows give repeated matches; repeated items each match.
    """
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}"
    schema = f"{kinds}, score double, `start` bigint, `end` bigint"
    arrow, out = _arrow_schema(docs.sparkSession, schema), None
    for items in _blocks(benchmark, item, item_text, least):
        part = docs.select(key, text).mapInArrow(_search(items, text, key, least, arrow), schema)
        out = part if out is None else out.unionAll(part)
    return out


def _blocks(benchmark: DataFrame, item: str, item_text: str, least: float):
    """The benchmark in blocks of about `BLOCK_WORDS` words at most."""
    queries = benchmark.select(F.col(item).alias("_item"), F.coalesce(F.col(item_text), F.lit("")).alias("_text"))
    total = queries.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * BLOCK_WORDS)))
    for block in range(blocks):
        chosen = queries.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block) if blocks > 1 else queries
        yield Items(sorted(((r[0], r[1]) for r in chosen.collect()), key=lambda r: (str(r[0]), r[1])), least)


def _find(items: Items, numbers: Numbers, texts: list, least: float) -> dict[tuple[int, int], tuple]:
    """Best (score, start, end) of each row and item of the block that reach `least`."""
    found = [numbers.of(words_of(t) if t else []) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)]).astype(np.int64)
    stream = np.concatenate([np.zeros(0, np.uint64), *found])
    waiting: dict[int, list] = {}
    for row, i, lo, hi in items.places(stream, starts):
        waiting.setdefault(i, []).append((row, lo - int(starts[row]), stream[lo:hi]))
    best: dict[tuple[int, int], tuple] = {}
    for i, places in waiting.items():
        places.sort(key=lambda p: len(p[2]), reverse=True)
        while places:
            group = places[-max(1, min(256, ALIGNED_CELLS // len(places[-1][2]))):]
            group = group[-max(1, ALIGNED_CELLS // len(group[0][2])):]
            del places[-len(group):]
            for (row, lo, _), (score, first, last) in zip(group, align(items.words[i], [w for _, _, w in group]), strict=True):
                share = score / len(items.words[i])
                if share >= least and share > best.get((row, i), (0,))[0]:
                    best[row, i] = (share, lo + first, lo + last)
    return best


def _search(items: Items, text: str, key: str, least: float, arrow: pa.Schema):
    def run(batches):
        numbers = Numbers()
        for batch in batches:
            for rows in slices(batch, text):
                columns: list[list] = [[] for _ in arrow]
                keys = rows.column(key).to_pylist()
                for (row, i), found in sorted(_find(items, numbers, rows.column(text).to_pylist(), least).items()):
                    for column, value in zip(columns, (keys[row], items.keys[i], *found), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          least: float = 0.5) -> DataFrame:
    """All rows and columns of `docs` but for documents that hold a benchmark item (see `matches`); nothing is shuffled."""
    def keep(items):
        def run(batches):
            numbers = Numbers()
            for batch in batches:
                for rows in slices(batch, text):
                    bad = {row for row, _ in _find(items, numbers, rows.column(text).to_pylist(), least)}
                    yield rows.filter(pa.array([i not in bad for i in range(rows.num_rows)], pa.bool_()))
        return run

    out = docs
    for items in _blocks(benchmark, item, item_text, least):
        out = out.mapInArrow(keep(items), docs.schema)
    return out
