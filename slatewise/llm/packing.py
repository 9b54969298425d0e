"""Bounded-space online packing of token sequences into windows of fixed length.

Every task keeps a fixed number of open windows. A document goes whole into the fullest window that still holds it
(best fit). When none does, the fullest window is closed: it takes the head of the document if at least `least` tokens
fit there, and the rest is placed again. The windows that are open when a task ends are merged by the same rule, largest first, in groups of tasks,
level by level, so no task ever gets more than a fixed number of them. What one last group leaves open is cut
at powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.encoding import encoder
from slatewise.llm.texts import slices
from slatewise.session import written

PIECES = "sequence_id bigint, offset bigint, start bigint, ids binary, doc_tokens bigint"
FAN_IN = 32


class Packer:
    """Open windows of one task. A piece is (row key, start in its document, ids, tokens of its document)."""

    def __init__(self, size: int, windows: int, least: int):
        self.size, self.windows, self.least = size, windows, least
        self.open: list[list] = []
        self.fill: list[int] = []

    def add(self, key, start: int, ids: bytes, total: int):
        """Place one piece; yields the windows that this closes."""
        while ids:
            length = len(ids) // 4
            if length >= self.size:
                yield [(key, start, ids[:4 * self.size], total)]
                start, ids = start + self.size, ids[4 * self.size:]
                continue
            room = [(fill, i) for i, fill in enumerate(self.fill) if fill + length <= self.size]
            if room:
                _, i = max(room)
                self.open[i].append((key, start, ids, total))
                self.fill[i] += length
                if self.fill[i] == self.size:
                    yield self._close(i)
                return
            if len(self.open) < self.windows:
                self.open.append([(key, start, ids, total)])
                self.fill.append(length)
                return
            i = int(np.argmax(self.fill))
            gap = self.size - self.fill[i]
            if gap >= self.least:
                self.open[i].append((key, start, ids[:4 * gap], total))
                start, ids = start + gap, ids[4 * gap:]
            yield self._close(i)

    def _close(self, i: int) -> list:
        self.fill.pop(i)
        return self.open.pop(i)


def _powers(pieces: list, size: int):
    """Cut a window that is not full into sequences whose lengths are powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    while left:
        want = min(size, 1 << (left.bit_length() - 1))
        taken, count = [], 0
        while count < want:
            key, start, ids, total = pieces.pop(0)
            n = min(len(ids) // 4, want - count)
            taken.append((key, start, ids[:4 * n], total))
            if len(ids) > 4 * n:
                pieces.insert(0, (key, start + n, ids[4 * n:], total))
            count += n
        yield taken
        left -= want


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, windows: int = 64, least: int = 16,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents: key, sequence_id, offset in it, start in the document, ids, doc_tokens.

    `ids` are little-endian unsigned 32-bit. A null or empty text is its end token alone. Null keys and repeated rows
    are documents of their own; an empty table gives no pieces; other columns are not read. Each token lies in
    exactly one piece, and a sequence has `size` tokens, a power of two, or less than `least` tokens of padding.
    """
    if size & (size - 1) or least < 1 or windows < 1:
        raise ValueError("size must be a power of two, least and windows positive")
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = f"`{key}` {kind}, {PIECES}, part bigint"

    def rows(windows_of, schema):
        columns: list[list] = [[] for _ in schema]
        for number, part, pieces in windows_of:
            offset = 0
            for k, start, ids, total in pieces:
                for column, value in zip(columns, (k, number, offset, start, ids, total, part), strict=True):
                    column.append(value)
                offset += len(ids) // 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    arrow = _schema(docs, schema)

    def first(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        packer, made = Packer(size, windows, least), 0
        for batch in batches:
            for rows_in in slices(batch, text):
                closed = []
                found = encoder(tokenizer).encode([t or "" for t in rows_in.column(text).to_pylist()])
                for k, ids in zip(rows_in.column(key).to_pylist(), found, strict=True):
                    ids += end
                    for window in packer.add(k, 0, ids, len(ids) // 4):
                        closed.append(((part << 33) + made, None, window))
                        made += 1
                yield rows(closed, arrow)
        yield rows([((part << 33) + made + i, part, w) for i, w in enumerate(packer.open)], arrow)

    def merge(level: int, last: bool):
        def run(groups):
            from pyspark import TaskContext
            group, waiting = TaskContext.get().partitionId(), []
            for batch in groups:
                waiting += batch.to_pylist()
            if not waiting:
                return
            by: dict[int, list] = {}
            for r in sorted(waiting, key=lambda r: (r["sequence_id"], r["offset"])):
                by.setdefault(r["sequence_id"], []).append((r[key], r["start"], r["ids"], r["doc_tokens"]))
            closed, made, packer = [], 0, Packer(size, windows, least)
            base = -((((level << 24) + group) << 33) + 1)
            for window in sorted(by.values(), key=lambda w: -sum(len(p[2]) for p in w)):
                for k, start, ids, total in window:
                    for full in packer.add(k, start, ids, total):
                        closed.append((base - made, None, full))
                        made += 1
            if last:
                left = [piece for window in packer.open for piece in window]
                while left:
                    for cut in _powers(left, size):
                        closed.append((base - made, None, cut))
                        made += 1
                yield rows(closed, arrow)
            else:
                yield rows([*closed, *((base - made - i, group, w) for i, w in enumerate(packer.open))], arrow)
        return run

    table = written(docs.select(key, text).mapInArrow(first, schema), "packed")
    parts = table.agg(F.max("part")).first()[0]
    done, level = [table.filter("part is null")], 0
    left = table.filter("part is not null")
    while parts is not None:
        groups, level = int(parts) // FAN_IN + 1, level + 1
        merged = written(_group(left, groups).mapInArrow(merge(level, groups == 1), schema), "merged")
        done.append(merged.filter("part is null"))
        left = merged.filter("part is not null")
        parts = groups - 1 if groups > 1 else None
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("part")


def _group(left: DataFrame, groups: int) -> DataFrame:
    """One task for the leftovers of `FAN_IN` tasks each."""
    return left.repartitionByRange(groups, F.floor(F.col("part") / FAN_IN)) if groups > 1 else left.coalesce(1)


def _schema(docs: DataFrame, ddl: str) -> pa.Schema:
    from slatewise.llm.texts import _arrow_schema
    return _arrow_schema(docs.sparkSession, ddl)
