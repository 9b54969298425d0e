"""Token-id files of directly addressable codes.

An id is split into 8-bit levels. Level 0 has a byte for every id; a bit per byte says whether the id goes on in the
next level, and the number of set bits before it (a rank directory plus the bits of one block) is its place there.
So any token is read by following ranks, without decoding its neighbours.

A file is one self-contained byte string with its document keys, document bounds and levels. Spark writes the files
as rows of a table in the shared folder, since only Spark reaches every store.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.encoding import encoder
from slatewise.llm.texts import _arrow_schema, slices
from slatewise.session import written

MAGIC = b"DACF"
BLOCK = 512
FILE_SCHEMA = "part int, number int, start_in_part bigint, n_docs bigint, n_tokens bigint, data binary"


def encode_file(keys: list, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """Keys (integers or None) of documents, their bounds in `ids` (one more than keys), and all ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK)))]) if len(more) else np.zeros(1)
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    nulls = np.array([k is None for k in keys], np.uint8)
    return b"".join([MAGIC, struct.pack("<QQB", len(keys), len(ids), len(levels)), numbers.tobytes(), nulls.tobytes(),
                     bounds.astype("<u8").tobytes(), *levels])


class TokenFile:
    """Reader of one file: `token(i)` for one id, `ids()` for all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("Not a token file")
        docs, self.size, count = struct.unpack_from("<QQB", data, 4)
        at = 21
        numbers = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.keys = [None if n else int(k) for k, n in zip(numbers, nulls, strict=True)]
        at += 9 * docs
        self.bounds = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunk = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            blocks = -(-n // BLOCK) + 1
            ranks = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            at += n + len(bits) + 4 * blocks
            self.levels.append((chunk, bits, ranks))

    def token(self, i: int) -> int:
        """The id at place `i`, by ranks alone."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = (i // BLOCK) * (BLOCK // 8)
            before = int(np.bitwise_count(bits[first:i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[i // BLOCK]) + before, shift + 8
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if len(out):
                value[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= out << 8
            out = value
        return out


def write_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", file_tokens: int = 1 << 20) -> DataFrame:
    """Write all documents, in ascending order of an integer key, as files of about `file_tokens` ids; returns the files.

    A null or empty text is its end id alone. Null keys come first; rows with the same key are ordered by a digest of
    their text and are each a document. An empty table gives no files. Other columns are not read.
    """
    arrow = _arrow_schema(docs.sparkSession, FILE_SCHEMA)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, parts, bounds = [], [], [0]

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = encode_file(keys, np.array(bounds), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((part, number, before, len(keys), len(ids), data), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for rows in slices(batch, text):
                found = encoder(tokenizer).encode([t or "" for t in rows.column(text).to_pylist()])
                for k, ids in zip(rows.column(key).to_pylist(), found, strict=True):
                    keys.append(k)
                    parts.append(ids + end)
                    bounds.append(bounds[-1] + len(ids) // 4 + 1)
                    if bounds[-1] >= file_tokens:
                        yield flush()
                        number, before = number + 1, before + bounds[-1]
                        keys, parts, bounds = [], [], [0]
        if keys:
            yield flush()

    digest = F.xxhash64(F.col(text))
    dealt = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first(), digest)
    ordered = dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), digest)
    return written(ordered.mapInArrow(run, FILE_SCHEMA), "token-files")


def part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each write task's files: one number per task, however many files there are."""
    starts, total = {}, 0
    for part, tokens in sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + tokens
    return starts


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of token files: key, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    starts = part_starts(files)
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids binary"
    arrow = _arrow_schema(files.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["data"])
                raw, bounds = file.ids().astype("<u4").tobytes(), file.bounds
                first = starts[row["part"]] + row["start_in_part"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(file.keys, pa.int64()), pa.array(bounds[:-1] + first, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([raw[4 * a:4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], arrow.field(3).type)], schema=arrow)

    return files.select("part", "start_in_part", "data").mapInArrow(run, schema)


def tokens_at(files: DataFrame, places: DataFrame, place: str = "position") -> DataFrame:
    """The token at each asked place (counted over all documents): place, token; null where there is none."""
    starts = part_starts(files)
    spark = files.sparkSession
    parts = spark.createDataFrame([(p, s) for p, s in starts.items()], "part int, part_start bigint")
    spans = files.withColumn("_file", F.struct("part", "number")).join(parts, "part")
    spans = spans.select(F.expr("part_start + start_in_part").alias("_from"), "n_tokens", "data")
    asked = places.select(F.col(place).cast("long").alias("_place"))
    arrow = _arrow_schema(spark, "_place bigint, token bigint")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                file = TokenFile(r["data"])
                yield pa.RecordBatch.from_arrays([pa.array(r["places"], pa.int64()),
                                                  pa.array([file.token(p - r["_from"]) for p in r["places"]], pa.int64())], schema=arrow)

    bounds = spans.select("_from", "n_tokens")
    step = bounds.agg(F.max("n_tokens")).first()[0] or 1
    grid = bounds.withColumn("_cell", F.explode(F.sequence(F.expr(f"_from div {step}"), F.expr(f"(_from + n_tokens - 1) div {step}"))))
    hits = asked.distinct().withColumn("_cell", F.expr(f"_place div {step}")).join(grid, "_cell").filter("_place >= _from and _place < _from + n_tokens")
    found = hits.groupBy("_from").agg(F.collect_list("_place").alias("places")).join(spans.select("_from", "data"), "_from")
    tokens = found.mapInArrow(read, "_place bigint, token bigint")
    return asked.join(tokens, "_place", "left").select(F.col("_place").alias(place), "token")


