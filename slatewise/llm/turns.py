"""Turns of conversations in order, cut into pieces of bounded size, so a conversation of any length spreads over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.texts import _arrow_schema
from slatewise.session import written

#: Most rows of a conversation that a task takes together.
PIECE_ROWS = 4096


def in_order(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) without nulls in role and text, with their place `at` in the order of the whole table and `piece`.

    Rows go by conversation, then turn (nulls first), then role, then the text's SHA-256; equal rows are alike. The sort
    is by ranges of the whole key, so neither a hot conversation nor a hot row lands in one task. Written once: places hold.
    """
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("_row")]
    keyed = turns.select("conv", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("_row"))
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("at", F.monotonically_increasing_id())
    return written(sorted_rows.withColumn("piece", F.expr(f"at div {PIECE_ROWS}")), "turns")


def join_piece(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows with what is known about their piece of their conversation (null conversations match)."""
    known = pieces.withColumnsRenamed({"conv": "_conv", "piece": "_piece"})
    return rows.join(known, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece"))).drop("_conv", "_piece")


def by_piece(rows: DataFrame, function: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What `function` makes of the rows of each piece of each conversation, in order; a piece has `PIECE_ROWS` rows at most."""
    sorted_rows = rows.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "at")
    return _streamed(sorted_rows, ("conv", "piece"), lambda: _Whole(function), schema)


def by_conversation(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """`make()` gives an object per conversation; `add(row)` takes its rows in order of `at`, `rows()` returns what it found.

    For short rows, or for what only one reader can compute, such as a digest: one task passes all rows of a conversation
    through such an object, without keeping them.
    """
    return _streamed(rows.repartition("conv").sortWithinPartitions("conv", "at"), ("conv",), make, schema)


class _Whole:
    def __init__(self, function):
        self.function, self.given = function, []

    def add(self, row: dict):
        self.given.append(row)

    def rows(self) -> list[tuple]:
        return self.function(self.given)


def _streamed(rows: DataFrame, keys: tuple[str, ...], make: Callable, schema: str) -> DataFrame:
    target = _arrow_schema(rows.sparkSession, schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, out = None, None, []
        for given in batches:
            for row in given.to_pylist():
                key = tuple(row[k] for k in keys)
                if group is None or key != known:
                    if group is not None:
                        out += group.rows()
                    if len(out) > 1000:
                        yield batch(out)
                        out = []
                    group, known = make(), key
                group.add(row)
        if group is not None:
            out += group.rows()
        yield batch(out)

    return rows.mapInArrow(run, schema)


