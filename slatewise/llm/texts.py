"""Shared plumbing: whole texts in bounded slices of Arrow batches, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A given table, read by Spark (the path may be in a store only Spark can open)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `limit` bytes of text (a longer text is a run of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = used = 0
    for i, size in enumerate(sizes):
        if i > start and used + size > limit:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, function: Callable[[list[str], pa.RecordBatch], list], schema: str,
              keep: tuple[str, ...] = (), limit: int = SLICE_BYTES) -> DataFrame:
    """Columns `keep` of `df` followed by what `function(texts, rows)` returns as columns; null texts arrive as ''.

    `schema` is the schema of the new columns. Only `keep` and `text` leave the scan.
    """
    narrow = df.select(*dict.fromkeys([*keep, text]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) if keep else ""
    full = ", ".join(x for x in (kept, schema) if x)
    target = _arrow_schema(df.sparkSession, full)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                texts = [t or "" for t in part.column(text).to_pylist()]
                columns = [part.column(c) for c in keep] + list(function(texts, part))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target, strict=True)],
                    schema=target)

    return narrow.mapInArrow(run, full)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))
