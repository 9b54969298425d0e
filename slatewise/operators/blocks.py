"""Square matrices over the movie catalogue as rows of tiles, multiplied and inverted by joins.

A tile is at most `tile` × `tile` numbers in one binary cell, so every task holds a few tiles whatever
the catalogue size; only a small catalogue fits in a single tile.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.session import release, settle, written

TILE = 2048
TILE_SCHEMA = "ti int, tj int, data binary"
#: Rows that a task counts or holds for its range of items, parts that ranges are made of, and pairs made at once.
RANGE_ROWS = 1 << 24
RANGE_PARTS = 4096
PAIRS = 1 << 22


def _size(block: int, n: int, tile: int) -> int:
    return min(tile, n - block * tile)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def cooccurrence(members: DataFrame, n: int, tile: int = TILE, both: bool = False) -> DataFrame:
    """(i, j, n) with i <= j: how many groups contain both items; members = (owner, idx), distinct. With `both`, (j, i) as well.

    An owner whose pairs are no more than its items times the rows of tiles is counted pair by pair; larger ones go through tiles.
    """
    blocks = -(-n // tile)
    mirrored = lambda upper: upper.select(
        F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("_p"), "n"
    ).select("_p.i", "_p.j", "n") if both else upper
    if blocks == 1:
        return mirrored(_in_one_tile(members, n))
    owners = written(members.where("owner is not null").groupBy("owner").agg(F.collect_list("idx").alias("items")), "owners")
    few = owners.where(F.size("items") < 2 * blocks).select("items")
    many = owners.where(F.size("items") >= 2 * blocks).select("owner", F.explode("items").alias("idx"))
    if many.isEmpty():
        return _by_ranges(few, n, both)
    return mirrored(_by_ranges(few, n, False).unionByName(_by_tiles(many, n, tile)).groupBy("i", "j").agg(F.sum("n").alias("n")))


def ranges(rows: DataFrame, item: Column, n: int, weight: Column) -> list[tuple[int, int]]:
    """Ranges (first, last + 1) of the items from 0 to n - 1, of about equal sums of `weight`: one for each core, and no more than `RANGE_ROWS` as far as
    parts of the items allow."""
    step = -(-n // RANGE_PARTS)
    sums = dict(rows.groupBy(F.floor(item / step).alias("part")).agg(F.sum(weight)).collect())
    share = max(1, min(RANGE_ROWS, -(-sum(sums.values()) // rows.sparkSession.sparkContext.defaultParallelism)))
    found, first, held = [], 0, 0
    for part in sorted(sums):
        if held and held + sums[part] > share:
            found.append((first, part * step))
            first, held = part * step, 0
        held += sums[part]
    return [*found, (first, n)]


def apart(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames of one partition, each of which stays a task: a union of frames that are partitioned alike would put them all into one."""
    # No rows, but nothing that an optimizer could tell from the filters that follow.
    none = frames[0].sparkSession.range(0, 1, 1, 2).where("id < 0").select(
        *[(F.col("id") * (place + 2)).cast(f.dataType).alias(f.name) for place, f in enumerate(frames[0].schema)])
    return reduce(DataFrame.unionByName, [none, *frames])


def _by_ranges(owners: DataFrame, n: int, both: bool) -> DataFrame:
    """The counts of `cooccurrence` pair by pair, from the items of each owner. Every task reads all owners and counts the pairs of its own range of
    items, so that no pairs are shuffled, and all pairs of an item come out in one place."""
    each = owners.select(F.explode("items").alias("i"), F.size("items").alias("_size"))
    counted = lambda first, last: lambda batches: _count_range(batches, first, last, n, both)
    return apart([owners.coalesce(1).mapInArrow(counted(*limits), "i int, j int, n long") for limits in ranges(each, F.col("i"), n, F.col("_size"))])


def _count_range(batches: Iterator[pa.RecordBatch], low: int, high: int, n: int, both: bool) -> Iterator[pa.RecordBatch]:
    keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merge() -> None:
        nonlocal keys, counts
        new, times = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        keys, counts = np.concatenate([keys, new]), np.concatenate([counts, times])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edges = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[edges], np.add.reduceat(counts, edges) if len(edges) else counts

    for batch in batches:
        items, sizes = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (batch.column(0).flatten(), batch.column(0).value_lengths()))
        starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        own = np.flatnonzero((items >= low) & (items < high))
        partners = sizes[row[own]]
        cuts = np.searchsorted(np.cumsum(partners), np.arange(0, partners.sum(), PAIRS))
        for first, last in zip(cuts, [*cuts[1:], len(own)], strict=True):
            one, size = own[first:last], partners[first:last]
            at = np.repeat(starts[row[one]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            i, j = np.repeat(items[one], size), items[at]
            key = (i - low) * n + j
            waiting.append(key if both else key[i <= j])
            if sum(map(len, waiting)) > max(PAIRS, len(keys)):
                merge()
    if waiting:
        merge()
    for first in range(0, len(keys), 1 << 20):
        some = slice(first, first + (1 << 20))
        yield pa.RecordBatch.from_arrays([pa.array((keys[some] // n + low).astype(np.int32)), pa.array((keys[some] % n).astype(np.int32)), pa.array(counts[some])],
                                         names=["i", "j", "n"])


def _in_one_tile(members: DataFrame, n: int) -> DataFrame:
    """The counts of `cooccurrence` for one tile: every task adds up whole owners, at most `n` items each, and only the sums are shuffled.

    Rows without an owner are owners of their own.
    """
    none = F.col("owner").isNull()
    known = members.select(none.alias("none"), F.coalesce("owner", F.lit(0).cast("bigint")).alias("owner"), "idx", F.when(none, F.col("idx")).alias("apart"))
    spread = known.repartition(tasks(members.sparkSession), "owner", "apart").sortWithinPartitions("owner").drop("apart")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n, n), np.int64)

        def add(owner: np.ndarray, items: np.ndarray):
            """Each row with itself, then with the row after it, the next one and so on, as long as the owner is the same."""
            np.add.at(sums, (items, items), 1)
            row, apart = np.arange(len(items)), 1
            while len(row):
                row = row[:np.searchsorted(row, len(items) - apart)]
                row = row[owner[row] == owner[row + apart]]
                one, other = items[row], items[row + apart]
                np.add.at(sums, (np.minimum(one, other), np.maximum(one, other)), 1)
                apart += 1

        owner, items = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            alone, idx = batch["none"].to_numpy(bool), batch["idx"].to_numpy()
            np.add.at(sums, (idx[alone], idx[alone]), 1)
            owner, items = np.concatenate([owner, batch["owner"].to_numpy()[~alone]]), np.concatenate([items, idx[~alone]])
            done = np.searchsorted(owner, owner[-1]) if len(owner) else 0
            add(owner[:done], items[:done])
            owner, items = owner[done:], items[done:]
        add(owner, items)
        i, j = np.nonzero(sums)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": sums[i, j]})

    return spread.mapInPandas(add_up, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def _by_tiles(members: DataFrame, n: int, tile: int) -> DataFrame:
    """The counts of `cooccurrence` from dense tiles.

    The Gram matrix of a 0/1 matrix, without a row per pair: every task adds the groups it receives
    into one dense tile at a time and emits only the tile's nonzero sums, which are summed once more.
    Groups are spread by a hash of their owner within each pair of tiles, so one owner with very many
    items costs one tile update of bounded size, and popular items are spread over all tasks.
    """
    spark = members.sparkSession
    blocks = -(-n // tile)
    pairs = blocks * (blocks + 1) // 2
    salts = max(1, -(-tasks(spark) // pairs))
    own = F.expr(f"idx div {tile}").cast("int")
    placed = members.select("owner", "idx", own.alias("_b"))
    if blocks > 1:
        placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        placed = placed.withColumn("_o", F.lit(0))
    keyed = placed.select("owner", "idx", F.least("_b", "_o").cast("int").alias("ti"),
                          F.greatest("_b", "_o").cast("int").alias("tj"),
                          F.pmod(F.xxhash64("owner"), F.lit(salts)).cast("int").alias("salt"))
    spread = keyed.repartition(max(tasks(spark), pairs), "ti", "tj", "salt").sortWithinPartitions(
        "ti", "tj", "owner").select("ti", "tj", "owner", "idx")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums, carry = None, None, None

        def emit():
            rows, columns = np.nonzero(sums)
            ti, tj = current
            i, j = rows + ti * tile, columns + tj * tile
            keep = i <= j
            return pd.DataFrame({"i": i[keep].astype("int32"), "j": j[keep].astype("int32"),
                                 "n": sums[rows, columns][keep].astype("int64")})

        def add(items: np.ndarray):
            ti, tj = current
            block = items // tile
            left, right = items[block == ti] % tile, items[block == tj] % tile
            if len(left) and len(right):
                sums[np.ix_(left, right)] += 1

        for batch in batches:
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            if batch.empty:
                continue
            owner = batch[["ti", "tj", "owner"]].to_numpy()
            edges = np.flatnonzero((owner[1:] != owner[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], edges])
            idx = batch["idx"].to_numpy()
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                where = (int(owner[start, 0]), int(owner[start, 1]))
                if where != current:
                    if current is not None:
                        yield emit()
                    current, sums = where, np.zeros((_size(where[0], n, tile), _size(where[1], n, tile)), np.int32)
                add(idx[start:stop])
            carry = batch.iloc[starts[-1]:]
        if carry is not None and len(carry):
            where = (int(carry["ti"].iloc[0]), int(carry["tj"].iloc[0]))
            if where != current:
                if current is not None:
                    yield emit()
                current, sums = where, np.zeros((_size(where[0], n, tile), _size(where[1], n, tile)), np.int32)
            add(carry["idx"].to_numpy())
            yield emit()

    partial = spread.mapInPandas(add_up, "i int, j int, n long")
    if salts == 1:  # every tile was summed by one task
        return partial
    return partial.groupBy("i", "j").agg(F.sum("n").alias("n"))


def to_tiles(entries: DataFrame, n: int, diagonal: float = 0.0, tile: int = TILE) -> DataFrame:
    """Upper-triangle (i, j, n) of a symmetric matrix to all its tiles, with `diagonal` added."""
    spark = entries.sparkSession
    blocks = -(-n // tile)
    corners = spark.range(blocks * blocks).select(
        (F.expr(f"id div {blocks}") * tile).cast("int").alias("i"), (F.col("id") % blocks * tile).cast("int").alias("j"),
        F.lit(0).cast("bigint").alias("n")).where("i <= j")
    rows = entries.select("i", "j", F.col("n").cast("bigint").alias("n")).unionByName(corners)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(key[0]), int(key[1])
        data = np.zeros((_size(ti, n, tile), _size(tj, n, tile)))
        np.add.at(data, (group["i"].to_numpy() % tile, group["j"].to_numpy() % tile), group["n"].to_numpy())
        if ti != tj:
            return pd.DataFrame({"ti": [ti, tj], "tj": [tj, ti], "data": [data.tobytes(), data.T.tobytes()]})
        data = data + np.triu(data, 1).T
        data[np.diag_indices_from(data)] += diagonal
        return pd.DataFrame({"ti": [ti], "tj": [tj], "data": [data.tobytes()]})

    return (rows.withColumns({"ti": F.expr(f"i div {tile}").cast("int"), "tj": F.expr(f"j div {tile}").cast("int")})
            .groupBy("ti", "tj").applyInPandas(pack, TILE_SCHEMA))


def _matrix(cell: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(cell).reshape(-1, columns)


def _map_tiles(df: DataFrame, compute, schema: str = TILE_SCHEMA) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"ti": [row.ti], "tj": [row.tj], "data": [compute(row).tobytes()]})
    return df.mapInPandas(run, schema)


def invert(tiles: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Inverse of a symmetric positive definite matrix by block Gauss-Jordan elimination.

    One round per diagonal tile: invert it, scale its row, and update every other tile from the
    matching tiles of the pivot row and column, found by equi-joins. The pivot's row and column are dealt anew, as the parts of a
    union would otherwise multiply from round to round. Rounds are cut by checkpoints; two are stored at a
    time, and a driver collection lets Spark delete the shuffle files of the round before.
    """
    blocks = -(-n // tile)
    width = lambda block: _size(int(block), n, tile)
    tiles = settle(tiles)
    for k in range(blocks):
        pivot = _map_tiles(tiles.where(f"ti = {k} and tj = {k}"),
                           lambda r: np.linalg.inv(_matrix(r.data, width(r.tj))))
        few = min(blocks, tasks(tiles.sparkSession))
        pivot = settle(pivot.repartition(1))
        unit = F.broadcast(pivot.select(F.col("data").alias("pivot")))  # one tile
        row = settle(_map_tiles(tiles.where(f"ti = {k} and tj <> {k}").crossJoin(unit),
                                lambda r: _matrix(r.pivot, width(r.ti)) @ _matrix(r.data, width(r.tj))).repartition(few, "tj"))
        column = tiles.where(f"tj = {k} and ti <> {k}")
        turned = _map_tiles(column.crossJoin(unit),
                            lambda r: -(_matrix(r.data, width(r.tj)) @ _matrix(r.pivot, width(r.tj)))).repartition(few, "ti")
        rest = (tiles.where(f"ti <> {k} and tj <> {k}")
                .join(row.select("tj", F.col("data").alias("across")), "tj")
                .join(column.select("ti", F.col("data").alias("down")), "ti"))
        updated = _map_tiles(rest, lambda r, k=k: _matrix(r.data, width(r.tj))
                             - _matrix(r.down, width(k)) @ _matrix(r.across, width(r.tj)))
        done = settle(pivot.unionByName(row).unionByName(turned).unionByName(updated))
        for old in (tiles, pivot, row):
            release(old)
        tiles = done
        del unit, row, column, turned, rest, updated, pivot, done, old
        gc.collect()
        tiles.sparkSession._jvm.System.gc()
    return tiles
