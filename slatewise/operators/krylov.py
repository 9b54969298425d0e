"""Columns of (G + λI)^-1 for a sparse Gram matrix G = XᵀX, without G and without a dense inverse.

Columns are independent: a task takes some of them, holds the likes X in padded rows and runs conjugate gradients on a
block of unit vectors. The systems of all λ share one Krylov space (their matrices differ by a multiple of the unit
matrix), so one run with the smallest λ serves every λ of a grid; the others only cost vector updates and converge sooner.

Each task needs all likes, so callers check their number first (`LIKES`) and use the dense tiles of `blocks` beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most likes that a task holds: 8 bytes each.
LIKES = 16_000_000
#: Likes in a chunk on its way to the tasks.
CHUNK = 1 << 18
#: Numbers in one vector block of a task, from which the columns of a block follow.
BLOCK_NUMBERS = 1 << 20
#: Residual aimed at, relative error of one pass, and its most steps; products are in single numbers, which a pass cannot get below.
GOAL, PASS = 1e-9, 1e-5
ROUNDS, PASSES = 2_000, 8
MOST_COLUMNS = 16
SCHEMA = "panel int, place int, data binary, residual double"
LONGEST = 64
#: Rows of a block that are read together.
STRETCH = 1 << 14


class Rows:
    """Sums of the rows of a block of vectors over padded lists of indices, longest list first.

    The block is read in stretches of about `STRETCH` rows, which stay in a core's cache, unless that leaves an owner less than four
    indices of a stretch. Lists longer than `LONGEST` are cut, and their parts added up at the end.
    """

    def __init__(self, owner: np.ndarray, index: np.ndarray, owners: int):
        self.owners = owners
        rows = int(index.max(initial=0)) + 1
        stretches = max(1, min(-(-rows // STRETCH), len(owner) // max(1, 4 * owners)))
        stretch = index // -(-rows // stretches)
        order = np.argsort((stretch * owners + owner) * rows + index)
        owner, index = owner[order], index[order]
        ends = np.searchsorted(stretch[order], np.arange(stretches + 1))
        self.parts = [self._lists(owner[i:j], index[i:j]) for i, j in pairwise(ends) if i < j]
        self.most, self.rooms = max((len(lists[0]) for lists, *_ in self.parts), default=0), {}

    def _lists(self, owner: np.ndarray, index: np.ndarray) -> tuple:
        """Lists of one stretch, the place of each owner's first part (behind all parts if there is none), and the other parts with their owners."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        cut = np.flatnonzero(place % LONGEST == 0)
        sizes = np.diff(np.append(cut, len(owner)))
        order = np.argsort(-sizes, kind="stable")
        sizes, cut = sizes[order], cut[order]
        lists = [index[cut[: int((sizes > k).sum())] + k] for k in range(int(sizes.max()))]
        names, first = np.unique(owner[cut], return_index=True)
        places = np.full(self.owners, len(cut))
        places[names] = first
        rest = np.delete(np.arange(len(cut)), first)
        return lists, places, rest, owner[cut[rest]]

    def sums(self, block: np.ndarray, dtype: np.dtype | None = None) -> np.ndarray:
        """One row for each owner, in the precision of `block` or a higher one."""
        width, dtype = block.shape[1], block.dtype if dtype is None else dtype
        out, kind = np.zeros((self.owners, width), dtype), (width, dtype, block.dtype)
        if kind not in self.rooms:
            self.rooms[kind] = [np.empty((rows, width), t) for rows, t in ((self.owners, dtype), (self.most + 1, dtype), (self.most, block.dtype))]
        each, found, room = self.rooms[kind]

        def taken(rows: np.ndarray) -> np.ndarray:
            if not block.flags.c_contiguous:
                return block[rows]
            return np.take(block, rows, axis=0, out=room[:len(rows)], mode="clip")

        for lists, places, rest, owner in self.parts:
            found[:len(lists[0])], found[len(lists[0])] = taken(lists[0]), 0
            for rows in lists[1:]:
                found[:len(rows)] += taken(rows)
            out += np.take(found, places, axis=0, out=each, mode="clip")
            np.add.at(out, owner, found[rest])
        return out

    def added(self, block: np.ndarray) -> np.ndarray:
        """The sums in double numbers, a stretch of columns at a time, whatever the precision of `block`."""
        out = np.zeros((self.owners, block.shape[1]))
        for first in range(0, block.shape[1], 256):
            out[:, first:first + 256] = self.sums(block[:, first:first + 256], np.float64)
        return out


class Likes:
    """X as index lists by user and by movie; applies G = XᵀX."""

    def __init__(self, users: np.ndarray, movies: np.ndarray, n: int):
        users = np.unique(users, return_inverse=True)[1] if len(users) else users
        count = int(users.max(initial=-1)) + 1
        self.by_user, self.by_movie = Rows(users, movies, count), Rows(movies, users, n)

    def gram(self, block: np.ndarray) -> np.ndarray:
        return self.by_movie.sums(self.by_user.sums(block))


def solve(apply, targets: np.ndarray, shifts: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(solution, largest residual by column) of (A + shift) x = targets for every shift, smallest first; A is `apply`.

    One pass for all shifts, in single numbers; then the residuals in double numbers, and passes for what is
    left of each shift until `GOAL` is reached.
    """
    out = []
    for x, shift in zip(_pass(apply, targets, shifts, PASS), shifts, strict=True):
        x = x.astype(np.float64)
        for _ in range(PASSES):
            left = targets - apply(x) - shift * x
            if np.abs(left).max() <= GOAL:
                break
            size = np.abs(left).max(0)
            scale = np.where(size > 0, size, 1.0)
            x += scale * _pass(apply, left / scale, [shift], max(PASS, min(0.1, GOAL / size.max() / 4)))[0]
        out.append((x, np.abs(left).max(0)))
    return out


def _pass(apply, targets: np.ndarray, shifts: Sequence[float], tolerance: float) -> list[np.ndarray]:
    """Conjugate gradients for all shifts in the Krylov space of the smallest one; vectors are single numbers, worked on in stretches of rows."""
    base, extra = shifts[0], [s - shifts[0] for s in shifts]
    single = lambda numbers: np.asarray(numbers, np.float32)
    stretches = [slice(first, first + STRETCH) for first in range(0, len(targets), STRETCH)]
    dot = lambda a, b: np.einsum("ij,ij->j", a, b).astype(np.float64)
    left = single(targets)
    found = [np.zeros_like(left) for _ in shifts]
    steps = [left.copy() for _ in shifts]
    norm = (targets * targets).sum(0)
    goal, before = norm * tolerance ** 2, np.ones(targets.shape[1])
    now = [np.ones(targets.shape[1]) for _ in shifts]
    last = [np.ones(targets.shape[1]) for _ in shifts]
    ratio, length = np.zeros(targets.shape[1]), norm.copy()
    for _ in range(ROUNDS):
        active = length > goal
        if not active.any():
            break
        moved, product, size = apply(steps[0]), 0.0, 0.0
        for s in stretches:
            moved[s] += base * steps[0][s]
            product = product + dot(steps[0][s], moved[s])
        with np.errstate(divide="ignore", invalid="ignore"):
            pace = np.where(active, length / product, 0.0)
            for s in stretches:
                left[s] -= single(pace) * moved[s]
                size = size + dot(left[s], left[s])
            share = np.where(active, size / length, 0.0)
            for i, shift in enumerate(extra):
                if i:
                    after = now[i] * last[i] * before / (pace * ratio * (last[i] - now[i]) + last[i] * before * (1 + shift * pace))
                    after = np.where(active & np.isfinite(after), after, 0.0)
                    gain = np.where(now[i] > 0, after / now[i], 0.0)
                else:
                    after, gain = np.ones_like(pace), np.ones_like(pace)
                for s in stretches:
                    found[i][s] += single(pace * gain) * steps[i][s]
                    steps[i][s] *= single(share * gain * gain)
                    steps[i][s] += single(after) * left[s]
                last[i], now[i] = now[i], after
        length = np.where(active, size, length)
        before, ratio = np.where(active, pace, before), share
    return found


def columns_of_a_block(n: int) -> int:
    return int(min(max(BLOCK_NUMBERS // n, 4), MOST_COLUMNS, n))


#: What a task of `solve_panels` reads: likes, then whatever its consumer asked for, then the panels to solve.
DEALT = {"task": "int", "kind": "int", "place": "int", "owners": "array<bigint>", "items": "array<int>", "flags": "array<boolean>",
         "numbers": "array<array<double>>"}
LIKED, ASKED = 0, 9


class Stored:
    """Keeps the weights of each panel as one row of `SCHEMA`."""

    def given(self, row) -> None:
        raise ValueError("Panels are stored without further rows")

    def panel(self, panel: int, place: int, weights: np.ndarray, residual: float) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"panel": [panel], "place": [place], "data": [weights.tobytes()], "residual": [residual]})

    def ended(self) -> Iterator[pd.DataFrame]:
        return iter(())


def in_chunks(rows: DataFrame, by: str, *columns: Column) -> DataFrame:
    """Rows gathered into chunks of about `CHUNK`, by a hash of `by`: (place, one array for each column)."""
    chunks = max(1, -(-rows.count() // CHUNK))
    place = F.pmod(F.xxhash64(by), F.lit(chunks)).cast("int").alias("place")
    names = [f"_{i}" for i in range(len(columns))]
    gathered = rows.select(place, F.struct(*[c.alias(n) for c, n in zip(columns, names)]).alias("_r")).groupBy("place").agg(F.collect_list("_r").alias("_r"))
    return gathered.select("place", *[F.col(f"_r.{n}").alias(n) for n in names])


def weight_panels(members: DataFrame, n: int, regularizations: Sequence[float]) -> DataFrame:
    """(panel, place, data, residual): for each λ (its place) the weights -P[:, j] / P[j, j], diagonal 0, of a panel's columns.

    members: (owner, idx), distinct, idx from 0 to n - 1. `data` is float32, n rows by the panel's columns. A row's residual is the
    largest entry of |(G + λI) x - e| that its columns leave, computed anew from the solution.
    """
    return solve_panels(members, n, regularizations, Stored, SCHEMA)


def solve_panels(members: DataFrame, n: int, regularizations: Sequence[float], consumer: Callable, schema: str, more: Sequence[DataFrame] = ()) -> DataFrame:
    """Solves all columns and hands the weights of each panel to the task's `consumer()` where they are made, so that only what it yields
    leaves the task: n × n weights need not be stored nor moved.

    more: tables with a `kind` from 1 to 8 and columns of `DEALT`, whose rows every task passes to `consumer().given` before its first panel.
    """
    spark = members.sparkSession
    order = sorted(range(len(regularizations)), key=lambda i: regularizations[i])
    shifts = [float(regularizations[i]) for i in order]
    width = columns_of_a_block(n)
    panels = -(-n // width)
    tasks = min(panels, spark.sparkContext.defaultParallelism * 2)  # each task gets all likes, so no more than keep the cores busy
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    likes = in_chunks(members, "owner", F.col("owner"), F.col("idx")).withColumnsRenamed({"_0": "owners", "_1": "items"}).withColumn("kind", F.lit(LIKED))
    asked = spark.range(panels).select((F.col("id") % tasks).cast("int").alias("task"), F.lit(ASKED).alias("kind"), F.col("id").cast("int").alias("place"))
    same = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in DEALT.items()])
    dealt = reduce(DataFrame.unionByName, [same(df.select("*", every)) for df in (likes, *more)] + [same(asked)])

    def solved(likes: Likes, panel: int) -> Iterator[tuple[int, np.ndarray, float]]:
        columns = np.arange(panel * width, min(n, (panel + 1) * width))
        own = columns, np.arange(len(columns))
        targets = np.zeros((n, len(columns)))
        targets[own] = 1.0
        for i, (x, residual) in zip(order, solve(likes.gram, targets, shifts), strict=True):
            if not residual.max() < 1e-5:
                raise ArithmeticError(f"Columns of panel {panel} do not settle in {ROUNDS} rounds; use the tiles (likes_limit=0)")
            weights = -x / x[own]
            weights[own] = 0.0
            yield i, weights.astype(np.float32), residual.max()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = use = likes = None
        owners, items = [], []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.task != task:
                    if use is not None:
                        yield from use.ended()
                    task, use, likes, owners, items = row.task, consumer(), None, [], []
                if row.kind == LIKED:
                    owners.append(np.asarray(row.owners, np.int64))
                    items.append(np.asarray(row.items, np.int64))
                elif row.kind != ASKED:
                    use.given(row)
                else:
                    if likes is None:
                        none = np.zeros(0, np.int64)
                        likes = Likes(np.concatenate([none, *owners]), np.concatenate([none, *items]), n)
                        owners, items = [], []
                    for place, weights, residual in solved(likes, row.place):
                        yield from use.panel(row.place, place, weights, residual)
        if use is not None:
            yield from use.ended()

    return dealt.repartitionByRange(tasks, "task").sortWithinPartitions("task", "kind", "place").mapInPandas(run, schema)
