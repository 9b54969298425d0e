"""Hard negatives by the threshold algorithm over sorted lists of components.

Rows are dealt to shelves of bounded size. A shelf keeps, for each dimension, its rows in order of that component. An
anchor reads the list of a dimension from the top where its own component is positive and from the bottom where it is
negative, so each list comes in falling order of what it can add to the score. Rows met anywhere are scored in full
(random access, integers). The sum of what the lists offer at the depth reached, the threshold, bounds the score of
every row not met yet; a shelf is left as soon as the threshold is strictly below the k-th score of each open window,
or below a window's least score, so that ties by id can never be lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import written

#: Rows of a shelf and anchors of a block: what one task holds at once, whatever the table's size.
SHELF_ROWS = 8192
BLOCK_ANCHORS = 2048
FIRST_DEPTH = 16
#: Below these, sums of whole numbers are exact in single and double numbers.
EXACT32, EXACT = 1 << 24, 1 << 53


def usable(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """Rows that take part, as (row, id, label, vector), written once so that their row numbers hold."""
    given = vectors.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return written(given.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
                   .select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


class Shelf:
    """Rows of one shelf with a list per dimension, sorted by component."""

    def __init__(self, table: pa.Table, scale: int, width: int):
        self.rows, self.labels = (table.column(c).to_numpy() for c in ("row", "label"))
        ids = table.column("id")
        self.no_id = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.values = matrix(table.column("vector"), scale, width)
        self.order = np.ascontiguousarray(np.argsort(self.values, axis=0, kind="stable").T.astype(np.int32))
        self.most = float(np.abs(self.values).max(initial=0))
        self.single = self.whole = None

    def kept(self, most: float) -> np.ndarray:
        """The components as numbers in which sums up to `most` are exact: single, double or Python's own."""
        if most < EXACT32:
            self.single = self.values.astype(np.float32) if self.single is None else self.single
            return self.single
        if most < EXACT:
            return self.values
        if self.whole is None:
            self.whole = np.array([int(x) for x in self.values.ravel().tolist()], object).reshape(self.values.shape)
        return self.whole

    def __len__(self):
        return len(self.rows)


def matrix(column: pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as rows of `width` whole numbers; shorter vectors end in zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def search(shelf: Shelf, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[list[np.ndarray], int]:
    """Places of the first k allowed rows of each window (low <= score <= high), with scores, and how many rows were scored.

    Returns arrays of (place, score) rows per window. Higher scores come first, then smaller ids, rows without id last.
    """
    n, width = shelf.values.shape
    used = np.flatnonzero(anchor)
    weights = anchor[used]
    top = weights > 0
    most = max(1, width) * shelf.most * float(np.abs(anchor).max(initial=0))
    values, target, number = shelf.kept(most), anchor, np.int64
    if most < EXACT32:
        target = anchor.astype(np.float32)
    elif most >= EXACT:
        target, number = np.array([int(x) for x in anchor.tolist()], object), lambda x: [int(v) for v in x.tolist()]
    seen = np.zeros(n, bool)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, scored = 0, 0
    while scored < n:
        until = min(n, max(FIRST_DEPTH, 2 * depth))
        fresh = np.zeros(n, bool)
        if n - scored <= len(used) * (until - depth) or not len(used):
            fresh[:] = True  # the rows left are fewer than the entries that the lists' next stretch would read
            until = n
        else:
            for ahead, dims in ((True, used[top]), (False, used[~top])):
                lists = shelf.order[dims]
                fresh[(lists[:, n - until:n - depth] if ahead else lists[:, depth:until]).ravel()] = True
        fresh &= ~seen
        seen |= fresh
        depth, met = until, np.flatnonzero(fresh)
        scored += len(met)
        met = met[allowed[met]]
        places = np.concatenate([places, met])
        scores = np.concatenate([scores, np.array(number(values[met] @ target), np.int64)]) if len(met) else scores
        if scored == n:
            break
        at = np.where(top, shelf.order[used, n - depth], shelf.order[used, depth - 1])
        threshold = sum(int(shelf.values[a, d]) * int(anchor[d]) for a, d in zip(at, used, strict=True))
        if all(threshold < bound(scores, low, high, k) for low, high in windows):
            break
    out = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        if len(inside) > k:
            inside = inside[scores[inside] >= np.partition(scores[inside], len(inside) - k)[len(inside) - k]]
        found = places[inside]
        first = np.lexsort((shelf.ids[found], shelf.no_id[found], -scores[inside]))[:k]
        out.append((found[first], scores[inside][first]))
    return out, scored


def bound(scores: np.ndarray, low: float, high: float, k: int) -> float:
    """What a row not met yet would have to reach to matter in a window: its k-th score so far, or else its least score."""
    if low > high:
        return math.inf
    inside = scores[(scores >= low) & (scores <= high)]
    return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low


def _found(rows: DataFrame, anchors: DataFrame, function: Callable, schema: str, count: int, anchor_count: int, scale: int, width: int) -> DataFrame:
    """What `function(shelf, anchor values, anchor)` yields for every shelf of the rows and every block of the anchors.

    Rows are copied once for each block of anchors, anchors once for each shelf; both groups have bounded sizes, as their
    members are dealt by a hash of the row number, not of anything in the data.
    """
    shelves, blocks = -(-count // SHELF_ROWS), -(-anchor_count // BLOCK_ANCHORS)
    dealt = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    left = rows.select(dealt(shelves).alias("_shelf"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "*")
    right = anchors.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shelves - 1).cast("bigint"))).alias("_shelf"),
                           dealt(blocks).cast("int").alias("_block"), "*")
    from slatewise.llm.texts import _arrow_schema
    target = _arrow_schema(rows.sparkSession, schema)

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if some.num_rows and asked.num_rows:
            shelf, values = Shelf(some, scale, width), matrix(asked.column("vector"), scale, width)
            for i, anchor in enumerate(asked.drop_columns(["vector"]).to_pylist()):
                out += function(shelf, values[i], anchor)
        columns = zip(*out, strict=True) if out else [[] for _ in target]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return left.groupBy("_shelf", "_block").cogroup(right.groupBy("_shelf", "_block")).applyInArrow(run, schema)


def _firsts(found: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(key), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", anchor: Column | None = None,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor and positive the best rows of another label whose score is `low` to `high` percent of the positive's.

    Components count as floor(scale * x), scores are integer inner products, higher first, ties by smaller id, then ids
    that are null. `anchor` says on the columns `id` and `label` which rows are anchors (all with an id by default).

    Rows with a null label, a null vector or any null or non-finite component take no part. Rows with a null id can be found
    but are no anchors. Repeated rows are rows of their own: each can be anchor, positive and negative. Shorter vectors
    count as ending in zeros, an empty one scores 0. Scores beyond 64 bits raise an error. An anchor without another row of its label, or a positive with an
    empty window, gives no rows; an empty table gives none. Other columns are not read.
    """
    rows = usable(vectors, key, vector, F.col(label) if isinstance(label, str) else label)
    asked = rows.filter(F.col("id").isNotNull() & (F.lit(True) if anchor is None else anchor))
    count, width, anchor_count = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count_if(
        F.col("id").isNotNull() & (F.lit(True) if anchor is None else anchor))).first()
    if not anchor_count:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def same(shelf, values, one):
        allowed = (shelf.labels == one["label"]) & (shelf.rows != one["row"])
        (places, scores), = search(shelf, values, allowed, [(-math.inf, math.inf)], positives)[0]
        ids = shelf.ids[places].tolist()
        return [(one["row"], int(shelf.rows[p]), None if shelf.no_id[p] else i, s) for p, i, s in zip(places, ids, scores.tolist(), strict=True)]

    found = _found(rows, asked, same, "anchor bigint, row bigint, id bigint, score bigint", count, anchor_count, scale, width)
    best = _firsts(found, ["anchor"], "score", "id", positives)
    paired = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("id").alias("positive"), "score"))).alias("positives"))
    asked = written(asked.join(paired, asked["row"] == paired["anchor"]).drop("anchor"), "anchors")

    def other(shelf, values, one):
        chosen = one["positives"]
        windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in chosen]
        out, _ = search(shelf, values, shelf.labels != one["label"], windows, negatives)
        for p, (places, scores) in zip(chosen, out, strict=True):
            for place, s in zip(places.tolist(), scores.tolist(), strict=True):
                yield (one["row"], p["place"], one["id"], p["positive"], p["score"], int(shelf.rows[place]),
                       None if shelf.no_id[place] else int(shelf.ids[place]), s)

    schema = ("anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint, row bigint, negative_id bigint, "
              "negative_score bigint")
    found = _found(rows, asked, other, schema, count, anchor_count, scale, width)
    return _firsts(found, ["anchor", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
