"""EASE: a closed-form linear item-item model, fitted, scored and stored as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.functions import formats as fmt
from slatewise.functions.scalars import positive
from slatewise.operators import blocks, krylov
from slatewise.operators.interactions import popular_unseen
from slatewise.operators.quality import DataError
from slatewise.operators.ranks import numbered
from slatewise.session import settle, written

# Users scored together, and the weights that a scoring task holds while users pass by.
USERS_PER_BLOCK = 512
WEIGHT_BYTES = 128 << 20
#: Weights that are stored; larger models are solved again where their weights are used, column by column, and keep only what is made of them.
STORED_BYTES = 256 << 20


@dataclass(frozen=True)
class EaseModel:
    """movies: (movie_id, title, idx, likes, popularity), idx null without likes.

    panels: (panel, data, residual), float32 weights of `width` target movies from all `size` movies, source by source.
    source: what the panels are solved from where they are used, None if they are stored.
    """

    movies: DataFrame
    panels: DataFrame
    histories: DataFrame
    size: int
    width: int
    regularization: float
    min_rating: int
    source: Training | None = None

    @property
    def spark(self) -> SparkSession:
        return self.movies.sparkSession

    @property
    def supported(self) -> DataFrame:
        return self.movies.where("popularity > 0")


def _check(regularization: float, min_rating: int) -> None:
    if not math.isfinite(regularization) or regularization <= 0:
        raise ValueError("λ has to be finite and above zero")
    if not fmt.MIN_RATING <= min_rating <= fmt.MAX_RATING:
        raise ValueError("The like threshold is a rating from 1 to 10")


@dataclass(frozen=True)
class Training:
    """Liked movies with their numbers, usable for every regularization. members: (owner, idx)."""

    movies: DataFrame
    members: DataFrame
    histories: DataFrame
    size: int
    likes: int
    min_rating: int


def prepare(pairs: DataFrame, movies: DataFrame, min_rating: int = fmt.DEFAULT_POSITIVE_RATING) -> Training:
    """Number the liked movies in order of their ids. Movies nobody liked have zero weights."""
    _check(1.0, min_rating)
    check_training(pairs, movies)
    liked = positive(F.col("rating"), F.col("watch_count"), min_rating)
    histories = written(pairs.select("user_id", "movie_id", liked.alias("liked")), "histories")
    users = histories.agg(F.countDistinct("user_id").alias("users"))
    likes = histories.where("liked").groupBy("movie_id").agg(F.count(F.lit(1)).alias("likes"))
    index = numbered(likes, [F.col("movie_id")], "idx").withColumn("idx", F.col("idx").cast("int"))
    known = (movies.select("movie_id", "title").join(index, "movie_id", "left").crossJoin(F.broadcast(users))
             .select("movie_id", "title", "idx", F.coalesce("likes", F.lit(0)).alias("likes"),
                     (F.coalesce("likes", F.lit(0)) / F.col("users")).alias("popularity")))
    known = written(known, "movies")
    size, total = known.where("idx is not null").agg(F.count("*"), F.sum("likes")).first()
    if not size:
        raise DataError("Nobody likes any movie of the catalogue, so there is nothing to fit")
    members = (histories.where("liked").join(known.where("idx is not null").select("movie_id", "idx"), "movie_id")
               .select(F.col("user_id").alias("owner"), "idx"))
    return Training(known, members, histories, size, total, min_rating)


def check_training(pairs: DataFrame, movies: DataFrame) -> None:
    """One row per pair and movie, and no pair outside the catalogue."""
    if pairs.groupBy("user_id", "movie_id").count().where("count > 1").limit(1).count():
        raise DataError("A user and movie occur in several training rows")
    if movies.groupBy("movie_id").count().where("count > 1").limit(1).count():
        raise DataError("A movie is listed more than once")
    if pairs.select("movie_id").distinct().join(movies, "movie_id", "left_anti").limit(1).count():
        raise DataError("Some training rows name movies that the catalogue lacks")


def solve(training: Training, regularizations: Sequence[float], likes_limit: int = krylov.LIKES, tile: int = blocks.TILE) -> list[EaseModel]:
    """A model for each λ: weights W[i, j] = -P[i, j] / P[j, j] with P = (G + λI)^-1 and a zero diagonal.

    Up to `likes_limit` likes, which every task then holds, columns are solved on their own and all λ in one run; beyond, the dense inverse
    is made tile by tile, once for each λ. A Gram matrix of one tile with fewer numbers than there are likes is counted, and inverted where it lies. Weights beyond `STORED_BYTES` are not stored: they grow with the square of the movies.
    """
    for regularization in regularizations:
        _check(regularization, training.min_rating)
    n, width = training.size, krylov.columns_of_a_block(training.size)
    if n <= tile and n * n < training.likes:
        one = F.coalesce("owner", F.lit(-(1 << 63)).cast("bigint")).alias("owner")  # pairs without a user count as one user's, as in `krylov`
        counts = settle(blocks.cooccurrence(training.members.select(one, "idx"), n, tile))
        solved = written(_tile_panels(counts, n, regularizations, width), "weights")
        panels = [solved.where(F.col("place") == i).drop("place") for i in range(len(regularizations))]
    elif training.likes <= likes_limit and 4 * n * n * len(regularizations) > STORED_BYTES:
        return [EaseModel(training.movies, krylov.weight_panels(training.members, n, [regularization]).drop("place"), training.histories, n, width,
                          regularization, training.min_rating, training) for regularization in regularizations]
    elif training.likes <= likes_limit:
        solved = written(krylov.weight_panels(training.members, n, regularizations), "weights")
        panels = [solved.where(F.col("place") == i).drop("place") for i in range(len(regularizations))]
    else:
        counts = settle(blocks.cooccurrence(training.members, n, tile))
        panels = [written(_dense_panels(counts, n, regularization, tile, width), "weights") for regularization in regularizations]
    return [EaseModel(training.movies, found, training.histories, n, width, regularization, training.min_rating)
            for found, regularization in zip(panels, regularizations, strict=True)]


def _tile_panels(counts: DataFrame, n: int, regularizations: Sequence[float], width: int) -> DataFrame:
    """Weight panels for each λ (its place) of a model whose Gram matrix is one tile."""
    shifts = [float(r) for r in regularizations]

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                gram = np.frombuffer(row.data).reshape(n, n)
                for place, shift in enumerate(shifts):
                    matrix = gram + shift * np.eye(n)
                    x = np.linalg.inv(matrix)
                    residual = np.abs(matrix @ x - np.eye(n)).max(0)
                    x = -x / np.diagonal(x)
                    np.fill_diagonal(x, 0.0)
                    for first in range(0, n, width):
                        yield pd.DataFrame({"panel": [first // width], "place": [place], "data": [x[:, first:first + width].astype(np.float32).tobytes()],
                                            "residual": [residual[first:first + width].max()]})

    return blocks.to_tiles(counts, n, 0.0, n).mapInPandas(solved, krylov.SCHEMA)


def _dense_panels(counts: DataFrame, n: int, regularization: float, tile: int, width: int) -> DataFrame:
    """Weight panels from the tiles of the inverse: each tile is cut into strips, and the strips of a panel put together.

    A task then holds the columns of some panels while the tiles of the Gram matrix pass by, and computes what they leave of (G + λI) x - e.
    """
    inverse = blocks.invert(blocks.to_tiles(counts, n, regularization, tile), n, tile)
    columns = lambda block: min(tile, n - int(block) * tile)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                part = np.frombuffer(row.data).reshape(-1, columns(row.tj))
                first = row.tj * tile
                for panel in range(first // width, (first + part.shape[1] - 1) // width + 1):
                    low, high = max(panel * width, first), min((panel + 1) * width, first + part.shape[1])
                    yield pd.DataFrame({"panel": [panel], "ti": [row.ti], "low": [low], "high": [high],
                                        "data": [np.ascontiguousarray(part[:, low - first:high - first]).tobytes()]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        panel = int(group["panel"].iloc[0])
        first, last = panel * width, min(n, (panel + 1) * width)
        x = np.zeros((n, last - first))
        for row in group.itertuples(index=False):
            part = np.frombuffer(row.data).reshape(-1, row.high - row.low)
            x[row.ti * tile:row.ti * tile + len(part), row.low - first:row.high - first] = part
        return pd.DataFrame({"place": [panel], "data": [x.tobytes()]})

    def solved(panels: list[tuple[int, np.ndarray]], left: np.ndarray) -> Iterator[pd.DataFrame]:
        for (panel, x), rest in zip(panels, np.split(np.abs(left), np.cumsum([x.shape[1] for _, x in panels])[:-1], 1), strict=True):
            own = np.arange(panel * width, panel * width + x.shape[1]), np.arange(x.shape[1])
            weights = -x / x[own]
            weights[own] = 0.0
            yield pd.DataFrame({"panel": [panel], "data": [weights.astype(np.float32).tobytes()], "residual": [rest.max()]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, panels, x, left = None, [], None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part != part:
                    if panels:
                        yield from solved(panels, left)
                    part, panels, x, left = row.part, [], None, None
                if row.kind == 0:
                    panels.append((row.place, np.frombuffer(row.data).reshape(n, -1)))
                    continue
                if x is None:
                    x = np.hstack([some for _, some in panels])
                    left = regularization * x
                    left[np.concatenate([np.arange(k * width, k * width + some.shape[1]) for k, some in panels]), np.arange(x.shape[1])] -= 1.0
                gram = np.frombuffer(row.data).reshape(-1, columns(row.place % size))
                rows, across = (slice(k * tile, k * tile + m) for k, m in zip((row.place // size, row.place % size), gram.shape, strict=True))
                left[rows] += gram @ x[across]
                if rows != across:
                    left[across] += gram.T @ x[rows]
        if panels:
            yield from solved(panels, left)

    found = inverse.mapInPandas(cut, "panel int, ti int, low int, high int, data binary").groupBy("panel").applyInPandas(join, "place int, data binary")
    size, panels, parallel = -(-n // tile), -(-n // width), counts.sparkSession.sparkContext.defaultParallelism
    together = max(1, min(WEIGHT_BYTES // (8 * n * width), -(-panels // parallel)))
    parts = -(-panels // together)
    gram = blocks.to_tiles(counts, n, 0.0, tile).where("ti <= tj").select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), (F.col("ti") * size + F.col("tj")).alias("place"), "data")
    dealt = found.select(F.expr(f"place div {together}").cast("int").alias("part"), F.lit(0).alias("kind"), "place", "data").unionByName(gram)
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "kind", "place").mapInPandas(check, "panel int, data binary, residual double")


def fit(pairs: DataFrame, movies: DataFrame, regularization: float = fmt.DEFAULT_REGULARIZATION,
        min_rating: int = fmt.DEFAULT_POSITIVE_RATING, likes_limit: int = krylov.LIKES, tile: int = blocks.TILE) -> EaseModel:
    """Fit on interactions (user, movie, rating, watch_count) of catalogue movies."""
    _check(regularization, min_rating)
    return solve(prepare(pairs, movies, min_rating), [regularization], likes_limit, tile)[0]


def _panel(row, n: int) -> np.ndarray:
    return np.frombuffer(row.data, np.float32).reshape(n, -1)


def weights(model: EaseModel) -> DataFrame:
    """Long form (src, dst, weight) of all nonzero weights; a catalogue has movies × movies of them."""
    n, width = model.size, model.width

    def open_panels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = _panel(row, n)
                i, j = np.nonzero(data)
                yield pd.DataFrame({"src": i.astype("int32"), "dst": (j + row.panel * width).astype("int32"), "weight": data[i, j]})

    flat = model.panels.select("panel", "data").mapInPandas(open_panels, "src int, dst int, weight float")
    names = model.movies.where("idx is not null").select("movie_id", "idx")
    return (flat.join(names.select(F.col("movie_id").alias("src_movie"), F.col("idx").alias("src")), "src")
            .join(names.select(F.col("movie_id").alias("dst_movie"), F.col("idx").alias("dst")), "dst")
            .select("src_movie", "dst_movie", "weight"))


SUMMARY_SCHEMA = "idx int, weights long, lowest double, highest double, total double, finite boolean"


def _summary(first: int, panel: np.ndarray) -> pd.DataFrame:
    data = panel.astype(np.float64)
    some = data != 0
    return pd.DataFrame({"idx": (np.arange(data.shape[1]) + first).astype("int32"), "weights": some.sum(0),
                         "lowest": np.where(some, data, np.inf).min(0), "highest": np.where(some, data, -np.inf).max(0),
                         "total": data.sum(0), "finite": np.isfinite(data).all(0)})


class _Summaries(krylov.Stored):
    """Summaries of the columns in place of their weights."""

    def __init__(self, width: int):
        self.width = width

    def panel(self, panel: int, place: int, weights: np.ndarray, residual: float) -> Iterator[pd.DataFrame]:
        yield _summary(panel * self.width, weights)


def weight_summary(model: EaseModel) -> DataFrame:
    """Per target movie: weights (nonzero ones), lowest, highest and total weight, and whether all are finite."""
    n, width = model.size, model.width

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _summary(row.panel * width, _panel(row, n))

    if model.source is None:
        found = model.panels.select("panel", "data").mapInPandas(summed, SUMMARY_SCHEMA)
    else:
        found = krylov.solve_panels(model.source.members, n, [model.regularization], lambda: _Summaries(width), SUMMARY_SCHEMA)
    some = lambda c: F.when(F.col("weights") > 0, F.col(c)).alias(c)
    return found.join(model.movies.where("idx is not null").select("movie_id", "idx"), "idx").select(
        "movie_id", "weights", some("lowest"), some("highest"), "total", "finite")


def score_users(liked: DataFrame, weight_rows: DataFrame, best: tuple[int, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(user, movie, score): weight rows of the liked movies added up, as join and aggregation.

    best: (k, seen, places), to get only the k highest scores of each user among movies in places: (movie, place) that are not in seen: (user, movie), the
    smaller place first where scores are equal. Movies are then numbers from 0, and a task holds the weights of a range of target movies while users
    pass by, so no sums by user and movie leave it.
    """
    if best is not None:
        return _best_scores(liked, weight_rows, *best)
    rows = weight_rows.select(F.col("src_movie").alias("movie_id"), "dst_movie", "weight")
    return (liked.select("user_id", "movie_id").join(rows, "movie_id")
            .groupBy("user_id", F.col("dst_movie").alias("movie_id"))
            .agg(F.sum(F.col("weight").cast("double")).alias("score")))


HELD, ASKING = range(2)


def _best_scores(liked: DataFrame, weight_rows: DataFrame, k: int, seen: DataFrame, places: DataFrame) -> DataFrame:
    items = lambda rows, name: rows.groupBy("user_id").agg(F.collect_list(F.col("movie_id").cast("int")).alias(name))
    placed = places.select(F.col("movie_id").alias("dst_movie"), F.col("place").cast("bigint").alias("place"))
    rows = written(weight_rows.select(F.col("src_movie").cast("int").alias("src"), F.col("dst_movie").cast("int").alias("dst"), F.col("weight").cast("double").alias("weight")), "weights")
    placed = written(placed.select(F.col("dst_movie").cast("int").alias("dst"), "place"), "places")
    users = written(items(liked, "liked").join(items(seen, "seen"), "user_id", "left").select("user_id", "liked", F.coalesce("seen", F.array().cast("array<int>")).alias("seen")), "liked-seen")
    n = rows.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
    if n is None:
        return rows.select(F.lit(None).cast(liked.schema["user_id"].dataType).alias("user_id"), F.col("dst").alias("movie_id"), F.col("weight").alias("score")).limit(0)
    # Empty lists where there is nothing: Arrow's writer passes over all null lists of a batch again for each row.
    same = lambda df, kind: df.coalesce(1).select(F.lit(kind).alias("kind"), *[
        F.col(c) if c in df.columns else (F.array() if t == "array<int>" else F.lit(None)).cast(t).alias(c) for c, t in (
            ("src", "int"), ("dst", "int"), ("weight", "double"), ("place", "bigint"), ("user_id", liked.schema["user_id"].dataType.simpleString()),
            ("liked", "array<int>"), ("seen", "array<int>"))])
    found = []
    for low, high in blocks.ranges(rows, F.col("dst"), n + 1, F.lit(1)):
        own = lambda df: df.where(F.col("dst").between(low, high - 1))
        parts = (same(own(rows), HELD), same(own(placed), HELD), same(users, ASKING))
        found.append(reduce(DataFrame.unionByName, parts).coalesce(1).mapInArrow(
            (lambda low, high: lambda batches: _best_of_range(batches, low, high, n + 1, k))(low, high),
            f"user_id {liked.schema['user_id'].dataType.simpleString()}, movie_id int, score double"))
    return blocks.apart(found)


def _best_of_range(batches: Iterator[pa.RecordBatch], low: int, high: int, n: int, k: int) -> Iterator[pa.RecordBatch]:
    """The weights and places of a range each come in one piece; users that come before both are kept until the end."""
    place, held, early, held_range = np.full(high - low, -1), [], [], None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        given, asking = batch.filter(pa.array(kind == HELD)), batch.filter(pa.array(kind == ASKING))
        if given.num_rows:
            if held_range is not None:
                raise RuntimeError("Weights of a range came between its users")
            target, is_place = given.column("dst").to_numpy().astype(np.int64) - low, np.asarray(given.column("place").is_valid())
            place[target[is_place]] = given.column("place").drop_null().to_numpy()
            given = given.filter(pa.array(~is_place))
            held.append((given.column("src").to_numpy().astype(np.int64), target[~is_place], given.column("weight").to_numpy()))
        if asking.num_rows and held_range is None and any(len(w) for _, _, w in held) and (place >= 0).any():
            held_range = _Range(low, n, place, *(np.concatenate(x) for x in zip(*held, strict=True)))
        if asking.num_rows and held_range is not None:
            yield from held_range.best(asking, k)
        elif asking.num_rows:
            early.append(asking)
    if early and held:
        held_range = held_range or _Range(low, n, place, *(np.concatenate(x) for x in zip(*held, strict=True)))
        for batch in early:
            yield from held_range.best(batch, k)


class _Range:
    """Weights of a range of target movies by source movie; gives the best of them for the users that pass by."""

    def __init__(self, low: int, n: int, place: np.ndarray, sources: np.ndarray, targets: np.ndarray, weights: np.ndarray):
        order = np.argsort(sources, kind="stable")
        self.low, self.place, self.targets, self.weights = low, place, targets[order], weights[order]
        self.bounds = np.append(np.searchsorted(sources[order], np.arange(n + 1)), len(order))  # movies beyond n have none

    def best(self, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """A few users at a time, so that their sums for all targets, or the weights to add, stay bounded."""
        (liked, sizes), (seen, hidden) = ((c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), c.value_lengths().to_numpy().astype(np.int64))
                                          for c in (batch.column("liked"), batch.column("seen")))
        liked = np.minimum(liked, len(self.bounds) - 2)
        degree, starts, seen_from = np.diff(self.bounds)[liked], np.append(0, sizes.cumsum()), np.append(0, hidden.cumsum())
        work = np.append(0, degree.cumsum())[starts]
        first = 0
        while first < batch.num_rows:
            last = min(int(np.searchsorted(work, work[first] + blocks.PAIRS, "right")) - 1, first + blocks.PAIRS // len(self.place), batch.num_rows)
            last = max(last, first + 1)
            own = slice(starts[first], starts[last])
            user, item, score = self._best(np.repeat(np.arange(last - first), sizes[first:last]), liked[own], degree[own], np.repeat(np.arange(last - first), hidden[first:last]),
                                           seen[seen_from[first]:seen_from[last]] - self.low, last - first, k)
            yield pa.RecordBatch.from_arrays([batch.column("user_id").take(pa.array(user + first)), pa.array((item + self.low).astype(np.int32)), pa.array(score)],
                                             names=["user_id", "movie_id", "score"])
            first = last

    def _best(self, row, liked, degree, owner, seen, users: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(self.place)
        at = np.repeat(self.bounds[liked] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
        key = np.repeat(row, degree) * width + self.targets[at]
        score, shown = np.bincount(key, self.weights[at], users * width).astype(np.float64, copy=False), np.zeros(users * width, bool)
        shown[key] = True
        inside = (seen >= 0) & (seen < width)
        shown[owner[inside] * width + seen[inside]] = False
        np.copyto(score, -np.inf, where=~shown)
        score = score.reshape(users, width)
        score[:, self.place < 0] = -np.inf
        limit = np.full(users, -np.inf)
        groups = np.maximum.reduceat(score, np.arange(0, width, -(-width // (4 * k))), axis=1)
        if groups.shape[1] > k:  # the k-th best of the best of groups is not above the k-th best of all
            limit = np.partition(groups, groups.shape[1] - k, axis=1)[:, groups.shape[1] - k]
        user, item = np.nonzero((score >= limit[:, None]) & (score > -np.inf))
        value = score[user, item]
        order = np.lexsort((self.place[item], -value, user))
        sorted_users = user[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_users, sorted_users) < k]
        return user[order], item[order], value[order]


def top_k(scores: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """First k rows per user by score, popularity and id; needs popularity > 0."""
    if k <= 0:
        raise ValueError("Ask for at least one movie per user")
    order = Window.partitionBy("user_id").orderBy(
        (F.col("score") if by is None else by).desc(), F.col("popularity").desc(), F.col("movie_id"))
    return (scores.where("popularity > 0").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def licence_penalties(movies: DataFrame, fees: DataFrame, penalty: float) -> DataFrame:
    """(movie, penalty) = penalty × fee; an unknown fee counts as the highest known one, for ranking only."""
    if not math.isfinite(penalty) or penalty <= 0:
        raise ValueError("The fee penalty has to be finite and above zero")
    known = fees.where("fee_status = 'known'").select("movie_id", F.col("fee").cast("double").alias("_fee"))
    if known.isEmpty():
        raise DataError("Not one movie has a known fee, so a penalty would do nothing")
    highest = known.agg(F.max("_fee").alias("_highest"))
    return (movies.select("movie_id").join(known, "movie_id", "left").crossJoin(F.broadcast(highest))
            .select("movie_id", (F.lit(penalty) * F.coalesce("_fee", "_highest")).alias("penalty")))


SCORED_SCHEMA = "user_id long, idx int, popularity double, score double, base_score double"
STREAM_COLUMNS = {"part": "int", "kind": "int", "place": "int", "users": "array<bigint>", "idx": "array<int>", "liked": "array<boolean>",
                  "popularity": "array<double>", "penalty": "array<double>", "data": "binary"}
FACTS, WEIGHTS, PEOPLE, PRICES = range(4)


def recommend(model: EaseModel, histories: DataFrame | None = None, k: int = fmt.SLATE_SIZE,
              penalties: DataFrame | None = None) -> DataFrame:
    """Top k unseen movies of every user with a supported liked movie.

    histories: (user, movie, liked), every row seen; the training histories by default, or any ad-hoc
    ones. Unsupported movies are ignored and repeats count once. Result: user, movie, rank, score,
    base_score (before penalties).
    """
    return recommend_each(model, histories, k, [penalties]).drop("policy")


def recommend_each(model: EaseModel, histories: DataFrame | None, k: int, penalties: Sequence[DataFrame | None]) -> DataFrame:
    """`recommend` for each of some penalties (None: without), with their place under `policy`; weights are solved or loaded once a task.

    Stored weights: a task loads those of some target movies once and lets blocks of users pass by: it adds the weight rows of
    a user's liked movies, masks what was seen and emits k movies per user. Weights that are not stored are scored in the task that solves them.
    The best k of these are the slate. No table of users by movies exists, and nothing passes through the driver.
    """
    if k <= 0:
        raise ValueError("Ask for at least one movie per user")
    rows = (model.histories if histories is None else histories).groupBy("user_id", "movie_id").agg(
        F.coalesce(F.max("liked"), F.lit(False)).alias("liked"))
    movies = model.movies.where("idx is not null")
    cost = lambda given: movies.select("movie_id", "idx", "popularity").withColumn("penalty", F.lit(0.0)) if given is None else movies.select(
        "movie_id", "idx", "popularity").join(given, "movie_id", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    known = written(rows.join(movies.select("movie_id", "idx"), "movie_id").select("user_id", "idx", "liked"), "profiles")
    n, width = model.size, model.width
    if model.source is None:
        best = reduce(DataFrame.unionByName, [
            _score_stream(model, known, cost(given)).mapInPandas(lambda batches: _score_groups(batches, n, width, k), SCORED_SCHEMA)
            .withColumn("policy", F.lit(place)) for place, given in enumerate(penalties)])
    else:
        best = _solve_and_score(model, known, [cost(given) for given in penalties], k)
    order = Window.partitionBy("policy", "user_id").orderBy(F.col("score").desc(), F.col("popularity").desc(), F.col("idx"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(movies.select("idx", "movie_id", "title"), "idx").select(
        "policy", "user_id", "movie_id", "title", "rank", "score", "base_score")


def _solve_and_score(model: EaseModel, known: DataFrame, costs: Sequence[DataFrame], k: int) -> DataFrame:
    """The best k movies of each user among those whose weights a task solves. A task holds the histories, k movies per user and policy, and one panel."""
    n, width, policies = model.size, model.width, len(costs)
    served = known.where("liked").select("user_id").distinct()
    people = krylov.in_chunks(known.join(served, "user_id", "left_semi"), "user_id", F.col("user_id"), F.col("idx"), F.col("liked")).withColumnsRenamed(
        {"_0": "owners", "_1": "items", "_2": "flags"}).withColumn("kind", F.lit(PEOPLE))
    each = reduce(DataFrame.unionByName, [cost.select("idx", "popularity", "penalty", F.lit(place).alias("at")) for place, cost in enumerate(costs)])
    facts = each.groupBy("idx").agg(F.first("popularity").alias("popularity"), F.transform(F.array_sort(F.collect_list(F.struct("at", "penalty"))), lambda p: p["penalty"]).alias("penalties"))
    facts = krylov.in_chunks(facts, "idx", F.col("idx"), F.concat(F.array("popularity"), F.col("penalties"))).withColumnsRenamed(
        {"_0": "items", "_1": "numbers"}).withColumn("kind", F.lit(PRICES))
    return krylov.solve_panels(model.source.members, n, [model.regularization], lambda: _Slates(n, width, k, policies), f"{SCORED_SCHEMA}, policy int", (facts, people))


class _Slates(krylov.Stored):
    """The best k movies of all users among the panels of a task, for each policy."""

    def __init__(self, n: int, width: int, k: int, policies: int):
        self.n, self.width, self.k = n, width, k
        self.popularity, self.penalty = np.zeros(n), np.zeros((policies, n))
        self.people, self.rows = [], None

    def given(self, row) -> None:
        if row.kind == PRICES:
            numbers, items = np.stack([np.asarray(x, float) for x in row.numbers], 1), np.asarray(row.items, np.int64)
            self.popularity[items], self.penalty[:, items] = numbers[0], numbers[1:]
        else:
            self.people.append((np.asarray(row.owners, np.int64), np.asarray(row.items, np.int32), np.asarray(row.flags, bool)))

    def _begin(self) -> None:
        none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        users, idx, liked = (np.concatenate(x) for x in zip(none, *self.people, strict=True))
        self.people = []
        self.names, user = np.unique(users, return_inverse=True)
        self.rows = krylov.Rows(user[liked], idx[liked].astype(np.int64), len(self.names))
        order = np.argsort(idx, kind="stable")
        self.seen, self.seen_from = user[order].astype(np.int32), np.searchsorted(idx[order], np.arange(self.n + 1))
        self.tie = np.empty(self.n, np.int32)
        self.tie[np.lexsort((np.arange(self.n), -self.popularity))] = np.arange(self.n)
        self.found = [[] for _ in self.penalty]
        self.limit = np.full((len(self.penalty), len(self.names)), -np.inf)

    def panel(self, panel: int, place: int, weights: np.ndarray, residual: float) -> Iterator[pd.DataFrame]:
        if self.rows is None:
            self._begin()
        first, last = panel * self.width, panel * self.width + weights.shape[1]
        own = slice(self.seen_from[first], self.seen_from[last])
        seen = self.seen[own], np.repeat(np.arange(last - first), np.diff(self.seen_from[first:last + 1]))
        base = self.rows.added(weights)
        for policy, penalty in enumerate(self.penalty):
            score = base - penalty[first:last]
            score[seen] = -np.inf
            user, item = np.nonzero((score >= self.limit[policy][:, None]) & (score > -np.inf))
            self.found[policy].append((user.astype(np.int32), (item + first).astype(np.int32), score[user, item], base[user, item]))
            if sum(len(f[0]) for f in self.found[policy][1:]) > max(len(self.names) * self.k, 1 << 18):
                self._cut(policy)
        return iter(())

    def _cut(self, policy: int) -> tuple:
        """Leave the best k of each user, and none that is below them to come."""
        user, item, score, base = (np.concatenate(x) for x in zip(*self.found[policy], strict=True))
        order = np.lexsort((self.tie[item], -score, user))
        sorted_users = user[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_users, sorted_users)
        last = order[place == self.k - 1]
        self.limit[policy][user[last]] = score[last]
        order = order[place < self.k]
        self.found[policy] = [(user[order], item[order], score[order], base[order])]
        return self.found[policy][0]

    def ended(self) -> Iterator[pd.DataFrame]:
        for policy in range(len(self.penalty) if self.rows is not None else 0):
            user, item, score, base = self._cut(policy)
            for at in range(0, len(user), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pd.DataFrame({"user_id": self.names[user[some]], "idx": item[some], "popularity": self.popularity[item[some]],
                                    "score": score[some], "base_score": base[some], "policy": np.int32(policy)})


def _score_stream(model: EaseModel, known: DataFrame, cost: DataFrame) -> DataFrame:
    """All that scoring needs, side by side for each group of panels and shard of users (a `part`): facts of the group's
    movies, its weights, then blocks of users. The weights are copied once for each shard, and there are only as many shards as it takes
    to give every task a part; users are copied once for each group."""
    n, width = model.size, model.width
    group = max(1, WEIGHT_BYTES // (4 * n * width))
    groups = -(-(-(-n // width)) // group)
    parallel = max(int(model.spark.conf.get("spark.sql.shuffle.partitions")), model.spark.sparkContext.defaultParallelism)
    served = known.where("liked").select("user_id").distinct()
    blocks_of_users = max(1, -(-served.count() // USERS_PER_BLOCK))
    shards = min(blocks_of_users, -(-parallel // groups))
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks_of_users)).cast("int").alias("place")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    number = F.expr(f"idx div {width * group}").cast("int").alias("group")
    facts = cost.groupBy(number).agg(F.array_sort(F.collect_list(F.struct("idx", "popularity", "penalty"))).alias("f"))
    people = known.join(served, "user_id", "left_semi").groupBy(block).agg(F.collect_list(F.struct("user_id", "idx", "liked")).alias("p"))
    part = F.col("group") * shards + F.col("shard")
    parts = [
        facts.select("group", each(shards).alias("shard"), F.col("f.popularity").alias("popularity"), F.col("f.penalty").alias("penalty"),
                     F.lit(FACTS).alias("kind"), F.lit(-1).alias("place")),
        model.panels.select(F.expr(f"panel div {group}").cast("int").alias("group"), each(shards).alias("shard"), F.lit(WEIGHTS).alias("kind"),
                            F.col("panel").alias("place"), "data"),
        people.select(each(groups).alias("group"), (F.col("place") % shards).alias("shard"), F.lit(PEOPLE).alias("kind"), "place",
                      F.col("p.user_id").alias("users"), F.col("p.idx").alias("idx"), F.col("p.liked").alias("liked"))]
    same = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in STREAM_COLUMNS.items()])
    stream = reduce(DataFrame.unionByName, [same(p.withColumn("part", part)) for p in parts])
    return stream.repartitionByRange(groups * shards, "part").sortWithinPartitions("part", "kind", "place")


class _Group:
    """Weights of a group of target movies; scores the blocks of users that pass by."""

    def __init__(self, first: int, columns: int, n: int):
        self.first, self.n = first, n
        self.weights = np.zeros((n, columns), np.float32)

    def facts(self, popularity: np.ndarray, penalty: np.ndarray) -> None:
        self.popularity, self.penalty = popularity, penalty

    def load(self, column: int, data: np.ndarray) -> None:
        self.weights[:, column - self.first:column - self.first + data.shape[1]] = data

    def best(self, users: np.ndarray, idx: np.ndarray, liked: np.ndarray, k: int) -> pd.DataFrame:
        names, user = np.unique(users, return_inverse=True)
        base = krylov.Rows(user[liked], idx[liked], len(names)).added(self.weights)
        score, inside = base - self.penalty, (idx >= self.first) & (idx < self.first + base.shape[1])
        score[user[inside], idx[inside] - self.first] = -np.inf
        chosen = []
        for line in score:
            items = np.flatnonzero(line > -np.inf)
            if len(items) > k:
                items = items[line[items] >= np.partition(line[items], len(items) - k)[len(items) - k]]
            chosen.append(items[np.lexsort((items, -self.popularity[items], -line[items]))][:k])
        row, item = np.repeat(np.arange(len(names)), list(map(len, chosen))), np.concatenate(chosen)
        return pd.DataFrame({"user_id": names[row], "idx": (item + self.first).astype("int32"), "popularity": self.popularity[item],
                             "score": score[row, item], "base_score": base[row, item]})


def _score_groups(batches: Iterator[pd.DataFrame], n: int, width: int, k: int) -> Iterator[pd.DataFrame]:
    current = part = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.kind == FACTS:
                part = row.part
                current = None
                facts = np.asarray(row.popularity, float), np.asarray(row.penalty, float)
            elif row.kind == WEIGHTS:
                if current is None:
                    current = _Group(row.place * width, len(facts[0]), n)
                    current.facts(*facts)
                current.load(row.place * width, _panel(row, n))
            elif current is not None and row.part == part:
                yield current.best(np.asarray(row.users, np.int64), np.asarray(row.idx, np.int64), np.asarray(row.liked, bool), k)


def recommend_all(model: EaseModel, users: DataFrame, k: int = fmt.SLATE_SIZE, penalties: DataFrame | None = None,
                  histories: DataFrame | None = None) -> DataFrame:
    """Personal slates, and popular unseen movies for users without a supported liked movie; `method` says which.

    Histories are the training ones by default, or any ad-hoc ones. Only `users` are scored.
    """
    wanted = users.select("user_id").distinct()
    rows = (model.histories if histories is None else histories).join(wanted, "user_id", "left_semi")
    personal = recommend(model, rows, k, penalties)
    liked = rows.where("liked").join(model.movies.where("idx is not null"), "movie_id", "left_semi").select("user_id").distinct()
    popular = popular_unseen(wanted.join(liked, "user_id", "left_anti"), rows, model.supported, k).join(
        model.movies.select("movie_id", "title"), "movie_id")
    columns = ["user_id", "movie_id", "title", "rank", "score"]
    return (personal.select(*columns).withColumn("method", F.lit("ease")).unionByName(
        popular.withColumn("score", F.col("popularity")).select(*columns).withColumn("method", F.lit("popularity"))))


def save_model(model: EaseModel, path: str) -> None:
    """Movies, weight tiles and histories as Parquet, parameters as a one-row table."""
    model.movies.write.mode("errorifexists").parquet(f"{path}/movies")
    model.panels.write.mode("errorifexists").parquet(f"{path}/panels")
    model.histories.write.mode("errorifexists").parquet(f"{path}/histories")
    model.spark.createDataFrame(
        [(2, model.size, model.width, float(model.regularization), int(model.min_rating))],
        "format_version int, size int, width int, regularization double, min_rating int",
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/parameters")


def load_model(spark: SparkSession, path: str) -> EaseModel:
    saved = spark.read.parquet(f"{path}/parameters").first()
    if saved.format_version != 2:
        raise ValueError("Unsupported model version")
    return EaseModel(spark.read.parquet(f"{path}/movies"), spark.read.parquet(f"{path}/panels"),
                     spark.read.parquet(f"{path}/histories"), saved.size, saved.width,
                     saved.regularization, saved.min_rating)


def candidate_checks(model: EaseModel, reference: EaseModel, training_movies: DataFrame,
                     catalogue: DataFrame) -> DataFrame:
    """(check, passed): same movies, finite numbers, some popularity, same parameters, usable fallback."""
    apart = lambda a, b: a.select("movie_id").join(b.select("movie_id"), "movie_id", "left_anti").agg(
        (F.count(F.lit(1)) == 0).alias("ok"))
    checks = {
        "movies_match_training": apart(model.movies, training_movies).crossJoin(
            apart(training_movies, model.movies).withColumnRenamed("ok", "ok2")).select((F.col("ok") & F.col("ok2")).alias("ok")),
        "movies_in_catalogue": apart(model.movies, catalogue),
        "finite_weights": weight_summary(model).agg(F.coalesce(F.every("finite"), F.lit(True)).alias("ok")),
        "finite_popularity": model.movies.agg(F.every(~F.isnan("popularity") & (F.abs("popularity") < float("inf"))).alias("ok")),
        "fallback_nonempty": model.movies.agg(F.coalesce(F.some(F.col("popularity") > 0), F.lit(False)).alias("ok")),
    }
    same = (model.regularization, model.min_rating) == (reference.regularization, reference.min_rating)
    result = model.spark.range(1).select(F.lit("same_parameters").alias("check"), F.lit(same).alias("passed"))
    for name, frame in checks.items():
        result = result.unionByName(frame.select(F.lit(name).alias("check"), F.col("ok").alias("passed")))
    return result


def policy_replay(model: EaseModel, fees: DataFrame, penalty: float, sample: int | None = None, seed: int = 42,
                  k: int = fmt.SLATE_SIZE) -> DataFrame:
    """Slates with and without a fee penalty for all users (or a seeded sample of them), one summary row per policy."""
    users = model.histories.where("liked").select("user_id").distinct()
    if sample is not None:
        users = users.orderBy(F.xxhash64(F.lit(seed), F.col("user_id")), "user_id").limit(sample)
    histories = model.histories.join(users, "user_id", "left_semi")
    known = fees.where("fee_status = 'known'").select("movie_id", F.col("fee").cast("double").alias("fee"))
    both = recommend_each(model, histories, k, [None, licence_penalties(model.movies, fees, penalty)]).withColumn(
        "policy", F.when(F.col("policy") == 0, "control").otherwise("treatment"))
    both = settle(both.join(known, "movie_id", "left"))
    slates = both.groupBy("policy", "user_id").agg(
        F.collect_set("movie_id").alias("ids"),  # at most k
        F.when(F.count("fee") == F.count(F.lit(1)), F.avg("fee")).alias("fee"),
        F.count_if(F.col("fee").isNull()).alias("unknown"), F.avg("base_score").alias("score"))
    shared = (slates.where("policy = 'control'").select("user_id", F.col("ids").alias("a"))
              .join(slates.where("policy = 'treatment'").select("user_id", F.col("ids").alias("b")), "user_id")
              .agg(F.avg(F.size(F.array_intersect("a", "b")) / F.size("a")).alias("mean_overlap")))
    return (slates.groupBy("policy").agg(
        F.count(F.lit(1)).alias("users"), F.sum("unknown").alias("unknown_fees"),
        F.when(F.count("fee") == F.count(F.lit(1)), F.avg("fee")).alias("mean_fee"),
        F.avg("score").alias("mean_base_score")).crossJoin(F.broadcast(shared)))
