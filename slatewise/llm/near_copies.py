"""Similarity join on word shingles: a MinHash LSH forest finds candidates, exact set comparison decides.

1. Documents with equal shingle sets form a class; from here on only classes move.
2. Each class has `TREES` signatures of `DEPTH` minima. A tree is the trie of its sorted signatures, and a trie node is
   known by the hash of its prefix. The matched prefix is shortened from `DEPTH` until pairs at the threshold meet with the
   target recall. A node with few members gives all its pairs (a bounded number); in a node with many every member
   is linked to the first one, and the members descend to the longer prefixes, where smaller nodes give all pairs.
3. Candidates whose whole signatures agree far less than the threshold are let go; the rest form candidate groups.
4. Inside each group *all* pairs are compared exactly, block against block as matrix products in tasks: what leaves a task
   is a number of links for each class and a spanning forest, not the pairs.
5. The verified links give the connected groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.decontaminate import Numbers, gram_hashes, words_of
from slatewise.llm.texts import map_texts
from slatewise.session import written

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 8
RECALL = 0.999
NODE_PAIRS = 32
#: Estimated similarity below which a candidate is let go: seven standard errors of the signatures below 0.8.
MARGIN = 0.2
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 31, TREES * DEPTH, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def shortest_prefix(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix length at which two sets at the threshold meet in one of the trees with the target recall."""
    for length in range(DEPTH, 0, -1):
        if 1 - (1 - threshold ** length) ** TREES >= recall:
            return length
    return 1


def shingles(text: str, numbers: Numbers, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    found = numbers.of(words_of(text))
    return np.unique(gram_hashes(found, min(width, len(found)))) if len(found) else found


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of `TREES * DEPTH` hash functions over a set."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        part = low[at:at + 256]
        mixed = part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(best, mixed.min(1), out=best)
    return best.view(np.int32)


def classes_of(docs: DataFrame, text: str, keep: tuple[str, ...], width: int = SHINGLE) -> DataFrame:
    """`keep` with _class (digest of the shingle set, null without words), _size and _signature."""
    numbers = Numbers()

    def run(texts, rows):
        names, sizes, signs, done = [], [], [], {}
        for t in texts:
            found = shingles(t, numbers, width)
            name = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            if name is not None and name not in done:
                done[name] = signature(found)
            names.append(name)
            sizes.append(len(found))
            signs.append(done.get(name))
        return [names, sizes, signs]

    return map_texts(docs, text, run, "_class binary, _size int, _signature array<int>", keep)


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct candidate pairs (a < b) of classes that share a prefix in some tree."""
    first = shortest_prefix(threshold)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("_tree")
    levels = list(range(first, DEPTH + 1))
    rows = classes.select("_class", "_signature", tree).select(
        "_class", *[F.xxhash64("_tree", F.slice("_signature", F.col("_tree") * DEPTH + 1, n)).alias(f"_p{n}") for n in levels])
    parts = []
    for n in levels:
        node = f"_p{n}"
        dealt = rows.repartition(node)
        large = dealt.groupBy(node).agg(F.count("*").alias("_n"), F.min("_class").alias("_first")).filter("_n > 1")
        members = dealt.join(large, node)
        few = members.filter(F.col("_n") <= NODE_PAIRS).groupBy(node).agg(F.array_sort(F.collect_list("_class")).alias("c"))
        pairs = few.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))
        many = members.filter(F.col("_n") > NODE_PAIRS)
        stars = many.filter("_class != _first").select(F.col("_first").alias("a"), F.col("_class").alias("b"))
        parts += [pairs, stars]
        if n < DEPTH:
            rows = written(many.select("_class", *[f"_p{m}" for m in levels if m > n]), "forest-level")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least a share `least` of the places."""
    signs = classes.select(F.col("_class"), "_signature")
    joined = pairs.join(signs.withColumnsRenamed({"_class": "a", "_signature": "x"}), "a").join(
        signs.withColumnsRenamed({"_class": "b", "_signature": "y"}), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    return joined.filter(same >= least * TREES * DEPTH).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and the least node of its component.

    Least neighbouring labels with pointer jumping; each round is a written table, and the rounds grow with the logarithm
    of a component's diameter.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                     .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = own.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        new = written(jump.select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old != label").isEmpty():
            return labels


def _agree(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets are similar: within `left`, or of `left` with `right`."""
    if right is None and len(left) == 2:
        common = len(np.intersect1d(left[0], left[1], assume_unique=True))
        hit = common * (1 + threshold) >= threshold * (len(left[0]) + len(left[1])) - 1e-9
        return np.array([[False, hit], [hit, False]])
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    unique, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    n = len(left)
    common = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    width = max(256, (1 << 23) // max(len(sets), 1) // 4)
    for at in range(0, len(unique), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        common += dense[:n] @ (dense[n:] if right is not None else dense).T
    other = sizes[n:] if right is not None else sizes
    hit = common * (1 + threshold) >= threshold * (sizes[:n, None] + other[None]) - 1e-6
    if right is None:
        np.fill_diagonal(hit, False)
    return hit


def _forest(hit: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similarity graph (columns of a cross block follow the rows)."""
    total = hit.shape[0] + (hit.shape[1] if cross else 0)
    parent = list(range(total))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
        j += hit.shape[0] if cross else 0
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            edges.append((i, j))
    return edges


def verify(groups: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, threshold: float, width: int) -> DataFrame:
    """Exact comparison of all pairs inside candidate groups: _class, links (documents), other (spanning edges, or null)."""
    known = written(classes.join(groups.select(F.col("node").alias("_class"), F.col("label").alias("_group")), "_class")
                    .select("_class", "_key", "_copies", "_size", "_group"), "grouped")
    shape = known.groupBy("_group").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    total = shape.agg(F.sum("_s")).first()[0] or 0
    bins = int(total // BLOCK_SHINGLES + 1)
    shape = shape.select("_group", F.greatest(F.ceil(F.col("_n") / BLOCK_SETS), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    placed = known.select("_class", "_copies", "_group").join(shape, "_group").withColumn("_block", F.pmod(F.xxhash64("_class"), F.col("_blocks")).cast("int"))
    # Sets are made again from the texts of the groups' first documents; nothing else of the texts moves.
    wanted = known.select(F.col("_key").alias(key)).distinct()
    numbers = Numbers()

    def sets(texts, rows):
        found = [shingles(t, numbers, width) for t in texts]
        return [[xxhash.xxh3_128_digest(f.tobytes()) if len(f) else None for f in found], [f.tobytes() for f in found]]

    near = docs.select(key, text).alias("d").join(wanted.alias("w"), F.col(f"d.`{key}`").eqNullSafe(F.col(f"w.`{key}`")), "left_semi")
    made = map_texts(near, text, sets, "_class binary, _set binary").filter("_class is not null").dropDuplicates(["_class"])
    full = placed.join(made, "_class")
    dealt = full.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_class", "_copies", "_group", "_set", "_block", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j"),
        F.when(F.col("_blocks") > 1, F.xxhash64("_group", F.least("_block", "_with"), F.greatest("_block", "_with")))
        .otherwise(F.pmod(F.xxhash64("_group"), F.lit(bins))).alias("_task"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in rows.groupby(["_group", "_i", "_j"], sort=False):
            part = part.sort_values(["_block", "_class"], kind="stable")
            names, copies = part["_class"].tolist(), part["_copies"].to_numpy()
            found = [np.frombuffer(s, np.uint64) for s in part["_set"]]
            n = int((part["_block"] == i).sum())
            if i == j:
                if len(found) < 2:
                    continue
                hit = _agree(found, None, threshold)
                links = hit @ copies
            else:
                if not n or n == len(found):
                    continue
                hit = _agree(found[:n], found[n:], threshold)
                links = np.concatenate([hit @ copies[n:], hit.T @ copies[:n]])
            out += [(c, int(k), None) for c, k in zip(names, links) if k]
            out += [(names[a], 0, names[b]) for a, b in _forest(hit, i != j)]
        return pd.DataFrame(out, columns=["_class", "links", "other"])

    return written(dealt.groupBy("_task").applyInPandas(compare, "_class binary, links bigint, other binary"), "links")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """One row per document: key, class_id, n_links.

    class_id is the least key of the documents connected by links (Jaccard similarity of word shingles of at least
    `threshold`); n_links counts the other documents linked to this one, copies included. Words are lower-cased runs of
    letters, digits and underscores. A text of fewer words than a shingle is one shingle; a null text or one without words
    links to nothing and is its own class. Repeated rows are copies of each other; a null key is carried along (class_id is
    then the least other key, or null). Other columns are not read; an empty table gives no rows.
    """
    table = written(classes_of(docs, text, (key,), width), "shingled")
    one = F.first(F.struct("_size", "_signature")).alias("_one")
    classes = written(table.filter("_class is not null").groupBy("_class").agg(F.min(key).alias("_key"), F.count("*").alias("_copies"), one)
                      .select("_class", "_key", "_copies", "_one.*"), "classes")
    pairs = likely(candidates(classes, threshold), classes, threshold - MARGIN)
    groups = components(written(pairs, "candidates"))
    links = verify(groups, classes, docs, text, key, threshold, width)
    counts = links.groupBy("_class").agg(F.sum("links").alias("_links"))
    joined = components(links.filter("other is not null").select(F.col("_class").alias("a"), F.col("other").alias("b")))
    labelled = classes.select("_class", "_key", "_copies").join(joined.select(F.col("node").alias("_class"), "label"), "_class", "left") \
        .withColumn("_label", F.coalesce("label", "_class"))
    least = labelled.groupBy("_label").agg(F.min("_key").alias("class_id"))
    facts = labelled.join(least, "_label").join(counts, "_class", "left").select(
        "_class", "class_id", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    return table.select(key, "_class").join(facts, "_class", "left").select(
        key, F.when(F.col("_class").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """All columns of `docs`; of every group of near copies only its first row stays (rows without words all stay)."""
    names = set(docs.columns)
    row = next(f"_row{i}" for i in range(len(names) + 1) if f"_row{i}" not in names)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_copies(numbered, text, row, threshold, width)
    firsts = found.filter(F.col(row) == F.col("class_id")).select(row)
    return numbered.join(firsts, row, "left_semi").drop(row)
