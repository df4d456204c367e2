"""Facets that face most nearly the way a given one does: exact search with KD-trees, one per shard.

Works on the facets of `triangle_geometry` (mesh_id, tid, and a direction such as the array of nx, ny
and nz), and on any other table of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.spread import cut, dense_ids, discard

FACET = ("mesh_id", "tid")
K, SCALE = 20, 64
# Vectors of a shard, asked vectors that are sought together, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
# Whole numbers below this are exact as doubles.
_EXACT = 1 << 53


def split(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves of a KD-tree as (node, rows): nodes halve at the median of their widest component.

    The root is node 1, the halves of node n are 2n and 2n + 1. Equal vectors are not split further.
    """
    waiting = [(1, np.arange(len(vectors)))]
    while waiting:
        node, rows = waiting.pop()
        spread = np.ptp(vectors[rows], axis=0) if vectors.shape[1] else np.zeros(1, np.int64)
        if len(rows) <= leaf_rows or not spread.any():
            yield node, rows
            continue
        middle = len(rows) // 2
        halves = np.argpartition(vectors[rows, spread.argmax()], middle)
        waiting += [(2 * node, rows[halves[:middle]]), (2 * node + 1, rows[halves[middle:]])]


def first_copies(vectors: np.ndarray, numbers: np.ndarray, most: int) -> np.ndarray:
    """Rows without those of equal vectors that come after `most` copies of a smaller number: they cannot be answers."""
    order = np.lexsort((numbers, *vectors.T))
    ranked = vectors[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < most]


class Tree:
    """A KD-tree with tight bounding boxes, rebuilt from its leaves."""

    def __init__(self, nodes: Sequence[int], vectors: Sequence[np.ndarray], numbers: Sequence[np.ndarray]):
        self.vectors, self.numbers = dict(zip(nodes, vectors)), dict(zip(nodes, numbers))
        self.low = {n: v.min(axis=0) for n, v in self.vectors.items()}
        self.high = {n: v.max(axis=0) for n, v in self.vectors.items()}
        # A node's number is greater than its parent's, so boxes grow from the leaves up.
        for n in sorted({m >> s for m in nodes for s in range(1, m.bit_length())}, reverse=True):
            self.low[n] = np.minimum(self.low[2 * n], self.low[2 * n + 1])
            self.high[n] = np.maximum(self.high[2 * n], self.high[2 * n + 1])

    def bounds(self, node: int, asked: np.ndarray) -> np.ndarray:
        """The greatest inner product that each asked vector can have with a vector in the node's box."""
        return np.maximum(asked, 0) @ self.high[node] + np.minimum(asked, 0) @ self.low[node]

    def reachable(self, asked: np.ndarray, floor: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves, and their bounds per asked vector; a branch whose box stays below the floor is not entered."""
        leaves, columns = [], []
        level = [(1, np.arange(len(asked)), self.bounds(1, asked))]
        while level:
            node, rows, bound = level.pop()
            near = bound >= floor[rows]
            rows, bound = rows[near], bound[near]
            if not len(rows):
                continue
            if node in self.vectors:
                column = np.full(len(asked), -np.inf)
                # Beyond the exact doubles the next one up is still a bound.
                column[rows] = bound if bound.dtype == np.float64 else np.nextafter(bound.astype(np.float64), np.inf)
                leaves.append(node)
                columns.append(column)
            else:
                level += [(child, rows, self.bounds(child, asked[rows])) for child in (2 * node, 2 * node + 1)]
        return leaves, np.stack(columns, axis=1) if columns else np.zeros((len(asked), 0))


def best(asked: np.ndarray, own: np.ndarray, floor: np.ndarray, tree: Tree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, number, score) of the `k` best per asked vector that reach its floor; ties to smaller numbers.

    Every vector goes through its leaves from the best bound down, one leaf first and then twice as
    many each round, until no bound reaches its kth score. That score starts at `floor`, the kth score
    that other shards have shown, and `own` numbers are left out.
    """
    kth = floor.copy()
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    leaves, bounds = tree.reachable(asked, kth)
    ranked, at, step = np.argsort(-bounds, axis=1, kind="stable"), 0, 1
    while at < len(leaves):
        turn = np.zeros(bounds.shape, bool)
        np.put_along_axis(turn, ranked[:, at : at + step], True, axis=1)
        turn &= (bounds >= kth[:, None]) & (bounds > -np.inf)
        if not turn.any():
            break
        found = [held]
        for n in np.flatnonzero(turn.any(axis=0)):
            rows, leaf = np.flatnonzero(turn[:, n]), leaves[n]
            scores = asked[rows] @ tree.vectors[leaf].T
            numbers = tree.numbers[leaf]
            i, j = np.nonzero((scores >= kth[rows, None]) & (numbers[None, :] != own[rows, None]))
            found.append((rows[i], numbers[j], scores[i, j].astype(np.int64)))
        row, number, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((number, -score, row))
        row, number, score = row[order], number[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        held = row[place < k], number[place < k], score[place < k]
        full = place == k - 1
        kth[row[full]] = np.maximum(kth[row[full]], score[full])
        at, step = at + step, step * 2
    return held


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims) if dims else np.zeros((len(column), 0), np.int64)


def _plant(k: int, leaf_rows: int):
    """Function of a shard's rows (dims, shard, number, vector) that gives one row per leaf of its tree."""

    def plant(rows: pa.Table) -> pa.Table:
        dims, shard = (rows.column(c)[0].as_py() for c in ("dims", "shard"))
        vectors, numbers = _matrix(rows.column("vector"), dims), rows.column("number").to_numpy()
        kept = first_copies(vectors, numbers, k + 1)
        vectors, numbers = vectors[kept], numbers[kept]
        leaves = list(split(vectors, leaf_rows))
        out = {"dims": [dims] * len(leaves), "shard": [shard] * len(leaves), "node": [n for n, _ in leaves]}
        out |= {"numbers": [numbers[r] for _, r in leaves], "vectors": [vectors[r].ravel() for _, r in leaves]}
        kinds = {"dims": pa.int32(), "shard": pa.int64(), "node": pa.int64(), "numbers": pa.list_(pa.int64()), "vectors": pa.list_(pa.int64())}
        return pa.table(out, schema=pa.schema(kinds))

    return plant


def _seek(k: int):
    """Function of the leaves of one shard and a block of asked rows that gives (asked, number, score)."""

    def seek(leaves: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([(c, pa.int64()) for c in ("asked", "number", "score")])
        if not leaves.num_rows or not asked.num_rows:
            return kinds.empty_table()
        dims = leaves.column("dims")[0].as_py()
        numbers = [np.array(x, np.int64) for x in leaves.column("numbers").to_pylist()]
        flat = leaves.column("vectors").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([len(x) * dims for x in numbers])[:-1]
        vectors = [v.reshape(len(n), dims) for n, v in zip(numbers, np.split(flat, ends))]
        wanted = _matrix(asked.column("vector"), dims)
        most = max((int(np.abs(v).max(initial=0)) for v in vectors), default=0) * int(np.abs(wanted).max(initial=0)) * max(1, dims)
        if most >= 1 << 63:
            raise OverflowError("an inner product does not fit into a long")
        kind = np.float64 if most < _EXACT else np.int64
        tree = Tree(leaves.column("node").to_pylist(), [v.astype(kind) for v in vectors], numbers)
        floor = asked.column("floor").to_numpy(zero_copy_only=False).astype(kind)
        own = asked.column("number").to_numpy()
        row, number, score = best(wanted.astype(kind), own, floor, tree, k)
        return pa.table([own[row], number, score], schema=kinds)

    return seek


def alike_facets(
    facets: DataFrame,
    asked: Column,
    keys: Sequence[str] = FACET,
    direction: str = "direction",
    k: int = K,
    scale: float = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The `k` facets whose directions have the greatest inner product with that of each facet for which `asked` holds.

    Returns a row per answer: the asked facet's keys with `asked_` before their names, rank (from 1),
    the found facet's keys, score. Components are scaled and rounded down to whole numbers first, so
    scores are exact; ties go to smaller keys. Every row but the asked one itself can be found; with
    fewer than `k` of them all are.

    Facets are shared out by a hash into shards of about `shard_rows`, each with a tree of its own, in
    which every branch has a tight box. An asked facet searches its own shard first; the kth score it
    finds there goes along to all other shards, where branches whose boxes cannot reach it are not
    entered. Answers per shard are merged by a window of at most `k` rows for each shard.

    Directions that are null or hold a null or a non-finite component take no part. Directions of
    different lengths never meet; those without components score 0 among each other. Facets that share
    a key are different rows and find each other; a null key comes after all others in ties. An empty
    table has no answers; other columns are ignored. A score that no long can hold raises an error.
    """
    vector = F.col("vector")
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = [F.col(c).alias(f"key{n}") for n, c in enumerate(keys)]
    held = [f"key{n}" for n in range(len(keys))]
    rows = facets.select(*named, facets[direction].cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("_asked"))
    rows = rows.where(whole).withColumn("vector", F.transform(vector, lambda x: F.floor(x * scale)))
    order = [*[F.col(c).asc_nulls_last() for c in held], F.xxhash64("vector").asc()]
    numbered = cut(dense_ids(rows, order, "number"))
    shards = max(1, -(-numbered.count() // shard_rows))
    blocks = max(1, -(-numbered.where("_asked").count() // block_rows))
    placed = numbered.select(
        "number", "vector", "_asked", F.size("vector").alias("dims"), F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard")
    )
    tree = "dims int, shard long, node long, numbers array<long>, vectors array<long>"
    answer = "asked long, number long, score long"
    leaves = cut(placed.drop("_asked").groupBy("dims", "shard").applyInArrow(_plant(k, leaf_rows), tree))
    wanted = placed.where("_asked").drop("_asked")

    def sought(leaves: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
        return leaves.groupBy(*on).cogroup(wanted.groupBy(*on)).applyInArrow(_seek(k), answer)

    at_home = sought(leaves, wanted.withColumn("floor", F.lit(-(1 << 62)).cast("long")), "dims", "shard")
    if shards > 1:
        at_home = cut(at_home)
        kth = at_home.groupBy("asked").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).withColumnRenamed("asked", "number")
        floor = F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(-(1 << 62)).cast("long"))
        known = wanted.join(kth.hint("merge"), "number", "left").withColumn("floor", F.coalesce(floor, F.lit(-(1 << 62)).cast("long")))
        every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
        travelling = known.select("number", "vector", "dims", "floor", F.explode(F.filter(every, lambda s: s != F.col("shard"))).alias("shard"))
        travelling = travelling.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
        spread = leaves.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        abroad = sought(spread, travelling, "dims", "shard", "block")
        found = at_home.union(abroad)
    else:
        found = at_home
    place = Window.partitionBy("asked").orderBy(F.desc("score"), "number")
    ranked = cut(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
    for copy in (leaves, *([at_home] if shards > 1 else [])):
        discard(copy)
    names = numbered.select("number", *held)
    asking = names.select(F.col("number").alias("asked"), *[F.col(h).alias(f"asked_{c}") for h, c in zip(held, keys)])
    found_keys = [F.col(h).alias(c) for h, c in zip(held, keys)]
    joined = ranked.join(asking.hint("merge"), "asked").join(names.hint("merge"), "number")
    return joined.select(*[f"asked_{c}" for c in keys], "rank", *found_keys, "score")
