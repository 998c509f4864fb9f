"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Vectors are dealt to shards by hash. A shard's tree is built over its vectors with one coordinate added that brings
all to the length of the longest; then the largest inner product is the least distance, and the triangle inequality
holds. A query passes over a subtree when the least distance its ring allows is more than ``factor`` times the
distance of the worst neighbour held so far: factor 1 is exact, smaller factors look at less.

Queries travel in blocks. Every block meets every shard in a group of its own of bounded size; what comes back is at
most k rows per query and shard, reduced where they are made before they meet.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Rows that
share an id count once, with the vector that sorts first. Vectors are compared with those of their own length only.
Of equal scores the smaller id comes first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import materialize

K = 20
# How much of the triangle inequality's bound is trusted: 1 is exact.
FACTOR = 0.9
# Vectors of a shard and queries of a block, about: they bound the memory of a group.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
LEAF = 128
# Share of the longest possible score that a sum's order may change, and that of a distance: far more than rounding.
SLACK, FAR_SLACK = 1e-12, 1e-7
# Pairs whose scores are summed at a time.
PAIRS = 1 << 16


class Tree:
    """Nodes in arrays: the vantage point, the rings its two children lie in, and a leaf's range of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        wide = self.vectors.astype(np.float64)
        squares = (wide * wide).sum(1)
        self.longest = float(np.sqrt(squares.max()))
        # the added coordinate of every vector; a query's is 0
        self._added = np.sqrt(np.maximum(self.longest**2 - squares, 0))
        self._wide = wide
        self.point: list[int] = []
        self.rings: list[tuple[float, float, float, float]] = []
        self.children: list[tuple[int, int]] = []
        self.leaf: list[np.ndarray | None] = []
        self._build()
        del self._added, self._wide

    def state(self) -> dict:
        """Plain values only, to travel between tasks."""
        return dict(vars(self))

    @classmethod
    def of_state(cls, state: dict) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(state)
        return tree

    def _build(self) -> None:
        rng = np.random.default_rng(len(self.ids))
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(self.ids)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            node = len(self.point)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            self.children.append((-1, -1))
            if len(members) <= LEAF:
                self.point.append(-1), self.rings.append((0.0,) * 4), self.leaf.append(members)
                continue
            vantage = int(members[rng.integers(len(members))])
            rest = members[members != vantage]
            far = self._distances(vantage, rest)
            half = len(rest) // 2
            order = np.argpartition(far, half)
            inner, outer = order[:half], order[half:]
            self.point.append(vantage)
            self.rings.append((far[inner].min(), far[inner].max(), far[outer].min(), far[outer].max()))
            self.leaf.append(None)
            todo += [(rest[outer], node, 1), (rest[inner], node, 0)]

    def _distances(self, vantage: int, rest: np.ndarray) -> np.ndarray:
        products = self._wide[rest] @ self._wide[vantage] + self._added[rest] * self._added[vantage]
        return np.sqrt(np.maximum(2 * self.longest**2 - 2 * products, 0))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query the places of its nearest vectors and their scores; places -1 where there are fewer."""
        return _Search(self, ids, queries.astype(np.float64), k, factor).run()


class _Search:
    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        squares = (queries * queries).sum(1)
        self.lengths = squares + tree.longest**2
        self.slack = SLACK * np.sqrt(squares) * tree.longest
        self.far_slack = FAR_SLACK * np.sqrt(self.lengths)
        self.scores = np.full((len(queries), k), -np.inf)
        self.places = np.full((len(queries), k), -1, dtype=np.int64)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        todo = [(0, np.arange(len(self.queries)), None)]
        while todo:
            node, active, least = todo.pop()
            if least is not None:
                keep = least <= self.factor * self._worst(active) + self.far_slack[active]
                active = active[keep]
            if not len(active):
                continue
            members = self.tree.leaf[node]
            if members is not None:
                self._offer(active, members)
                continue
            vantage = self.tree.point[node]
            far = self._offer(active, np.array([vantage]))[:, 0]
            a, b, c, d = self.tree.rings[node]
            to_inner = np.maximum(np.maximum(a - far, far - b), 0)
            to_outer = np.maximum(np.maximum(c - far, far - d), 0)
            near = to_inner <= to_outer
            inner, outer = self.tree.children[node]
            # taken from the end: each query goes to its nearer side first
            for child, chosen, bound in ((inner, ~near, to_inner), (outer, near, to_outer),
                                         (outer, ~near, to_outer), (inner, near, to_inner)):
                if chosen.any():
                    todo.append((child, active[chosen], bound[chosen]))
        return self.places, self.scores

    def _worst(self, active: np.ndarray) -> np.ndarray:
        """Distance of the worst neighbour held."""
        worst = self.scores[active, -1]
        none = np.isinf(worst)
        squares = self.lengths[active] - 2 * np.where(none, 0, worst)
        return np.where(none, np.inf, np.sqrt(np.maximum(squares, 0)))

    def _offer(self, active: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Keep the best of what is held and the members; gives the distances to the members."""
        products = self.queries[active] @ self.tree.vectors[members].astype(np.float64).T
        own = self.ids[active][:, None] == self.tree.ids[members][None, :]
        # a product that may belong to the best is summed in one order, so that equal vectors tie wherever they stand
        possible = ~own & (products >= (self.scores[active, -1] - self.slack[active])[:, None])
        scores = np.full(products.shape, -np.inf)
        rows, columns = np.nonzero(possible)
        for start in range(0, len(rows), PAIRS):
            r, c = rows[start : start + PAIRS], columns[start : start + PAIRS]
            scores[r, c] = inner_products(self.queries[active[r]], self.tree.vectors[members[c]])
        better = possible.any(1)
        if better.any():
            rows = active[better]
            all_scores = np.hstack([self.scores[rows], scores[better]])
            all_places = np.hstack([self.places[rows], np.broadcast_to(members, (len(rows), len(members)))])
            all_places[np.isinf(all_scores)] = -1
            # places follow ids, so of equal scores the smaller id comes first
            best = np.lexsort((all_places, -all_scores), axis=1)[:, : self.k]
            self.scores[rows] = np.take_along_axis(all_scores, best, 1)
            self.places[rows] = np.take_along_axis(all_places, best, 1)
        return np.sqrt(np.maximum(self.lengths[active][:, None] - 2 * products, 0))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row in double precision, always summed in the same order."""
    return np.add.reduce(left.astype(np.float64) * right.astype(np.float64), axis=1)


def taking_part(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding and its length (dim) of the vectors that take part, one row per id."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull())
            .where(finite & F.exists(v, lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
            .withColumn("dim", F.size("embedding")))


def _bundles(rows: DataFrame, parts: int, salt: int, build) -> DataFrame:
    """One row per length and part: what ``build`` makes of the part's ids and vectors, pickled."""

    def bundle(key, table):
        ids = table["vec_id"].to_numpy()
        vectors = np.stack([np.asarray(x, dtype=_number(table)) for x in table["embedding"].to_numpy()])
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "data": pa.array([pickle.dumps(build(ids, vectors))], pa.binary())})

    part = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).groupBy("dim", "part").applyInArrow(bundle, "dim int, part int, data binary")


def _number(table: pa.Table) -> type:
    return np.float32 if pa.types.is_float32(table.schema.field("embedding").type.value_type) else np.float64


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of every vector for which ``is_query`` holds.

    ``is_query`` is a condition on vec_id. Scores are inner products of the original vectors in double precision.
    """
    rows = materialize(taking_part(vectors), "vectors")
    queries = rows.where(is_query)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    trees = _bundles(rows, shards, 1, lambda ids, found: Tree(ids, found).state()).select(
        "dim", F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "data")
    asked = _bundles(queries, blocks, 2, lambda ids, found: (ids, found)).select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("part").alias("block"), "data")

    def search(left, right):
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for tree in map(Tree.of_state, map(pickle.loads, _bytes(left))):
            for ids, found in map(pickle.loads, _bytes(right)):
                places, scores = tree.search(ids, found, k, factor)
                at, column = np.nonzero(places >= 0)
                for part, values in zip(out, (ids[at], tree.ids[places[at, column]], scores[at, column])):
                    part.append(values)
        return pa.table({n: np.concatenate(p) for n, p in zip(("query_id", "vec_id", "score"), out)})

    met = trees.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _bytes(table: pa.Table) -> Iterator[bytes]:
    return (x.as_py() for x in table["data"])
