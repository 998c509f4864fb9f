"""Approximate top-k: vectors in lists by nearest centroid, with short codes that are scanned before the vectors.

A query reads the lists whose centroids are closest to it. Within them it may first rank product-quantised codes
(a byte for each of several parts of a vector) and then only the best vectors in full. Vectors of all lists together are
all vectors: probing every list without codes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.functions.text import quoted
from nearfield.operators.topk import nearest

CENTROID_BYTES = 64 << 20
# Words of a code book, one byte each; vectors at most that code books are fitted on; numbers that one byte stands for.
WORDS, CODE_SAMPLE, NUMBERS_PER_BYTE = 256, 20_000, 8
PLACE = "list_id int, code binary"


@dataclass(frozen=True)
class Quantizer:
    """Centroids of the lists, and the code books: for each part of a vector its words."""

    centers: np.ndarray
    books: list[np.ndarray]

    @property
    def lists(self) -> int:
        return len(self.centers)

    def closest(self, query: Sequence[float], probes: int) -> list[int]:
        """The ``probes`` lists closest to a query."""
        if probes < 1:
            raise NearfieldError(f"at least one list must be probed, got {probes}")
        vector = np.asarray(query, dtype=np.float64)
        vector = vector / (np.sqrt((vector * vector).sum()) or 1.0)
        closeness = self.centers @ vector - (self.centers * self.centers).sum(axis=1) / 2
        return [int(i) for i in np.argsort(-closeness, kind="stable")[:probes]]

    def place(self, embedding: Column) -> Column:
        """list_id and code of a vector; a vector without direction stands in the first list and has no code."""
        by_column = np.ascontiguousarray(self.centers.T)
        half = (self.centers * self.centers).sum(axis=1) / 2
        books = self.books
        # centroids that tie up to rounding must not depend on the rows beside a vector
        digits = 12

        def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = _directions(batch, len(by_column))
                none = ~rows.any(axis=1)
                lists = np.where(none, 0, np.round(rows @ by_column - half, digits).argmax(axis=1)).astype(np.int32)
                if books:
                    bytes_ = np.stack([_nearest_word(part, book) for part, book in zip(_parts(rows, books), books)], axis=1)
                    codes = pa.array([None if n else b.tobytes() for b, n in zip(bytes_, none)], pa.binary())
                else:
                    codes = pa.nulls(len(rows), pa.binary())
                yield pa.StructArray.from_arrays([pa.array(lists), codes], names=["list_id", "code"])

        return F.arrow_udf(placed, PLACE)(embedding)

    def decoded(self, code: Column) -> Column:
        """The direction that a code stands for; no direction without a code."""
        books = self.books
        dims = self.centers.shape[1]

        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                codes = np.zeros((len(batch), len(books)), np.uint8)
                known = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
                if len(known):
                    codes[known] = np.frombuffer(b"".join(batch.drop_null().to_pylist()), np.uint8).reshape(-1, len(books))
                rows = np.concatenate([book[codes[:, i]] for i, book in enumerate(books)], axis=1).astype(np.float32)
                rows[~np.isin(np.arange(len(batch)), known)] = 0
                yield pa.ListArray.from_arrays(np.arange(0, rows.size + 1, dims, dtype=np.int32), rows.ravel())

        return F.arrow_udf(vectors, "array<float>")(code)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("center", i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        rows += [(f"book-{b}", i, [float(x) for x in w]) for b, book in enumerate(self.books) for i, w in enumerate(book)]
        spark.createDataFrame(rows, "kind string, number int, value array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Quantizer:
        """Centroids and words were bounded when they were made."""
        by_kind: dict[str, list] = {}
        for row in spark.read.parquet(path).orderBy("kind", "number").collect():
            by_kind.setdefault(row["kind"], []).append(row["value"])
        books = [np.asarray(by_kind[f"book-{b}"]) for b in range(len(by_kind) - 1)]
        return cls(np.asarray(by_kind["center"], dtype=np.float64), books)


def fit(
    vectors: DataFrame, lists: int, *, seed: int = 42, centroids: Sequence | None = None, code_bytes: int | None = None
) -> Quantizer:
    """Centroids fitted on all vectors, or given ones, and code books fitted on at most CODE_SAMPLE vectors.

    ``code_bytes`` is the length of a code; None is a byte for every eight numbers, 0 means no codes.
    """
    present = vectors.where(quoted("embedding").isNotNull()).select("embedding")
    one = present.first()
    if one is None:
        raise NearfieldError("there are no vectors to place in lists")
    dims = len(one["embedding"])
    if lists * dims * 8 > CENTROID_BYTES:
        raise NearfieldError(f"{lists} centroids of {dims} dimensions are too many to share")
    if centroids is None:
        # one list needs no centroid of its own
        centers = _fitted(present, lists, seed) if lists > 1 else np.zeros((1, dims))
    else:
        centers = np.asarray(centroids, dtype=np.float64)
        if centers.shape != (lists, dims):
            raise NearfieldError(f"expected {lists} centroids of {dims} dimensions, got {centers.shape}")
    code_bytes = max(1, dims // NUMBERS_PER_BYTE) if code_bytes is None else min(code_bytes, dims)
    if not code_bytes:
        return Quantizer(centers, [])
    # the hash decides, so the sample is the same in every run
    sample = present.orderBy(F.xxhash64("embedding")).limit(CODE_SAMPLE).collect()
    rows = np.asarray([r["embedding"] for r in sample], dtype=np.float64).reshape(-1, dims)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    rows = rows[lengths > 0] / lengths[lengths > 0, None]
    parts = np.array_split(rows if len(rows) else np.zeros((1, dims)), code_bytes, axis=1)
    return Quantizer(centers, [_words(part) for part in parts])


def _words(part: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Words in the middle of clusters of one part of the vectors."""
    words = np.unique(part, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(WORDS, len(words))).astype(int)]
    for _ in range(rounds):
        nearest_word = _nearest_word(part, words)
        counts = np.bincount(nearest_word, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, nearest_word, part)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _nearest_word(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (part @ words.T - (words * words).sum(axis=1) / 2).argmax(axis=1).astype(np.uint8)


def _parts(rows: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(rows, np.cumsum([book.shape[1] for book in books])[:-1], axis=1)


def _directions(batch: pa.Array, dims: int) -> np.ndarray:
    rows = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(rows / np.sqrt((rows * rows).sum(axis=1))[:, None])


def _fitted(present: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Centroids of the directions of all vectors that have one."""
    training = present.where(F.exists("embedding", lambda x: x != 0)).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("_v")
    )
    # every round of the fit reads the vectors again
    training = Normalizer(inputCol="_v", outputCol="features").transform(training).select("features").persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        return np.asarray(KMeans(k=lists, seed=seed, maxIter=10).fit(training).clusterCenters(), dtype=np.float64)
    finally:
        training.unpersist()


def build_lists(
    vectors: DataFrame, key: list[str], path: str, lists: int, seed: int = 42, centroids: Sequence | None = None
) -> None:
    """Write every vector of a table that does not change under the list of its nearest centroid.

    Centroids are fitted on all vectors, or given. The lists of a table that changes are kept by ``VectorLists``.
    """
    present = vectors.where(quoted("embedding").isNotNull()).select(*[quoted(c) for c in key], "embedding")
    quantizer = fit(present, lists, seed=seed, centroids=centroids, code_bytes=0)
    (
        present.withColumn("_place", quantizer.place(F.col("embedding")))
        .select(*[quoted(c) for c in key], "embedding", F.col("_place.list_id").alias("list_id"))
        # a list that holds a large share of all vectors is split over several tasks and files
        .hint("rebalance", "list_id")
        .write.partitionBy("list_id").parquet(f"{path}/lists")
    )
    # written last: a build that broke off is never read
    quantizer.save(vectors.sparkSession, f"{path}/centroids")


def probe(spark: SparkSession, path: str, key: list[str], query: Sequence[float], k: int, probes: int) -> DataFrame:
    """Top-k among the ``probes`` lists closest to the query; probing all lists is exact."""
    return nearest(probed(spark, path, query, probes), key, query, k)


def probed(spark: SparkSession, path: str, query: Sequence[float], probes: int) -> DataFrame:
    """The vectors of the ``probes`` lists closest to the query, as they were written."""
    chosen = Quantizer.load(spark, f"{path}/centroids").closest(query, probes)
    # a filter on the partition column: the other lists are not even listed
    return spark.read.parquet(f"{path}/lists").where(F.col("list_id").isin(chosen)).drop("list_id")


def recall(exact: DataFrame, approximate: DataFrame, key: list[str]) -> DataFrame:
    """Share of the exact result found by the approximate one."""
    hits = exact.select(*key).join(approximate.select(*key).withColumn("_hit", F.lit(1)), key, "left")
    return hits.agg(F.round(F.avg(F.coalesce(F.col("_hit"), F.lit(0)).cast("double")), 4).alias("recall"))
