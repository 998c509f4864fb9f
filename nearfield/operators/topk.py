"""Exact cosine top-k: one query, many queries, and best chunk per row.

Scores never leave the tasks that computed them: each task keeps the best k rows it has seen per
query and only those rows meet in the final merge. The result does not depend on how the rows are
partitioned, since a row of the global top-k is in the top-k of whichever task holds it. There is one
way to score, whatever the size of the table: similarities are rounded to 12 digits, equal ones are
ordered by key, and vectors of another length than the query's are an error.
"""

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.text import quoted
from nearfield.session import estimated_bytes, materialize

# Query vectors that are multiplied together, and that travel to the tasks for one scan.
QUERY_BYTES_PER_BLOCK, QUERY_BYTES_PER_PASS = 8 << 20, 64 << 20
# Queries that are fetched without being counted first.
FEW_QUERIES = 2000
# Groups in which the rows of one query are reduced before they meet.
MERGE_GROUPS = 64
# Scores a task holds in memory at a time, over all queries.
SCORES_AT_ONCE = 2_000_000

SIMILARITY = "similarity"


def by_similarity(key: list[str], similarity: str = SIMILARITY) -> list[Column]:
    """Best first; equal similarities in key order; vectors without direction last."""
    return [quoted(similarity).desc_nulls_last(), *[quoted(c).asc() for c in key]]


def nearest(
    vectors: DataFrame,
    key: list[str],
    query: Sequence[float],
    k: int,
    *,
    embedding: str = "embedding",
    part: str | None = None,
) -> DataFrame:
    """The ``k`` rows closest to ``query``: key columns [, part] and similarity.

    With ``part`` (a chunk number) rows sharing a key count once, by their best part. Only the key
    and the vector are read; join the winners back for anything else.
    """
    wanted = key + ([part] if part else [])
    present = vectors.where(quoted(embedding).isNotNull()).select(
        *[quoted(c) for c in wanted], quoted(embedding).alias("embedding")
    )
    local = _local_best(present, key, [([0], np.asarray([query], dtype=np.float64))], T.LongType(), k, part)
    if part is not None:
        local = _best_part(local, key, part)
    return local.drop("query_id").orderBy(*by_similarity(key)).limit(k)


def similarities(
    vectors: DataFrame,
    key: list[str],
    query: Sequence[float],
    *,
    embedding: str = "embedding",
    part: str | None = None,
) -> DataFrame:
    """Key columns [, part] and similarity of every vector, scored as ``nearest`` does.

    For joins with more than a broadcast holds: what is shuffled then is keys and numbers, not vectors.
    """
    wanted = key + ([part] if part else [])
    present = vectors.where(quoted(embedding).isNotNull()).select(
        *[quoted(c) for c in wanted], quoted(embedding).alias("embedding")
    )
    fields = [f for f in present.schema.fields if f.name != "embedding"]
    schema = T.StructType([*fields, T.StructField(SIMILARITY, T.DoubleType())])
    asked = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt((asked * asked).sum()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, values, norms = _unpacked(batch, wanted, len(asked))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.round((values @ asked) / (norms * length), 12)
                scored = rows.append_column(SIMILARITY, pa.array(scores, mask=np.isnan(scores)))
                yield from scored.combine_chunks().to_batches()

    return present.mapInArrow(score, schema)


def best_of(scored: DataFrame, key: list[str], k: int, part: str | None = None) -> DataFrame:
    """The ``k`` best of scored rows; with ``part`` rows sharing a key count once, by their best part."""
    if part is not None:
        best = Window.partitionBy(*key).orderBy(quoted(SIMILARITY).desc_nulls_last(), quoted(part).asc())
        scored = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return scored.orderBy(*by_similarity(key)).limit(k)


def nearest_batch(
    vectors: DataFrame,
    key: list[str],
    queries: DataFrame,
    query_key: str,
    k: int,
    *,
    embedding: str = "embedding",
    query_embedding: str = "embedding",
    part: str | None = None,
    pass_bytes: int = QUERY_BYTES_PER_PASS,
) -> DataFrame:
    """Top-k per query: query key, key columns [, part], similarity and rank.

    The vectors never move. Queries travel to them, ``pass_bytes`` at most in one scan; more of them take further
    scans, one after the other, each of which writes its winners and lets its queries go. Scoring so many queries
    costs far more than reading the vectors once more.
    """
    wanted = key + ([part] if part else [])
    present = vectors.where(quoted(embedding).isNotNull()).select(
        *[quoted(c) for c in wanted], quoted(embedding).alias("embedding")
    )
    asked = queries.where(quoted(query_embedding).isNotNull()).select(
        quoted(query_key).alias("query_id"), quoted(query_embedding).alias("vector")
    ).distinct()
    id_type = asked.schema["query_id"].dataType
    first = asked.limit(FEW_QUERIES + 1).collect()
    if len(first) <= FEW_QUERIES and _bytes(first) <= pass_bytes:
        return _ranked(_winners(present, key, _blocks(first, pass_bytes), id_type, k, part), key, query_key, k, part)
    asked = materialize(asked, "queries")
    size = asked.agg(F.sum(8 * F.size("vector")).alias("bytes")).first()["bytes"]
    # hashes are not quite even, so a pass is asked for half of what it may hold
    passes = math.ceil(2 * size / pass_bytes)
    found = None
    for number in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(passes)) == number).collect()
        if not rows:
            continue
        shared: list[Broadcast] = []
        best = _ranked(_winners(present, key, _blocks(rows, pass_bytes), id_type, k, part, shared), key, query_key, k, part)
        best = materialize(best, "winners")
        for one in shared:
            one.unpersist()
        found = best if found is None else found.unionByName(best)
    # a query that comes with several vectors has one list of winners
    again = Window.partitionBy(quoted(query_key)).orderBy(*by_similarity(key))
    return found.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def _bytes(rows: list) -> int:
    return sum(8 * len(r["vector"]) for r in rows)


def _blocks(rows: list, pass_bytes: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of queries in blocks of a bounded size."""
    if not rows:
        return
    at_once = max(1, min(QUERY_BYTES_PER_BLOCK, pass_bytes) // max(8, 8 * len(rows[0]["vector"])))
    for start in range(0, len(rows), at_once):
        block = rows[start : start + at_once]
        yield [r["query_id"] for r in block], np.asarray([r["vector"] for r in block], dtype=np.float64)


def _winners(
    present: DataFrame, key: list[str], blocks: Iterable[tuple[list, np.ndarray]], id_type: T.DataType, k: int, part: str | None,
    shared: list[Broadcast] | None = None,
) -> DataFrame:
    """The best rows of every task."""
    result = _local_best(present, key, blocks, id_type, k, part, shared)
    return result if part is None else _best_part(result, key, part)


def _ranked(result: DataFrame, key: list[str], query_key: str, k: int, part: str | None) -> DataFrame:
    # in two steps, so that the best rows of very many tasks do not meet in one
    groups = Window.partitionBy("query_id", "_group").orderBy(*by_similarity(key))
    per_task = result.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if estimated_bytes(result) > MERGE_GROUPS * per_task:
        result = result.withColumn("_group", F.pmod(F.xxhash64(*[quoted(c) for c in key]), F.lit(MERGE_GROUPS)))
        result = result.withColumn("rank", F.row_number().over(groups)).where(F.col("rank") <= k).drop("rank", "_group")
    ranked = Window.partitionBy("query_id").orderBy(*by_similarity(key))
    return (
        result.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumnRenamed("query_id", query_key)
    )


def _best_part(local: DataFrame, key: list[str], part: str) -> DataFrame:
    """One row per query and key; the input holds at most k rows per query and task."""
    best = Window.partitionBy("query_id", *key).orderBy(
        quoted(SIMILARITY).desc_nulls_last(), quoted(part).asc()
    )
    return local.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _local_best(
    present: DataFrame,
    key: list[str],
    blocks: Iterable[tuple[list, np.ndarray]],
    id_type: T.DataType,
    k: int,
    part: str | None,
    shared: list[Broadcast] | None = None,
) -> DataFrame:
    """Best ``k`` rows per query within each task; ``blocks`` are the ids and vectors of the queries.

    What is shared with the tasks is added to ``shared``.
    """
    schema = T.StructType(
        [T.StructField("query_id", id_type)]
        + [f for f in present.schema.fields if f.name != "embedding"]
        + [T.StructField(SIMILARITY, T.DoubleType())]
    )
    context = present.sparkSession.sparkContext
    sent = [
        context.broadcast((np.ascontiguousarray(matrix.T), np.sqrt((matrix * matrix).sum(axis=1)), ids))
        for ids, matrix in blocks
    ]
    if shared is not None:
        shared += sent
    if not sent:
        return present.sparkSession.createDataFrame([], schema)
    columns = [f.name for f in present.schema.fields if f.name != "embedding"]

    def best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [_Best(*block.value, columns, key, k, part) for block in sent]
        for batch in batches:
            if batch.num_rows:
                rows, values, norms = _unpacked(batch, columns, len(kept[0].by_column))
                for one in kept:
                    one.add(rows, values, norms)
        for one in kept:
            yield from one.batches()

    return present.mapInArrow(best_rows, schema)


def _unpacked(batch: pa.RecordBatch, columns: list[str], dims: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The plain columns, the vectors as a matrix in double precision, and their lengths."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    sizes = pc.list_value_length(vectors).to_numpy()
    if (sizes != dims).any():
        raise ValueError(f"query has {dims} dimensions, table holds {sorted(set(sizes.tolist()))}")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return pa.Table.from_batches([batch]).select(columns), values, np.sqrt((values * values).sum(axis=1))


class _Best:
    """The best rows of one task for one block of queries."""

    def __init__(
        self, by_column: np.ndarray, lengths: np.ndarray, ids: list, columns: list[str], key: list[str], k: int,
        part: str | None,
    ) -> None:
        self.by_column, self.lengths, self.ids = by_column, lengths, ids
        self.columns, self.key, self.k, self.part = columns, key, k, part
        self.slice_rows = max(1, SCORES_AT_ONCE // len(ids))
        # the k-th best similarity so far per query: anything lower can be skipped
        self.floor = np.full(len(ids), -np.inf)
        self.kept: pa.Table | None = None
        self.pending: list[pa.Table] = []

    def add(self, rows: pa.Table, values: np.ndarray, norms: np.ndarray) -> None:
        for start in range(0, len(values), self.slice_rows):
            some = slice(start, start + self.slice_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (values[some] @ self.by_column) / (norms[some, None] * self.lengths[None, :])
            # equal vectors must get equal scores wherever they sit in a batch
            scores = np.round(scores, 12)
            scores[np.isnan(scores)] = -np.inf
            cut = self.floor
            if self.part is None and len(scores) > self.k:
                cut = np.maximum(cut, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
            at, q = np.nonzero(scores >= cut)
            if len(at) == 0:
                continue
            found = rows.take(pa.array(at + start)).append_column("_s", pa.array(scores[at, q]))
            self.pending.append(found.append_column("_q", pa.array(q)))
            if sum(len(t) for t in self.pending) > 4 * self.k * len(self.ids):
                self.compact()

    def compact(self) -> None:
        order = [("_q", "ascending"), ("_s", "descending"), *[(c, "ascending") for c in self.columns]]
        rows = pa.concat_tables(([self.kept] if self.kept is not None else []) + self.pending).sort_by(order)
        if self.part is not None:
            rows = self._first_of(rows)
        q = rows["_q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        self.kept, self.pending = rows.filter(pa.array(rank < self.k)), []
        last = rank == self.k - 1
        self.floor[q[last]] = rows["_s"].to_numpy()[last]

    def _first_of(self, rows: pa.Table) -> pa.Table:
        """First row per query and key; rows come in with the best of each first."""
        numbered = rows.append_column("_at", pa.array(np.arange(len(rows))))
        first = numbered.group_by(["_q", *self.key]).aggregate([("_at", "min")])["_at_min"].to_numpy()
        return rows.take(pa.array(np.sort(first)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            self.compact()
        if self.kept is not None:
            scores, q = self.kept["_s"].to_numpy(), self.kept["_q"].to_numpy()
            out = self.kept.select(self.columns).add_column(0, "query_id", pa.array([self.ids[i] for i in q]))
            out = out.append_column(SIMILARITY, pa.array(scores, mask=np.isneginf(scores)))
            yield from out.combine_chunks().to_batches()
