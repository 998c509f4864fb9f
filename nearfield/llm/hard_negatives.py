"""Hard negatives: for an anchor and each of its positives, the rows of other labels that score just below the positive.

Vectors become integers, and a score is their inner product. The best rows are found with shared lists: anchors are
clustered by direction; within a shard of rows each cluster sorts them once by an upper bound that holds for all its
members (length times the cosine of the angle to the cluster's centre less the widest angle of a member), and every
member walks that list until the bound certifies that nothing behind can matter. Positives take one pass, negatives a
second one in which every positive is a window of scores.

Rows are dealt to shards of bounded size by hash and move once; anchors travel to every shard, one cluster after the
other, and are read as a stream there. A task gives at most as many rows per anchor and window as are wanted, and these
are ranked where they meet. The driver sees a bounded sample of anchors, to place the centres, and one angle per centre.

Rows without id, label or vector, and vectors that hold null or non-finite components, take no part. Rows that share an
id count once, with the least label and then the vector that sorts first. Vectors score only with those of their own
length; a zero or empty vector scores 0. Of equal scores the smaller id comes first; copies of a vector under other ids
are rows of their own. Positives of equal score have the same window and so the same negatives, each of them its own rows. Scores that
a long integer cannot hold are an error. Without anchors, positives or negatives there are no rows. Other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# A negative's score in percent of the positive's.
LOW, HIGH = 30, 90
# Anchors at most that centres are placed on, and centres at most of one length of vectors.
SAMPLE, CENTRES = 4096, 64
# Bytes of vectors in a shard, about, and its least rows where there are cores to spare.
SHARD_BYTES, SHARD_ROWS = 32 << 20, 4096
# Anchors and rows that are multiplied at a time.
BLOCK, STEP = 512, 1024
# Added to every cosine of a bound: far more than the rounding of angles.
SLACK = 1e-7
_NONE = np.iinfo(np.int64).min
_EXACT, _MOST = 2.0**52, 2.0**56

TRAVEL = "dim int, shard int, kind int, cluster int, label bigint, vec_id bigint, embedding array<double>, windows array<bigint>"
FOUND = "anchor_id bigint, window bigint, vec_id bigint, score bigint"


def taking_part(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim and the vector in integers of the rows that take part, one row per id."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return (rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
            .groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one"))
            .select("vec_id", "one.label", "one.embedding")
            .select("vec_id", "label", F.size("embedding").alias("dim"), whole.alias("embedding")))


def centres(vectors: np.ndarray, most: int = CENTRES, rounds: int = 10) -> np.ndarray:
    """Unit vectors in the middle of clusters of directions; zero vectors are left out."""
    lengths = np.sqrt((vectors * vectors).sum(1))
    units = np.unique(vectors[lengths > 0] / lengths[lengths > 0, None], axis=0)
    count = int(np.clip(np.sqrt(len(units)) / 2, 1, most))
    if not len(units):
        return np.zeros((0, vectors.shape[1]))
    middle = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = (units @ middle.T).argmax(1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, units)
        size = np.sqrt((sums * sums).sum(1))
        middle = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], middle)
    return middle


class Shard:
    """Rows of one shard, and the list of the cluster at hand."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.longest = float(self.lengths.max(initial=0))

    def sort_for(self, centre: np.ndarray | None, widest: float) -> None:
        """Order all rows by what a member of the cluster, at most ``widest`` from its centre, can score at most."""
        if centre is None:
            bound = self.lengths * (1 + SLACK)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                cosines = np.nan_to_num(self.vectors @ centre / self.lengths)
            between = np.maximum(np.arccos(np.clip(cosines, -1, 1)) - widest, 0)
            bound = self.lengths * (np.cos(between) + SLACK)
        self.order = np.argsort(-bound, kind="stable")
        self.bounds = bound[self.order]
        self.sorted_labels = self.labels[self.order]

    def walk(self, ids: np.ndarray, label: int, vectors: np.ndarray, best: Best, same: bool) -> int:
        """Offer the cluster's list to anchors of one label until nothing behind can matter; gives the rows looked at."""
        mine = np.flatnonzero((self.sorted_labels == label) == same)
        lengths = np.sqrt((vectors * vectors).sum(1))
        size, at, looked = STEP, 0, 0
        going = best.going(np.inf * np.ones(len(ids)))
        while at < len(mine) and len(going):
            members, places = np.unique(best.member[going], return_inverse=True)
            chosen = self.order[mine[at : at + size]]
            scores = products(vectors[members], self.vectors[chosen], float(lengths.max()) * self.longest)
            scores[ids[members][:, None] == self.ids[chosen][None, :]] = _NONE
            best.offer(going, scores[places], self.ids[chosen])
            at += size
            looked += len(members) * len(chosen)
            if at < len(mine):
                going = best.going(self.bounds[mine[at]] * lengths)
        return looked


def products(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of vectors of whole numbers; ``most`` bounds their size."""
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    if most < _MOST:
        return left.astype(np.int64) @ right.T.astype(np.int64)
    raise ValueError("scores of these vectors do not fit a long integer")


class Best:
    """The best rows within a range of scores, for several ranges (windows) per anchor."""

    def __init__(self, member: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.member, self.low, self.high, self.k = member, low, high, k
        # the k best scores so far, the least of them first
        self.scores = np.full((len(member), k), _NONE)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def going(self, bounds: np.ndarray) -> np.ndarray:
        """Windows for which a score of at most ``bounds`` (one per anchor) can matter."""
        needed = np.maximum(self.scores[:, 0], self.low)
        return np.flatnonzero((bounds[self.member] >= needed) & (self.low <= self.high))

    def offer(self, going: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        within = (scores >= self.low[going, None]) & (scores <= self.high[going, None]) & (scores > _NONE)
        scores = np.where(within, scores, _NONE)
        both = np.hstack([self.scores[going], scores])
        self.scores[going] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.scores[going] = np.sort(self.scores[going], axis=1)
        rows, columns = np.nonzero(within & (scores >= self.scores[going, :1]))
        self.held.append((going[rows], scores[rows, columns], ids[columns]))
        self.n += len(rows)
        # equal scores may be many: only those with the smallest ids are kept
        if self.n > 4 * self.k * len(self.member) + 10 * STEP:
            self.held = [self.result()]
            self.n = len(self.held[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, score and id of the best k of each window."""
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        window, score, found = (np.concatenate(part) for part in zip(*self.held))
        order = np.lexsort((found, -score, window))
        window, score, found = window[order], score[order], found[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        return window[rank < self.k], score[rank < self.k], found[rank < self.k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values in ``columns``, at most ``most`` at a time."""
    for batch in batches:
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            for at in range(start, end, most):
                yield tuple(int(k[at]) for k in keys), pa.Table.from_batches([batch.slice(at, min(most, end - at))])


def _meet(rows: DataFrame, anchors: DataFrame, shards: int, fitted: dict, same: bool, k: int, window) -> DataFrame:
    """The best rows of every shard for every anchor and window: anchor_id, window, vec_id, score.

    ``anchors`` has the windows as numbers; ``window`` gives the least and the largest score of one.
    """
    own = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                      F.lit(0).alias("cluster"), "label", "vec_id", "embedding", F.lit(None).cast("array<bigint>").alias("windows"))
    asked = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
                           "cluster", "label", "vec_id", "embedding", "windows")
    together = own.unionByName(asked).repartition(shards, "dim", "shard").sortWithinPartitions(
        "dim", "shard", "kind", "cluster", "label", "vec_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shard = sorted_for = None
        parts: list[tuple] = []
        for (dim, number, kind, cluster, label), table in _runs(batches, ["dim", "shard", "kind", "cluster", "label"], BLOCK):
            if (dim, number) != at:
                at, shard, sorted_for, parts = (dim, number), None, None, []
            table = table.combine_chunks()
            ids, vectors = table["vec_id"].to_numpy(), _matrix(table["embedding"].combine_chunks(), dim)
            if kind == 0:
                parts.append((ids, np.full(len(ids), label), vectors))
                continue
            if not parts and shard is None:
                continue
            if shard is None:
                shard, parts = Shard(*(np.concatenate(p) for p in zip(*parts))), []
            if sorted_for != cluster:
                shard.sort_for(*fitted.get((dim, cluster), (None, 0.0)))
                sorted_for = cluster
            windows = table["windows"].to_pylist()
            member = np.repeat(np.arange(len(ids)), [len(w) for w in windows])
            named = np.array([x for w in windows for x in w], dtype=np.int64)
            best = Best(member, *window(named), k)
            shard.walk(ids, label, vectors, best, same)
            which, scores, found = best.result()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[member[which]], named[which], found, scores)],
                                             names=["anchor_id", "window", "vec_id", "score"])

    return together.mapInArrow(task, FOUND)


def _clustered(anchors: DataFrame) -> tuple[DataFrame, dict]:
    """Anchors with their cluster, and per length and cluster its centre and the widest angle of a member."""
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(row["embedding"])
    middles = {dim: centres(np.array(v, dtype=np.float64).reshape(len(v), dim)) for dim, v in by_dim.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), table in _runs(batches, ["dim"], BLOCK):
            middle = middles.get(dim)
            cluster, angle = np.zeros(len(table), np.int32), np.full(len(table), np.pi)
            if middle is not None and len(middle):
                vectors = _matrix(table["embedding"].combine_chunks(), dim)
                lengths = np.sqrt((vectors * vectors).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosines = np.nan_to_num(vectors @ middle.T / lengths[:, None], nan=1.0)
                cluster = cosines.argmax(1).astype(np.int32)
                angle = np.arccos(np.clip(cosines.max(1), -1, 1))
            out = table.append_column("cluster", pa.array(cluster)).append_column("angle", pa.array(angle))
            yield from out.combine_chunks().to_batches()

    named = anchors.select("dim", "vec_id", "label", "embedding")
    clustered = materialize(named.mapInArrow(
        assign, "dim int, vec_id bigint, label bigint, embedding array<double>, cluster int, angle double"), "anchors")
    # one row per centre that was placed; other lengths have one cluster of all directions
    widest = clustered.where(F.col("dim").isin([int(d) for d in middles])).groupBy("dim", "cluster").agg(
        F.max("angle").alias("angle")).collect()
    return clustered.drop("angle"), {
        (r["dim"], r["cluster"]): (middles[r["dim"]][r["cluster"]], r["angle"] + SLACK)
        for r in widest if len(middles[r["dim"]])}


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id. An anchor's positives are the best
    ``positives`` other rows of its label; for each come the best ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's.
    """
    rows = materialize(taking_part(rows, scale), "rows")
    size = rows.agg(F.count("*").alias("n"), F.sum("dim").alias("numbers")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-8 * (size["numbers"] or 0) // SHARD_BYTES), min(cores, -(-size["n"] // SHARD_ROWS)))
    anchors, fitted = _clustered(rows.where(is_anchor))

    def everything(named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(named), _NONE + 1), np.full(len(named), np.iinfo(np.int64).max)

    def percent(named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -((-low * named) // 100), (high * named) // 100

    all_scores = anchors.withColumn("windows", F.array(F.lit(0).cast("bigint")))
    chosen = materialize(_best(_meet(rows, all_scores, shards, fitted, True, positives, everything), positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` numbers per anchor
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("windows"))
    asked = anchors.join(windows, "vec_id")
    found = _best(_meet(rows, asked, shards, fitted, False, negatives, percent), negatives)
    found = found.withColumnRenamed("anchor_id", "vec_of").withColumnRenamed("window", "score_of")
    same = (F.col("anchor_id") == F.col("vec_of")) & (F.col("positive_score") == F.col("score_of"))
    return chosen.join(found, same).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
