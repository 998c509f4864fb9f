"""Helpers shared by the operators of this folder: Arrow tasks with bounded batches, folds, small classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize

# Rows of text handed to Python at a time, so that a batch stays small even when texts are very long.
ROWS_PER_BATCH = 256


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones; other columns, whatever their names, are left out."""
    return docs.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def map_rows(df: DataFrame, each: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Run ``each`` over the rows of every partition, streaming; rows go in and come out as tuples.

    ``each`` may use ``df``'s columns in order. At most ROWS_PER_BATCH rows are turned into Python objects at a
    time, and as many results are held before they are passed on.
    """
    wanted = df.sparkSession.createDataFrame([], schema).schema
    names = wanted.names
    types = [_arrow(f.dataType) for f in wanted]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in each(_rows(batches)):
            held.append(row)
            if len(held) == ROWS_PER_BATCH:
                yield _batch(held, names, types)
                held = []
        if held:
            yield _batch(held, names, types)

    return df.mapInArrow(task, wanted)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_BATCH):
            part = batch.slice(start, ROWS_PER_BATCH)
            yield from zip(*(column.to_pylist() for column in part.columns))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text, modulo ``parts``; null keys fall in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, name: str) -> DataFrame:
    """doc_id, text and label of at most ``per_class`` labelled documents of each class, written once.

    Only rows of ``labels`` for which ``learn`` holds are used; the choice is by hash of doc_id, so it is the same
    in every run. The chosen ids are few, which is why they may be broadcast. Rows without a label are left out; of
    repeated rows for one document the larger label counts.
    """
    chosen = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = None
    for value in (0, 1):
        part = chosen.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    return materialize(text_rows(docs).join(F.broadcast(ids), "doc_id"), name)


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton steps on standardised features."""
    n, d = features.shape
    middle, spread = features.mean(0), features.std(0) + 1e-9
    x = np.hstack([(features - middle) / spread, np.ones((n, 1))])
    ridge = np.diag([penalty * n] * d + [1e-9])
    w = np.zeros(d + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / spread, w[-1])
    out[-1] -= (w[:-1] / spread * middle).sum()
    return out


def probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))


def keep_rows(docs: DataFrame, keep: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """The rows whose text passes; all columns stay as they are, whatever their names. A map: no shuffle.

    ``keep`` is called once per task and gives the test. Null texts are tested as empty ones.
    """
    place = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                yield part.filter(pa.array([passes(x or "") for x in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def unused(columns: list[str], name: str) -> str:
    """A name that no column has, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
