"""Embed what is not embedded yet, reindex from scratch, and move a table to another model."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import CommitConflictError, NearfieldError
from nearfield.functions import text as X
from nearfield.functions.chunking import MAX_WORDS, OVERLAP, chunk_column
from nearfield.functions.embedders import Embedder, Models
from nearfield.functions.text import quoted
from nearfield.operators.joins import rows_with_keys, spread
from nearfield.operators.rows import embedded_keys, inline_view, unembedded_rows
from nearfield.registry import Registry, TableEntry
from nearfield.session import estimated_bytes, materialize

# Source bytes that are embedded before the result is committed.
STEP_BYTES = 256 << 30


@dataclass(frozen=True)
class IndexReport:
    """What one run wrote and how fast."""

    rows: int
    seconds: float

    @property
    def rows_per_minute(self) -> float:
        return round(60 * self.rows / self.seconds, 1) if self.seconds > 0 else 0.0


def chunk_rows(
    source: DataFrame, key: list[str], columns: list[str], max_words: int = MAX_WORDS, overlap: int = OVERLAP
) -> DataFrame:
    """Key, chunk number from 0 and chunk text; a blank text gives one row without a chunk.

    That row marks the text as handled, so that an incremental run does not meet it again.
    """
    chunks = chunk_column(F.col("_text"), max_words, overlap)
    return (
        spread(_texts(source, key, columns))
        .select(*[quoted(c) for c in key], chunks.alias("_chunks"))
        .select(*[quoted(c) for c in key], F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text"))
    )


def embed_rows(
    source: DataFrame,
    key: list[str],
    columns: list[str],
    model: Embedder,
    *,
    chunked: bool = False,
    max_words: int = MAX_WORDS,
    overlap: int = OVERLAP,
    errors: bool = False,
) -> DataFrame:
    """Rows for an embedding table; each text is embedded exactly once.

    With ``errors`` a text that the model refuses gives a row with its error in ``error_msg``; without,
    it is an error of the job.
    """
    text = "chunk_text" if chunked else "_text"
    rows = chunk_rows(source, key, columns, max_words, overlap) if chunked else spread(_texts(source, key, columns))
    if errors:
        rows = rows.withColumn("_result", model.column_or_error(F.col(text)))
        rows = rows.withColumn("embedding", F.col("_result.embedding")).withColumn("error_msg", F.col("_result.error"))
        return rows.drop("_result", "_text")
    return rows.withColumn("embedding", model.column(F.col(text))).drop("_text")


def _texts(source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return source.where(X.has_content(columns)).select(*[quoted(c) for c in key], X.content(columns).alias("_text"))


def _embed(entry: TableEntry, rows: DataFrame, model: Embedder) -> DataFrame:
    return embed_rows(
        rows, entry.primary_key, entry.columns, model,
        chunked=entry.chunked, max_words=entry.chunk_words, overlap=entry.chunk_overlap,
    )


def embedded_view(spark: SparkSession, entry: TableEntry) -> DataFrame:
    """The source as inline storage shows it: with its vectors as one more column."""
    if entry.chunked:
        raise NearfieldError(f"{entry.table} has many vectors per row and no inline view")
    return inline_view(entry.rows(spark), entry.embeddings(spark).read(), entry.primary_key)


def _steps(rows: DataFrame, key: list[str], steps: int | None) -> Iterator[DataFrame]:
    """The source in parts that are embedded and committed one after the other.

    A run that breaks off loses one part, not everything. Parts are sets of files where the source has
    files, so that each file is read once; otherwise each part is a share of the keys' hashes.
    """
    steps = steps or max(1, math.ceil(estimated_bytes(rows) / STEP_BYTES))
    if steps == 1:
        yield rows
        return
    split = _split(rows, key)
    for step in range(steps):
        yield rows.where(F.pmod(split, F.lit(steps)) == step)


def _split(rows: DataFrame, key: list[str]) -> Column:
    try:
        rows.select("_metadata.file_path")
        return F.xxhash64("_metadata.file_path")
    except AnalysisException:
        return F.xxhash64(*[quoted(c) for c in key])


def _to_embed(spark: SparkSession, entry: TableEntry, before: DataFrame | None, steps: int | None) -> Iterator[DataFrame]:
    """The rows that ``before`` has no embedding of, in parts.

    The embedded keys are read once for the whole run: what is left of the keys is written with its
    part, and each part then meets its own keys only.
    """
    rows, key = entry.rows(spark), entry.primary_key
    steps = steps or max(1, math.ceil(estimated_bytes(rows) / STEP_BYTES))
    if before is None:
        yield from _steps(rows, key, steps)
        return
    if steps == 1:
        yield unembedded_rows(rows, before, key, entry.columns)
        return
    part = F.pmod(_split(rows, key), F.lit(steps))
    names = [quoted(c) for c in key]
    wanted = rows.where(X.has_content(entry.columns)).select(*names, part.cast("int").alias("_step"))
    left = materialize(wanted.join(embedded_keys(before, key), key, "left_anti"), "keys-to-embed")
    for step in range(steps):
        yield rows_with_keys(rows.where(part == step), left.where(F.col("_step") == step).select(*names), key)


def index_table(spark: SparkSession, entry: TableEntry, models: Models, steps: int | None = None) -> IndexReport:
    """Embed the rows without an embedding and append them. Running it again resumes."""
    started = time.monotonic()
    table, written = entry.embeddings(spark), 0
    # the table itself says which model its vectors are of; an entry may be older
    model = models.get(table.snapshot().model)
    # the parts share no rows, so each is compared with what was there before the run, if anything
    before = table.read() if table.snapshot().live else None
    for part in _to_embed(spark, entry, before, steps):
        written += table.append(_embed(entry, part, model), model=model.key)
    return IndexReport(written, time.monotonic() - started)


def reindex_table(spark: SparkSession, entry: TableEntry, models: Models, steps: int | None = None) -> IndexReport:
    """Embed every row anew; searches see the old embeddings until the new ones are complete."""
    started = time.monotonic()
    written = _embed_beside(spark, entry, models.get(entry.embeddings(spark).snapshot().model), steps)
    return IndexReport(written, time.monotonic() - started)


def migrate_table(
    spark: SparkSession,
    registry: Registry,
    table: str,
    model_key: str,
    models: Models,
    registry_path: str | None = None,
    steps: int | None = None,
    schema: str | None = None,
) -> IndexReport:
    """Re-embed a table with another model beside the live rows, then switch over.

    A run that stopped half way continues with the rows it has not written yet.
    """
    started = time.monotonic()
    entry = registry.require(table, schema)
    model = models.get(model_key)
    if model_key == entry.embeddings(spark).snapshot().model:
        raise NearfieldError(f"{table} already uses model {model_key}")
    model.embed_query("test")  # the model must answer with the dimensions it declares
    written = _embed_beside(spark, entry, model, steps)
    lists = entry.embeddings(spark).lists()
    if lists.count() and lists.current() is None and entry.embeddings(spark).snapshot().live:
        # lists of the old model's vectors say nothing about the new ones
        lists.build(lists.count())
    entry.model, entry.model_name, entry.dims, entry.storage = model.key, model.model_name, model.dims, "external"
    if registry_path is not None:
        registry.save(spark, registry_path)
    return IndexReport(written, time.monotonic() - started)


def _embed_beside(spark: SparkSession, entry: TableEntry, model: Embedder, steps: int | None) -> int:
    """Embed all rows into a second set and make it the live one."""
    target, written = entry.embeddings(spark), 0
    target.begin_migration(model.key, model.model_name, model.dims)
    while True:
        start = target.snapshot()
        version, before = start.version, target.staged() if start.staged["live"] else None
        for part in _to_embed(spark, entry, before, steps):
            added = target.append(_embed(entry, part, model), staged=True, model=model.key)
            written += added
            version += added > 0
        now = target.snapshot()
        # rows changed meanwhile have lost their new vector and come up again
        if now.version == version:
            try:
                target.finish_migration(now)
                return written
            except CommitConflictError:
                continue
