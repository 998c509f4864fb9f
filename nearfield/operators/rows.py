"""Rows, keys and embedding coverage of a source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.functions import text as X
from nearfield.functions.scoring import coverage_pct
from nearfield.functions.text import quoted
from nearfield.operators.joins import rows_with_keys, rows_without_keys

DETAIL_WIDTH = 2000


def with_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose source columns are all present, with the text to embed."""
    return df.where(X.has_content(columns)).withColumn("content", X.content(columns))


def unembedded_rows(source: DataFrame, embeddings: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Source rows with content that have no embedding row yet."""
    return rows_without_keys(source.where(X.has_content(columns)), embedded_keys(embeddings, key), key)


def embedded_keys(embeddings: DataFrame, key: list[str]) -> DataFrame:
    """Each embedded key once: a chunked row may own a large share of the embedding table.

    Every handled row has exactly one first chunk, or a marker without a chunk number, so no shuffle
    is needed to make the keys distinct.
    """
    if "chunk_index" in embeddings.columns:
        embeddings = embeddings.where(F.coalesce("chunk_index", F.lit(0)) == 0)
    return embeddings.select(*[quoted(c) for c in key])


def orphan_embeddings(embeddings: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Keys of embedded rows whose source row is gone; only keys are shuffled."""
    return embedded_keys(embeddings, key).join(source.select(*[quoted(c) for c in key]), key, "left_anti")


def keyset_page(df: DataFrame, key: list[str], limit: int, after: list[object] | None = None) -> DataFrame:
    """The next ``limit`` rows in key order after the key ``after``."""
    rows = df if after is None else df.where(X.key_after(key, after))
    return rows.orderBy(*[quoted(c).asc() for c in key]).limit(limit)


def key_types(df: DataFrame, key: list[str]) -> dict:
    return {c: df.schema[c].dataType for c in key}


def row_detail(df: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """One row by its row id as display text, without its vector."""
    types = key_types(df, key)
    parts = X.key_from_row_id(row_id, types)
    for name, part in zip(key, parts):
        df = df.where(quoted(name) == F.lit(part).try_cast(types[name]))
    return df.limit(1).select(*[X.display_value(f, DETAIL_WIDTH) for f in df.schema.fields if f.name != "embedding"])


def fetch_content(keys: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Content per requested key; null if the row is gone or a source column is null."""
    wanted = keys.select(*[quoted(c) for c in key]).distinct()
    found = rows_with_keys(source.select(*[quoted(c) for c in key], X.content(columns).alias("content")), wanted, key)
    return wanted.join(found, key, "left")


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that are null or occur more than once; empty for a valid key."""
    missing: Column = F.lit(False)
    for name in key:
        missing = missing | quoted(name).isNull()
    return df.groupBy(*[quoted(c) for c in key]).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def require_key(df: DataFrame, key: list[str]) -> None:
    """Refuse a declared key that does not identify rows."""
    bad = key_violations(df, key).first()
    if bad is not None:
        raise NearfieldError(f"{key} does not identify rows, for example {bad.asDict()}")


def count_embedded(embeddings: DataFrame, key: list[str]) -> DataFrame:
    """Rows that have an embedding; a chunked row counts once."""
    present = embeddings.where(quoted("embedding").isNotNull())
    return embedded_keys(present, key).agg(F.count("*").alias("embedded"))


def count_content(source: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that could be embedded, and all rows, in one pass over the source columns."""
    return source.agg(F.count_if(X.has_content(columns)).alias("with_content"), F.count("*").alias("total_rows"))


def coverage(
    source: DataFrame, embeddings: DataFrame, key: list[str], columns: list[str]
) -> DataFrame:
    """One row: embedded rows, rows with content and the share of the two in percent."""
    counts = count_content(source, columns).select(F.col("with_content").alias("total"))
    # two one-row aggregates side by side
    both = count_embedded(embeddings, key).withColumn("one", F.lit(1)).join(
        counts.withColumn("one", F.lit(1)), "one"
    )
    return both.select("embedded", "total", coverage_pct(F.col("embedded"), F.col("total")).alias("coverage_pct"))


def inline_view(source: DataFrame, embeddings: DataFrame, key: list[str]) -> DataFrame:
    """The source with its embedding as one more column, null where there is none."""
    vectors = embeddings.select(*[quoted(c) for c in key], quoted("embedding"))
    return source.join(vectors, key, "left")
