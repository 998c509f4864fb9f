"""Register tables for search, and remove them again."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import JOB_ERRORS, NearfieldError, RegistryError
from nearfield.functions.chunking import MAX_WORDS, OVERLAP, check_window
from nearfield.functions.embedders import Models
from nearfield.operators.rows import require_key
from nearfield.registry import Registry, TableEntry, check_identifier
from nearfield.sources.embedding_table import EmbeddingTable

# Fixed value: tables registered in one request.
BULK_LIMIT = 20
REPORT = "table_name string, ok boolean, message string"


def apply_table(
    spark: SparkSession,
    registry: Registry,
    models: Models,
    *,
    table: str,
    source: str,
    root: str,
    primary_key: list[str],
    column: str | None = None,
    columns: list[str] | None = None,
    schema: str = "public",
    model: str = "local",
    storage: str = "external",
    chunked: bool = False,
    chunk_words: int = MAX_WORDS,
    chunk_overlap: int = OVERLAP,
    buckets: int = 32,
    check_key: bool = True,
) -> TableEntry:
    """Check a table, create its embedding table and register it.

    ``check_key`` counts every key once, a shuffle of the key columns; leave it out where the source
    guarantees its key.
    """
    if (column is None) == (columns is None):
        raise RegistryError("give either column or columns")
    for name in (table, schema):
        check_identifier(name)
    if storage not in ("inline", "external"):
        raise RegistryError(f"unknown storage {storage!r}")
    check_window(chunk_words, chunk_overlap)
    chosen = models.get(model)
    entry = TableEntry(
        table=table,
        source=source,
        columns=[column] if column else list(columns),
        model=chosen.key,
        model_name=chosen.model_name,
        dims=chosen.dims,
        path=f"{root}/{schema}.{table}",
        schema=schema,
        primary_key=list(primary_key),
        storage="external" if chunked else storage,
        chunked=chunked,
        chunk_words=chunk_words,
        chunk_overlap=chunk_overlap,
        applied_at=datetime.now(timezone.utc).isoformat(timespec="seconds"),
    )
    rows = entry.rows(spark)
    missing = [c for c in [*entry.columns, *entry.primary_key] if c not in rows.columns]
    if missing or not entry.primary_key:
        raise RegistryError(f"{table} has no column {', '.join(missing)}" if missing else f"{table} needs a key")
    if check_key:
        require_key(rows, entry.primary_key)
    key_schema = T.StructType([rows.schema[c] for c in entry.primary_key])
    EmbeddingTable.create(
        spark, entry.path, key_schema, chosen.key, chosen.model_name, chosen.dims, ",".join(entry.columns),
        chunked=chunked, buckets=buckets,
    )
    registry.put(entry)
    return entry


def apply_many(spark: SparkSession, registry: Registry, models: Models, requests: list[dict]) -> DataFrame:
    """Register several tables; one that fails does not stop the others."""
    if len(requests) > BULK_LIMIT:
        raise RegistryError(f"at most {BULK_LIMIT} tables at a time")
    report = []
    for request in requests:
        name = str(request.get("table"))
        try:
            apply_table(spark, registry, models, **request)
            report.append((name, True, "registered"))
        except (NearfieldError, *JOB_ERRORS, TypeError) as error:
            report.append((name, False, str(error).split("\n")[0]))
    return spark.createDataFrame(report, REPORT)


def teardown_table(
    spark: SparkSession, registry: Registry, table: str, jobs: DataFrame | None = None, schema: str | None = None
) -> tuple[dict[str, bool], DataFrame | None]:
    """Remove embeddings, registration and jobs of a table; says what was there to remove.

    Returns the jobs that are left, for the caller to write. Where jobs name a schema, those of a table
    of the same name in another schema stay.
    """
    entry = registry.require(table, schema)
    own = F.col("table_name") == entry.table
    if jobs is not None and "table_schema" in jobs.columns:
        own = own & F.coalesce(F.col("table_schema") == entry.schema, F.lit(True))
    removed = {
        "embeddings": entry.embeddings(spark).drop(),
        "registration": registry.remove(entry.table, entry.schema),
        "jobs": jobs is not None and jobs.where(own).take(1) != [],
    }
    return removed, None if jobs is None else jobs.where(~own)
