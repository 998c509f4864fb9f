"""Coverage and queue state of the registered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import JOB_ERRORS, NearfieldError
from nearfield.functions.scoring import coverage_pct
from nearfield.operators.jobs import queue_depth
from nearfield.operators.rows import coverage, embedded_keys
from nearfield.registry import Registry, TableEntry

COLUMNS = (
    "table_name string, table_schema string, model string, storage string, applied_at string, "
    "embedded bigint, total bigint, coverage_pct double, migrating boolean, error string"
)


def table_status(spark: SparkSession, entry: TableEntry) -> DataFrame:
    """One row: counts and coverage of one table, all of one snapshot; its model is the one the snapshot names."""
    table = entry.embeddings(spark)
    snap = table.snapshot()
    counts = coverage(entry.rows(spark), table.read(snap.version), entry.primary_key, entry.columns)
    return counts.select(
        F.lit(entry.table).alias("table_name"),
        F.lit(entry.schema).alias("table_schema"),
        F.lit(snap.model).alias("model"),
        F.lit(entry.storage).alias("storage"),
        F.lit(entry.applied_at).alias("applied_at"),
        "embedded",
        "total",
        "coverage_pct",
        F.lit(snap.staged is not None).alias("migrating"),
        F.lit(None).cast("string").alias("error"),
    )


def status(spark: SparkSession, registry: Registry, jobs: DataFrame | None = None) -> DataFrame:
    """One row per registered table; a table that cannot be read becomes a row with its error."""
    rows, readable = [], []
    for entry in registry.entries:
        try:
            readable.append((entry, table_status(spark, entry)))
        except (*JOB_ERRORS, NearfieldError) as error:
            rows.append(_unreadable(entry, error))
    try:
        # one row per table, all in one job
        merged = reduce(DataFrame.unionByName, [one for _, one in readable], spark.createDataFrame([], COLUMNS))
        rows += merged.collect()
    except JOB_ERRORS:
        # one bad table must not fail the others
        for entry, one in readable:
            try:
                rows += one.collect()
            except JOB_ERRORS as error:
                rows.append(_unreadable(entry, error))
    merged = spark.createDataFrame(rows, COLUMNS)
    if jobs is None:
        return merged.withColumn("pending", F.lit(0).cast("bigint")).withColumn("failed", F.lit(0).cast("bigint"))
    # one row per table on either side
    names = [c for c in merged.columns if c in ("table_schema", "table_name") and c in jobs.columns]
    return merged.join(queue_depth(jobs), names, "left").fillna(0, ["pending", "failed"])


def _unreadable(entry: TableEntry, error: Exception) -> tuple:
    known = (entry.table, entry.schema, entry.model, entry.storage, entry.applied_at)
    return (*known, None, None, None, None, str(error).split("\n")[0])


def migration_progress(total: DataFrame, staged: DataFrame, key: list[str]) -> DataFrame:
    """Rows a migration has finished and rows it still has to do. ``total`` holds rows with content."""
    counted = total.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    done = embedded_keys(staged, key).agg(F.count("*").alias("already")).withColumn("one", F.lit(1))
    return counted.join(done, "one").select(
        "total",
        "already",
        F.greatest(F.lit(0), F.col("total") - F.col("already")).alias("remaining"),
        coverage_pct(F.col("already"), F.col("total")).alias("progress_pct"),
    )
