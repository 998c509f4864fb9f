"""What tables there are, what they hold and what their first rows look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import NearfieldError
from nearfield.functions import text as X
from nearfield.functions.text import quoted

# How many rows and characters a sample or a schema overview shows.
SAMPLE_LIMIT, MAX_SAMPLE, SAMPLE_WIDTH = 5, 10, 200
CONTEXT_ROWS, CONTEXT_WIDTH = 3, 100
VECTOR_MARK = "[vector]"


def list_tables(spark: SparkSession, schemas: list[str] | None = None) -> DataFrame:
    """Tables and views of all databases, or of the given ones, by schema and name.

    Temporary views belong to the session and to no database; their schema is empty.
    """
    found = {
        (t.name, ".".join(t.namespace or []))
        for database in spark.catalog.listDatabases()
        for t in spark.catalog.listTables(database.name)
    }
    wanted = sorted(((name, schema) for name, schema in found if schemas is None or schema in schemas), key=lambda t: t[::-1])
    return spark.createDataFrame(wanted, "table_name string, table_schema string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count per table; for Parquet Spark reads the footers only."""
    merged = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        merged = one if merged is None else merged.unionByName(one)
    return merged


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Every column of every table with its type, nullability and position, and the table's row count."""
    spark = next(iter(tables.values())).sparkSession
    columns = [
        (name, at, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for at, f in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
    return spark.createDataFrame(columns, schema).join(row_counts(tables), "table_name")


def sample_rows(df: DataFrame, limit: int = SAMPLE_LIMIT, order: list[str] | None = None) -> DataFrame:
    """A few rows, at most MAX_SAMPLE, as short text; vectors are only marked."""
    if not 0 <= limit <= MAX_SAMPLE:
        raise NearfieldError(f"a sample has at most {MAX_SAMPLE} rows, asked for {limit}")
    rows = df.orderBy(*[quoted(c) for c in order]) if order else df
    return rows.select(*[_shown(f, SAMPLE_WIDTH) for f in df.schema.fields]).limit(limit)


def _shown(field: T.StructField, width: int):
    if field.name == "embedding":
        return F.when(quoted(field.name).isNotNull(), F.lit(VECTOR_MARK)).alias(field.name)
    return X.display_value(field, width)


def schema_context(tables: dict[str, DataFrame], keys: dict[str, list[str]], only: list[str] | None = None) -> DataFrame:
    """One row per table: its columns, its row count and its first rows as JSON.

    ``keys`` gives the order that decides which rows come first.
    """
    merged = None
    for name, df in tables.items():
        if only is not None and name not in only:
            continue
        plain = df.drop("embedding")
        columns = F.array(
            *[
                F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
                for f in plain.schema.fields
            ]
        )
        order = keys.get(name, plain.columns[:1])
        first = plain.orderBy(*[quoted(c) for c in order]).limit(CONTEXT_ROWS)
        shown = F.struct(*[X.display_value(f, CONTEXT_WIDTH) for f in plain.schema.fields])
        samples = first.select(F.struct(*[quoted(c) for c in order], F.to_json(shown).alias("_row")).alias("r")).agg(
            F.transform(F.sort_array(F.collect_list("r")), lambda r: r["_row"]).alias("samples")
        )
        count = df.agg(F.count("*").alias("row_count"))
        one = samples.withColumn("_one", F.lit(1)).join(count.withColumn("_one", F.lit(1)), "_one").select(
            F.lit(name).alias("table_name"), columns.alias("columns"), "row_count", "samples"
        )
        merged = one if merged is None else merged.unionByName(one)
    return merged
