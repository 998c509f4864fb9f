"""Read a source table from a relational database, in parallel over a numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Filters, column choice and aggregates are pushed down to the database by Spark.

    Needs the database's driver on the class path; without ``partition_column`` a single task reads
    the whole table.
    """
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
        .options(**(properties or {}))
    )
    if partition_column is not None:
        if bounds is None:
            raise ValueError("partition_column needs the lowest and highest value as bounds")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
            .option("numPartitions", partitions)
        )
    return reader.load()
