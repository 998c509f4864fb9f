"""Which text columns of which tables are worth embedding."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import JOB_ERRORS
from nearfield.functions import scoring
from nearfield.functions.text import quoted, text_columns

logger = logging.getLogger(__name__)

# Fixed value: share of rows looked at by default.
SAMPLE_SHARE = 0.05
SEED = 42
# Files that a sample must be expected to have if it is to be made of whole files.
LEAST_FILES = 50
COLUMNS = (
    "table_name string, table_schema string, column_name string, data_type string, "
    "avg_length double, sampled_rows bigint"
)


def sampled(df: DataFrame, share: float) -> DataFrame:
    """About ``share`` of the rows: whole files where a table has enough of them, so that the others are not read.

    Which files are taken is decided by a hash of their path while the scan is planned. Tables of few files are
    sampled row by row, which reads them.
    """
    if share >= 1.0:
        return df
    files = _file(df)
    if files is None or len(df.inputFiles()) * share < LEAST_FILES:
        return df.sample(share, seed=SEED)
    return df.where(F.pmod(F.xxhash64(files), F.lit(1 << 20)) < int(share * (1 << 20)))


def _file(df: DataFrame) -> Column | None:
    try:
        df.select("_metadata.file_path")
        return F.col("_metadata.file_path")
    except AnalysisException:
        return None


def length_estimates(df: DataFrame, columns: list[str], share: float = SAMPLE_SHARE) -> DataFrame:
    """Average length of every text column with the standard error of the estimate: column_name, avg_length, error,
    sampled_rows and files.

    Rows of one file are alike, so files are what is drawn: the average is the ratio of their sums, and its error
    comes from how far single files are from it. The error is 0 if everything was read, and null if the rows of
    fewer than two files were.
    """
    some = sampled(df, share)
    files = _file(df)
    counted = []
    for name in columns:
        length = F.length(quoted(name).cast("string"))
        counted += [F.sum(length).cast("double").alias(f"y_{name}"), F.count(quoted(name)).alias(f"x_{name}")]
    by_file = some.groupBy((F.lit("") if files is None else files).alias("_file")).agg(*counted)
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.coalesce(quoted(f"y_{name}"), F.lit(0.0)).alias("y"),
                 quoted(f"x_{name}").alias("x"))
        for name in columns
    ]
    sums = by_file.select("_file", F.inline(F.array(*entries))).where("x > 0").groupBy("column_name").agg(
        F.sum("y").alias("y"), F.sum("x").alias("x"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("files"))
    ratio = F.col("y") / F.col("x")
    spread = F.greatest(F.lit(0.0), F.col("yy") - 2 * ratio * F.col("xy") + ratio * ratio * F.col("xx"))
    several = F.col("files") > 1
    error = F.sqrt((1 - min(share, 1.0)) * F.col("files") * spread / (F.col("files") - 1)) / F.col("x")
    return sums.select(
        "column_name", ratio.alias("avg_length"), F.when(F.lit(share >= 1.0), 0.0).when(several, error).alias("error"),
        F.col("x").alias("sampled_rows"), "files")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average length and number of non-null values of every text column, in one aggregate."""
    sums = []
    for at, name in enumerate(columns):
        length = F.length(quoted(name).cast("string"))
        sums += [F.coalesce(F.avg(length), F.lit(0.0)).alias(f"a{at}"), F.count(quoted(name)).alias(f"n{at}")]
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"a{at}").alias("avg_length"), F.col(f"n{at}").alias("sampled_rows"))
        for at, name in enumerate(columns)
    ]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def table_profile(
    df: DataFrame, table: str, schema: str = "public", share: float = SAMPLE_SHARE, columns: list[str] | None = None
) -> DataFrame:
    """Profile of one table's text columns; a column the sample caught nothing of is read whole."""
    names = text_columns(df) if columns is None else columns
    return df.sparkSession.createDataFrame(_profiles({(table, schema): (df, names)}, share), COLUMNS)


def _profiles(tables: dict[tuple[str, str], tuple[DataFrame, list[str]]], share: float) -> list[tuple]:
    """Profiles of several tables in one job, plus one for the columns a sample missed.

    One row per text column comes back.
    """
    merged = None
    for (table, schema), (df, names) in tables.items():
        if not names:
            continue
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        type_of = F.create_map(*[F.lit(x) for name in names for x in (name, types[name])])
        one = text_lengths(sampled(df, share), names).select(
            F.lit(table).alias("table_name"),
            F.lit(schema).alias("table_schema"),
            "column_name",
            type_of[F.col("column_name")].alias("data_type"),
            "avg_length",
            "sampled_rows",
        )
        merged = one if merged is None else merged.unionByName(one)
    rows = [] if merged is None else [tuple(r) for r in merged.collect()]
    if share >= 1.0:
        return rows
    missed: dict[tuple[str, str], tuple[DataFrame, list[str]]] = {}
    for table, schema, name, _, _, seen in rows:
        if seen == 0:
            missed.setdefault((table, schema), (tables[table, schema][0], []))[1].append(name)
    return [r for r in rows if r[-1] > 0] + (_profiles(missed, 1.0) if missed else [])


def scored(profiles: DataFrame) -> DataFrame:
    """Candidates with score and stars, best first."""
    score = scoring.column_score(F.col("column_name"), F.col("avg_length"))
    return (
        profiles.withColumn("score", score)
        .withColumn("stars", scoring.stars(F.col("score")))
        .orderBy(F.desc("score"), F.desc("avg_length"), "table_name", "column_name")
    )


def inspect(
    spark: SparkSession, tables: dict[str, DataFrame], share: float = SAMPLE_SHARE, only: str | None = None
) -> DataFrame:
    """Score the text columns of all tables; a table that cannot be sampled reports zero length."""
    chosen = {(n, "public"): (df, text_columns(df)) for n, df in tables.items() if only is None or n == only}
    try:
        rows = _profiles(chosen, share)
    except JOB_ERRORS:
        # one bad table must not fail the others
        rows = []
        for table, (df, names) in chosen.items():
            try:
                rows += _profiles({table: (df, names)}, share)
            except JOB_ERRORS as error:
                logger.warning("cannot sample %s: %s", table[0], error)
                rows += [(*table, c, df.schema[c].dataType.simpleString(), 0.0, 0) for c in names]
    return scored(spark.createDataFrame(rows, COLUMNS))


def candidates_json(candidates: DataFrame) -> DataFrame:
    """One JSON object per candidate."""
    return candidates.select(F.to_json(F.struct(*[quoted(c) for c in candidates.columns])).alias("json"))
