"""Change events and the jobs made from them, as set operations.

A change has a table name, a row id (or key columns), an operation, a sequence number that orders
changes of one row, and a time. A job is the newest change of a row that still has to be applied.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import NearfieldError
from nearfield.functions.scoring import uptime, worker_status
from nearfield.functions.text import quoted
from nearfield.sources import files

# Operations, job states, retries before a job fails, jobs claimed at a time,
# the pause between polls and between heartbeats.
OPERATIONS = ["INSERT", "UPDATE", "DELETE"]
PENDING, PROCESSING, FAILED = "pending", "processing", "failed"
MAX_RETRIES = 3
CLAIM_SIZE = 10
POLL_MILLISECONDS = 500
HEARTBEAT_SECONDS = 60
# Buckets of a kept state.
STATE_BUCKETS = 1024

JOB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("retries", T.IntegerType()),
        T.StructField("error_msg", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
HEALTH_SCHEMA = T.StructType(
    [
        T.StructField("worker_id", T.StringType()),
        T.StructField("last_heartbeat", T.TimestampType()),
        T.StructField("jobs_processed", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
    ]
)


def operation_of(operation: Column) -> Column:
    """The operation in its fixed spelling, or null for one that is not known."""
    spelled = F.upper(F.trim(operation))
    return F.when(spelled.isin(OPERATIONS), spelled)


def coalesce_changes(
    changes: DataFrame, key: list[str], *, operation: str = "operation", sequence: str = "seq", at: str = "created_at"
) -> DataFrame:
    """One pending job per key: the last operation, the first time, the last time and sequence.

    All aggregates keep fixed-width buffers (operations travel as small numbers), so each task hashes
    its changes down to one row per key before the shuffle, however many changes one key has. Changes
    with an unknown operation are to be set aside before; one among them is an error, never a delete.
    """
    message = F.concat(F.lit("unknown operation: "), F.coalesce(quoted(operation), F.lit("null")))
    known = F.coalesce(operation_of(quoted(operation)), F.raise_error(message))
    code = F.array_position(F.array(*[F.lit(o) for o in OPERATIONS]), known).cast("int")
    coalesced = changes.groupBy(*[quoted(c) for c in key]).agg(
        F.max_by(code, quoted(sequence)).alias("_code"),
        F.max(quoted(sequence)).alias("seq"),
        F.min(quoted(at)).alias("created_at"),
        F.max(quoted(at)).alias("updated_at"),
        F.count("*").alias("changes"),
    )
    decoded = F.when(F.col("_code") > 0, F.element_at(F.array(*[F.lit(o) for o in OPERATIONS]), F.col("_code")))
    return coalesced.select(
        *[quoted(c) for c in key],
        decoded.alias("operation"),
        F.lit(PENDING).alias("status"),
        F.lit(0).alias("retries"),
        F.lit(None).cast("string").alias("error_msg"),
        "created_at",
        "updated_at",
        "seq",
        "changes",
    )


def merge_jobs(jobs: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Existing jobs with new changes folded in: a changed row starts over as pending, but keeps the
    time it first asked for work."""
    new = coalesce_changes(changes, key)
    first = jobs.select(*[quoted(c) for c in key], F.col("created_at").alias("_first"))
    updated = new.join(first, key, "left").withColumn(
        "created_at", F.least(F.col("_first"), F.col("created_at"))
    ).drop("_first")
    return jobs.join(new.select(*key), key, "left_anti").unionByName(updated, allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], watched: list[str]) -> DataFrame:
    """Changes between two states of a table: inserts, deletes, and updates of a watched column.

    Only the key and a digest of the watched columns are shuffled.
    """
    return _differences(_digested(before, key, watched), _digested(after, key, watched), key)


def _digested(df: DataFrame, key: list[str], watched: list[str]) -> DataFrame:
    digest = F.concat(*[F.coalesce(F.md5(quoted(c).cast("string").cast("binary")), F.lit("-")) for c in watched])
    return df.select(*[quoted(c) for c in key], digest.alias("_digest"))


def _differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    both = before.withColumnRenamed("_digest", "_old").join(after.withColumnRenamed("_digest", "_new"), key, "full_outer")
    operation = (
        F.when(F.col("_old").isNull(), "INSERT")
        .when(F.col("_new").isNull(), "DELETE")
        .when(F.col("_old") != F.col("_new"), "UPDATE")
    )
    return both.withColumn("operation", operation).where(F.col("operation").isNotNull()).select(*key, "operation")


class KeptState:
    """Keys and digests of a table as it was, in buckets, each with a digest of all its rows.

    The next state is compared bucket by bucket: its own bucket digests are added up where its rows are read, and only
    buckets that differ are read from what was kept, and shuffled. Two sums and a parity of hashes tell buckets apart.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def keep(cls, df: DataFrame, path: str, key: list[str], watched: list[str], buckets: int = STATE_BUCKETS) -> KeptState:
        """Write the state of ``df``; the digests come last, so a state that is not complete cannot be compared."""
        rows = cls._bucketed(_digested(df, key, watched), key, buckets)
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
        state = cls(df.sparkSession, path)
        written = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
        about = F.lit(json.dumps({"key": key, "watched": watched, "buckets": buckets})).alias("about")
        cls._digests(written, key).select("*", about).coalesce(1).write.parquet(f"{path}/digests")
        return state

    @staticmethod
    def _bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*[quoted(c) for c in key]), F.lit(buckets)).cast("int"))

    @staticmethod
    def _digests(rows: DataFrame, key: list[str]) -> DataFrame:
        own = F.xxhash64(*[quoted(c) for c in key], "_digest")
        return rows.groupBy("_bucket").agg(
            F.count("*").alias("_n"), F.sum(own.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
            F.sum(F.shiftrightunsigned(own, 32)).alias("_high"), F.bit_xor(own).alias("_parity"))

    def changes(self, after: DataFrame) -> DataFrame:
        """As ``snapshot_diff`` of the kept state and ``after``."""
        kept = self.spark.read.parquet(f"{self.path}/digests")
        first = kept.first()
        if first is None:
            raise NearfieldError(f"the state kept at {self.path} had no rows; compare with an empty table instead")
        about = json.loads(first["about"])
        key, buckets = about["key"], about["buckets"]
        now = self._bucketed(_digested(after, key, about["watched"]), key, buckets)
        names = ["_n", "_low", "_high", "_parity"]
        old, new = kept.select("_bucket", F.struct(*names).alias("_was")), self._digests(now, key).select(
            "_bucket", F.struct(*names).alias("_is"))
        # at most one row per bucket
        differ = [r["_bucket"] for r in old.join(new, "_bucket", "full_outer").where(
            ~F.col("_was").eqNullSafe(F.col("_is"))).select("_bucket").collect()]
        before = self.spark.read.schema(now.schema).parquet(f"{self.path}/rows")
        wanted = F.col("_bucket").isin(differ)
        return _differences(before.where(wanted).drop("_bucket"), now.where(wanted).drop("_bucket"), key)


def claim(jobs: DataFrame, limit: int = CLAIM_SIZE) -> DataFrame:
    """The oldest pending jobs."""
    return jobs.where(F.col("status") == PENDING).orderBy("created_at", "id").limit(limit)


def mark_claimed(jobs: DataFrame, claimed: DataFrame) -> DataFrame:
    """All jobs, the claimed ones marked as in progress. ``claimed`` holds at most one claim's jobs."""
    ids = F.broadcast(claimed.select("id", F.lit(True).alias("_mine")))
    mine = F.coalesce(F.col("_mine"), F.lit(False))
    return jobs.join(ids, "id", "left").withColumn(
        "status", F.when(mine, PROCESSING).otherwise(F.col("status"))
    ).drop("_mine")


def complete(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs left after ``done``; a job that changed again meanwhile has a newer sequence and stays."""
    finished = done.select(*[quoted(c) for c in key], F.col("seq").alias("_done"))
    return jobs.join(finished, key, "left").where(
        F.col("_done").isNull() | (F.col("seq") > F.col("_done"))
    ).drop("_done")


def fail(jobs: DataFrame, message: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Count one failed try: back to pending while tries are left, otherwise failed."""
    tries = F.col("retries") + 1
    return (
        jobs.withColumn("status", F.when(tries < max_retries, PENDING).otherwise(FAILED))
        .withColumn("retries", tries)
        .withColumn("error_msg", F.lit(message))
    )


def retry_failed(jobs: DataFrame, table: str | None = None) -> DataFrame:
    """Failed jobs of one table, or of all, start over."""
    again = F.col("status") == FAILED
    if table is not None:
        again = again & (F.col("table_name") == table)
    return jobs.select(
        *[
            F.when(again, new).otherwise(F.col(name)).alias(name) if new is not None else F.col(name)
            for name, new in (
                (c, {"status": F.lit(PENDING), "retries": F.lit(0), "error_msg": F.lit(None)}.get(c))
                for c in jobs.columns
            )
        ],
        again.alias("retried"),
    )


def queue_depth(jobs: DataFrame) -> DataFrame:
    """Pending and failed jobs of every table, in one pass; jobs that name a schema count for that schema only."""
    names = [c for c in ("table_schema", "table_name") if c in jobs.columns]
    return jobs.groupBy(*names).agg(
        F.count_if(F.col("status") == PENDING).alias("pending"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )


def worker_health(heartbeats: DataFrame, now) -> DataFrame:
    """Latest state per worker from its heartbeats, most recent first.

    A worker is one run of a stream, so that uptime does not span restarts.
    """
    return (
        heartbeats.groupBy("worker_id")
        .agg(
            F.max("last_heartbeat").alias("last_heartbeat"),
            F.sum("jobs_processed").alias("jobs_processed"),
            F.min("started_at").alias("started_at"),
        )
        .withColumn("status", worker_status(F.col("last_heartbeat"), now))
        .withColumn("uptime", uptime(F.col("started_at"), now))
        .orderBy(F.desc("last_heartbeat"), "worker_id")
    )


def create_job_tables(spark: SparkSession, path: str) -> tuple[str, str]:
    """Empty jobs and heartbeat folders with their schemas, unless they exist."""
    made = []
    for name, schema in (("jobs", JOB_SCHEMA), ("health", HEALTH_SCHEMA)):
        folder = f"{path}/{name}"
        if not files.exists(spark, folder):
            spark.createDataFrame([], schema).write.parquet(folder)
        made.append(folder)
    return made[0], made[1]
