"""Apply change events to embedding tables with Structured Streaming.

Every micro-batch is one set operation: coalesce the changes, look up the current text of the rows,
embed, and commit once. The commit records the batch number, so a batch that is replayed after a crash
changes nothing. Changes are replayed from the checkpoint, never claimed and lost.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from nearfield.functions.embedders import Models
from nearfield.functions.text import quoted
from nearfield.operators.jobs import (
    FAILED, HEALTH_SCHEMA, HEARTBEAT_SECONDS, POLL_MILLISECONDS, coalesce_changes, operation_of,
)
from nearfield.operators.joins import rows_with_keys
from nearfield.plans.indexing import embed_rows
from nearfield.registry import TableEntry
from nearfield.session import materialize
from nearfield.sources import files


def apply_changes(
    spark: SparkSession,
    entry: TableEntry,
    models: Models,
    changes: DataFrame,
    *,
    stream: str | None = None,
    batch_id: int | None = None,
    dead_letters: Callable[[DataFrame], None] | None = None,
) -> int:
    """Bring one table's embeddings up to date with a batch of changes; returns the rows touched.

    A row that is gone, or whose text has become null, loses its embedding. The text comes from the
    source as it is now, so only the last change of a row matters. Changes with an unknown operation
    and rows whose text the model refuses go to ``dead_letters`` with their error, keep the embedding
    they have, and don't hold up the rest; without ``dead_letters`` they are an error.
    """
    key = entry.primary_key
    table = entry.embeddings(spark)
    start = table.snapshot()
    if stream is not None and start.batches.get(stream, -1) >= batch_id:
        return 0
    # the table itself says which model its vectors are of
    model = models.get(start.model)
    if dead_letters is not None:
        known = operation_of(F.col("operation")).isNotNull()
        dead_letters(changes.where(~known).withColumn(
            "error_msg", F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("null")))))
        changes = changes.where(known)
    jobs = coalesce_changes(changes, key).persist()
    try:
        wanted = jobs.where(F.col("operation") != "DELETE").select(*[quoted(c) for c in key])
        touched = jobs.count()
        if not touched:
            return 0
        # a micro-batch is usually small next to its source, but that is checked, not assumed
        rows = rows_with_keys(entry.rows(spark), wanted, key)
        upserts = embed_rows(
            rows, key, entry.columns, model,
            chunked=entry.chunked, max_words=entry.chunk_words, overlap=entry.chunk_overlap, errors=dead_letters is not None,
        )
        drops = jobs.select(*key)
        if dead_letters is not None:
            # written, so that a text is embedded once for both uses
            upserts = materialize(upserts, "sync-embedded")
            refused = upserts.where("error_msg IS NOT NULL").groupBy(*[quoted(c) for c in key]).agg(
                F.min("error_msg").alias("error_msg"))
            dead_letters(jobs.drop("error_msg").join(refused, key))
            bad = refused.select(*[quoted(c) for c in key])
            upserts = upserts.drop("error_msg").join(bad, key, "left_anti")
            drops = drops.join(bad, key, "left_anti")
        # every touched key is dropped first, so whatever has no new row ends up without an embedding
        table.merge(upserts, drops, stream=stream, batch_id=batch_id, model=model.key)
        return touched
    finally:
        jobs.unpersist()


class ChangeSync:
    """Routes micro-batches of changes to the registered tables they name.

    Dead letters are one folder per stream, batch and reason, so a batch that is replayed overwrites its own.
    """

    def __init__(
        self,
        spark: SparkSession,
        entries: list[TableEntry],
        models: Models,
        *,
        name: str = "sync",
        health_path: str | None = None,
        dead_letter_path: str | None = None,
    ) -> None:
        self.spark, self.entries, self.models, self.name = spark, entries, models, name
        self.health_path, self.dead_letter_path = health_path, dead_letter_path
        self._new_run()

    def _new_run(self) -> None:
        self.worker_id = f"{self.name}:{uuid.uuid4().hex[:8]}"
        self.started_at = datetime.datetime.now(datetime.timezone.utc)
        self._last_beat = 0.0
        self._processed = 0

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; safe to run again with the same number."""
        batch = batch.persist()
        try:
            self._apply(batch, batch_id)
        finally:
            batch.unpersist()

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # batch numbers count from zero again under a new checkpoint, which has a new query id
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        stream = f"{self.name}:{query_id}"
        folder = f"query={query_id or 'none'}/batch={batch_id}"
        wanted = {number: self._is_for(entry, batch) for number, entry in enumerate(self.entries)}
        known = F.coalesce(F.col("table_name").isin([e.table for e in self.entries]), F.lit(False))
        # one look at the batch, one row: tables without a change are not touched at all
        found = batch.agg(
            F.max(~known).alias("lost"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"t{n}") for n, c in wanted.items()]
        ).first()
        processed = 0
        for number, condition in wanted.items():
            if found[f"t{number}"]:
                letters = self._letters(f"{folder}/table={number}")
                processed += apply_changes(
                    spark, self.entries[number], self.models, batch.where(condition), stream=stream, batch_id=batch_id,
                    dead_letters=letters)
        letters = self._letters(f"{folder}/table=none")
        if letters is not None and found["lost"]:
            letters(batch.where(~known).withColumn("error_msg", F.lit("table is not registered")))
        self.beat(processed)

    @staticmethod
    def _is_for(entry: TableEntry, batch: DataFrame) -> Column:
        mine = F.col("table_name") == entry.table
        if "table_schema" in batch.columns:
            mine = mine & F.coalesce(F.col("table_schema") == entry.schema, F.lit(True))
        return mine

    def _letters(self, folder: str) -> Callable[[DataFrame], None] | None:
        if self.dead_letter_path is None:
            return None
        written: list[int] = []

        def write(lost: DataFrame) -> None:
            written.append(1)
            if not lost.isEmpty():
                path = f"{self.dead_letter_path}/{folder}/reason={len(written)}"
                lost.withColumn("status", F.lit(FAILED)).write.mode("overwrite").parquet(path)

        return write

    def beat(self, processed: int) -> None:
        """Replace the one row of this run: its last heartbeat and all that it has processed."""
        if self.health_path is None:
            return
        self._last_beat = time.monotonic()
        self._processed += processed
        row = {
            "worker_id": self.worker_id, "last_heartbeat": datetime.datetime.now(datetime.timezone.utc).isoformat(),
            "jobs_processed": self._processed, "started_at": self.started_at.isoformat(),
        }
        # names of files may not hold a colon everywhere
        path = f"{self.health_path}/{self.worker_id.replace(':', '-')}.json"
        files.write_text(self.spark, path, json.dumps(row) + "\n", replace=True)

    def beat_if_due(self) -> None:
        if time.monotonic() - self._last_beat >= HEARTBEAT_SECONDS:
            self.beat(0)

    def start(
        self, changes: DataFrame, checkpoint: str, *, once: bool = False, every_milliseconds: int = POLL_MILLISECONDS
    ) -> StreamingQuery:
        """Run continuously, or with ``once`` until everything available is applied.

        A stream without changes goes on beating.
        """
        self._new_run()
        writer = changes.writeStream.queryName(self.name).option("checkpointLocation", checkpoint).foreachBatch(
            self.apply_batch
        )
        if once:
            return writer.trigger(availableNow=True).start()
        query = writer.trigger(processingTime=f"{every_milliseconds} milliseconds").start()
        if self.health_path is not None:
            self.spark.streams.addListener(_IdleBeats(self, str(query.runId)))
        return query


def heartbeats(spark: SparkSession, health_path: str) -> DataFrame:
    """One row per run of a stream, for ``worker_health``."""
    return spark.read.schema(HEALTH_SCHEMA).option("pathGlobFilter", "*.json").json(health_path)


class _IdleBeats(StreamingQueryListener):
    """Heartbeats of one run while it has nothing to do."""

    def __init__(self, sync: ChangeSync, run_id: str) -> None:
        self.sync, self.run_id = sync, run_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.sync.beat_if_due()

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.sync.spark.streams.removeListener(self)
