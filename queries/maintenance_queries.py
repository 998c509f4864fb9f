"""Writes to embedding tables, jobs and change sync."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from nearfield.functions.embedders import Models
from nearfield.operators import jobs, status
from nearfield.operators.rows import with_content
from nearfield.plans.indexing import embed_rows, index_table, migrate_table, reindex_table
from nearfield.plans.setup import apply_table
from nearfield.registry import Registry, TableEntry
from nearfield.session import scratch_path
from nearfield.streaming.sync import ChangeSync, apply_changes
from queries import query
from queries.sqlparts import JOBS, OPERATION, chunks, hash_slots

MODELS = Models()
MODEL = MODELS.get("hash-64")
NOW = "2024-01-30 23:59:00"


def registered(load, table="documents", key=("doc_id",), columns=("text",), source=None, registry=None, **options):
    registry = registry or Registry()
    entry = apply_table(
        load.spark, registry, MODELS, table=table, source=source or load.path(table),
        root=scratch_path(load.spark, "embeddings"), primary_key=list(key), columns=list(columns),
        model="hash-64", buckets=4, **options,
    )
    return entry, registry


def squares(vectors, *keys):
    """A small fingerprint of each vector that SQL can compute too."""
    zero = F.lit(0.0)
    return vectors.select(
        *keys,
        F.aggregate("embedding", zero, lambda s, x: s + x * x).alias("squares"),
        F.aggregate("embedding", zero, lambda s, x: s + x).alias("total"),
    )


def squares_sql(source: str, key: str, text: str, dims: int = 64) -> str:
    return f"""SELECT s.{key}, COALESCE(SUM(w * w), 0) AS squares, COALESCE(SUM(w), 0) AS total
        FROM {source} s LEFT JOIN ({hash_slots(source, key, text, dims)}) USING ({key}) GROUP BY 1"""


def changed(load):
    """Documents labelled toxic, with another text."""
    toxic = load("labels").where("toxic = 1").select("doc_id")
    return load("documents").join(toxic, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("revised "), "lang", F.lit(" "), "text"))


CHANGED_SQL = """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
                                THEN 'revised ' || lang || ' ' || text ELSE text END AS text FROM documents"""


# -- embedding tables ----------------------------------------------------------


@query("upsert_embeddings", f"WITH now AS ({CHANGED_SQL}) {squares_sql('now', 'doc_id', 'text')}")
def upsert_embeddings(load):
    entry, _ = registered(load)
    index_table(load.spark, entry, MODELS)
    table = entry.embeddings(load.spark)
    table.merge(embed_rows(changed(load), ["doc_id"], ["text"], MODEL))
    return squares(table.read(), "doc_id")


@query("delete_embeddings", f"""
    WITH kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
    {squares_sql('kept', 'doc_id', 'text')}""")
def delete_embeddings(load):
    entry, _ = registered(load)
    index_table(load.spark, entry, MODELS)
    table = entry.embeddings(load.spark)
    table.merge(deletes=load("labels").where("quality = 0").select("doc_id"))
    return squares(table.read(), "doc_id")


@query("replace_chunks", f"""
    WITH RECURSIVE now AS ({CHANGED_SQL}), {chunks("now", "doc_id", "text")}
    SELECT doc_id, chunk_index, md5(chunk_text) AS digest FROM chunks""")
def replace_chunks(load):
    entry, _ = registered(load, chunked=True)
    index_table(load.spark, entry, MODELS)
    table = entry.embeddings(load.spark)
    table.merge(embed_rows(changed(load), ["doc_id"], ["text"], MODEL, chunked=True))
    kept = table.read().where("embedding IS NOT NULL")
    return kept.select("doc_id", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query("index_incremental", """
    SELECT 1 AS run, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS written,
           (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS embedded
    UNION ALL SELECT 2, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
                     (SELECT count(*) FROM documents)
    UNION ALL SELECT 3, 0, (SELECT count(*) FROM documents)""")
def index_incremental(load):
    """Only labelled rows first, then the rest, then nothing is left to do."""
    entry, _ = registered(load)
    table = entry.embeddings(load.spark)
    labelled = load("documents").join(load("labels").select("doc_id"), "doc_id", "left_semi")
    table.append(embed_rows(labelled, ["doc_id"], ["text"], MODEL))
    counts = [(1, table.read().count(), table.read().count())]
    for run in (2, 3):
        written = index_table(load.spark, entry, MODELS).rows
        counts.append((run, written, table.read().count()))
    return load.spark.createDataFrame(counts, "run int, written bigint, embedded bigint")


@query("index_throughput")
def index_throughput(load):
    entry, _ = registered(load, "conversations", ("conv_id", "turn"), ("role", "text"))
    report = index_table(load.spark, entry, MODELS)
    return load.spark.createDataFrame(
        [(report.rows, report.seconds, report.rows_per_minute)], "rows bigint, seconds double, rows_per_minute double"
    )


@query("reindex", squares_sql("documents", "doc_id", "text"))
def reindex(load):
    """Stale vectors, vectors of rows that are gone and missing ones are all put right."""
    entry, _ = registered(load)
    table = entry.embeddings(load.spark)
    stale = load("embeddings").select((F.col("vec_id") + 100).alias("doc_id"), "embedding")
    table.append(stale)
    reindex_table(load.spark, entry, MODELS)
    return squares(table.read(), "doc_id")


@query("migrate", f"""
    SELECT doc_id, squares, total, 128 AS dims, 'md5-word-hash-128' AS model_name
    FROM ({squares_sql("documents", "doc_id", "text", 128)})""")
def migrate(load):
    entry, registry = registered(load)
    index_table(load.spark, entry, MODELS)
    migrate_table(load.spark, registry, "documents", "hash-128", MODELS)
    moved = entry.embeddings(load.spark).read()
    return squares(moved, "doc_id", F.size("embedding").alias("dims"), "model_name")


@query("migration_progress", """
    SELECT count(*) AS total, count(l.doc_id) AS already, count(*) - count(l.doc_id) AS remaining,
           round(100.0 * count(l.doc_id) / count(*), 1)::DOUBLE AS progress_pct
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL""")
def migration_progress(load):
    """A migration that stopped after the labelled rows."""
    entry, _ = registered(load)
    table, model = entry.embeddings(load.spark), MODELS.get("hash-128")
    table.begin_migration(model.key, model.model_name, model.dims)
    labelled = load("documents").join(load("labels").select("doc_id"), "doc_id", "left_semi")
    table.append(embed_rows(labelled, ["doc_id"], ["text"], model), staged=True)
    return status.migration_progress(with_content(load("documents"), ["text"]), table.staged(), ["doc_id"])


@query("status", """
    SELECT 'conversations' AS table_name, 'hash-64' AS model, (SELECT count(*) FROM conversations) AS embedded,
           (SELECT count(*) FROM conversations) AS total, 100.0::DOUBLE AS coverage_pct, false AS unreadable,
           0::BIGINT AS pending, 0::BIGINT AS failed
    UNION ALL
    SELECT 'purchase', 'hash-64', (SELECT count(*) FROM documents JOIN labels USING (doc_id)), (SELECT count(*) FROM documents),
           round(100.0 * (SELECT count(*) FROM documents JOIN labels USING (doc_id)) / (SELECT count(*) FROM documents), 1)::DOUBLE,
           false, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND value < 50),
           (SELECT count(*) FROM events WHERE event_type = 'purchase' AND value >= 150)
    UNION ALL SELECT 'missing', 'hash-64', NULL, NULL, NULL, true, 0, 0""")
def status_rows(load):
    """A complete table, a half-embedded one that has jobs, and one whose data is gone."""
    conversations, registry = registered(load, "conversations", ("conv_id", "turn"), ("role", "text"))
    index_table(load.spark, conversations, MODELS)
    half, _ = registered(load, "purchase", source=load.path("documents"), registry=registry)
    labelled = load("documents").join(load("labels").select("doc_id"), "doc_id", "left_semi")
    half.embeddings(load.spark).append(embed_rows(labelled, ["doc_id"], ["text"], MODEL))
    nowhere = scratch_path(load.spark, "gone")
    registry.put(TableEntry("missing", nowhere, ["text"], MODEL.key, MODEL.model_name, MODEL.dims, nowhere))
    return status.status(load.spark, registry, job_rows(load)).select(
        "table_name", "model", "embedded", "total", "coverage_pct", F.col("error").isNotNull().alias("unreadable"),
        "pending", "failed",
    )


# -- changes and jobs -------------------------------------------------------------


def operation():
    return F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")


def job_rows(load):
    state = F.when(F.col("value") < 50, "pending").when(F.col("value") < 150, "processing").otherwise("failed")
    return load("events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("table_name"),
        F.col("user_id").cast("string").alias("row_id"),
        F.lit("text").alias("column_name"),
        operation().alias("operation"),
        state.alias("status"),
        F.least(F.lit(3), F.floor(F.col("value") / 50)).cast("int").alias("retries"),
        F.lit(None).cast("string").alias("error_msg"),
        F.col("ts").alias("created_at"),
    )


def change_rows(events, table="documents", spelled=None):
    return events.select(
        F.lit(table).alias("table_name"),
        F.col("user_id").alias("doc_id"),
        (operation() if spelled is None else F.expr(spelled)).alias("operation"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query("coalesce_changes", f"""
    SELECT user_id AS doc_id, arg_max({OPERATION}, event_id) AS operation, 'pending' AS status, 0 AS retries,
           min(ts) AS created_at, max(ts) AS updated_at, max(event_id) AS seq, count(*) AS changes
    FROM events GROUP BY user_id""")
def coalesce_changes(load):
    coalesced = jobs.coalesce_changes(change_rows(load("events")), ["doc_id"])
    return coalesced.drop("error_msg").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")}
    )


@query("merge_jobs", f"""
    WITH old AS (SELECT id AS seq, row_id, operation, status, retries, created_at FROM ({JOBS}) j
                 WHERE id = (SELECT max(event_id) FROM events e
                             WHERE CAST(e.user_id AS VARCHAR) = j.row_id AND e.event_type <> 'purchase')
                   AND table_name <> 'purchase'),
    new AS (SELECT CAST(user_id AS VARCHAR) AS row_id, 'UPDATE' AS operation, min(ts) AS created_at, max(event_id) AS seq
            FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT o.row_id, o.operation, o.status, o.retries, o.created_at, o.seq FROM old o
    WHERE o.row_id NOT IN (SELECT row_id FROM new)
    UNION ALL
    SELECT n.row_id, n.operation, 'pending', 0, least(n.created_at, o.created_at), n.seq
    FROM new n LEFT JOIN old o USING (row_id)""")
def merge_jobs(load):
    """Jobs from all other events, then the purchases arrive."""
    old = job_rows(load).where("table_name <> 'purchase'").withColumn("seq", F.col("id"))
    newest = old.groupBy("row_id").agg(F.max("seq").alias("seq"))
    old = old.join(newest, ["row_id", "seq"], "left_semi")
    new = job_rows(load).where("table_name = 'purchase'").withColumn("seq", F.col("id"))
    merged = jobs.merge_jobs(old, new, ["row_id"])
    return merged.select("row_id", "operation", "status", "retries", "created_at", "seq")


@query("claim_batch", f"""
    SELECT id, table_name, row_id, operation FROM ({JOBS}) WHERE status = 'pending' ORDER BY created_at, id LIMIT 10""")
def claim_batch(load):
    return jobs.claim(job_rows(load)).select("id", "table_name", "row_id", "operation")


@query("mark_claimed", f"""
    WITH j AS ({JOBS}), c AS (SELECT id FROM j WHERE status = 'pending' ORDER BY created_at, id LIMIT 10)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'processing' ELSE status END AS status FROM j""")
def mark_claimed(load):
    pending = job_rows(load)
    return jobs.mark_claimed(pending, jobs.claim(pending)).select("id", "status")


@query("complete_jobs", f"""
    SELECT user_id AS doc_id, max(event_id) AS seq FROM events
    GROUP BY user_id HAVING max(event_id) > COALESCE(max(event_id) FILTER (event_type = 'error'), -1)""")
def complete_jobs(load):
    """Work done up to each row's last delete is complete; rows that changed later keep their job."""
    changes = change_rows(load("events"))
    done = changes.where("operation = 'DELETE'").groupBy("doc_id").agg(F.max("seq").alias("seq"))
    left = jobs.complete(jobs.coalesce_changes(changes, ["doc_id"]), done, ["doc_id"])
    return left.select("doc_id", "seq")


@query("fail_jobs", f"""
    SELECT id, CASE WHEN retries + 1 < 3 THEN 'pending' ELSE 'failed' END AS status, retries + 1 AS retries,
           'model not reachable' AS error_msg
    FROM ({JOBS}) WHERE status = 'processing'""")
def fail_jobs(load):
    running = job_rows(load).where("status = 'processing'")
    return jobs.fail(running, "model not reachable").select("id", "status", "retries", "error_msg")


@query("retry_failed", f"""
    SELECT id, CASE WHEN status = 'failed' AND table_name = 'click' THEN 'pending' ELSE status END AS status,
           CASE WHEN status = 'failed' AND table_name = 'click' THEN 0 ELSE retries END AS retries,
           status = 'failed' AND table_name = 'click' AS retried
    FROM ({JOBS})""")
def retry_failed(load):
    return jobs.retry_failed(job_rows(load), "click").select("id", "status", "retries", "retried")


@query("queue_depth", f"""
    SELECT table_name, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed
    FROM ({JOBS}) GROUP BY table_name""")
def queue_depth(load):
    return jobs.queue_depth(job_rows(load))


@query("worker_health", f"""
    SELECT *, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_heartbeat) < 30000000 THEN 'running'
                   WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_heartbeat) < 300000000 THEN 'stale'
                   ELSE 'stopped' END AS status,
           CAST((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) // 3600000000 AS VARCHAR) || 'h '
           || CAST((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) // 60000000 % 60 AS VARCHAR) || 'm' AS uptime
    FROM (SELECT CAST(user_id AS VARCHAR) AS worker_id, max(ts) AS last_heartbeat, count(*) AS jobs_processed,
                 min(ts) AS started_at FROM events GROUP BY user_id)""")
def worker_health(load):
    beats = load("events").select(
        F.col("user_id").cast("string").alias("worker_id"),
        F.col("ts").alias("last_heartbeat"),
        F.lit(1).cast("bigint").alias("jobs_processed"),
        F.col("ts").alias("started_at"),
    )
    return jobs.worker_health(beats, F.lit(datetime.datetime.fromisoformat(NOW)).cast("timestamp_ntz"))


SNAPSHOT_SQL = """
    SELECT doc_id, 'UPDATE' AS operation FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT doc_id, 'DELETE' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0)
    UNION ALL SELECT 1000000 + page_id, 'INSERT' FROM pages"""


def later_documents(load):
    """Toxic documents were revised, poor ones deleted and the pages added; other columns don't count."""
    documents, labels = load("documents"), load("labels")
    revised = changed(load)
    kept = documents.join(labels.where("toxic = 1 OR quality = 0").select("doc_id"), "doc_id", "left_anti")
    added = load("pages").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.col("html").alias("text"))
    return kept.withColumn("n_chars", F.col("n_chars") + 1).unionByName(revised).unionByName(added, allowMissingColumns=True)


@query("snapshot_diff", SNAPSHOT_SQL)
def snapshot_diff(load):
    return jobs.snapshot_diff(load("documents"), later_documents(load), ["doc_id"], ["text"])


@query("snapshot_diff_tree", SNAPSHOT_SQL)
def snapshot_diff_tree(load):
    """The same against a kept state: buckets whose digests agree are not read."""
    state = jobs.KeptState.keep(load("documents"), scratch_path(load.spark, "state"), ["doc_id"], ["text"], buckets=64)
    return state.changes(later_documents(load))


SYNCED_SQL = f"""
    WITH last AS (SELECT user_id AS doc_id, arg_max({OPERATION}, event_id) AS operation FROM events GROUP BY user_id),
    now AS (SELECT d.doc_id, CASE WHEN l.operation IS NULL THEN d.lang || ' ' || d.source ELSE d.text END AS text
            FROM documents d LEFT JOIN last l USING (doc_id) WHERE l.operation IS DISTINCT FROM 'DELETE')
    {squares_sql("now", "doc_id", "text")}"""


def before_sync(load):
    """Documents whose vectors come from an earlier text, so that a row the sync missed would show."""
    entry, _ = registered(load)
    earlier = load("documents").withColumn("text", F.concat_ws(" ", "lang", "source"))
    entry.embeddings(load.spark).append(embed_rows(earlier, ["doc_id"], ["text"], MODEL))
    return entry


@query("sync_batch", SYNCED_SQL)
def sync_batch(load):
    entry = before_sync(load)
    apply_changes(load.spark, entry, MODELS, change_rows(load("events")))
    return squares(entry.embeddings(load.spark).read(), "doc_id")


@query("sync_stream", SYNCED_SQL)
def sync_stream(load):
    """The same changes through Structured Streaming."""
    entry = before_sync(load)
    events = (
        load.spark.readStream.schema(load("events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(load.sf_dir)
    )
    sync = ChangeSync(
        load.spark, [entry], MODELS, health_path=scratch_path(load.spark, "health"),
        dead_letter_path=scratch_path(load.spark, "dead-letter"),
    )
    running = sync.start(change_rows(events), scratch_path(load.spark, "sync-checkpoint"), once=True)
    running.awaitTermination()
    return squares(entry.embeddings(load.spark).read(), "doc_id")


@query("sync_two_tables", f"""
    WITH last AS (SELECT user_id AS doc_id, arg_max({OPERATION}, event_id) AS operation FROM events GROUP BY user_id),
    now AS (SELECT d.doc_id, CASE WHEN l.operation IS NULL THEN d.lang || ' ' || d.source ELSE d.text END AS text
            FROM documents d LEFT JOIN last l USING (doc_id) WHERE l.operation IS DISTINCT FROM 'DELETE')
    SELECT 'documents' AS table_name, true AS changed, doc_id AS id, squares, total
    FROM ({squares_sql("now", "doc_id", "text")})
    UNION ALL SELECT 'benchmark', false, item_id, squares, total FROM ({squares_sql("benchmark", "item_id", "text")})""")
def sync_two_tables(load):
    """Two batches of changes of one table: the other one keeps its snapshot."""
    entry = before_sync(load)
    other, _ = registered(load, "benchmark", ["item_id"])
    index_table(load.spark, other, MODELS)
    before = {e.table: e.embeddings(load.spark).snapshot().version for e in (entry, other)}
    sync = ChangeSync(load.spark, [entry, other], MODELS)
    first = F.col("created_at") < F.lit("2024-01-16").cast("timestamp")
    for number, some in enumerate((first, ~first)):
        sync.apply_batch(change_rows(load("events")).withColumn("table_name", F.lit("documents")).where(some), number)
    merged = None
    for e in (entry, other):
        table = e.embeddings(load.spark)
        one = squares(table.read(), F.col(e.primary_key[0]).alias("id")).select(
            F.lit(e.table).alias("table_name"), F.lit(table.snapshot().version > before[e.table]).alias("changed"), "*")
        merged = one if merged is None else merged.unionByName(one)
    return merged


@query("upsert_duplicates", f"""
    WITH now AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
                                     THEN 'revised 2 ' || text ELSE text END AS text FROM documents)
    {squares_sql('now', 'doc_id', 'text')}""")
def upsert_duplicates(load):
    """Every changed row comes twice in one batch; the later one is stored, once."""
    entry, _ = registered(load)
    index_table(load.spark, entry, MODELS)
    table = entry.embeddings(load.spark)
    toxic = load("documents").join(load("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    batch = None
    for number in (2, 1):
        text = F.concat(F.lit(f"revised {number} "), "text")
        rows = embed_rows(toxic.withColumn("text", text), ["doc_id"], ["text"], MODEL).withColumn("seq", F.lit(number))
        batch = rows if batch is None else batch.unionByName(rows)
    table.merge(batch, sequence="seq")
    return squares(table.read(), "doc_id")


# clicks carry an operation nobody knows, errors theirs in small letters; other operations are as in sync_batch
ODD_OPERATION = """CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'UPSERT' ELSE 'UPDATE' END"""


@query("sync_unknown_operations", f"""
    WITH last AS (SELECT user_id AS doc_id, arg_max({OPERATION}, event_id) AS operation
                  FROM events WHERE event_type <> 'click' GROUP BY user_id),
    now AS (SELECT d.doc_id, CASE WHEN l.operation IS NULL THEN d.lang || ' ' || d.source ELSE d.text END AS text
            FROM documents d LEFT JOIN last l USING (doc_id) WHERE l.operation IS DISTINCT FROM 'DELETE')
    SELECT *, (SELECT count(*) FROM events WHERE event_type = 'click') AS dead_letters
    FROM ({squares_sql("now", "doc_id", "text")})""")
def sync_unknown_operations(load):
    """Unknown operations become dead letters and change nothing; the others are applied in any spelling."""
    entry, dead = before_sync(load), scratch_path(load.spark, "dead-letter")
    odd = change_rows(load("events"), spelled=ODD_OPERATION)
    ChangeSync(load.spark, [entry], MODELS, dead_letter_path=dead).apply_batch(odd, 0)
    letters = load.spark.read.parquet(dead).count()
    return squares(entry.embeddings(load.spark).read(), "doc_id").withColumn("dead_letters", F.lit(letters).cast("bigint"))


@query("sync_dead_letters", f"""
    WITH last AS (SELECT user_id AS doc_id, arg_max({OPERATION}, event_id) AS operation FROM events GROUP BY user_id)
    SELECT d.doc_id, 'ValueError: line break' AS error_msg FROM documents d JOIN last l USING (doc_id)
    WHERE l.operation <> 'DELETE' AND contains(d.text, chr(10))""")
def sync_dead_letters(load):
    """A model that refuses texts with line breaks: those rows become dead letters, the batch commits."""
    from nearfield.functions.embedders import Embedder

    def factory():
        def encode(texts):
            if any("\n" in t for t in texts):
                raise ValueError("line break")
            return [[float(len(t))] * 64 for t in texts]
        return encode

    strict = Models()
    strict.register(Embedder(MODEL.key, MODEL.model_name, MODEL.dims, factory))
    entry, dead = before_sync(load), scratch_path(load.spark, "dead-letter")
    ChangeSync(load.spark, [entry], strict, dead_letter_path=dead).apply_batch(change_rows(load("events")), 0)
    return load.spark.read.parquet(dead).select("doc_id", "error_msg")
