import datetime
import re

import pytest
from pyspark.sql import functions as F

from nearfield.errors import NearfieldError
from nearfield.operators import jobs
from nearfield.operators.status import status
from nearfield.plans import setup
from nearfield.plans.indexing import index_table
from nearfield.registry import Registry
from nearfield.streaming.sync import ChangeSync, apply_changes, heartbeats

T0 = datetime.datetime(2024, 1, 1)
CHANGE = "table_name string, id bigint, operation string, seq bigint, created_at timestamp"


def changes(spark, *items, table="docs"):
    rows = [(table, key, op, seq, T0 + datetime.timedelta(seconds=seq)) for key, op, seq in items]
    return spark.createDataFrame(rows, CHANGE)


class TestJobs:
    def test_last_change_wins_and_first_time_is_kept(self, spark):
        job = jobs.coalesce_changes(changes(spark, (1, "INSERT", 1), (1, "DELETE", 3), (1, "UPDATE", 2)), ["id"]).first()
        assert (job["operation"], job["retries"], job["status"], job["seq"], job["changes"]) == ("DELETE", 0, "pending", 3, 3)
        assert job["created_at"] == T0 + datetime.timedelta(seconds=1)

    def test_one_key_with_a_third_of_the_changes(self, spark):
        items = [(0 if i % 3 == 0 else i, "UPDATE" if i < 8999 else "DELETE", i) for i in range(9001)]
        found = {r["id"]: r for r in jobs.coalesce_changes(changes(spark, *items).repartition(8), ["id"]).collect()}
        assert found[0]["operation"] == "DELETE" and found[0]["changes"] == 3001 and len(found) == 6001

    def test_changes_are_reduced_before_the_shuffle(self, spark):
        plan = jobs.coalesce_changes(changes(spark, (1, "INSERT", 1)), ["id"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan

    def test_merge_keeps_the_first_time(self, spark):
        old = jobs.coalesce_changes(changes(spark, (1, "INSERT", 1), (2, "INSERT", 1)), ["id"]).withColumn("retries", F.lit(2))
        merged = {r["id"]: r for r in jobs.merge_jobs(old, changes(spark, (1, "UPDATE", 9), (3, "INSERT", 9)), ["id"]).collect()}
        assert (merged[1]["operation"], merged[1]["retries"]) == ("UPDATE", 0)
        assert merged[1]["created_at"] == T0 + datetime.timedelta(seconds=1)
        assert merged[2]["retries"] == 2 and merged[3]["created_at"] == T0 + datetime.timedelta(seconds=9)

    def test_failures(self, spark):
        df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, retries int").withColumn("status", F.lit("processing"))
        rows = jobs.fail(df, "no", max_retries=3).orderBy("id").collect()
        assert [(r["status"], r["retries"]) for r in rows] == [("pending", 1), ("pending", 2), ("failed", 3)]

    def test_retry(self, spark):
        df = spark.createDataFrame([("a", "failed", 3, "x"), ("b", "failed", 3, "x"), ("a", "pending", 1, None)],
                                   "table_name string, status string, retries int, error_msg string")
        assert jobs.retry_failed(df, "a").where("retried").count() == 1
        again = jobs.retry_failed(df).where("retried").collect()
        assert [(r["status"], r["retries"], r["error_msg"]) for r in again] == [("pending", 0, None)] * 2

    def test_job_that_changed_meanwhile_is_not_completed(self, spark):
        open_jobs = jobs.coalesce_changes(changes(spark, (1, "UPDATE", 5), (2, "UPDATE", 5), (3, "UPDATE", 5)), ["id"])
        done = spark.createDataFrame([(1, 5), (2, 4)], "id bigint, seq bigint")
        assert sorted(r["id"] for r in jobs.complete(open_jobs, done, ["id"]).collect()) == [2, 3]

    def test_snapshot_diff(self, spark):
        before = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, None, 1), (5, None, 1)], "id bigint, t string, n int")
        after = spark.createDataFrame([(1, "a", 9), (2, "x", 1), (4, "", 1), (5, None, 1), (6, "z", 1)], "id bigint, t string, n int")
        assert sorted(tuple(r) for r in jobs.snapshot_diff(before, after, ["id"], ["t"]).collect()) == [
            (2, "UPDATE"), (3, "DELETE"), (4, "UPDATE"), (6, "INSERT")]

    def test_only_buckets_that_differ_are_read(self, spark, tmp_path):
        rows = [(i, f"text {i}", None if i % 5 else i) for i in range(3000)]
        before = spark.createDataFrame(rows, "id bigint, t string, n int")
        state = jobs.KeptState.keep(before, str(tmp_path / "state"), ["id"], ["t", "n"], buckets=50)
        assert state.changes(before.repartition(7)).count() == 0
        after = before.where("id != 7").withColumn("t", F.when(F.col("id") == 9, "x").otherwise(F.col("t"))).unionByName(
            spark.createDataFrame([(5000, None, None)], before.schema))
        found = jobs.KeptState(spark, str(tmp_path / "state")).changes(after)
        assert sorted(tuple(r) for r in found.collect()) == [(7, "DELETE"), (9, "UPDATE"), (5000, "INSERT")]
        # three of fifty buckets at most, pruned as folders
        plan = found._jdf.queryExecution().executedPlan().toString()
        folders = re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (?:IN \(([\d,]+)\)|= \d+|INSET ([\d, ]+))", plan)
        assert folders and len((folders[1] or folders[2] or "0").split(",")) <= 3

    def test_a_state_without_rows(self, spark, tmp_path):
        nothing = spark.createDataFrame([], "id bigint, t string")
        state = jobs.KeptState.keep(nothing, str(tmp_path / "state"), ["id"], ["t"])
        with pytest.raises(NearfieldError, match="no rows"):
            state.changes(nothing)

    def test_job_tables_are_made_once(self, spark, tmp_path):
        first = jobs.create_job_tables(spark, str(tmp_path))
        spark.createDataFrame([(1, "t", "1", "c", "INSERT", "pending", 0, None, T0, T0)], jobs.JOB_SCHEMA).write.mode("append").parquet(first[0])
        assert jobs.create_job_tables(spark, str(tmp_path)) == first
        assert spark.read.parquet(first[0]).count() == 1 and spark.read.parquet(first[1]).columns == jobs.HEALTH_SCHEMA.names


@pytest.fixture(params=[False, True], ids=["whole", "chunked"])
def setup_docs(request, spark, models, tmp_path):
    """Rows 1 to 5 are indexed; then the source changes."""
    state = {}

    def write(rows):
        path = str(tmp_path / f"docs-{len(state)}")
        state[path] = rows
        spark.createDataFrame(rows, "id bigint, body string").coalesce(1).write.parquet(path)
        return path

    entry = setup.apply_table(
        spark, Registry(), models, table="docs", source=write([(i, f"old text {i}") for i in range(1, 6)]),
        root=str(tmp_path / "emb"), primary_key=["id"], column="body", model="hash-64", buckets=2, chunked=request.param)
    index_table(spark, entry, models)
    entry.source = write([(1, "old text 1"), (2, "completely new words"), (3, None), (5, "   "), (6, "added row")])
    return entry


def embeddings(spark, entry):
    found = entry.embeddings(spark).read().where("embedding IS NOT NULL")
    return {r["id"]: list(r["embedding"]) for r in found.collect()}


def expected(models, chunked):
    embed = models.get("hash-64").embed_query
    result = {1: embed("old text 1"), 2: embed("completely new words"), 6: embed("added row")}
    if not chunked:
        result[5] = [0.0] * 64
    return result


ALL = [(2, "UPDATE", 1), (3, "UPDATE", 2), (4, "INSERT", 3), (4, "DELETE", 4), (5, "UPDATE", 5), (6, "INSERT", 6), (7, "INSERT", 7)]


def test_batch(spark, models, setup_docs):
    """New text, text that became null or blank, a deleted row, an added row, and a row that came and went."""
    assert apply_changes(spark, setup_docs, models, changes(spark, *ALL)) == 6
    assert embeddings(spark, setup_docs) == expected(models, setup_docs.chunked)


def test_untouched_rows_stay_as_they_are(spark, models, setup_docs):
    before = embeddings(spark, setup_docs)
    apply_changes(spark, setup_docs, models, changes(spark, (6, "INSERT", 1)))
    after = embeddings(spark, setup_docs)
    assert {k: v for k, v in after.items() if k != 6} == before


def test_empty_batch(spark, models, setup_docs):
    before = embeddings(spark, setup_docs)
    assert apply_changes(spark, setup_docs, models, changes(spark)) == 0
    assert embeddings(spark, setup_docs) == before


def write_feed(spark, folder, name, items, table="docs"):
    changes(spark, *items, table=table).coalesce(1).write.parquet(f"{folder}/{name}")


def feed(spark, folder):
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(sync, stream, checkpoint):
    query = sync.start(stream, checkpoint, once=True)
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_and_resumes(spark, models, setup_docs, tmp_path):
    folder, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    sync = ChangeSync(spark, [setup_docs], models, health_path=str(tmp_path / "health"), dead_letter_path=str(tmp_path / "dead"))
    write_feed(spark, folder, "a", ALL[:3])
    run(sync, feed(spark, folder), checkpoint)
    version = setup_docs.embeddings(spark).snapshot().version
    run(sync, feed(spark, folder), checkpoint)
    assert setup_docs.embeddings(spark).snapshot().version == version
    write_feed(spark, folder, "b", ALL[3:5])
    write_feed(spark, folder, "c", ALL[5:])
    write_feed(spark, folder, "d", [(1, "DELETE", 9)], table="unknown")
    run(sync, feed(spark, folder), checkpoint)
    assert embeddings(spark, setup_docs) == expected(models, setup_docs.chunked)
    beats = heartbeats(spark, str(tmp_path / "health"))
    health = jobs.worker_health(beats, F.current_timestamp()).first()
    assert health["worker_id"].startswith("sync:") and health["status"] == "running"
    # one row per run, however many batches it had; the second run had none
    assert sorted(r["jobs_processed"] for r in beats.collect()) == [3, 4]
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert [(r["table_name"], r["status"], r["error_msg"]) for r in dead] == [("unknown", "failed", "table is not registered")]


def test_new_checkpoint_starts_over(spark, models, setup_docs, tmp_path):
    """Batch numbers start from zero under a new checkpoint and must not be taken for replays."""
    folder = str(tmp_path / "feed")
    sync = ChangeSync(spark, [setup_docs], models)
    write_feed(spark, folder, "a", ALL[:2])
    run(sync, feed(spark, folder), str(tmp_path / "one"))
    write_feed(spark, folder, "b", ALL[2:])
    run(sync, feed(spark, folder), str(tmp_path / "two"))
    assert embeddings(spark, setup_docs) == expected(models, setup_docs.chunked)


def test_replayed_batch_changes_nothing(spark, models, setup_docs):
    batch = changes(spark, *ALL)
    apply_changes(spark, setup_docs, models, batch, stream="s", batch_id=0)
    version = setup_docs.embeddings(spark).snapshot().version
    assert apply_changes(spark, setup_docs, models, batch, stream="s", batch_id=0) == 0
    assert setup_docs.embeddings(spark).snapshot().version == version


def test_unknown_operations_delete_nothing(spark, models, setup_docs, tmp_path):
    before = embeddings(spark, setup_docs)
    dead = str(tmp_path / "dead")
    batch = changes(spark, (1, "UPSERT", 1), (2, " update ", 2), (4, "delete", 3), (5, None, 4))
    ChangeSync(spark, [setup_docs], models, dead_letter_path=dead).apply_batch(batch, 0)
    after = embeddings(spark, setup_docs)
    assert after[1] == before[1] and after[5] == before[5] and after[2] != before[2] and 4 not in after
    found = sorted((r["id"], r["error_msg"]) for r in spark.read.parquet(dead).collect())
    assert found == [(1, "unknown operation: UPSERT"), (5, "unknown operation: null")]
    with pytest.raises(Exception, match="unknown operation"):
        apply_changes(spark, setup_docs, models, batch)


def test_a_text_the_model_refuses_holds_nothing_up(spark, models, setup_docs, tmp_path):
    from nearfield.functions.embedders import Embedder, Models, hash_embedder

    def factory():
        inner = hash_embedder(64).factory()

        def encode(texts):
            if any("completely" in t for t in texts):
                raise ValueError("no such text")
            return inner(texts)
        return encode

    strict = Models()
    strict.register(Embedder("hash-64", "md5-word-hash-64", 64, factory))
    before, dead = embeddings(spark, setup_docs), str(tmp_path / "dead")
    ChangeSync(spark, [setup_docs], strict, dead_letter_path=dead).apply_batch(changes(spark, *ALL), 0)
    want = {**expected(models, setup_docs.chunked), 2: before[2]}
    assert embeddings(spark, setup_docs) == want
    row = spark.read.parquet(dead).first()
    assert (row["id"], row["status"], row["error_msg"]) == (2, "failed", "ValueError: no such text")


def test_an_idle_stream_goes_on_beating(spark, models, setup_docs, tmp_path, monkeypatch):
    import time

    from nearfield.streaming import sync as module

    if setup_docs.chunked:
        return
    monkeypatch.setattr(module, "HEARTBEAT_SECONDS", 0)
    folder, health = str(tmp_path / "feed"), str(tmp_path / "health")
    write_feed(spark, folder, "a", ALL[:1])
    sync = ChangeSync(spark, [setup_docs], models, health_path=health)
    query = sync.start(feed(spark, folder), str(tmp_path / "checkpoint"), every_milliseconds=200)
    seen = set()
    try:
        for _ in range(60):
            time.sleep(0.5)
            # the stream reports that it is idle every ten seconds
            seen |= {tuple(r) for r in heartbeats(spark, health).collect()} if query.lastProgress else set()
            if len({r[1] for r in seen}) > 1:
                break
        last = heartbeats(spark, health).collect()
    finally:
        query.stop()
    assert len({r[1] for r in seen}) > 1 and {(r[0], r[2]) for r in seen} == {(sync.worker_id, 1)} and len(last) == 1


def test_a_batch_touches_only_the_tables_it_names(spark, models, setup_docs, tmp_path):
    from nearfield.sources import files

    path = str(tmp_path / "notes")
    spark.createDataFrame([(1, "a note")], "id bigint, body string").write.parquet(path)
    other = setup.apply_table(spark, Registry(), models, table="notes", source=path, root=str(tmp_path / "other"),
                              primary_key=["id"], column="body", model="hash-64", buckets=2)
    index_table(spark, other, models)
    table = other.embeddings(spark)
    table.lists().build(1)
    before = table.snapshot(), sorted(files.names(spark, table.path)), table.lists().current()
    sync = ChangeSync(spark, [other, setup_docs], models)
    version = setup_docs.embeddings(spark).snapshot().version
    for number, some in enumerate((ALL[:2], ALL[2:], [])):
        sync.apply_batch(changes(spark, *some), number)
    assert (table.snapshot(), sorted(files.names(spark, table.path)), table.lists().current()) == before
    assert setup_docs.embeddings(spark).snapshot().version == version + 2
    assert embeddings(spark, setup_docs) == expected(models, setup_docs.chunked)


def test_a_merge_of_nothing_publishes_nothing(spark, models, setup_docs):
    table = setup_docs.embeddings(spark)
    before = table.snapshot()
    nothing = table.read().limit(0)
    assert table.merge(nothing, nothing.select("id")) == before == table.snapshot()


def test_model_of_the_table_wins_over_a_stale_entry(spark, models, tmp_path):
    import dataclasses

    from nearfield.errors import NearfieldError
    from nearfield.plans.indexing import migrate_table
    from nearfield.plans.text_search import search

    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red apples"), (2, "blue plums")], "id bigint, body string").write.parquet(path)
    registry = Registry()
    entry = setup.apply_table(spark, registry, models, table="docs", source=path, root=str(tmp_path / "emb"),
                              primary_key=["id"], column="body", model="hash-64", buckets=2)
    index_table(spark, entry, models)
    stale = Registry([dataclasses.replace(entry)])
    migrate_table(spark, registry, "docs", "hash-128", models)
    found = search(spark, stale, models, "blue plums", "docs", limit=1).first()
    assert (found["row_id"], found["similarity"]) == ("2", 1.0)
    assert search(spark, stale, models, "blue plums").first()["row_id"] == "2"
    assert status(spark, stale).first()["model"] == "hash-128"
    spark.createDataFrame([(3, "green pears")], "id bigint, body string").write.mode("append").parquet(path)
    assert index_table(spark, stale.require("docs"), models).rows == 1
    apply_changes(spark, stale.require("docs"), models, changes(spark, (1, "UPDATE", 1)))
    rows = entry.embeddings(spark).read().collect()
    assert {(r["model_name"], len(r["embedding"])) for r in rows} == {("md5-word-hash-128", 128)}
    with pytest.raises(NearfieldError, match="holds vectors"):
        entry.embeddings(spark).merge(entry.embeddings(spark).read().select("id", "embedding"), model="hash-64")


def test_duplicate_keys_are_stored_once(spark, models, setup_docs):
    if setup_docs.chunked:
        return
    table = setup_docs.embeddings(spark)
    one, two = [1.0] * 64, [2.0] * 64
    rows = spark.createDataFrame([(3, two, 1), (3, one, 2), (4, one, 1)], "id bigint, embedding array<float>, seq bigint")
    table.merge(rows.drop("seq"))
    assert sorted(r["id"] for r in table.read().where("id IN (3, 4)").collect()) == [3, 4]
    assert list(table.read().where("id = 3").first()["embedding"]) == two
    table.merge(rows, sequence="seq")
    assert [list(r["embedding"]) for r in table.read().where("id = 3").collect()] == [one]
