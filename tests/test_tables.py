import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import registry as registry_module
from nearfield.errors import CommitConflictError, NearfieldError, RegistryError, UnsafeQueryError
from nearfield.functions.embedders import Embedder, hash_embedder
from nearfield.operators import joins, profile, rows, status
from nearfield.operators.bounded_sql import check_select, run_bounded
from nearfield.operators.projection import cluster_keywords, project_2d, sample_rows, topic_clusters
from nearfield.plans import indexing, setup
from nearfield.registry import Registry, TableEntry
from nearfield.session import scratch_path, scratch_root
from nearfield.sources import files, tables
from nearfield.sources.embedding_table import EmbeddingTable

KEY = T.StructType([T.StructField("id", T.LongType())])


def vectors(spark, numbers, value=1.0, dims=2):
    return spark.createDataFrame([(n, [value] * dims) for n in numbers], "id bigint, embedding array<float>")


def replace_all(table, rows_):
    """Fresh vectors for everything, beside the live ones."""
    snap = table.begin_migration("m", "model", 2)
    table.append(rows_, staged=True)
    table.finish_migration()
    return snap


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture()
def table(spark, tmp_path):
    return EmbeddingTable.create(spark, str(tmp_path / "emb"), KEY, "m", "model", 2, "text", buckets=4)


class TestEmbeddingTable:
    def test_schema(self, table, spark, tmp_path):
        assert table.read().columns == ["id", "row_id", "embedding", "source_column", "model_name", "updated_at"]
        chunked = EmbeddingTable.create(spark, str(tmp_path / "c"), KEY, "m", "model", 2, "text", chunked=True)
        assert chunked.read().columns[:5] == ["id", "row_id", "chunk_index", "chunk_text", "embedding"]
        assert table.read().count() == 0 and chunked.read().count() == 0

    def test_create_twice(self, table, spark):
        table.append(vectors(spark, [1]))
        again = EmbeddingTable.create(spark, table.path, KEY, "m", "model", 2, "text")
        assert ids(again.read()) == [1]
        with pytest.raises(NearfieldError):
            EmbeddingTable.create(spark, table.path, KEY, "m", "model", 3, "text")

    def test_append_rewrites_nothing(self, table, spark):
        assert table.append(vectors(spark, range(100))) == 100
        first = table.snapshot().live
        assert table.append(vectors(spark, range(100, 150))) == 50
        assert table.append(vectors(spark, [])) == 0
        assert first.items() <= table.snapshot().live.items()
        assert ids(table.read()) == list(range(150))

    def test_upsert_replaces_and_rewrites_nothing(self, table, spark):
        table.append(vectors(spark, range(100)))
        first = table.snapshot().live
        table.merge(vectors(spark, [3], 2.0))
        rows_ = {r["id"]: r["embedding"] for r in table.read().collect()}
        assert rows_[3] == [2.0, 2.0] and rows_[4] == [1.0, 1.0] and len(rows_) == 100
        assert first.items() <= table.snapshot().live.items()

    def test_compaction_rewrites_only_the_buckets_of_pending_keys(self, table, spark):
        table.append(vectors(spark, range(100)))
        (first,) = table.snapshot().live
        table.merge(vectors(spark, [3], 2.0))
        before = sorted(table.read().drop("updated_at").collect())
        table.compact()
        snap = table.snapshot()
        assert snap.pending == [] and len(snap.live[first]["buckets"]) == 3
        assert sorted(table.read().drop("updated_at").collect()) == before

    @pytest.mark.parametrize("broadcasts", [1, 8])
    def test_random_writes_equal_a_dictionary(self, table, spark, monkeypatch, broadcasts):
        """Merges, deletes, folds, compactions and rewrites in random order."""
        monkeypatch.setattr("nearfield.sources.embedding_table.MOST_BROADCASTS", broadcasts)
        monkeypatch.setattr("nearfield.sources.embedding_table.FOLD_AFTER", 3)
        monkeypatch.setattr("nearfield.sources.embedding_table.BROADCAST_KEYS", 25)
        rng, model = random.Random(11), {}
        for step in range(14):
            keys = rng.sample(range(40), rng.randint(1, 12))
            gone = rng.sample(range(40), rng.randint(0, 6))
            kind = rng.choice(["merge", "merge", "merge", "delete", "append", "rewrite"])
            if kind == "merge":
                table.merge(vectors(spark, keys, float(step)), vectors(spark, gone))
                model = {k: v for k, v in model.items() if k not in gone} | dict.fromkeys(keys, float(step))
            elif kind == "delete":
                table.merge(deletes=vectors(spark, gone))
                model = {k: v for k, v in model.items() if k not in gone}
            elif kind == "append":
                new = [k for k in keys if k not in model]
                table.append(vectors(spark, new, float(step)))
                model |= dict.fromkeys(new, float(step))
            else:
                replace_all(table, vectors(spark, keys, float(step)))
                model = dict.fromkeys(keys, float(step))
            found = table.read().select("id", "embedding").collect()
            assert sorted((r["id"], r["embedding"][0]) for r in found) == sorted(model.items()), (step, kind)
        table.vacuum(keep=1)
        assert ids(table.read()) == sorted(model)

    def test_change_during_an_append_wins(self, table, spark, monkeypatch):
        write = table._write

        def slow(snap, rows, *args, **options):
            result = write(snap, rows, *args, **options)
            monkeypatch.setattr(table, "_write", write)
            EmbeddingTable(spark, table.path).merge(vectors(spark, [1], 2.0), vectors(spark, [2]))
            return result

        monkeypatch.setattr(table, "_write", slow)
        table.append(vectors(spark, [1, 2, 3]))
        assert {r["id"]: r["embedding"][0] for r in table.read().collect()} == {1: 2.0, 3: 1.0}

    def test_two_appends_at_once_are_a_conflict(self, table, spark, monkeypatch):
        write = table._write

        def slow(*args, **options):
            result = write(*args, **options)
            EmbeddingTable(spark, table.path).append(vectors(spark, [1]))
            return result

        monkeypatch.setattr(table, "_write", slow)
        with pytest.raises(CommitConflictError):
            table.append(vectors(spark, [1]))
        assert ids(table.read()) == [1]

    def test_change_during_a_migration_is_migrated_again(self, table, spark):
        table.append(vectors(spark, [1, 2, 3]))
        table.begin_migration("n", "new", 3)
        table.append(vectors(spark, [1, 2, 3], dims=3), staged=True)
        seen = table.snapshot()
        table.merge(vectors(spark, [1], 2.0), vectors(spark, [2]))
        assert ids(table.staged()) == [3] and ids(table.read()) == [1, 3]
        with pytest.raises(CommitConflictError):
            table.finish_migration(seen)
        table.append(vectors(spark, [1], 7.0, dims=3), staged=True)
        table.finish_migration(table.snapshot())
        assert {r["id"]: r["embedding"] for r in table.read().collect()} == {1: [7.0] * 3, 3: [1.0] * 3}
        table.merge(vectors(spark, [3], 8.0, dims=3))
        table.compact()
        assert {r["id"]: r["embedding"][0] for r in table.read().collect()} == {1: 7.0, 3: 8.0}

    def test_upsert_inserts_missing(self, table, spark):
        table.append(vectors(spark, [1]))
        table.merge(vectors(spark, [1, 2], 2.0))
        assert ids(table.read()) == [1, 2]

    def test_delete(self, table, spark):
        table.append(vectors(spark, range(10)))
        table.merge(deletes=vectors(spark, [2, 3, 99]))
        assert ids(table.read()) == [0, 1, 4, 5, 6, 7, 8, 9]

    def test_reads_leave_out_many_keys_without_a_shuffle(self, table, spark, monkeypatch):
        """Pending keys go out in groups that may be broadcast; nothing is rewritten, also while a migration is open."""
        monkeypatch.setattr("nearfield.sources.embedding_table.BROADCAST_KEYS", 10)
        table.append(vectors(spark, range(60)))
        first = next(iter(table.snapshot().live))
        table.begin_migration("m2", "model2", 2)
        table.merge(vectors(spark, range(0, 20), 2.0))
        table.merge(deletes=vectors(spark, range(55, 60)))
        snap = table.snapshot()
        assert len(snap.pending) == 2 and len(snap.live[first]["buckets"]) == snap.buckets
        plan = table.read()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"Exchange (hash|range|rebalance)", plan)
        rows_ = {r["id"]: r["embedding"][0] for r in table.read().collect()}
        assert rows_ == {n: 2.0 if n < 20 else 1.0 for n in range(55)}

    @pytest.mark.parametrize("broadcasts", [1, 8])
    def test_merge_with_keys_too_many_to_broadcast(self, table, spark, monkeypatch, broadcasts):
        monkeypatch.setattr("nearfield.sources.embedding_table.MOST_BROADCASTS", broadcasts)
        monkeypatch.setattr("nearfield.sources.embedding_table.BROADCAST_KEYS", 1)
        table.append(vectors(spark, range(60)))
        table.merge(vectors(spark, range(0, 20), 2.0), vectors(spark, range(50, 60)))
        rows_ = {r["id"]: r["embedding"][0] for r in table.read().collect()}
        assert rows_ == {n: 2.0 if n < 20 else 1.0 for n in range(50)}

    def test_replace_chunks(self, spark, tmp_path):
        table = EmbeddingTable.create(spark, str(tmp_path / "c"), KEY, "m", "model", 2, "text", chunked=True, buckets=2)

        def chunks(number, texts):
            data = [(number, i, t, [1.0, float(i)]) for i, t in enumerate(texts)]
            return spark.createDataFrame(data, "id bigint, chunk_index int, chunk_text string, embedding array<float>")

        assert table.append(chunks(42, ["a", "b", "c"]).union(chunks(7, ["x"]))) == 2
        table.merge(chunks(42, ["d"]))
        assert sorted((r["id"], r["chunk_index"], r["chunk_text"]) for r in table.read().collect()) == [(7, 0, "x"), (42, 0, "d")]
        assert rows.count_embedded(table.read(), ["id"]).first()[0] == 2

    def test_batch_is_applied_once(self, table, spark):
        table.merge(vectors(spark, [1]), stream="s", batch_id=0)
        version = table.snapshot().version
        table.merge(deletes=vectors(spark, [1]), stream="s", batch_id=0)
        assert table.snapshot().version == version and ids(table.read()) == [1]
        table.merge(deletes=vectors(spark, [1]), stream="s", batch_id=1)
        assert ids(table.read()) == []

    def test_open_reader_keeps_its_rows(self, table, spark):
        table.append(vectors(spark, range(10)))
        before = table.read()
        table.merge(deletes=vectors(spark, range(5)))
        replace_all(table, vectors(spark, [77]))
        assert ids(before) == list(range(10)) and ids(table.read()) == [77]
        assert ids(table.read(version=1)) == list(range(10))

    def test_second_writer_is_told(self, table, spark):
        snap = table.snapshot()
        table.append(vectors(spark, [1]))
        with pytest.raises(CommitConflictError):
            table._publish(table._after(snap))
        assert ids(table.read()) == [1]

    def test_wrong_dimensions_are_not_written(self, table, spark):
        with pytest.raises(PySparkException, match="expected 2 dimensions, got 3"):
            table.append(vectors(spark, [1], dims=3))
        assert table.read().count() == 0

    def test_vacuum_keeps_what_is_live(self, table, spark):
        table.append(vectors(spark, range(10)))
        replace_all(table, vectors(spark, range(5)))
        replace_all(table, vectors(spark, range(3)))
        assert len(table.vacuum(keep=1)) == 2
        assert ids(table.read()) == [0, 1, 2]

    def test_lookup_opens_only_the_buckets_of_the_keys(self, table, spark):
        table.append(vectors(spark, range(100)))
        found = table.read_buckets_of(vectors(spark, [5]).select("id"))
        assert 5 in ids(found) and found.count() < 100

    def test_migration_is_staged_and_resumed(self, table, spark):
        table.append(vectors(spark, range(4)))
        table.begin_migration("n", "new", 3)
        table.append(vectors(spark, [0, 1], dims=3), staged=True)
        assert ids(table.read()) == [0, 1, 2, 3] and ids(table.staged()) == [0, 1]
        table.begin_migration("n", "new", 3)
        with pytest.raises(NearfieldError):
            table.begin_migration("other", "other", 5)
        table.append(vectors(spark, [2, 3], dims=3), staged=True)
        table.finish_migration()
        assert table.snapshot().dims == 3 and {len(r["embedding"]) for r in table.read().collect()} == {3}
        with pytest.raises(NearfieldError):
            table.finish_migration()


class TestIndexing:
    @pytest.fixture()
    def source(self, spark, tmp_path):
        def write(data, name="docs"):
            path = str(tmp_path / f"{name}-{len(data)}")
            spark.createDataFrame(data, "id bigint, title string, body string").write.mode("overwrite").parquet(path)
            return path
        return write

    def entry(self, spark, models, registry, path, tmp_path, **options):
        arguments = {"column": "body", "model": "hash-64", "primary_key": ["id"], "buckets": 2, **options}
        return setup.apply_table(spark, registry, models, table="docs", source=path, root=str(tmp_path / "emb"), **arguments)

    def test_incremental(self, spark, models, source, tmp_path):
        entry = self.entry(spark, models, Registry(), source([(1, "a", "one"), (2, "b", None), (3, "c", "")]), tmp_path)
        assert indexing.index_table(spark, entry, models).rows == 2
        assert indexing.index_table(spark, entry, models).rows == 0
        entry.source = source([(1, "a", "one"), (2, "b", "two"), (3, "c", ""), (4, "d", "four")])
        report = indexing.index_table(spark, entry, models)
        assert report.rows == 2 and report.rows_per_minute > 0
        assert ids(entry.embeddings(spark).read()) == [1, 2, 3, 4]

    def test_blank_text_of_a_chunked_table_is_handled_once(self, spark, models, source, tmp_path):
        path = source([(1, "a", "one two"), (2, "b", "  \n "), (3, "c", None)])
        entry = self.entry(spark, models, Registry(), path, tmp_path, chunked=True)
        assert indexing.index_table(spark, entry, models).rows == 2
        assert indexing.index_table(spark, entry, models).rows == 0
        found = rows.coverage(entry.rows(spark), entry.embeddings(spark).read(), ["id"], ["body"]).first()
        assert (found["embedded"], found["total"], found["coverage_pct"]) == (1, 2, 50.0)

    def test_migrate_and_reindex(self, spark, models, source, tmp_path):
        registry, path = Registry(), str(tmp_path / "registry.json")
        entry = self.entry(spark, models, registry, source([(i, "t", f"text {i}") for i in range(6)]), tmp_path)
        indexing.index_table(spark, entry, models)
        with pytest.raises(NearfieldError):
            indexing.migrate_table(spark, registry, "docs", "hash-64", models)
        assert indexing.migrate_table(spark, registry, "docs", "hash-128", models, path).rows == 6
        assert Registry.load(spark, path).require("docs").dims == 128
        assert {len(r["embedding"]) for r in entry.embeddings(spark).read().collect()} == {128}
        assert indexing.reindex_table(spark, registry.require("docs"), models).rows == 6

    def test_migration_that_broke_off_goes_on(self, spark, models, source, tmp_path):
        registry = Registry()
        entry = self.entry(spark, models, registry, source([(i, "t", f"text {i}") for i in range(6)]), tmp_path)
        indexing.index_table(spark, entry, models)
        model = models.get("hash-128")
        target = entry.embeddings(spark)
        target.begin_migration(model.key, model.model_name, model.dims)
        done = entry.rows(spark).where("id < 4")
        target.append(indexing.embed_rows(done, ["id"], ["body"], model), staged=True)
        progress = status.migration_progress(rows.with_content(entry.rows(spark), ["body"]), target.staged(), ["id"])
        assert progress.first().asDict() == {"total": 6, "already": 4, "remaining": 2, "progress_pct": 66.7}
        assert status.table_status(spark, entry).first()["migrating"]
        assert indexing.migrate_table(spark, registry, "docs", "hash-128", models).rows == 2
        assert ids(target.read()) == list(range(6))

    def test_source_in_parts(self, spark, models, tmp_path):
        path = str(tmp_path / "many")
        spark.range(40).selectExpr("id", "concat('text ', id) AS body").repartition(8).write.parquet(path)
        registry = Registry()
        entry = self.entry(spark, models, registry, path, tmp_path)
        assert indexing.index_table(spark, entry, models, steps=3).rows == 40
        assert len(entry.embeddings(spark).snapshot().live) > 1
        assert indexing.index_table(spark, entry, models, steps=3).rows == 0
        assert indexing.reindex_table(spark, entry, models, steps=2).rows == 40
        assert indexing.migrate_table(spark, registry, "docs", "hash-128", models, steps=3).rows == 40
        assert ids(entry.embeddings(spark).read()) == list(range(40))
        joined = spark.read.parquet(path).join(spark.range(30), "id")
        assert sum(part.count() for part in indexing._steps(joined, ["id"], 4)) == 30

    def test_model_that_does_not_keep_its_promise(self, spark, models, source, tmp_path):
        registry = Registry()
        self.entry(spark, models, registry, source([(1, "t", "x")]), tmp_path)
        models.register(Embedder("liar", "liar", 5, lambda: lambda texts: [[1.0] for _ in texts]))
        with pytest.raises(NearfieldError):
            indexing.migrate_table(spark, registry, "docs", "liar", models)

    def test_pending_keys_when_nothing_fits_a_broadcast(self, spark, monkeypatch):
        source = spark.createDataFrame([(i, "x") for i in range(50)], "id bigint, text string")
        done = vectors(spark, range(0, 50, 2))
        for limit in (10, 24, 25, 1000):
            monkeypatch.setattr(joins, "BROADCAST_KEYS", limit)
            assert ids(rows.unembedded_rows(source, done, ["id"], ["text"])) == list(range(1, 50, 2))
            assert ids(joins.rows_with_keys(source, done, ["id"])) == list(range(0, 50, 2))


class TestPlaces:
    """Wide rows of files and more keys than are broadcast: rows are found by their place, no text is shuffled."""

    @pytest.fixture()
    def wide(self, spark, tmp_path):
        path = str(tmp_path / "wide")
        rows = spark.range(0, 120_000, 1, 3).select("id", F.concat(F.lit("text "), "id").alias("text"))
        rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 'no key' AS text").coalesce(1)).write.parquet(path)
        return spark.read.parquet(path)

    @pytest.mark.parametrize("groups", [1, 3])
    def test_rows_by_place(self, spark, wide, monkeypatch, groups):
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 100)
        monkeypatch.setattr(joins, "BROADCAST_BYTES", joins.BROADCAST_BYTES if groups == 1 else 3 * joins.BITMAP_BYTES)
        keys = spark.range(0, 120_000, 3).unionByName(spark.range(500_000, 500_100)).select("id")
        present = wide.where("text != 'text 30'")
        for found, want in (
            (joins.rows_with_keys(present, keys, ["id"]), [i for i in range(0, 120_000, 3) if i != 30]),
            (joins.rows_without_keys(present, keys, ["id"]), [i for i in range(120_000) if i % 3] + [None]),
        ):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet [id") == groups and not re.search(r"(?<!Broadcast)Exchange", plan)
            rows = found.collect()
            assert sorted((r["id"] for r in rows), key=str) == sorted(want, key=str) and found.columns == ["id", "text"]
            assert all(r["text"] == ("no key" if r["id"] is None else f"text {r['id']}") for r in rows)

    def test_rows_without_places_meet_in_a_shuffle(self, spark, monkeypatch):
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 10)
        rows, keys = spark.range(100).withColumn("text", F.lit("x")), spark.range(0, 100, 2)
        assert sorted(ids(joins.rows_with_keys(rows, keys, ["id"]))) == list(range(0, 100, 2))
        assert sorted(ids(joins.rows_without_keys(rows, keys, ["id"]))) == list(range(1, 100, 2))

    def test_nothing_is_left(self, spark, wide, monkeypatch):
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 10)
        assert joins.rows_with_keys(wide, spark.range(200_000, 200_100), ["id"]).count() == 0


class TestSetup:
    @pytest.fixture()
    def source(self, products, tmp_path):
        path = str(tmp_path / "products")
        products.write.parquet(path)
        return path

    def test_registry_file(self, spark, models, source, tmp_path):
        path = str(tmp_path / "registry.json")
        assert Registry.load(spark, path) is None
        registry = Registry()
        setup.apply_table(spark, registry, models, table="products", source=source, root=str(tmp_path / "e"),
                          primary_key=["id"], columns=["name", "description"], model="openai-large", chunked=True, storage="inline")
        registry.save(spark, path)
        back = Registry.load(spark, path)
        assert back == registry and back.require("products").dims == 3072
        assert back.require("products").storage == "external"
        assert back.to_df(spark).first()["columns"] == ["name", "description"]

    def test_older_registry_gets_defaults(self, spark, tmp_path):
        path = str(tmp_path / "registry.json")
        old = {"version": "1", "entries": [{"table": "t", "source": "t", "columns": ["a"], "model": "local", "model_name": "n",
                                            "dims": 384, "path": "p", "unknown": 1}]}
        files.write_text(spark, path, json.dumps(old), replace=True)
        entry = Registry.load(spark, path).require("t")
        assert (entry.primary_key, entry.chunked, entry.chunk_words, entry.chunk_overlap) == (["id"], False, 256, 64)
        for broken in ("{", "[]", '{"entries": []}', '{"version": "1", "entries": [{"table": "t"}]}'):
            files.write_text(spark, path, broken, replace=True)
            with pytest.raises(RegistryError):
                Registry.load(spark, path)

    def test_same_name_in_two_schemas(self):
        registry = Registry()
        for schema in ("a", "b", "a"):
            registry.put(TableEntry("t", "t", ["x"], "m", "n", 1, "p", schema=schema))
        assert len(registry.entries) == 2 and registry.get("t", "a").schema == "a"
        with pytest.raises(RegistryError):
            registry.get("t")
        with pytest.raises(RegistryError):
            registry.require("u")

    @pytest.mark.parametrize(
        "change",
        [{"column": None}, {"columns": ["name"]}, {"column": "price"}, {"primary_key": ["nope"]}, {"primary_key": []},
         {"primary_key": ["kind"]}, {"table": "a b"}, {"model": "nothing"}, {"storage": "cloud"},
         {"chunk_words": 5, "chunk_overlap": 5}],
    )
    def test_bad_requests(self, spark, models, products, tmp_path, change):
        path = str(tmp_path / "with-kind")
        products.withColumn("kind", F.lit("x")).write.parquet(path)
        arguments = {"table": "products", "source": path, "root": str(tmp_path / "e"), "primary_key": ["id"],
                     "column": "description", "model": "hash-64", **change}
        registry = Registry()
        with pytest.raises(NearfieldError):
            setup.apply_table(spark, registry, models, **arguments)
        assert registry.entries == []

    def test_many_and_teardown(self, spark, models, source, tmp_path):
        registry = Registry()
        good = {"table": "products", "source": source, "root": str(tmp_path / "e"), "primary_key": ["id"],
                "column": "description", "model": "hash-64"}
        report = setup.apply_many(spark, registry, models, [{**good, "column": "nope"}, good, {"table": "x"}, {**good, "source": "/nowhere/x"}])
        assert [r["ok"] for r in report.collect()] == [False, True, False, False]
        with pytest.raises(RegistryError):
            setup.apply_many(spark, registry, models, [good] * 21)
        jobs = spark.createDataFrame([("products", 1), ("other", 2)], "table_name string, id int")
        removed, left = setup.teardown_table(spark, registry, "products", jobs)
        assert removed == {"embeddings": True, "registration": True, "jobs": True}
        assert [r["id"] for r in left.collect()] == [2] and registry.entries == []
        assert not files.exists(spark, str(tmp_path / "e" / "public.products"))

    def test_two_schemas_with_the_same_table(self, spark, models, source, tmp_path):
        registry = Registry()
        for schema in ("one", "two"):
            setup.apply_table(spark, registry, models, table="docs", source=source, root=str(tmp_path / schema),
                              primary_key=["id"], column="description", model="hash-64", schema=schema)
        jobs = spark.createDataFrame([("one", "docs", 1, "pending"), ("one", "docs", 2, "pending"), ("two", "docs", 3, "failed")],
                                     "table_schema string, table_name string, id int, status string")
        found = {r["table_schema"]: (r["pending"], r["failed"]) for r in status.status(spark, registry, jobs).collect()}
        assert found == {"one": (2, 0), "two": (0, 1)}
        with pytest.raises(RegistryError):
            setup.teardown_table(spark, registry, "docs", jobs)
        removed, left = setup.teardown_table(spark, registry, "docs", jobs, schema="one")
        assert removed["jobs"] and [r["id"] for r in left.collect()] == [3]
        assert [e.schema for e in registry.entries] == ["two"]

    @pytest.mark.parametrize("name,ok", [("a_1", True), ("_x", True), ("1a", False), ("a-b", False), ("", False), ("a" * 128, True), ("a" * 129, False)])
    def test_identifiers(self, name, ok):
        if ok:
            assert registry_module.check_identifier(name) == name
        else:
            with pytest.raises(RegistryError):
                registry_module.check_identifier(name)


class TestRows:
    def test_pages(self, products):
        first = rows.keyset_page(products, ["id"], 5).collect()
        second = rows.keyset_page(products, ["id"], 5, [first[-1]["id"]]).collect()
        assert [r["id"] for r in first + second] == list(range(1, 11))

    def test_composite_pages_cover_everything_once(self, spark):
        df = spark.createDataFrame([(a, b) for a in "abc" for b in range(4)], "k string, n int")
        seen, last = [], None
        while page := rows.keyset_page(df, ["k", "n"], 5, last).collect():
            seen += [tuple(r) for r in page]
            last = list(page[-1])
        assert seen == [(a, b) for a in "abc" for b in range(4)]

    def test_detail(self, spark):
        df = spark.createDataFrame([(1, "x" * 2100, [1.0], b"z")], "id int, t string, embedding array<double>, b binary")
        row = rows.row_detail(df, ["id"], "1").first()
        assert row["id"] == "1" and len(row["t"]) == 2003 and row["b"] == "bytes" and "embedding" not in row
        assert rows.row_detail(df, ["id"], "2").count() == 0 and rows.row_detail(df, ["id"], "x").count() == 0

    def test_fetch_content(self, spark):
        source = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, t string")
        keys = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id bigint")
        assert sorted(rows.fetch_content(keys, source, ["id"], ["t"]).collect()) == [(1, "a"), (2, None), (3, None)]

    def test_key_violations(self, spark):
        df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c")], "id bigint, k string")
        assert sorted(tuple(r) for r in rows.key_violations(df.where("id is not null"), ["id"]).collect()) == [(1, 2)]
        assert rows.key_violations(df, ["id"]).count() == 2
        with pytest.raises(NearfieldError):
            rows.require_key(df, ["id"])
        rows.require_key(df.where("id is not null"), ["id", "k"])

    def test_orphans(self, spark):
        source = spark.createDataFrame([(1, "a")], "id bigint, t string")
        assert ids(rows.orphan_embeddings(vectors(spark, [1, 2]), source, ["id"])) == [2]


class TestProfile:
    def test_sample_that_caught_nothing_falls_back(self, spark):
        df = spark.createDataFrame([("abc", None), ("abcde", None)], "a string, b string")
        found = {r["column_name"]: (r["avg_length"], r["sampled_rows"]) for r in profile.table_profile(df, "t", share=1e-9).collect()}
        assert found == {"a": (4.0, 2), "b": (0.0, 0)}

    def test_order_and_json(self, spark):
        df = spark.createDataFrame([("x" * 300, "y" * 60, "z", 1)], "description string, notes string, email string, n int")
        found = profile.inspect(spark, {"t": df, "u": df}, share=1.0, only="t")
        assert [(r["column_name"], r["score"], r["stars"]) for r in found.collect()] == [
            ("description", 3.5, "★★★"), ("notes", 2.5, "★★★"), ("email", 1.0, "★☆☆")]
        assert json.loads(profile.candidates_json(found).first()[0])["sampled_rows"] == 1

    def test_table_that_cannot_be_read(self, spark, tmp_path):
        path = str(tmp_path / "gone")
        spark.createDataFrame([("x",)], "text string").write.parquet(path)
        df = spark.read.parquet(path)
        files.delete(spark, path)
        row = profile.inspect(spark, {"gone": df}, share=0.5).first()
        assert (row["column_name"], row["avg_length"], row["sampled_rows"]) == ("text", 0.0, 0)

    def test_bad_table_does_not_fail_the_status_of_others(self, spark, models, products, tmp_path):
        registry, paths = Registry(), []
        for name in ("good", "bad"):
            paths.append(str(tmp_path / name))
            products.write.parquet(paths[-1])
            entry = setup.apply_table(spark, registry, models, table=name, source=paths[-1], root=str(tmp_path / "e"),
                                      primary_key=["id"], column="description", model="hash-64", buckets=2)
            indexing.index_table(spark, entry, models)
        files.delete(spark, entry.path + "/" + [n for n in files.names(spark, entry.path) if n.startswith("gen=")][0])
        jobs = spark.createDataFrame([("good", "failed"), ("good", "pending"), ("other", "failed")], "table_name string, status string")
        found = {r["table_name"]: r for r in status.status(spark, registry, jobs).collect()}
        assert (found["good"]["coverage_pct"], found["good"]["failed"], found["good"]["pending"], found["good"]["error"]) == (100.0, 1, 1, None)
        assert found["bad"]["error"] and found["bad"]["embedded"] is None and found["bad"]["failed"] == 0

    def test_tables(self, spark, products):
        products.createOrReplaceTempView("shop_products")
        spark.sql("CREATE DATABASE IF NOT EXISTS second_place")
        spark.sql("CREATE OR REPLACE VIEW second_place.nearfield_shown AS SELECT 1 AS one")
        names = {(r["table_name"], r["table_schema"]) for r in tables.list_tables(spark).collect()}
        assert {("shop_products", ""), ("nearfield_shown", "second_place")} <= names
        assert [tuple(r) for r in tables.list_tables(spark, ["second_place"]).collect()] == [("nearfield_shown", "second_place")]
        catalog = tables.table_catalog({"p": products}).orderBy("ordinal").collect()
        assert [(r["column_name"], r["data_type"], r["row_count"]) for r in catalog] == [
            ("id", "bigint", 10), ("name", "string", 10), ("description", "string", 10)]
        context = tables.schema_context({"p": products, "q": products}, {"p": ["id"]}, only=["p"]).collect()
        assert len(context) == 1 and len(context[0]["samples"]) == 3 and json.loads(context[0]["samples"][0])["id"] == "1"
        assert tables.sample_rows(products, 10, ["id"]).count() == 10
        with pytest.raises(NearfieldError):
            tables.sample_rows(products, 11, ["id"])


class TestParts:
    def test_embedded_keys_are_read_once(self, spark, models, tmp_path, monkeypatch):
        path, registry = str(tmp_path / "docs"), Registry()
        spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id bigint, body string").repartition(8).write.parquet(path)
        entry = setup.apply_table(spark, registry, models, table="docs", source=path, root=str(tmp_path / "emb"),
                                  primary_key=["id"], column="body", model="hash-64", buckets=2)
        some = entry.rows(spark).where("id % 3 = 0")
        entry.embeddings(spark).append(indexing.embed_rows(some, ["id"], ["body"], models.get("hash-64")))
        calls = []
        whole = indexing.embedded_keys
        monkeypatch.setattr(indexing, "embedded_keys", lambda *a: calls.append(1) or whole(*a))
        assert indexing.index_table(spark, entry, models, steps=4).rows == 26 and len(calls) == 1
        assert sorted(ids(entry.embeddings(spark).read())) == list(range(40))


class TestSampledProfile:
    def test_samples_are_whole_files_and_carry_their_error(self, spark, tmp_path, monkeypatch):
        """Of 60 files some are read, the others are not; the truth lies within a few errors of the estimate."""
        path = str(tmp_path / "many")
        rows = spark.range(0, 6000, 1, 60).select("id", F.repeat(F.lit("x"), (F.col("id") % 40 + F.floor(F.col("id") / 100)).cast("int")).alias("t"))
        rows.write.parquet(path)
        df = spark.read.parquet(path)
        monkeypatch.setattr(profile, "LEAST_FILES", 5)
        some = profile.sampled(df, 0.25)
        read = len(some.select("_metadata.file_path").distinct().collect())
        assert 5 <= read <= 30 and some.count() == 100 * read
        # the files are left out when the scan is planned
        assert len(some.rdd.glom().map(len).collect()) < 60
        row = profile.length_estimates(df, ["t"], 0.25).first()
        truth = df.agg(F.avg(F.length("t"))).first()[0]
        assert row["files"] == read and 0 < row["error"] < 10 and abs(row["avg_length"] - truth) < 4 * row["error"]
        whole = profile.length_estimates(df, ["t"], 1.0).first()
        assert (round(whole["avg_length"], 6), whole["error"], whole["sampled_rows"]) == (round(truth, 6), 0.0, 6000)

    def test_tables_of_few_files_are_sampled_by_row(self, spark):
        df = spark.range(2000).select(F.lit("abc").alias("t"))
        assert 50 < profile.sampled(df, 0.05).count() < 200
        row = profile.length_estimates(df, ["t"], 0.05).first()
        assert (row["avg_length"], row["error"]) == (3.0, None)


class TestBoundedSql:
    @pytest.mark.parametrize("sql", [
        "INSERT INTO t VALUES (1)", "DELETE FROM t", "SELECT 1; DROP TABLE t", "DROP VIEW t", "CREATE TABLE u AS SELECT 1", "SHOW TABLES",
        "", "-- SELECT 1", "SELECTED", "SET spark.sql.ansi.enabled = false", "CACHE TABLE t AS SELECT 1", "EXPLAIN SELECT 1",
        "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x", "FROM t INSERT INTO u SELECT *",
    ])
    def test_other_statements_are_refused(self, spark, sql):
        with pytest.raises(UnsafeQueryError):
            check_select(spark, sql)

    @pytest.mark.parametrize("sql", [
        "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT `reflect`('a', 'b')", "SELECT reflect/**/('java.lang.System','getProperty','user.dir')",
        "SELECT reflect -- note\n('java.lang.System', 'getProperty', 'user.dir')", "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.System', 'nanoTime'))",
        "SELECT 1 FROM (WITH x AS (SELECT a FROM sly) SELECT a FROM x)", "SELECT 1 FROM (WITH x AS (SELECT Reflect('java.lang.System', 'nanoTime') AS a) SELECT a FROM x)", "SELECT * FROM sly", "SELECT (SELECT max(a) FROM sly) AS b",
        "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))", "SELECT TRANSFORM(id) USING 'cat' AS (a STRING) FROM range(3)",
    ])
    def test_programs_are_refused_whatever_they_are_written_like(self, spark, sql):
        spark.sql("SELECT reflect('java.lang.System', 'nanoTime') AS a").createOrReplaceTempView("sly")
        with pytest.raises(UnsafeQueryError):
            check_select(spark, sql)

    @pytest.mark.parametrize("sql", [
        "SELECT 1", "  select 'drop table; x' AS a ;", "-- a note\nSELECT 1", "/* update */ SELECT 1 -- delete", "SELECT credit_limit FROM t",
        "SELECT `create` FROM t", "SELECT `create` AS copy FROM t", "SELECT reflection FROM t", "SELECT 'reflect(1)' AS a; -- reflect('a')",
        "SELECT * FROM (WITH x AS (SELECT * FROM t) SELECT * FROM x UNION ALL SELECT * FROM x)", "SELECT transform(array(1), x -> x + 1)",
    ])
    def test_allowed(self, spark, sql):
        spark.createDataFrame([(1, 2, 3)], "credit_limit int, `create` int, reflection int").createOrReplaceTempView("t")
        check_select(spark, sql)

    @pytest.mark.parametrize("path", ["text.`/etc/hostname`", "parquet.`/root/testdata`", "csv.`/etc`", "(SELECT * FROM json.`/etc`)"])
    def test_files_are_out_of_reach(self, spark, path):
        with pytest.raises(UnsafeQueryError, match="only registered tables"):
            run_bounded(spark, f"SELECT * FROM {path}")
        assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == "true"

    def test_result_is_bounded_and_text(self, spark):
        spark.range(500).createOrReplaceTempView("numbers")
        result = run_bounded(spark, "SELECT id, array(id) AS a, repeat('x', 600) AS t, CAST(NULL AS STRING) AS n, 5 AS credit_limit FROM numbers ORDER BY id")
        assert (result.row_count, result.truncated, result.columns) == (100, True, ["id", "a", "t", "n", "credit_limit"])
        assert result.rows[0] == {"id": "0", "a": "list", "t": "x" * 500 + "...", "n": None, "credit_limit": "5"}
        small = run_bounded(spark, "SELECT id FROM numbers WHERE id < 100")
        assert (small.row_count, small.truncated) == (100, False)


class TestMaps:
    def test_projection(self, spark):
        import numpy as np

        rng = np.random.default_rng(42)
        data = rng.normal(size=(60, 12)) * np.linspace(4, 1, 12)
        df = spark.createDataFrame([(i, [float(x) for x in v], "l" * 200) for i, v in enumerate(data)], "id bigint, embedding array<double>, label string")
        points = project_2d(df, ["id"], F.col("label")).orderBy("id").collect()
        got = np.array([[p["x"], p["y"]] for p in points])
        assert got.min(axis=0).tolist() == [0.0, 0.0] and got.max(axis=0).tolist() == [1.0, 1.0]
        assert {len(p["label"]) for p in points} == {100}
        centred = data - data.mean(axis=0)
        _, _, directions = np.linalg.svd(centred, full_matrices=False)
        expected = centred @ directions[:2].T
        expected = (expected - expected.min(axis=0)) / (expected.max(axis=0) - expected.min(axis=0))
        for axis in range(2):
            same = np.abs(got[:, axis] - expected[:, axis]).max()
            mirrored = np.abs(got[:, axis] - (1 - expected[:, axis])).max()
            assert min(same, mirrored) < 2e-3

    def test_too_few_or_equal_points(self, spark):
        assert project_2d(vectors(spark, [1]), ["id"]).count() == 0
        assert {(p["x"], p["y"]) for p in project_2d(vectors(spark, [1, 2, 3]), ["id"]).collect()} == {(0.0, 0.0)}

    def test_sample(self, spark):
        df = vectors(spark, range(100))
        one, two = sample_rows(df, ["id"], 10), sample_rows(df.repartition(5), ["id"], 10)
        assert ids(one) == ids(two) and len(ids(one)) == 10 and ids(one) != ids(sample_rows(df, ["id"], 10, seed=7))
        for n in (0, 5001):
            with pytest.raises(NearfieldError):
                sample_rows(df, ["id"], n)

    def test_clusters_and_keywords(self, spark):
        data = [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0], "apple pear apple" if i % 2 else "wrench bolt apple") for i in range(10)]
        df = spark.createDataFrame(data, "id bigint, embedding array<float>, text string")
        members = topic_clusters(df, ["id"], 2)
        by_cluster = {}
        for r in members.collect():
            by_cluster.setdefault(r["cluster"], set()).add(r["id"] % 2)
        assert sorted(map(sorted, by_cluster.values())) == [[0], [1]]
        words = cluster_keywords(members, df, ["id"], "text", top=2).collect()
        odd = [c for c, parity in by_cluster.items() if parity == {1}][0]
        assert [w["term"] for w in words if w["cluster"] == odd] == ["pear", "apple"]
        assert [(w["term"], w["tf"], w["df"]) for w in words if w["cluster"] != odd] == [("bolt", 5, 5), ("wrench", 5, 5)]


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named
    assert scratch_path(spark, "a").startswith(scratch_root(spark))


def test_hash_model_is_equal_everywhere(spark):
    assert hash_embedder(64).embed_query("one two") == hash_embedder(64).embed_query("two ONE")
