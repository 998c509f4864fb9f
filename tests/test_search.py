import json
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError, InvalidFilterError, NearfieldError
from nearfield.functions.embedders import Embedder, hash_embedder
from nearfield.operators import ann, joins, topk
from nearfield.operators.search import Searchable, TaggedTable, escaped_pattern, search_all, shaped
from nearfield.operators import search as searching
from nearfield.plans.indexing import embed_rows, index_table, migrate_table, reindex_table
from nearfield.plans.setup import apply_table
from nearfield.plans.text_search import build_lists, search
from nearfield.registry import Registry
from nearfield.sources import files, results
from nearfield.sources.vector_lists import VectorLists

HOT = [1.0 if i == 1 else 0.01 for i in range(384)]
FLAT = [0.1] * 384


@pytest.fixture()
def table(products, product_vectors):
    return Searchable(products, product_vectors, ["id"], ["description"])


def ids(df):
    return [r["id"] for r in df.collect()]


class TestTopK:
    def test_best_first(self, product_vectors):
        rows = topk.nearest(product_vectors, ["id"], HOT, 3).collect()
        assert [r["id"] for r in rows] == [1, 2, 3]
        assert rows[0]["similarity"] == pytest.approx(1.0, abs=1e-6)
        assert rows[1]["similarity"] == pytest.approx(0.0561, abs=1e-4)

    def test_ties_are_in_key_order(self, product_vectors):
        assert ids(topk.nearest(product_vectors.repartition(7), ["id"], FLAT, 10)) == list(range(1, 11))

    def test_repeated_texts_tie(self, spark):
        """A text written once or many times has the same direction, so the lowest keys win."""
        model = hash_embedder(64)
        source = spark.createDataFrame([(i, "late deliveries of heavy goods " * (i + 1)) for i in range(60)], "id bigint, t string")
        rows = embed_rows(source, ["id"], ["t"], model).repartition(5)
        query = model.embed_query("late deliveries of heavy goods")
        assert ids(topk.nearest(rows, ["id"], query, 8)) == list(range(8))
        scored = topk.best_of(topk.similarities(rows, ["id"], query), ["id"], 8)
        assert scored.collect() == topk.nearest(rows, ["id"], query, 8).collect()

    def test_scores_in_one_scan_equal_the_ranked_ones(self, spark):
        rng = np.random.default_rng(8)
        rows = [(i, i % 4, [float(x) for x in rng.normal(size=5)]) for i in range(400)] + [(900, 0, [0.0] * 5)]
        df = spark.createDataFrame(rows, "id bigint, n int, embedding array<float>")
        for part in (None, "n"):
            scored = topk.best_of(topk.similarities(df, ["id"], [1.0, 2.0, 0.0, 1.0, 3.0], part=part), ["id"], 500, part)
            assert scored.collect() == topk.nearest(df, ["id"], [1.0, 2.0, 0.0, 1.0, 3.0], 500, part=part).collect()

    def test_null_vectors_are_left_out_and_zero_vectors_come_last(self, spark):
        df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "id bigint, embedding array<float>")
        rows = topk.nearest(df, ["id"], [1.0, 0.0], 10).collect()
        assert [(r["id"], None if r["similarity"] is None else round(r["similarity"], 4)) for r in rows] == [
            (4, 0.7071), (3, 0.0), (2, None)]

    def test_a_third_of_all_rows_are_copies(self, spark):
        """Copies of one vector fill whole batches; the lowest keys must still win."""
        rng = np.random.default_rng(5)
        rows = [(i, [1.0, 0.5, 0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(9000)]
        df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(11)
        query = [1.0, 0.5, 0.0]
        assert ids(topk.nearest(df, ["id"], query, 50)) == [i for i in range(0, 9000, 3)][:50]

    def test_batch_equals_one_by_one(self, spark):
        rng = np.random.default_rng(1)
        df = spark.createDataFrame(
            [(f"k{i}", i % 5, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(500)],
            "a string, b int, embedding array<float>",
        ).repartition(6)
        asked = spark.createDataFrame([(f"q{i}", [float(x) for x in rng.normal(size=4)]) for i in range(7)], "q string, v array<double>")
        found = topk.nearest_batch(df, ["a", "b"], asked, "q", 9, query_embedding="v").collect()
        for row in asked.collect():
            expected = topk.nearest(df, ["a", "b"], row["v"], 9).collect()
            mine = sorted((r for r in found if r["q"] == row["q"]), key=lambda r: r["rank"])
            assert [(r["a"], r["b"]) for r in mine] == [(r["a"], r["b"]) for r in expected]

    def test_many_queries_travel_in_several_blocks(self, spark, product_vectors, monkeypatch):
        whole = topk.nearest_batch(product_vectors, ["id"], product_vectors.withColumnRenamed("id", "q"), "q", 3).collect()
        monkeypatch.setattr(topk, "QUERY_BYTES_PER_BLOCK", 384 * 8 * 3)
        parts = topk.nearest_batch(product_vectors, ["id"], product_vectors.withColumnRenamed("id", "q"), "q", 3).collect()
        assert sorted(parts) == sorted(whole) and len(parts) == 30

    @pytest.mark.parametrize("part", [None, "part"])
    def test_more_queries_than_one_scan_takes(self, spark, product_vectors, monkeypatch, part):
        """Passes hold a bounded number of queries each, and give what one pass gives."""
        vectors = product_vectors.withColumn("part", F.lit(0)) if part else product_vectors
        asked = product_vectors.withColumnRenamed("id", "q")
        whole = topk.nearest_batch(vectors, ["id"], asked, "q", 3, part=part).collect()
        monkeypatch.setattr(topk, "FEW_QUERIES", 2)
        sent, plain = [], topk._local_best
        monkeypatch.setattr(topk, "_local_best", lambda present, key, blocks, *more: plain(
            present, key, [sent.append(len(b[0])) or b for b in blocks], *more))
        passes = topk.nearest_batch(vectors, ["id"], asked, "q", 3, part=part, pass_bytes=384 * 8 * 4)
        assert sorted(passes.collect()) == sorted(whole) and len(whole) == 30
        assert sum(sent) == 10 and len(sent) > 2 and max(sent) <= 4

    def test_rows_of_one_query_meet_in_two_steps(self, spark, product_vectors, monkeypatch):
        monkeypatch.setattr(topk, "estimated_bytes", lambda df: 1 << 50)
        found = topk.nearest_batch(product_vectors, ["id"], product_vectors.withColumnRenamed("id", "q"), "q", 3)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number") >= 2 and "_group" in plan

    def test_no_queries(self, spark, product_vectors):
        none = product_vectors.where("id < 0").withColumnRenamed("id", "q")
        assert topk.nearest_batch(product_vectors, ["id"], none, "q", 3).count() == 0

    def test_wrong_length(self, product_vectors):
        with pytest.raises(PySparkException, match="table holds"):
            topk.nearest(product_vectors, ["id"], [1.0, 2.0], 3).collect()
        with pytest.raises(PySparkException, match="table holds"):
            topk.similarities(product_vectors, ["id"], [1.0, 2.0]).collect()

    def test_best_chunk_per_row(self, spark):
        angle = lambda s: [float(s), float(np.sqrt(1 - s * s))]
        df = spark.createDataFrame(
            [("1", 0, angle(0.9)), ("1", 1, angle(0.7)), ("2", 0, angle(0.85))], "row_id string, n int, embedding array<float>")
        rows = topk.nearest(df, ["row_id"], [1.0, 0.0], 10, part="n").collect()
        assert [(r["row_id"], r["n"], round(r["similarity"], 2)) for r in rows] == [("1", 0, 0.9), ("2", 0, 0.85)]

    def test_best_chunk_with_one_row_owning_a_third_of_the_chunks(self, spark):
        rng = random.Random(3)
        rows = [("hot" if i % 3 == 0 else f"r{i % 40}", i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(6000)]
        df = spark.createDataFrame(rows, "k string, n int, embedding array<float>").repartition(9)
        query = np.array([0.6, 0.8])
        best = {}
        for key, n, v in rows:
            v = np.asarray(v, dtype=np.float32).astype(float)
            s = round(float(v @ query / np.sqrt(v @ v)), 12)
            if key not in best or (-s, n) < (-best[key][0], best[key][1]):
                best[key] = (s, n)
        expected = sorted(((-s, k, n) for k, (s, n) in best.items()))[:8]
        found = topk.nearest(df, ["k"], list(query), 8, part="n").collect()
        assert [(r["k"], r["n"]) for r in found] == [(k, n) for _, k, n in expected]


class TestSearch:
    def test_result_columns(self, table):
        found = table.search(HOT, 2)
        assert found.columns == ["row_id", "content", "similarity", "id", "name", "description"]
        assert found.first()["content"].startswith("Folding wooden")

    def test_several_columns_make_the_content(self, products, product_vectors):
        found = Searchable(products, product_vectors, ["id"], ["name", "description"]).search(HOT, 1).first()
        assert found["content"].startswith("name: Garden Chair\ndescription: Folding")

    def test_empty_filter_equals_no_filter(self, table):
        assert table.search(FLAT, 5, {}).collect() == table.search(FLAT, 5).collect()

    @pytest.mark.parametrize(
        "filters,expected",
        [
            ({"name": "garden CHAIR"}, [1]),
            ({"name": "%mat%"}, [4]),
            ({"name": "_ent"}, [9]),
            ({"id_max": 3}, [1, 2, 3]),
            ({"id_min": 8}, [8, 9, 10]),
            ({"id_min": 3, "id_max": 4, "name": "Yoga%"}, [4]),
            ({"id": 7}, [7]),
            ({"name": None}, []),
        ],
    )
    def test_filters(self, table, filters, expected):
        assert sorted(ids(table.search(FLAT, 10, filters))) == expected

    def test_filters_when_the_allowed_keys_are_too_many_to_broadcast(self, table, monkeypatch):
        for keys, literals in ((2, 1000), (2, 5)):
            monkeypatch.setattr(joins, "BROADCAST_KEYS", keys)
            monkeypatch.setattr("nearfield.operators.search.LITERAL_KEYS", literals)
            assert ids(table.search(FLAT, 2, {"id_min": 4})) == [4, 5]
            assert ids(table.search(FLAT, 20, {"id_min": 4})) == list(range(4, 11))

    def test_unknown_filter_names_the_valid_ones(self, table):
        with pytest.raises(InvalidFilterError, match="'price'.*description, id, name"):
            table.search(FLAT, 5, {"price_max": 3})

    def test_column_named_like_a_bound_wins(self, spark, product_vectors):
        source = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id bigint, x_min int, text string")
        assert ids(Searchable(source, product_vectors, ["id"], ["text"]).search(FLAT, 5, {"x_min": 6})) == [2]

    def test_backslashes_in_patterns(self, spark, product_vectors):
        source = spark.createDataFrame([(1, "50% off"), (2, "50 off"), (3, "a\\b"), (4, "end\\")], "id bigint, text string")
        table = Searchable(source, product_vectors, ["id"], ["text"])
        assert ids(table.search(FLAT, 5, {"text": "50\\% off"})) == [1]
        assert ids(table.search(FLAT, 5, {"text": "A\\b"})) == [3]
        assert ids(table.search(FLAT, 5, {"text": "end\\"})) == [4]
        assert escaped_pattern("a\\\\b") == "a\\\\b"

    def test_orphans_take_no_place(self, products, product_vectors):
        table = Searchable(products.where("id > 6"), product_vectors, ["id"], ["description"])
        assert ids(table.search(HOT, 2)) == [7, 8]
        assert ids(table.search(FLAT, 10)) == [7, 8, 9, 10]

    def test_dimensions_are_checked_before_the_plan(self, table):
        with pytest.raises(DimensionMismatchError):
            table.search([1.0], 5, dims=384)

    def test_shaping(self, spark):
        df = spark.createDataFrame([("1", "x" * 600, 0.123456, [1.0])], "row_id string, content string, similarity double, embedding array<double>")
        row = shaped(df).first()
        assert shaped(df).columns == ["row_id", "content", "similarity"]
        assert (len(row["content"]), row["similarity"]) == (500, 0.1235)

    def test_composite_key_with_commas(self, spark):
        source = spark.createDataFrame([("a,b", "c", "one"), ("a", "b,c", "two")], "k string, l string, text string")
        vectors = spark.createDataFrame([("a,b", "c", [1.0, 0.0]), ("a", "b,c", [0.0, 1.0])], "k string, l string, embedding array<float>")
        rows = Searchable(source, vectors, ["k", "l"], ["text"]).search([1.0, 0.0], 2).collect()
        assert [(r["content"], r["similarity"]) for r in rows] == [("one", 1.0), ("two", 0.0)]


class TestSearchAll:
    def tables(self, spark, products, product_vectors):
        articles = spark.createDataFrame([("x", 2.5, "about one")], "slug string, price double, body string")
        article_vectors = spark.createDataFrame([("x", HOT)], "slug string, embedding array<float>")
        return [
            TaggedTable("products", "public", "local", Searchable(products, product_vectors, ["id"], ["description"])),
            TaggedTable("articles", "blog", "other", Searchable(articles, article_vectors, ["slug"], ["body"])),
        ]

    def test_merged_and_tagged(self, spark, products, product_vectors):
        found = search_all(self.tables(spark, products, product_vectors), {"local": HOT, "other": HOT}, 3).collect()
        assert [(r["_source_schema"], r["_source_table"], r["row_id"]) for r in found] == [
            ("blog", "articles", "x"), ("public", "products", "1"), ("public", "products", "2")]
        assert json.loads(found[0]["row_json"]) == {"slug": "x", "price": 2.5, "body": "about one"}

    def test_table_without_provider_is_left_out(self, spark, products, product_vectors):
        found = search_all(self.tables(spark, products, product_vectors), {"local": HOT}, 20).collect()
        assert {r["_source_table"] for r in found} == {"products"} and len(found) == 10

    @pytest.mark.parametrize("limit", [3, 12, 600])
    def test_tables_ranked_together_equal_tables_searched_one_by_one(self, spark, products, product_vectors, limit):
        """With rows whose source is gone, vectors without direction, and a table that loses too many rows."""
        rng = np.random.default_rng(12)
        tables = []
        for name, count, gone in (("many", 40, 0), ("half", 30, 25), ("few", 3, 0), ("none", 5, 5)):
            rows = [(i, f"{name} {i}", [float(x) for x in rng.normal(size=384)] if i else [0.0] * 384) for i in range(count)]
            df = spark.createDataFrame(rows, "id bigint, t string, embedding array<float>")
            source = df.where(F.col("id") >= gone).drop("embedding")
            tables.append(TaggedTable(name, "s", "m", Searchable(source, df.drop("t"), ["id"], ["t"])))
        found = search_all(tables, {"m": HOT}, limit).collect()
        single = []
        for one in tables:
            single += [(one.name, r["row_id"], r["similarity"]) for r in one.table.search(HOT, limit).collect()]
        single.sort(key=lambda r: (-(r[2] if r[2] is not None else -9), r[0], r[1]))
        assert [(r["_source_table"], r["row_id"], r["similarity"]) for r in found] == single[:limit]

    def test_no_tables(self, spark, models):
        assert search_all([], {}, 5) is None
        assert search(spark, Registry(), models, "anything").count() == 0


class TestEntry:
    @pytest.fixture()
    def registry(self, spark, models, products, tmp_path):
        products.write.parquet(str(tmp_path / "products"))
        registry = Registry()
        long_text = products.select("id", F.concat_ws(" ", F.array_repeat("description", 3)).alias("story"))
        long_text.write.parquet(str(tmp_path / "stories"))
        for name, options in (
            ("products", {"columns": ["name", "description"]}),
            ("stories", {"column": "story", "chunked": True, "chunk_words": 10, "chunk_overlap": 3}),
        ):
            entry = apply_table(
                spark, registry, models, table=name, source=str(tmp_path / name), root=str(tmp_path / "emb"),
                primary_key=["id"], model="hash-256", buckets=3, **options)
            assert index_table(spark, entry, models).rows == 10
        return registry

    def test_one_table(self, spark, models, registry):
        assert ids(search(spark, registry, models, "yoga mat", "products", limit=1)) == [4]

    def test_chunked_table_returns_the_matching_chunk(self, spark, models, registry):
        row = search(spark, registry, models, "laptop sleeve", "stories", limit=3).first()
        assert row["id"] == 6 and "sleeve" in row["content"] and len(row["content"].split()) <= 10

    def test_chunked_table_with_filter(self, spark, models, registry):
        found = search(spark, registry, models, "laptop sleeve", "stories", {"id_min": 7}, 3)
        assert found.count() == 3 and min(ids(found)) >= 7

    def test_all_tables(self, spark, models, registry):
        found = search(spark, registry, models, "two person tent", limit=4).collect()
        assert {r["_source_table"] for r in found[:2]} == {"products", "stories"} and found[0]["row_id"] == "9"

    def test_bad_arguments(self, spark, models, registry):
        for arguments in ({"query": " "}, {"query": "x", "filters": {"id": 1}}, {"query": "x", "table": "nothing"}):
            with pytest.raises(NearfieldError):
                search(spark, registry, models, **arguments)


class TestApproximate:
    def test_all_lists_are_exact_and_recall_grows(self, spark, tmp_path):
        rng = np.random.default_rng(2)
        centers = rng.normal(size=(6, 16))
        points = centers[rng.integers(0, 6, 600)] + 0.2 * rng.normal(size=(600, 16))
        df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<float>")
        path = str(tmp_path / "lists")
        ann.build_lists(df, ["id"], path, lists=6)
        assert spark.read.parquet(path + "/lists").count() == 600
        query = [float(x) for x in points[17]]
        exact = topk.nearest(df, ["id"], query, 10)
        everywhere = ann.probe(spark, path, ["id"], query, 10, probes=6).collect()
        assert [(r["id"], round(r["similarity"], 9)) for r in everywhere] == [
            (r["id"], round(r["similarity"], 9)) for r in exact.collect()]
        shares = [ann.recall(exact, ann.probe(spark, path, ["id"], query, 10, n), ["id"]).first()[0] for n in (1, 3, 6)]
        assert shares == sorted(shares) and shares[-1] == 1.0 and shares[0] > 0.5

    def test_probing_reads_only_the_chosen_lists(self, spark, tmp_path, product_vectors):
        path = str(tmp_path / "lists")
        ann.build_lists(product_vectors, ["id"], path, lists=4)
        plan = ann.probe(spark, path, ["id"], HOT, 3, probes=1)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"list_id#\d+ (=|IN)", plan)

    def test_codes_stand_for_vectors(self, spark):
        rng = np.random.default_rng(3)
        points = rng.normal(size=(2000, 32))
        df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(5000, [0.0] * 32)],
                                   "id bigint, embedding array<float>")
        quantizer = ann.fit(df, 4, code_bytes=16)
        placed = df.withColumn("place", quantizer.place(F.col("embedding"))).withColumn("back", quantizer.decoded(F.col("place.code")))
        rows = {r["id"]: r for r in placed.collect()}
        assert rows[5000]["place"]["code"] is None and not any(rows[5000]["back"]) and rows[5000]["place"]["list_id"] == 0
        likeness = [np.dot(rows[i]["back"], p) / np.linalg.norm(p) / np.linalg.norm(rows[i]["back"]) for i, p in enumerate(points)]
        assert len(rows[0]["place"]["code"]) == 16 and np.mean(likeness) > 0.9

    def test_no_vectors(self, spark, tmp_path, product_vectors):
        with pytest.raises(NearfieldError):
            ann.build_lists(product_vectors.where("id < 0"), ["id"], str(tmp_path / "lists"), lists=2)


@pytest.fixture
def indexed(request, spark, models, tmp_path):
    """A registered table of 80 rows, embedded, and what searches it."""
    path, registry = str(tmp_path / "docs"), Registry()
    rows = [(i, f"subject {i % 7} item {i} " * 3, i % 2) for i in range(80)]
    spark.createDataFrame(rows, "id bigint, body string, kind int").write.parquet(path)
    entry = apply_table(spark, registry, models, table="docs", source=path, root=str(tmp_path / "emb"), primary_key=["id"],
                        column="body", model="hash-64", buckets=2, chunked=request.param, chunk_words=4, chunk_overlap=1)
    index_table(spark, entry, models)
    return entry, registry


WHOLE = pytest.mark.parametrize("indexed", [False], indirect=True, ids=["whole"])


class TestListsThatFollowTheirTable:
    def built(self, spark, entry):
        lists = entry.embeddings(spark).lists()
        build = lists.current()
        return build, set(files.names(spark, f"{lists.root}/{build.name}/done")) if build else set()

    def ask(self, spark, models, registry, **more):

        return search(spark, registry, models, "subject 3 item 10", "docs", **more).collect()

    def change(self, spark, models, entry, keys):
        rows = spark.createDataFrame([(k, f"subject {k} was changed to item 10") for k in keys], "id bigint, body string")
        entry.embeddings(spark).merge(embed_rows(rows, ["id"], ["body"], models.get("hash-64"), chunked=entry.chunked,
                                                 max_words=entry.chunk_words, overlap=entry.chunk_overlap))

    @pytest.mark.parametrize("indexed", [True], indirect=True, ids=["chunked"])
    def test_every_write_keeps_them(self, spark, models, indexed, caplog):
        entry, registry = indexed
        build_lists(spark, entry, 3)
        build, before = self.built(spark, entry)
        table = entry.embeddings(spark)
        for write in (
            lambda: self.change(spark, models, entry, [3, 10, 24]),
            lambda: table.merge(deletes=spark.createDataFrame([(17,), (31,)], "id bigint")),
            table.fold, table.compact,
        ):
            write()
            now, placed = self.built(spark, entry)
            assert now == build and set(table.snapshot().live) <= {m.split(".")[0] for m in placed}
            # what was placed before stays as it is
            assert before <= placed
            before = placed
            assert self.ask(spark, models, registry, probes=3) == self.ask(spark, models, registry)
        reindex_table(spark, entry, models)
        assert self.ask(spark, models, registry, filters={"kind": 1}, probes=3) == self.ask(spark, models, registry, filters={"kind": 1})
        assert "searching all" not in caplog.text

    @WHOLE
    def test_rows_that_are_not_placed_yet_are_found(self, spark, models, indexed, monkeypatch):
        entry, registry = indexed
        build_lists(spark, entry, 3)
        with monkeypatch.context() as patch:
            patch.setattr(VectorLists, "follow", lambda self: None)
            self.change(spark, models, entry, [3, 10, 99])
        assert self.ask(spark, models, registry, probes=3) == self.ask(spark, models, registry)
        some = self.ask(spark, models, registry, limit=3, probes=1)
        entry.embeddings(spark).lists().follow()
        assert self.ask(spark, models, registry, limit=3, probes=1) == some

    @WHOLE
    def test_build_that_broke_off_is_not_read_and_can_be_repeated(self, spark, models, indexed, monkeypatch, caplog):
        entry, registry = indexed
        with monkeypatch.context() as patch:
            patch.setattr(VectorLists, "_place", lambda *arguments: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                build_lists(spark, entry, 5)
        assert self.built(spark, entry)[0] is None
        exact = self.ask(spark, models, registry)
        assert self.ask(spark, models, registry, probes=1) == exact and "has no lists" in caplog.text
        for lists in (3, 2):
            build_lists(spark, entry, lists)
            assert self.built(spark, entry)[0].lists == lists
            assert self.ask(spark, models, registry, probes=lists) == exact

    @WHOLE
    def test_too_few_rows_widen_the_search(self, spark, models, indexed):
        entry, registry = indexed
        build_lists(spark, entry, 8)
        assert len(self.ask(spark, models, registry, limit=40, probes=1)) == 40
        assert len(self.ask(spark, models, registry, limit=30, filters={"kind": 1}, probes=1)) == 30
        assert len(self.ask(spark, models, registry, filters={"id_min": 76}, limit=30, probes=1)) == 4

    @WHOLE
    def test_codes_are_read_before_vectors(self, spark, models, indexed, monkeypatch):
        entry, registry = indexed
        build_lists(spark, entry, 2)
        plans, plain = [], searching.nearest
        monkeypatch.setattr(searching, "nearest", lambda v, *a, **k: plans.append(
            v.select(*a[0], "embedding")._jdf.queryExecution().executedPlan().toString()) or plain(v, *a, **k))
        assert self.ask(spark, models, registry, limit=2, probes=1)
        schemas = [re.findall(r"ReadSchema: struct<([^\n]*)>", p) for p in plans[:2]]
        assert all("code" in x and "embedding" not in x for x in schemas[0])
        assert all("embedding" in x for x in schemas[1]) and "PushedFilters: [" in plans[1] and re.search(r"In\(id|EqualTo\(id", plans[1])

    @WHOLE
    def test_migration_builds_them_for_the_new_model(self, spark, models, indexed):
        entry, registry = indexed
        build_lists(spark, entry, 4)
        migrate_table(spark, registry, "docs", "hash-128", models)
        assert (self.built(spark, entry)[0].model, self.built(spark, entry)[0].lists) == ("hash-128", 4)
        assert self.ask(spark, models, registry, probes=4) == self.ask(spark, models, registry)

    @WHOLE
    def test_vacuum_keeps_the_current_build(self, spark, models, indexed):
        entry, registry = indexed
        build_lists(spark, entry, 4)
        build_lists(spark, entry, 5)
        for key in (1, 2, 3):
            self.change(spark, models, entry, [key])
        entry.embeddings(spark).fold()
        entry.embeddings(spark).vacuum(keep=1)
        lists = entry.embeddings(spark).lists()
        assert set(files.names(spark, lists.root)) == {lists.current().name, "current.json"}
        assert {m.split(".")[0] for m in self.built(spark, entry)[1]} == set(entry.embeddings(spark).snapshot().live)
        assert self.ask(spark, models, registry, probes=5) == self.ask(spark, models, registry)


class TestResults:
    def test_json(self, table, spark):
        best = table.search(HOT, 1).select("row_id", "similarity")
        assert json.loads(results.json_array(best)) == [{"row_id": "1", "similarity": pytest.approx(1.0, abs=1e-6)}]
        assert results.json_array(best.where("1 = 0")) == "[]"

    def test_files(self, spark, tmp_path):
        df = spark.createDataFrame([(1, None, ["a"]), (2, 'say "hi", you', None)], "id int, t string, tags array<string>")
        results.write_csv(df, str(tmp_path / "csv"))
        lines = sorted(line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_text().splitlines())
        assert lines[0].startswith("1,,") and '2,"say ""hi"", you",' in lines and "id,t,tags" in lines
        results.write_jsonl(df, str(tmp_path / "jsonl"))
        rows = [json.loads(line) for f in (tmp_path / "jsonl").glob("*.json") for line in f.read_text().splitlines()]
        assert sorted(rows, key=lambda r: r["id"]) == [{"id": 1, "t": None, "tags": ["a"]}, {"id": 2, "t": 'say "hi", you', "tags": None}]
        results.write_jsonl(df.where("id < 0"), str(tmp_path / "empty"))
        assert spark.read.schema(df.schema).json(str(tmp_path / "empty")).count() == 0


def test_embedding_runs_once_per_text(spark, tmp_path):
    """Filters on the result must not make Spark call the model a second time."""

    log = str(tmp_path / "texts")

    def factory():
        def encode(texts):
            with open(log, "a") as out:
                out.write("\n".join(texts) + "\n")
            return [[1.0, 0.0] for _ in texts]
        return encode

    model = Embedder("counting", "counting", 2, factory)
    source = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id bigint, t string")
    rows = embed_rows(source, ["id"], ["t"], model)
    assert len(topk.nearest(rows, ["id"], [1.0, 0.0], 5).collect()) == 5
    seen = open(log).read().split("\n")[:-1]
    assert sorted(seen) == sorted(f"text {i}" for i in range(30))


def test_hash_model_finds_shared_words(spark, products):
    model = hash_embedder(256)
    rows = embed_rows(products, ["id"], ["description"], model)
    assert ids(topk.nearest(rows, ["id"], model.embed_query("person tent"), 1)) == [9]


@pytest.mark.parametrize("chunked", [False, True])
def test_large_filters_move_no_vectors(spark, monkeypatch, chunked):
    """With more allowed keys than are broadcast, one scan scores all vectors and only keys and scores meet the rest."""

    rng = np.random.default_rng(9)
    rows = [(i // 2 if chunked else i, i % 2, f"part {i}", [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id bigint, chunk_index int, chunk_text string, embedding array<float>")
    source = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(280)], "id bigint, t string, kind int")
    one = Searchable(source, vectors if chunked else vectors.select("id", "embedding"), ["id"], ["t"], chunked)
    query = [1.0, 0.0, 2.0, 0.0, 1.0, 1.0]
    small = one.search(query, 7, {"kind": 1}).collect()
    monkeypatch.setattr(searching, "fits_broadcast", lambda *keys: False)
    assert one.search(query, 7, {"kind": 1}).collect() == small
    assert replace(one, small_bytes=0).search(query, 7, {"kind": 1}).collect() == small
    assert len(replace(one, small_bytes=0).search(query, 1500).collect()) == (150 if chunked else 280)
    assert len(one.search(query, 1500).collect()) == (150 if chunked else 280)


@pytest.mark.parametrize("share", [2, 40])
def test_only_the_best_scores_meet_a_large_filter(spark, monkeypatch, share):
    """Of 4,000 scores as many meet the filter as its selectivity asks for; a filter that is rarer among them widens."""
    rng = np.random.default_rng(10)
    query = [1.0, 0.0, 2.0, 0.0, 1.0, 1.0]
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(4000)] + [[0.0] * 6]
    by_score = np.argsort([-np.dot(v, query) / (np.linalg.norm(v) or 1) for v in vectors], kind="stable")
    # the allowed rows are the worst ones in the second case
    allowed = {int(i) for i in (by_score[::2] if share == 2 else by_score[-100:])}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id bigint, embedding array<float>")
    source = spark.createDataFrame([(i, "t", i in allowed) for i in range(4001)], "id bigint, t string, ok boolean")
    met, plain = [], searching.rows_with_keys
    monkeypatch.setattr(searching, "rows_with_keys", lambda wide, keys, key: met.append(keys.count()) or plain(wide, keys, key))
    found = ids(Searchable(source, df, ["id"], ["t"], most_allowed=10, small_bytes=0).search(query, 10, {"ok": True}))
    assert found == [int(i) for i in by_score if int(i) in allowed][:10]
    assert met[0] < (100 if share == 2 else 1000) and (len(met) == 1 if share == 2 else met[-1] > 1000)


class TestNames:
    def test_source_columns_named_like_the_result(self, spark):
        source = spark.createDataFrame([(1, "one", "x", 0.5), (2, "two", "y", 0.6)], "row_id bigint, content string, chunk_index string, similarity double")
        vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "row_id bigint, embedding array<float>")
        rows = Searchable(source, vectors, ["row_id"], ["content"]).search([1.0, 0.0], 2).collect()
        assert [tuple(r) for r in rows] == [("1", "one", 1.0, "x"), ("2", "two", 0.0, "y")]

    def test_number_of_results(self, table):
        with pytest.raises(NearfieldError):
            table.search(FLAT, 0)
        assert table.search(FLAT, 2000).count() == 10
