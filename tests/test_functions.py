import random
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import DimensionMismatchError, NearfieldError, UnknownModelError
from nearfield.functions import scoring, text, vectors
from nearfield.functions.batches import counted_words, pieces
from nearfield.functions.chunking import chunk_column, windows
from nearfield.functions.embedders import Embedder, hash_embedder
from nearfield.operators.projection import word_counts


def chunk(spark, value, *args, **options):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(chunk_column(F.col("t"), *args, **options).alias("c")).first()["c"]


class TestChunks:
    def test_short_text_is_kept_as_it_is(self, spark):
        assert chunk(spark, "  This is a  short\nsentence. ") == ["This is a  short\nsentence."]

    def test_whole_sentences(self, spark):
        value = "First sentence. Second sentence. Third sentence. Fourth sentence."
        assert chunk(spark, value, 5, 0) == ["First sentence. Second sentence.", "Third sentence. Fourth sentence."]

    def test_long_run_is_cut(self, spark):
        value = " ".join(["word"] * 100)
        assert [len(c.split()) for c in chunk(spark, value, 30, 0)] == [30, 30, 30, 10]

    def test_overlap(self, spark):
        value = " ".join(f"w{i}" for i in range(100))
        chunks = chunk(spark, value, 30, 10)
        assert [c.split()[0] for c in chunks] == ["w0", "w20", "w40", "w60", "w80"]
        assert len(chunks[-1].split()) == 20

    def test_whole_text_unless_a_number_of_chunks_is_asked_for(self, spark):
        value = " ".join(["word"] * 50_000)
        assert len(chunk(spark, value, 10, 0)) == 5000
        assert len(chunk(spark, value, 10, 0, max_chunks=200)) == 200

    @pytest.mark.parametrize("value", ["", "   \n\t ", "  "])
    def test_blank(self, spark, value):
        assert chunk(spark, value) == []

    def test_null(self, spark):
        assert chunk(spark, None) is None

    def test_unicode_whitespace_separates_words(self, spark):
        assert chunk(spark, "a b c d e", 2, 0) == ["a b", "c d", "e"]

    @pytest.mark.parametrize("window,overlap", [(10, 10), (10, 11), (0, 0), (10, -1)])
    def test_window_that_cannot_move_is_refused(self, window, overlap):
        with pytest.raises(NearfieldError):
            chunk_column(F.lit("x"), window, overlap)

    @settings(max_examples=300, deadline=None)
    @given(
        st.lists(st.integers(1, 40), max_size=30),
        st.integers(1, 20).flatmap(lambda w: st.tuples(st.just(w), st.integers(0, w - 1))),
    )
    def test_ranges_of_any_sentences(self, lengths, sizes):
        """What every cutting must obey, whichever way it is computed."""
        window, overlap = sizes
        found = list(windows(lengths, window, overlap))
        total, ends = sum(lengths), {sum(lengths[: i + 1]) for i in range(len(lengths))}
        if not total:
            assert found == []
            return
        assert found[0][0] == 0 and found[-1][1] == total
        assert all(0 < b - a <= window for a, b in found)
        for (a, b), (c, d) in zip(found, found[1:]):
            # neighbours share the overlap, or all of a chunk that is shorter than it
            assert c == b - min(overlap, b - a) and d > b
            if b in ends:
                # a chunk that ends with a sentence had no room for the next one
                assert min(e for e in ends if e > b) - a > window
            else:
                # a sentence is cut only where a chunk is full, and only if it does not fit by itself
                sentence = min(e for e in ends if e > b)
                begin = max([0, *(e for e in ends if e < b)])
                assert b - a == window and sentence - min(begin, a) > window

    @pytest.mark.parametrize("lengths,window,overlap,expected", [
        ([], 5, 2, []),
        ([3], 5, 2, [(0, 3)]),
        ([2, 2, 2, 2], 4, 0, [(0, 4), (4, 8)]),
        ([3, 3, 3], 6, 2, [(0, 6), (4, 9)]),
        ([12], 5, 0, [(0, 5), (5, 10), (10, 12)]),
        ([9], 5, 2, [(0, 5), (3, 8), (6, 9)]),
        ([1, 10], 4, 1, [(0, 1), (0, 4), (3, 7), (6, 10), (9, 11)]),
    ])
    def test_ranges_worked_by_hand(self, lengths, window, overlap, expected):
        assert [tuple(r) for r in windows(lengths, window, overlap)] == expected


class TestText:
    def test_content_of_one_and_many(self, spark):
        df = spark.createDataFrame([("Widget", "A great widget"), ("Only", None)], "title string, description string")
        rows = df.select(text.content(["title"]).alias("a"), text.content(["title", "description"]).alias("b")).collect()
        assert rows[0] == ("Widget", "title: Widget\ndescription: A great widget")
        assert rows[1] == ("Only", None)

    def test_empty_text_is_content(self, spark):
        df = spark.createDataFrame([("", "x")], "a string, b string")
        assert df.where(text.has_content(["a", "b"])).count() == 1

    def test_row_id_round_trip(self, spark):
        df = spark.createDataFrame([("org1", 2)], "org string, user bigint")
        back = df.select(text.row_id(["org", "user"]).alias("r")).select(
            "r", *text.row_id_parts(F.col("r"), {"org": T.StringType(), "user": T.LongType()})
        )
        assert back.first() == ("org1,2", "org1", 2)

    def test_row_id_with_wrong_number_of_parts(self, spark):
        df = spark.createDataFrame([("a,b,c",), ("a",), ("a,x",)], "r string")
        parts = text.row_id_parts(F.col("r"), {"org": T.StringType(), "user": T.LongType()})
        assert df.select(*parts).collect() == [(None, None), (None, None), ("a", None)]
        with pytest.raises(NearfieldError):
            text.key_from_row_id("a,b,c", {"org": T.StringType(), "user": T.LongType()})

    def test_single_key_may_hold_a_comma(self, spark):
        df = spark.createDataFrame([("a,b",)], "r string")
        assert df.select(*text.row_id_parts(F.col("r"), {"id": T.StringType()})).first() == ("a,b",)

    def test_ellipsis(self, spark):
        df = spark.createDataFrame([("x" * 5,), ("x" * 6,), (None,)], "t string")
        assert [r[0] for r in df.select(text.ellipsis(F.col("t"), 5)).collect()] == ["xxxxx", "xxxxx...", None]

    def test_text_columns(self, spark):
        df = spark.createDataFrame([], "a string, b int, c string, d array<string>")
        assert text.text_columns(df) == ["a", "c"]

    def test_odd_column_names(self, spark):
        df = spark.createDataFrame([(1, "x")], "`my id` bigint, `a.b` string")
        assert df.select(text.content(["a.b", "my id"])).first()[0] == "a.b: x\nmy id: 1"


class TestVectors:
    def test_hot_vectors(self, product_vectors):
        query = [1.0 if i == 1 else 0.01 for i in range(384)]
        rows = dict(product_vectors.select("id", vectors.cosine_similarity(F.col("embedding"), query)).collect())
        assert rows[1] == pytest.approx(1.0, abs=1e-6)
        assert rows[2] == pytest.approx(0.0582 / 1.0383, abs=1e-4)

    def test_zero_and_null_vectors_have_no_similarity(self, spark):
        df = spark.createDataFrame([([0.0, 0.0],), (None,)], "embedding array<float>")
        assert [r[0] for r in df.select(vectors.cosine_similarity(F.col("embedding"), [1.0, 0.0])).collect()] == [None, None]

    def test_lengths_are_checked(self, spark):
        with pytest.raises(DimensionMismatchError):
            vectors.check_query([1.0, 2.0], 3)
        df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
        assert df.select(vectors.checked(F.col("embedding"), 2)).count() == 1
        with pytest.raises(PySparkException, match="expected 3 dimensions, got 2"):
            df.select(vectors.checked(F.col("embedding"), 3)).collect()


class TestScores:
    @pytest.mark.parametrize(
        "name,length,score",
        [("description", 847.0, 3.5), ("bio", 143.0, 2.5), ("name", 34.0, 1.0), ("email", 200.0, 1.0), ("data", 500.0, 3.0),
         ("content", 500.0, 3.5), ("data", 200.0, 2.0), ("data", 50.0, 2.0), ("data", 49.9, 1.0)],
    )
    def test_score(self, spark, name, length, score):
        df = spark.createDataFrame([(name, length)], "n string, l double")
        assert df.select(scoring.column_score(F.col("n"), F.col("l"))).first()[0] == score

    def test_stars(self, spark):
        df = spark.createDataFrame([(s,) for s in (3.0, 2.5, 2.0, 1.5, 1.0, 0.5)], "s double")
        found = [r[0] for r in df.select(scoring.stars(F.col("s"))).collect()]
        assert found == ["★★★", "★★★", "★★☆", "★★☆", "★☆☆", "★☆☆"]

    def test_worker_status_and_uptime(self, spark):
        df = spark.sql("""
            SELECT TIMESTAMP '2024-01-01 12:00:00' - make_interval(0, 0, 0, 0, 0, 0, s) AS t,
                   TIMESTAMP '2024-01-01 12:00:00' AS now FROM VALUES (0), (30), (299), (300), (7384) AS v(s)""")
        rows = df.select(scoring.worker_status(F.col("t"), F.col("now")), scoring.uptime(F.col("t"), F.col("now"))).collect()
        assert [r[0] for r in rows] == ["running", "stale", "stale", "stopped", "stopped"]
        assert rows[-1][1] == "2h 3m"

    def test_coverage(self, spark):
        df = spark.createDataFrame([(1, 3), (5, 4), (0, 0)], "e bigint, t bigint")
        assert [r[0] for r in df.select(scoring.coverage_pct(F.col("e"), F.col("t"))).collect()] == [33.3, 100.0, 0.0]


class TestModels:
    def test_known_models(self, models):
        expected = {"local": 384, "local-mpnet": 768, "openai": 1536, "openai-large": 3072, "ollama": 768}
        assert {k: models.get(k).dims for k in expected} == expected

    def test_unknown_or_without_provider(self, models):
        with pytest.raises(UnknownModelError):
            models.get("nothing")
        assert models.provided("openai") is None and models.provided("hash-64") is not None
        with pytest.raises(UnknownModelError):
            models.get("openai").embed_query("x")

    def test_own_provider_in_batches(self, spark, models):
        def factory():
            def encode(texts):
                assert len(texts) <= 32
                return [[float(len(t))] * 384 for t in texts]
            return encode

        model = models.provide("local", factory)
        df = spark.createDataFrame([("x" * n if n else None,) for n in range(100)], "t string")
        rows = df.select("t", model.column(F.col("t")).alias("v")).collect()
        for row in rows:
            assert row["v"] is None if row["t"] is None else row["v"] == [float(len(row["t"]))] * 384

    def test_wrong_shape_is_an_error(self, spark):
        model = Embedder("bad", "bad", 3, lambda: lambda texts: [[1.0, 2.0] for _ in texts])
        with pytest.raises(PySparkException, match="expected 3 dimensions"):
            spark.createDataFrame([("x",)], "t string").select(model.column(F.col("t"))).collect()
        with pytest.raises(DimensionMismatchError):
            model.embed_query("x")

    def test_model_is_loaded_once_per_worker_process(self, spark, tmp_path):
        log = str(tmp_path / "loads")

        def factory():
            import os
            with open(log, "a") as out:
                out.write(f"{os.getpid()}\n")
            return lambda texts: [[1.0] for _ in texts]

        model = Embedder("one", "one", 1, factory)
        df = spark.range(0, 400, 1, 40).select(F.col("id").cast("string").alias("t"))
        assert df.select(F.size(model.column(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 400
        loads = open(log).read().split()
        assert len(loads) == len(set(loads))

    def test_hash_model(self, spark):
        model = hash_embedder(64)
        one, two = model.embed_query("Red red shoes"), model.embed_query("shoes, RED... red!")
        assert one == two and sum(abs(x) for x in one) <= 3 and model.embed_query("...") == [0.0] * 64
        df = spark.createDataFrame([("Red red shoes",)], "t string")
        assert df.select(model.column(F.col("t"))).first()[0] == one


def test_random_windows_cover_every_word():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        ranges = windows(lengths, 16, 4)
        assert sorted({w for a, b in ranges for w in range(a, b)}) == list(range(sum(lengths)))


def peak_of(job) -> int:
    """The most bytes of Python objects while ``job`` runs, which drops what it gets."""
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def some_texts(n: int) -> pa.Array:
    """Texts of 1,000 different words each, some 6 KB."""
    return pa.array([" ".join(f"w{(i * 7 + j) % 5000:04}" for j in range(1000)) for i in range(n)])


def called(column):
    """The function that ``column`` makes an Arrow UDF of."""
    made = []

    def arrow_udf(function, *_):
        made.append(function)
        return real(function, *_)

    real, F.arrow_udf = F.arrow_udf, arrow_udf
    try:
        column(F.lit("text"))
    finally:
        F.arrow_udf = real
    return made[0]


class TestPieces:
    def test_are_the_whole_batch(self):
        batch = pa.array(["aa", None, "", "bbbb", "c" * 50, None, "d", "e", None])[1:]
        for most, size in ((None, 5), (2, 1000), (1, 1), (None, 1000)):
            found = list(pieces(batch, most, size))
            assert pa.concat_arrays(found).to_pylist() == batch.to_pylist()
            for piece in found:
                held = [t for t in piece.to_pylist() if t is not None]
                assert most is None or len(held) <= most
                assert sum(map(len, held)) <= size or len(piece) == 1
        assert [len(p) for p in pieces(batch, 2, 1000)] == [3, 3, 2]
        assert [len(p) for p in pieces(pa.array([], pa.string()))] == [0]
        assert [len(p) for p in pieces(pa.array([None] * 3, pa.string()), 1)] == [3]

    def test_word_counts_hold_a_piece_of_a_large_batch(self, spark):
        texts = [None, "", "One two, ONE", "--"]
        df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
        rows = [r["w"] for r in df.select(word_counts(F.col("t")).alias("w")).collect()]
        assert [None if r is None else [(e["term"], e["n"]) for e in r] for r in rows] == [None, [], [("one", 2), ("two", 1)], []]
        batch = some_texts(2000)
        seen = []
        peak = peak_of(lambda: seen.extend(len(found) for found in counted_words(iter([batch]))))
        assert sum(seen) == 2000 and len(seen) > 4 and peak < 60 << 20

    def test_models_get_a_piece_of_a_large_batch(self):
        calls = []

        def factory():
            def encode(texts):
                calls.append(len(texts))
                return [[len(t), 1] for t in texts]
            return encode

        model = Embedder("counts", "counts", 2, factory, batch_size=300)
        batch = pa.array([None, *some_texts(2000).to_pylist()])
        for column in (model.column, model.column_or_error):
            embed = called(column)
            seen = []
            peak = peak_of(lambda: seen.extend(embed(iter([batch]))))
            rows = [r for found in seen for r in found.to_pylist()]
            assert rows[0] is None and len(rows) == 2001 and len(seen) > 4 and peak < 8 << 20
            vectors_found = [r["embedding"] if isinstance(r, dict) else r for r in rows[1:]]
            assert vectors_found == [[len(t), 1] for t in batch.to_pylist()[1:]]
        assert max(calls) == 300 and sum(calls) == 4000

    def test_known_words_are_few_and_shared(self):
        one, two = hash_embedder(64), hash_embedder(64)
        assert one.identity == two.identity != hash_embedder(128).identity
        encode = one.factory()
        held = []

        def many():
            for start in range(0, 400_000, 20_000):
                encode([" ".join(f"v{i}" for i in range(start, start + 20_000)) + " " + "long" * 50_000])
            held.append(tracemalloc.get_traced_memory()[0])

        peak_of(many)
        assert held[0] < 25 << 20
        assert (encode(["v1 v2 v399999"]) == hash_embedder(64).factory()(["v1 v2 v399999"])).all()

    def test_chunks_of_a_piece_of_a_large_batch(self):
        batch = pa.array([None, *some_texts(4000).to_pylist()])
        split = called(lambda text: chunk_column(text, 500, 100))
        seen = []
        peak = peak_of(lambda: seen.extend((len(found), found.null_count) for found in split(iter([batch]))))
        assert sum(n for n, _ in seen) == 4001 and sum(n for _, n in seen) == 1 and len(seen) > 8 and peak < 20 << 20
