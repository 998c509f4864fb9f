"""Operators over whole tables and the pipeline: near duplicates, neighbours, classifiers."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from samples import frame, odd  # noqa: F401

import __spark_entry__ as driver
import corpus_pipeline
from nearfield.llm import near_dups, quality, secrets, toxicity, vantage
from nearfield.llm.queries import QUERIES
from nearfield.llm.tasks import fold

LARGER = SF_DIR.replace("sf0.001", "sf0.01")


def read(spark, name, folder=SF_DIR):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- near duplicates ---------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for run in own:
            for j in holders[run]:
                shared[j] += 1
            holders[run].append(i)
        for j, n in shared.items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least[root(i)] if d is not None else None,
                    d == least[root(i)] if d is not None else True) for i, (d, _) in enumerate(rows)), key=str)


def families():
    """A group of near copies around one text, a chain of links, copies, and texts that share a long passage."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        text = base[:]
        for _ in range(rng.choice([1, 2, 3, 4])):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    chain = rng.choices(words, k=100)
    for i in range(60, 90):
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append((i, " ".join(chain)))
    passage = rng.choices(words, k=60)
    for i in range(90, 140):
        rows.append((i, " ".join(passage + rng.choices(words, k=rng.randint(20, 60)))))
    rows += [(200 + i, "the same short text") for i in range(30)]
    return rows


@pytest.mark.parametrize("limit", [2048, 12])
def test_components_equal_brute_force(spark, frame, odd, limit):
    rows = families()
    docs = frame(rows).unionByName(odd)
    found = sorted((tuple(r) for r in near_dups.near_duplicates(docs, limit=limit).collect()), key=str)
    assert found == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_the_given_table(spark):
    docs = read(spark, "documents")
    found = sorted((tuple(r) for r in near_dups.near_duplicates(docs).collect()), key=str)
    assert found == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_equal_bytes_are_no_shared_band():
    """A pair whose bytes agree in an earlier band, but not its minima, is given in the band that it does share."""
    bands = np.arange(2 * near_dups.BANDS, dtype=np.int64).reshape(2, -1)
    bands[:, 7] = bands[:, 9] = -1
    rows = {"cell": np.zeros(2, np.int64), "node": np.arange(2), "component": np.arange(2), "asks": np.ones(2, bool),
            "n": np.full(2, 100), "signature": np.zeros((2, near_dups.PLACES), np.uint8), "bands": bands, "whole": np.ones(2, bool)}
    found = [len(near_dups._compare(rows | {"band": np.full(2, b)}, False, near_dups.least_matches(), 75)[0]) for b in (7, 9)]
    assert found == [1, 0]


def test_links_of_a_large_bucket_need_no_other_band(spark, frame, monkeypatch):
    plain, rows = near_dups.signed, families()
    key = lambda x, i: F.when(i == 3, F.lit(1).cast("bigint")).otherwise(F.xxhash64("set_hash", i))
    monkeypatch.setattr(near_dups, "signed", lambda docs: plain(docs).withColumn("bands", F.transform("bands", key)))
    found = sorted((tuple(r) for r in near_dups.near_duplicates(frame(rows), limit=12).collect()), key=str)
    assert found == brute_components(rows)


def test_bounds_follow_the_posterior():
    strict, loose = near_dups.least_matches(1e-2), near_dups.least_matches(1e-8)
    assert len(strict) == near_dups.PLACES // near_dups.BATCH
    assert all(a > b for a, b in zip(strict, loose)) and strict == sorted(strict)
    # a pair at the threshold passes all bounds nearly always
    rng = np.random.default_rng(1)
    equal = (rng.random((20000, near_dups.PLACES)) < 0.75).cumsum(1)[:, near_dups.BATCH - 1 :: near_dups.BATCH]
    assert (equal < np.array(near_dups.least_matches())).any(1).mean() < 1e-3


def test_components_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (55, 60), (70, 71)], "a bigint, b bigint")
    found = {r.node: r.component for r in near_dups.components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50, 70: 70, 71: 70}


def test_one_of_each_keeps_columns_and_one_row(spark, frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "other words entirely"), (None, "x"), (None, "x")]
    docs = frame(rows).withColumn("node", F.lit(1)).withColumn("signature", F.lit("s"))
    found = near_dups.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == [
        ("1", "a b c d e f"), ("3", "other words entirely"), ("None", "x"), ("None", "x")]


def test_rows_with_one_id_stay_by_their_own_texts(frame):
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(1, copy), (2, copy + " end"), (2, "a text that nobody else has"), (3, copy.upper()), (1, copy + " more"), (1, "another one of its own"),
            (4, ""), (4, " "), (4, "")]
    found = sorted((r.doc_id, r.text) for r in near_dups.one_of_each(frame(rows)).collect())
    assert found[2:] == [(2, "a text that nobody else has"), (4, ""), (4, " ")]
    assert found[0] == (1, "another one of its own") and found[1] in [(1, copy), (1, copy + " more")]


# -- nearest neighbours ------------------------------------------------------


def brute_nearest(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted(((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q and len(w) == len(v)))
            out[q] = [i for _, i in scores[:k]]
    return out


def test_exact_factor_gives_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 150)
    monkeypatch.setattr(vantage, "BLOCK_ROWS", 10)
    monkeypatch.setattr(vantage, "LEAF", 16)
    vectors = read(spark, "embeddings")
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()])
    for factor, least in ((1.0, 1.0), (vantage.FACTOR, 0.9)):
        rows = vantage.nearest(vectors, F.col("vec_id") % 20 == 0, factor=factor).collect()
        found = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
            found[r.query_id].append(r.vec_id)
        recall = np.mean([len(set(found[q]) & set(ids)) / len(ids) for q, ids in want.items()])
        assert found.keys() == want.keys() and recall >= least
        if least == 1.0:
            assert found == want


@pytest.mark.parametrize("scale", [1e-9, 1e-4, 1e9, None])
def test_factor_one_is_exact_whatever_the_lengths(spark, monkeypatch, scale):
    """Vectors much shorter or longer than 1, of lengths that differ by 18 orders, of several dimensions, and copies."""
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "LEAF", 8)
    rng = np.random.default_rng(8)
    rows = []
    for i, r in enumerate(read(spark, "embeddings").limit(400).collect()):
        own = scale or 10.0 ** int(rng.integers(-9, 10))
        rows.append((r.vec_id, [own * x for x in r.embedding[: 64 if i % 10 else 16]]))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]
    found = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for r in sorted(vantage.nearest(table, F.col("vec_id") % 20 == 0, factor=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
    assert found == {q: ids for q, ids in brute_nearest(rows).items() if ids}


def test_vectors_that_take_no_part_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (20, [1.0, 0.0, 0.0]),
            (40, [])] + [(100 + i, [1.5, 0.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("shard", F.lit(1))
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vantage.nearest(table, F.col("vec_id") % 20 == 0, factor=1.0).collect())
    want = [6, 7, *range(100, 118)]
    assert [f[2] for f in found if f[0] == 0] == want
    assert found[0] == (0, 1, 6, 2.0) and {f[0] for f in found} == {0, 100, 120}
    assert vantage.nearest(table.where("vec_id = 1"), F.lit(True)).count() == 0


# -- toxicity ----------------------------------------------------------------


def test_grammar_scores_clauses():
    model = toxicity.Model({"idiot$": 4.0, "moron$": 4.0}, (1.0, 0.0, 0.0, 0.0, 0.0, -1.0))
    one = toxicity.Scorer(model)

    def total(text):
        return sum(one.clauses(text)[0])

    assert total("a calm clause. another one") == 0
    assert total("you idiot") > total("idiot") > total("they said idiot") > 0
    assert total("not an idiot") < total("idiot")
    assert total("they will kill you") > 0 == total("they kill time")
    assert total("idiot moron") > total("idiot") + total("moron")
    assert total("said. idiot") == total("idiot")
    assert one.clauses("idiot " * 20_000)[1] == 20_000


def test_a_reading_does_not_depend_on_words_seen(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 200)
    one = toxicity.Scorer(toxicity.Model({"kill$": 4.0, "murd": 3.0, "your$": 2.0, "idiot$": 4.0}, (1.0, 0.0, 0.0, 0.0, 0.0, -1.0)))
    texts = ["they will kill you", "murder", "your kill", "you idiot"]
    fresh = [one.clauses(t) for t in texts]
    assert fresh[1] == ([], 1)
    for i in range(1000):
        one.clauses(f"word{i}")
        assert i % 50 or [one.clauses(t) for t in texts] == fresh


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read(spark, "documents", LARGER), read(spark, "labels", LARGER)
    held_out = fold("doc_id", 5) == 0
    model = toxicity.learn(docs, labels, ~held_out)
    rows = toxicity.score(docs, model).where(held_out).join(labels, "doc_id").collect()
    right = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows])
    assert len(rows) > 50 and right >= 0.93
    assert all((r.score < 0.5) for r in rows if not r.toxic)


def test_odd_rows_get_scores(spark, odd):
    labels = read(spark, "labels")
    docs = read(spark, "documents").unionByName(odd)
    model = toxicity.learn(docs, labels, fold("doc_id", 5) != 0)
    chain = quality.learn(docs, labels, fold("doc_id", 4) != 2)
    for rows in (toxicity.score(odd, model).collect(), quality.score(odd, chain).collect()):
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(odd, model).columns == odd.columns


def test_nothing_to_learn_from(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model, chain = toxicity.learn(odd, labels, F.lit(True)), quality.learn(odd, labels, F.lit(True))
    assert toxicity.without_toxic(odd, model).count() == quality.good_only(odd, chain).count() == odd.count()


# -- quality -----------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    chain = quality.Chain(rng.normal(size=3), 0.3, 1.2)
    seen = rng.normal(size=(7, 3))
    odds = seen @ chain.weights + chain.constant
    total, good = 0.0, np.zeros(7)
    for labels in range(1 << 7):
        y = np.array([labels >> i & 1 for i in range(7)])
        weight = math.exp((odds * y).sum() + 1.2 * (y[1:] == y[:-1]).sum())
        total += weight
        good += weight * y
    assert np.allclose(chain.marginals(seen), good / total)


def test_lines_of_a_mixed_document(spark):
    docs, labels = read(spark, "documents", LARGER), read(spark, "labels", LARGER)
    chain = quality.learn(docs, labels, fold("doc_id", 4) != 2)
    good = "The and attion to thanedble the, anea. Eriner thanea."
    marginals, lengths = quality.line_marginals("\n".join([good] * 1 + ["AB!! CD!! EF!! AB!! CD!! EF!! AB!!"] * 6), chain)
    assert len(marginals) == len(lengths) == 7 and marginals[0] > marginals[1:].max()
    held_out = fold("doc_id", 4) == 2
    rows = quality.score(docs, chain).where(held_out).join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.7) == bool(r.quality) for r in rows]) >= 0.97


# -- pipeline and registration -----------------------------------------------


def test_every_operator_is_registered():
    names = driver.queries()
    assert QUERIES.keys() <= names.keys() and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {"op11_line_dedup", "op12_hard_negatives", "op13_fill_middle"} <= driver.oracle_sql().keys()


def test_stages_against_plain_versions(spark, odd):
    docs = read(spark, "documents").unionByName(odd)
    columns = docs.columns
    held = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, held = held, stage(spark, held, SF_DIR).cache()
        kept.append((name, before, held))
        if name != "packing":
            assert held.columns == columns
    rows = {name: (sorted(map(str, b.collect())), sorted(map(str, h.collect()))) for name, b, h in kept[:3]}
    assert all(len(after) <= len(before) and set(after) <= set(before) for before, after in rows.values())
    assert len(rows["toxicity"][1]) < len(rows["toxicity"][0]) and len(rows["quality"][1]) < len(rows["quality"][0])
    _, before, after = kept[2]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {w[0] for w in want if w[3]}
    assert len(after.collect()) == len({(r.doc_id, r.text) for r in after.collect()})
    _, before, after = kept[3]
    assert before.count() == after.count()
    live = {r.doc_id: r for r in secrets.scan(before).where("n_live > 0").collect()}
    texts = {(r.doc_id, r.text) for r in before.collect()}
    changed = {r.doc_id for r in after.collect() if (r.doc_id, r.text) not in texts}
    assert changed == set(live)
    _, before, packed = kept[4]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_equals_its_stages(spark):
    whole = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    held = read(spark, "documents")
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF_DIR)
    assert json.dumps(sorted(map(tuple, whole.collect()))) == json.dumps(sorted(map(tuple, held.select(whole.columns).collect())))


def test_empty_tables(spark):
    docs = read(spark, "documents").limit(0)
    labels = read(spark, "labels")
    assert near_dups.near_duplicates(docs).count() == 0
    assert secrets.scan(docs).count() == 0
    assert near_dups.one_of_each(docs).count() == 0
    model = toxicity.learn(docs, labels, F.lit(True))
    assert toxicity.score(docs, model).count() == 0
    assert vantage.nearest(read(spark, "embeddings").limit(0), F.lit(True)).count() == 0
