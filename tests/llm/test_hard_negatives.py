"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from nearfield.llm import hard_negatives
from nearfield.llm.queries import QUERIES


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    one = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one[vec_id] = min(one.get(vec_id, (label, vector)), (label, vector))
    own = {i: (label, [math.floor(scale * x) for x in vector]) for i, (label, vector) in one.items()}
    out = []
    for anchor, (label, vector) in own.items():
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, other) for i, (other, v) in own.items()
                        if i != anchor and len(v) == len(vector))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            within = [(i, -s) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(anchor, positive, rank, i, -p, s) for rank, (i, s) in enumerate(within, 1)]
    return sorted(out)


def clustered(rng, n, dims, spread=0.3):
    middles = rng.normal(size=(6, dims))
    return [(middles[rng.integers(6)] + spread * rng.normal(size=dims)).tolist() for _ in range(n)]


SCHEMA = "vec_id bigint, label int, embedding array<double>"


def found(df):
    return sorted(tuple(r) for r in df.collect())


def many_shards(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 8 * 8 * 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "STEP", 5)


@pytest.mark.parametrize("settings", [{}, {"positives": 2, "negatives": 3, "low": 50, "high": 100}, {"low": -50, "high": 40},
                                      {"scale": 4}])
def test_equals_brute_force(spark, monkeypatch, settings):
    many_shards(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(i - 20, int(rng.integers(3)), v) for i, v in enumerate(clustered(rng, 260, 8))]
    mined = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **settings)
    assert mined.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(mined) == brute(rows, lambda i: i % 10 == 0, **settings) != []


def test_odd_rows_ties_and_lengths(spark, monkeypatch):
    """Nulls, non-finite numbers, zero and empty vectors, other lengths, repeated ids, and hundreds of copies."""
    many_shards(monkeypatch)
    rng = np.random.default_rng(4)
    base = clustered(rng, 40, 4)
    rows = [(i, i % 2, base[i % 3]) for i in range(150)] + [(200 + i, i % 3, v) for i, v in enumerate(base)]
    rows += [(None, 1, base[0]), (400, None, base[0]), (401, 1, None), (402, 1, [1.0, None, 0.0, 0.0]), (403, 1, [1.0, math.nan, 0.0, 0.0]),
             (404, 1, [math.inf, 0.0, 0.0, 0.0]), (410, 1, [0.0] * 4), (411, 1, [0.0] * 4), (412, 0, [0.0] * 4), (420, 0, []), (421, 0, []),
             (422, 1, []), (430, 0, [1.0]), (431, 0, [2.0]), (432, 1, [1.5]), (433, 1, [-1.0]), (0, 7, base[5]), (0, 0, base[0]), (0, 0, base[0]),
             (440, 0, [1e-9] * 4), (441, 0, [-1e-9] * 4), (442, 1, [3e5, 1.0, 2.0, 3.0])]
    mined = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert found(mined) == brute(rows, lambda i: i % 10 == 0)


def test_one_label_and_one_direction_hold_a_third(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1 if i % 3 == 0 else int(rng.integers(4)), v) for i, v in enumerate(clustered(rng, 600, 6, 0.05))]
    rows = [(i, label, rows[0][2] if i % 3 == 1 else v) for i, label, v in rows]
    mined = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 20 == 0)
    assert found(mined) == brute(rows, lambda i: i % 20 == 0)


def test_the_registered_query(spark):
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding))
            for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert found(QUERIES["op12_hard_negatives"](spark, SF_DIR)) == brute(rows, lambda i: i % 100 == 0) != []


def test_empty_tables_and_clashing_columns(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    rows = [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.5])]
    plain = spark.createDataFrame(rows, SCHEMA)
    assert hard_negatives.mine(plain, F.col("vec_id") == 99).collect() == []
    names = ["dim", "shard", "kind", "cluster", "windows", "window", "score", "anchor_id", "Rank", "one"]
    other = plain.select("*", *[F.lit("x").alias(n) for n in names])
    assert found(hard_negatives.mine(other, F.col("vec_id") == 1)) == [(1, 2, 1, 3, 65536, 32768)]


def test_scores_beyond_a_long_are_an_error(spark):
    rows = [(i, i % 2, [1e12, 1e12]) for i in range(4)]
    with pytest.raises(Exception, match="do not fit a long"):
        hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()


def test_lists_end_early_and_bounds_hold():
    """Members look at a part of the list only, and no row scores more than its bound."""
    rng = np.random.default_rng(6)
    vectors = np.floor(256 * np.array(clustered(rng, 4000, 16, 0.1)))
    labels = rng.integers(0, 2, 4000)
    shard = hard_negatives.Shard(np.arange(4000), labels, vectors)
    middle = hard_negatives.centres(vectors)
    cosines = vectors @ middle.T / shard.lengths[:, None]
    looked = asked = 0
    for c in range(len(middle)):
        members = np.flatnonzero((cosines.argmax(1) == c) & (labels == 1))[:20]
        if not len(members):
            continue
        widest = float(np.arccos(np.clip(cosines[members, c], -1, 1)).max())
        shard.sort_for(middle[c], widest)
        scores = vectors[members] @ vectors[shard.order].T
        assert (scores <= shard.bounds * shard.lengths[members, None]).all()
        low = np.full(len(members), hard_negatives._NONE + 1)
        best = hard_negatives.Best(np.arange(len(members)), low, np.full(len(members), 1 << 60), 5)
        hard_negatives.STEP, step = 64, hard_negatives.STEP
        looked += shard.walk(members, 1, vectors[members], best, True)
        hard_negatives.STEP = step
        asked += len(members) * int((labels == 1).sum())
        window, score, _ = best.result()
        want = np.where((labels == 1)[None, :] & (np.arange(4000) != members[:, None]), vectors[members] @ vectors.T, -np.inf)
        assert (score.reshape(len(members), 5) == -np.sort(-want, axis=1)[:, :5]).all()
    assert 0 < looked < 0.5 * asked


def test_rows_move_once(spark):
    """Vectors of rows stand in one exchange per pass; only anchors are repeated."""
    rng = random.Random(7)
    rows = [(i, i % 2, [rng.random() for _ in range(4)]) for i in range(50)]
    mined = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    plan = mined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
