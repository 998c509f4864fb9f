"""Empty tables and extra columns whose names clash, for every operator on documents; ownership against brute force."""

from collections import defaultdict

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from samples import frame  # noqa: F401

from nearfield.llm import byte_bpe, fingerprints, licenses, near_dups, quality, secrets, toxicity
from nearfield.llm.queries import RANKS
from nearfield.llm.tasks import fold


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    return toxicity.learn(docs, labels, fold("doc_id", 5) != 0), quality.learn(docs, labels, fold("doc_id", 4) != 2)


OPERATORS = {
    "byte_bpe": lambda docs, learnt: byte_bpe.round_trip(docs, RANKS),
    "near_dups": lambda docs, learnt: near_dups.near_duplicates(docs),
    "toxicity": lambda docs, learnt: toxicity.score(docs, learnt[0]),
    "secrets": lambda docs, learnt: secrets.scan(docs),
    "licenses": lambda docs, learnt: licenses.scan(docs),
    "fingerprints": lambda docs, learnt: fingerprints.compare_with_next(docs),
    "quality": lambda docs, learnt: quality.score(docs, learnt[1]),
    "redact": lambda docs, learnt: secrets.redact(docs, secrets.scan(docs)).select("doc_id", "text", "n_chars"),
}
TEXTS = ["one two three four five six", "all rights reserved", "password = 'abcDEF123456+x'", "", None, "you are a fool. Go away!\nNow."]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(frame, learnt, name):
    operator = OPERATORS[name]
    docs = frame(list(enumerate(TEXTS)))
    plain = operator(docs, learnt)
    assert operator(docs.limit(0), learnt).collect() == []
    more = {c for c in plain.columns if c not in docs.columns} | {"Row", "value", "label", "words", "hash", "node", "line"}
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in sorted(more)])
    assert sorted(map(str, operator(clashing, learnt).select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_ownership_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    owners = defaultdict(set)
    for _, source, text in rows:
        for _, _, _, value in secrets.candidates(text):
            owners[value].add(source.split("/")[0])
    want = {}
    for doc_id, _, text in rows:
        found = secrets.candidates(text)
        copied = [len(owners[v]) >= secrets.COPIED_OWNERS for *_, v in found]
        live = [secrets.span_list([f[:3]]) for f, c in zip(found, copied) if not c and secrets.looks_live(f[3], f[1])]
        want[doc_id] = (sum(copied), sorted(live), secrets.span_list([f[:3] for f in found]))
    assert {r.doc_id: (r.n_copied, sorted(r.live), r.spans) for r in secrets.scan(docs).collect()} == want
    assert any(w[0] for w in want.values()) or any(w[1] for w in want.values())
