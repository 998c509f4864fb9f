"""From raw documents to packed training sequences, in stages that each work on all their predecessor kept.

toxicity   drops the documents that the pattern grammar rejects
quality    drops the documents that the line model rejects
near_dups  keeps one document of every group of near duplicates
secrets    replaces live credentials in the texts; no document goes
packing    cuts and packs what is left into sequences of token ids

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, with the columns of documents in all but the last.
Models are learnt anew from the labels beside the documents. Null texts count as empty; how each stage treats other
odd rows stands with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import near_dups, packing, quality, secrets, toxicity
from nearfield.llm.queries import TOKENIZER, table
from nearfield.llm.tasks import fold
from nearfield.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.good_only(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_dups", drop_copies),
    ("secrets", hide_secrets),
    ("packing", pack),
]

# Models and similarity are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
