"""Search by text: embed the query once per model, pick the right search, return rows."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import NearfieldError
from nearfield.functions.embedders import Models
from nearfield.operators.search import FOUND, LIMIT, Searchable, TaggedTable, search_all
from nearfield.registry import Registry, TableEntry
from nearfield.sources.embedding_table import Snapshot

logger = logging.getLogger(__name__)

def searchable(spark: SparkSession, entry: TableEntry, snap: Snapshot | None = None) -> Searchable:
    """The rows of one snapshot; queries must be embedded with the model that this snapshot names."""
    table = entry.embeddings(spark)
    snap = snap or table.snapshot()
    return Searchable(
        entry.rows(spark), table.read(snap.version), entry.primary_key, entry.columns, entry.chunked,
        lambda keys: table.read_buckets_of(keys, snap.version),
    )


def build_lists(spark: SparkSession, entry: TableEntry, lists: int, code_bytes: int | None = None) -> None:
    """Lists for approximate search. Every later write of the table keeps them, also a migration.

    Codes of ``code_bytes`` bytes are scanned before vectors; 0 means that vectors of the probed lists are scanned.
    """
    entry.embeddings(spark).lists().build(lists, code_bytes=code_bytes)


def _found(
    spark: SparkSession, entry: TableEntry, snap: Snapshot, vector: list[float], limit: int, filters: Mapping[str, object] | None,
    probes: int | None,
) -> DataFrame:
    """Search one snapshot; with ``probes`` the closest lists, twice as many until enough rows are found."""
    one, lists = searchable(spark, entry, snap), entry.embeddings(spark).lists()
    build = lists.current(snap) if probes is not None else None
    if build is None:
        if probes is not None:
            logger.warning("%s has no lists, searching all of it", entry.table)
        return one.search(vector, limit, filters, snap.dims)
    while True:
        near = replace(one, vectors=lists.probed(snap, build, vector, probes))
        if build.coded and probes < build.lists:
            near = replace(near, decode=lists.quantizer(build).decoded)
        winners = near.winners(vector, limit, filters, snap.dims)
        if probes >= build.lists or winners.count >= limit:
            return near.with_rows(winners, limit)
        probes *= 2


def search(
    spark: SparkSession,
    registry: Registry,
    models: Models,
    query: str,
    table: str | None = None,
    filters: Mapping[str, object] | None = None,
    limit: int = LIMIT,
    schema: str | None = None,
    probes: int | None = None,
) -> DataFrame:
    """One table if named, with filters if given; otherwise all registered tables.

    With ``probes`` only so many lists of vectors are read, the closest ones, where a table has lists; if fewer rows than
    ``limit`` pass the filters there, more lists are. Probing all lists is exact. The model is the one each table's
    vectors are of now, also when the registry was saved before a migration.
    """
    if not query.strip():
        raise NearfieldError("the query text is empty")
    if table is not None:
        entry = registry.require(table, schema)
        snap = entry.embeddings(spark).snapshot()
        vector = models.get(snap.model).embed_query(query)
        return _found(spark, entry, snap, vector, limit, filters, probes)
    if filters:
        raise NearfieldError("filters need a table")
    entries = [(e, e.embeddings(spark).snapshot()) for e in registry.entries if schema in (None, e.schema)]
    vectors = {
        key: model.embed_query(query)
        for key in {snap.model for _, snap in entries}
        if (model := models.provided(key)) is not None
    }
    tagged = []
    for entry, snap in entries:
        def find(query, entry=entry, snap=snap):
            return _found(spark, entry, snap, query, limit, None, probes)

        tagged.append(TaggedTable(
            entry.table, entry.schema, snap.model, searchable(spark, entry, snap),
            None if probes is None else find))
    found = search_all(tagged, vectors, limit)
    return found if found is not None else spark.createDataFrame([], FOUND)
