"""Search one table or many: filters, top-k, then the winners' source rows."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import InvalidFilterError, NearfieldError
from nearfield.functions import text as X
from nearfield.functions import vectors as V
from nearfield.functions.text import quoted
from nearfield.operators.joins import LITERAL_KEYS, fits_broadcast, key_count, literal_keys, pushed_keys, rows_with_keys
from nearfield.operators.topk import SIMILARITY, best_of, by_similarity, nearest, similarities
from nearfield.session import estimated_bytes, materialize

logger = logging.getLogger(__name__)

# Default number of results, and how results are shortened for display.
LIMIT = 10
SIMILARITY_DIGITS = 4
CONTENT_WIDTH = 500
# Vectors compared in full for each one wanted, after a scan of codes, and how many at most; beyond, all are.
RERANKED, MOST_RERANKED = 8, 4000
# Bins of the scores' histogram for a similarity of 1, and how many times the expected number of scores is looked at.
SCORE_BINS, CUT_MARGIN = 512, 2
SMALL_BYTES = 64 << 20
FOUND = "_source_table string, _source_schema string, row_id string, content string, similarity double, row_json string"


def filter_condition(df: DataFrame, filters: Mapping[str, object]) -> Column | None:
    """Search filters as one condition; every key is checked before the plan is built.

    Text columns match case-insensitively with ``%`` and ``_`` as wildcards, other columns match by
    equality, and ``x_min`` / ``x_max`` bound column ``x`` unless a column of that very name exists.
    """
    known = {f.name: f.dataType for f in df.schema.fields}
    result = None
    for key, value in filters.items():
        bound = key[-4:] if key not in known and key.endswith(("_min", "_max")) else ""
        name = key.removesuffix(bound)
        if name not in known:
            raise InvalidFilterError(
                f"invalid filter column {name!r} (from filter key {key!r}); valid columns: {', '.join(sorted(known))}"
            )
        column = quoted(name)
        if value is None:
            one = F.lit(False)
        elif bound:
            one = column >= F.lit(value) if bound == "_min" else column <= F.lit(value)
        elif isinstance(known[name], T.StringType):
            one = column.ilike(escaped_pattern(str(value)))
        else:
            one = column == F.lit(value)
        result = one if result is None else result & one
    return result


def escaped_pattern(pattern: str) -> str:
    """A backslash that escapes nothing stands for itself instead of being an error."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            following = pattern[at + 1:at + 2]
            out.append("\\" + (following if following in ("%", "_", "\\") and following else "\\"))
            at += 2 if following in ("%", "_", "\\") and following else 1
        else:
            out.append(pattern[at])
            at += 1
    return "".join(out)


@dataclass(frozen=True)
class Winners:
    """Keys and similarities of the best rows, and their number; as rows too if they are few."""

    best: DataFrame
    count: int
    rows: list | None = None


def fetched(best: DataFrame, limit: int) -> Winners:
    """At most ``limit`` rows, on the driver if they are few and else written."""
    if limit <= LITERAL_KEYS:
        rows = best.collect()
        return Winners(best.sparkSession.createDataFrame(rows, best.schema), len(rows), rows)
    best = materialize(best, "winners")
    return Winners(best, best.count())


@dataclass(frozen=True)
class Searchable:
    """A source table and its vectors, joined on the real key columns.

    ``lookup`` reads only the stored vectors that may have one of a few given keys. With ``decode``, vectors
    have a code that stands for them roughly; codes are ranked first and only the best vectors in full.
    """

    source: DataFrame
    vectors: DataFrame
    key: list[str]
    columns: list[str]
    chunked: bool = False
    lookup: Callable[[DataFrame], DataFrame] | None = None
    decode: Callable[[Column], Column] | None = None
    # allowed keys that are broadcast at most, if not as many as any set
    most_allowed: int | None = None
    # vectors of so many bytes have few enough scores to meet a large filter all
    small_bytes: int = SMALL_BYTES

    def search(
        self,
        query: Sequence[float],
        limit: int = LIMIT,
        filters: Mapping[str, object] | None = None,
        dims: int | None = None,
    ) -> DataFrame:
        """Best rows with their content, similarity and remaining source columns.

        Chunked tables return the text of the best chunk as content. Filters act before ranking, and
        a vector whose source row is gone never takes a place in the result. Winners are found at once,
        their rows are read when the result is.
        """
        return self.with_rows(self.winners(query, limit, filters, dims), limit)

    def winners(
        self, query: Sequence[float], limit: int, filters: Mapping[str, object] | None = None, dims: int | None = None
    ) -> Winners:
        """Keys and similarities of the best rows."""
        if limit < 1:
            raise NearfieldError(f"the number of results must be positive, got {limit}")
        return self._winners(V.check_query(query, dims), limit, filter_condition(self.source, filters or {}))

    def with_rows(self, winners: Winners, limit: int) -> DataFrame:
        """The winners' source rows, best first."""
        source, vectors, best = self.source, self.vectors, winners.best
        if winners.rows is not None:
            near = literal_keys(winners.rows, self.key)
            source = source.where(near)
            if self.chunked:
                vectors = (self.lookup(best) if self.lookup else vectors).where(near)
        elif self.chunked and self.lookup:
            vectors = self.lookup(best)
        key = [quoted(c) for c in self.key]
        own = ["row_id", "content", SIMILARITY, *(["chunk_index"] if self.chunked else [])]
        rest = [c for c in source.columns if c not in {*self.key, *own, "embedding"}]
        # the result's own names may also be names of the source
        found = best.join(
            source.select(*key, X.content(self.columns).alias("_content"), *[quoted(c) for c in rest]), self.key
        )
        if self.chunked:
            texts = vectors.select(*key, "chunk_index", F.col("chunk_text").alias("_chunk"))
            found = found.join(texts, [*self.key, "chunk_index"])
        return found.orderBy(*by_similarity(self.key)).limit(limit).select(
            X.row_id(self.key).alias("row_id"),
            F.col("_chunk" if self.chunked else "_content").alias("content"),
            *[quoted(c) for c in own[2:]],
            *[quoted(c) for c in self.key if c not in own],
            *[quoted(c) for c in rest],
        )

    def _nearest(self, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        part = "chunk_index" if self.chunked else None
        if self.decode is not None and RERANKED * k <= MOST_RERANKED:
            # the codes alone are read first, then the vectors that look best
            coded = vectors.withColumn("embedding", self.decode(F.col("code")))
            rows = nearest(coded, self.key, query, RERANKED * k, part=part).collect()
            vectors = vectors.where(pushed_keys(rows, self.key))
        return nearest(vectors, self.key, query, k, part=part)

    def _winners(self, query: Sequence[float], limit: int, condition: Column | None) -> Winners:
        """Key, similarity [and chunk number] of the best rows that exist and pass the filter.

        The vectors are by far the widest data here and never move. A small set of allowed keys is
        broadcast to them. Without a filter nearly all vectors have their row, so twice the wanted
        number is ranked and checked. Else every vector is scored in one scan, and only the keys of the
        best scores meet the filter.
        """
        allowed = self.source if condition is None else self.source.where(condition)
        allowed = allowed.select(*[quoted(c) for c in self.key])
        share = 1.0
        if condition is not None:
            size = key_count(allowed)
            if fits_broadcast(size, self.most_allowed):
                near = self.vectors.join(F.broadcast(allowed), self.key, "left_semi")
                return fetched(self._nearest(near, query, limit), limit)
            share = size[0] / max(1, self.source.count())
        if condition is None and 2 * limit <= LITERAL_KEYS:
            ranked = self._nearest(self.vectors, query, 2 * limit)
            rows = ranked.collect()
            passing = {tuple(r) for r in allowed.where(literal_keys(rows, self.key)).collect()} if rows else set()
            kept = [r for r in rows if tuple(r[c] for c in self.key) in passing]
            if len(kept) >= limit or len(rows) < 2 * limit:
                kept = kept[:limit]
                return Winners(self.source.sparkSession.createDataFrame(kept, ranked.schema), len(kept), kept)
        return self._above_a_cut(query, limit, allowed, share)

    def _above_a_cut(self, query: Sequence[float], limit: int, allowed: DataFrame, share: float) -> Winners:
        """Winners among the best scores only: as many as the share of allowed rows asks for, more if too few pass.

        Of a small table all scores meet the filter. Else all scores are written once, not shuffled; their histogram tells
        which score so many rows reach. Whatever passes above that score beats all rows below, so enough of them are the
        result.
        """
        part = "chunk_index" if self.chunked else None
        scored = similarities(self.vectors, self.key, query, part=part)
        if estimated_bytes(self.vectors) <= self.small_bytes:
            return fetched(best_of(scored.join(allowed, self.key, "left_semi"), self.key, limit, part), limit)
        scored = materialize(scored.sortWithinPartitions(quoted(SIMILARITY).desc_nulls_last()), "scores")
        counts = {
            r["bin"]: r["n"]
            for r in scored.groupBy(F.floor(quoted(SIMILARITY) * SCORE_BINS).alias("bin")).agg(F.count("*").alias("n")).collect()
        }  # similarities are from -1 to 1, so there are at most so many bins on either side of 0
        wanted = CUT_MARGIN * limit / max(share, 1e-12)
        while True:
            reached, cut = 0, None
            for number in sorted((b for b in counts if b is not None), reverse=True):
                reached += counts[number]
                if reached >= wanted:
                    cut = number
                    break
            above = scored if cut is None else scored.where(quoted(SIMILARITY) >= cut / SCORE_BINS)
            # only these keys meet the filter
            passing = rows_with_keys(allowed, above.select(*[quoted(c) for c in self.key]).distinct(), self.key)
            winners = fetched(best_of(above.join(passing, self.key, "left_semi"), self.key, limit, part), limit)
            if cut is None or winners.count >= limit:
                return winners
            wanted *= CUT_MARGIN ** 3


def shaped(results: DataFrame) -> DataFrame:
    """Results for display: similarity to 4 digits, content cut at 500, no vector."""
    return (
        results.withColumn(SIMILARITY, F.round(quoted(SIMILARITY), SIMILARITY_DIGITS))
        .withColumn("content", F.substring("content", 1, CONTENT_WIDTH))
        .drop("embedding")
    )


@dataclass(frozen=True)
class TaggedTable:
    """One table of a search across tables; ``find`` is its own way to search, if not all vectors."""

    name: str
    schema: str
    model: str
    table: Searchable
    find: Callable[[Sequence[float]], DataFrame] | None = None


def search_all(
    tables: list[TaggedTable], query_vectors: Mapping[str, Sequence[float]], limit: int = LIMIT
) -> DataFrame | None:
    """Top-k over several tables: each table's own top-k, tagged with its table, then merged.

    All tables are ranked in one job, and rows are read only from tables that have a row among the best of all. Tables
    may have different columns, so the remaining ones travel as JSON. A table whose model has no query vector is left
    out with a warning; None means that no table was left.
    """
    asked = []
    for tagged in tables:
        query = query_vectors.get(tagged.model)
        if query is None:
            logger.warning("no provider for model %s, leaving out table %s", tagged.model, tagged.name)
        else:
            asked.append((tagged, V.check_query(query, None)))
    if not asked:
        return None
    found = [(tagged, tagged.find(query)) for tagged, query in asked if tagged.find]
    plain = [(tagged, query) for tagged, query in asked if not tagged.find]
    best = _best_of_all(plain, limit)
    found += [(tagged, tagged.table.with_rows(one, limit)) for (tagged, _), one in zip(plain, best) if one.count]
    merged = asked[0][0].table.source.sparkSession.createDataFrame([], FOUND)
    for tagged, rows in found:
        common = ["row_id", "content", SIMILARITY, "chunk_index"]
        rest = [c for c in rows.columns if c not in common]
        merged = merged.unionByName(rows.select(
            F.lit(tagged.name).alias("_source_table"),
            F.lit(tagged.schema).alias("_source_schema"),
            "row_id",
            "content",
            SIMILARITY,
            F.to_json(F.struct(*[quoted(c) for c in rest])).alias("row_json"),
        ))
    return merged.orderBy(*by_similarity(["_source_schema", "_source_table", "row_id"])).limit(limit)


def _best_of_all(tables: list[tuple[TaggedTable, Sequence[float]]], limit: int) -> list[Winners]:
    """Winners of every table, as far as they can be among the ``limit`` best of all tables.

    As in a search of one table, twice the wanted number of vectors is ranked and their source rows are looked for; here
    each step is one job for all tables. A table that lost too many rows is searched by itself.
    """
    if 2 * limit > LITERAL_KEYS or len(tables) < 2:
        return [tagged.table.winners(query, limit) for tagged, query in tables]
    ranked, merged = [], None
    for at, (tagged, query) in enumerate(tables):
        table = tagged.table
        ranked.append(table._nearest(table.vectors, query, 2 * limit))
        one = ranked[-1].select(F.lit(at).alias("_table"), F.struct("*").alias(f"_row_{at}"))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    rows: list[list] = [[] for _ in tables]
    for row in merged.collect():  # at most 2 * limit for each table
        rows[row["_table"]].append(row[f"_row_{row['_table']}"])
    merged = None
    for at, (tagged, _) in enumerate(tables):
        key = [quoted(c) for c in tagged.table.key]
        one = tagged.table.source.where(literal_keys(rows[at], tagged.table.key)).select(
            F.lit(at).alias("_table"), F.struct(*key).alias(f"_row_{at}"))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    passing: list[set] = [set() for _ in tables]
    for row in merged.collect():
        passing[row["_table"]].add(tuple(row[f"_row_{row['_table']}"]))
    best = []
    for at, (tagged, query) in enumerate(tables):
        kept = [r for r in rows[at] if tuple(r[c] for c in tagged.table.key) in passing[at]]
        if len(kept) < limit and len(rows[at]) == 2 * limit:
            kept = tagged.table.winners(query, limit).rows
        order = [-math.inf if r[SIMILARITY] is None else r[SIMILARITY] for r in kept]
        best.append([kept[i] for i in sorted(range(len(kept)), key=lambda i: -order[i])][:limit])
    # a row below this similarity is behind ``limit`` others, whatever table it is of
    scores = sorted((r[SIMILARITY] for one in best for r in one if r[SIMILARITY] is not None), reverse=True)
    least = scores[limit - 1] if len(scores) >= limit else None
    best = [one if least is None else [r for r in one if r[SIMILARITY] is not None and r[SIMILARITY] >= least] for one in best]
    spark = tables[0][0].table.source.sparkSession
    return [Winners(spark.createDataFrame(one, frame.schema), len(one), one) for one, frame in zip(best, ranked)]
