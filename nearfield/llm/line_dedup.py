"""Line dedup: lines that too many documents hold are dropped from all of them.

Lines are exploded and normalised, and only their 128-bit hashes, positions and documents move: counting distinct
documents per hash gives the common lines, and a document that holds one gets the positions it loses. What stays is
put together by position. Built-in functions only.

A line's key is the line without white space at both ends, with A-Z in lower case; keys shorter than ``least_chars``
code points are never common. Documents are told apart by their id: rows that share an id count as one document, rows
without an id as one together. Null texts count as empty, an empty text is one empty line. Equal rows lose the same
lines, each of them gives a row; there are no ties, a line is common or not. Texts and lines may be of any length. An
empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import text_rows
from nearfield.session import materialize

LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
# White space that is stripped, and the letters that are lowered.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # of a text in ASCII, lower() changes A-Z alone, and it is much the faster of the two
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hash(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in (11, 12)]


def _named(docs: DataFrame) -> DataFrame:
    """Documents with a name of 128 bits for what a row holds; equal rows share it."""
    one, two = _hash("doc_id", "text")
    return docs.select("doc_id", "text", one.alias("row_1"), two.alias("row_2"))


def _lines() -> Column:
    return F.split("text", "\n", -1)


def line_places(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, the row's name, position and hash of every line whose key is long enough."""
    exploded = _named(docs).select("doc_id", "row_1", "row_2", F.posexplode(_lines()).alias("position", "line"))
    keyed = exploded.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    one, two = _hash("key")
    return keyed.select("doc_id", "row_1", "row_2", "position", one.alias("key_1"), two.alias("key_2"))


def common_keys(places: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Hashes of the lines that at least so many documents hold.

    Documents are made distinct within each task and by line and document first, so a line of a third of all
    documents costs one row per document and is then counted in parts.
    """
    documents = F.count_distinct(F.struct("doc_id"))
    return places.groupBy("key_1", "key_2").agg(documents.alias("documents")).where(
        F.col("documents") >= least_documents).select("key_1", "key_2")


def drop_common_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, a row for every row of ``docs``."""
    docs = text_rows(docs)
    places = materialize(line_places(docs, least_chars), "line-places")
    common = materialize(common_keys(places, least_documents), "common-lines")
    # the sets are filled where the rows are, so copies of a row meet as one
    lost = places.join(common, ["key_1", "key_2"], "left_semi").groupBy("row_1", "row_2").agg(
        F.collect_set("position").alias("lost"))
    joined = _named(docs).join(lost, ["row_1", "row_2"], "left").withColumn("lines", _lines())
    places_of_all = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places_of_all, "lost"), lambda at: F.get("lines", at))
    return joined.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("bigint").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
