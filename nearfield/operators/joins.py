"""Match wide rows against keys without shuffling the wide rows, wherever sizes allow.

Texts and vectors are far wider than keys. A key set is therefore counted first: a handful becomes
literals that reach the Parquet reader, a set of proven size is broadcast, and beyond that only keys are
shuffled: they meet the keys and places of the wide rows, which are then read again by place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import quoted, row_id
from nearfield.session import estimated_bytes, materialize

# Up to this many keys travel as literals, so that a reader can skip Parquet row groups.
LITERAL_KEYS = 1000
# A key set no larger than this is broadcast.
BROADCAST_KEYS = 500_000
BROADCAST_BYTES = 16 << 20
# Size of a bitmap of places with its file's name, about, and groups of files that are looked up by place at most.
BITMAP_BYTES, MOST_GROUPS = 4352, 32


def key_count(keys: DataFrame) -> tuple[int, int]:
    """Exact number of rows and bytes of text of a key set."""
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length(row_id(keys.columns))).alias("bytes")).first()
    return size["n"], size["bytes"] or 0


def fits_broadcast(keys: DataFrame | tuple[int, int], most: int | None = None) -> bool:
    """Whether a key set, or one of a known size, is no larger than ``most`` keys, or than any set that is broadcast."""
    n, size = key_count(keys) if isinstance(keys, DataFrame) else keys
    return n <= (BROADCAST_KEYS if most is None else most) and size <= BROADCAST_BYTES


def literal_keys(rows: list, key: list[str]) -> Column:
    """Rows that may have one of the given keys; exact for a single key column."""
    if not rows:
        return F.lit(False)
    condition = F.lit(True)
    for name in key:
        condition = condition & quoted(name).isin(sorted({r[name] for r in rows}))
    return condition


def pushed_keys(rows: list, key: list[str], at_once: int = 10) -> Column:
    """As ``literal_keys``, in short lists: the Parquet reader tests these value by value and can skip pages."""
    if not rows:
        return F.lit(False)
    condition = F.lit(True)
    for name in key:
        values = sorted({r[name] for r in rows})
        some = F.lit(False)
        for start in range(0, len(values), at_once):
            some = some | quoted(name).isin(values[start : start + at_once])
        condition = condition & some
    return condition


def rows_with_keys(wide: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wide`` whose key is in ``keys``."""
    keys = keys.select(*[quoted(c) for c in key])
    n, size = key_count(keys)
    if n <= LITERAL_KEYS and size <= BROADCAST_BYTES:
        wide = wide.where(literal_keys(keys.collect(), key))
    if n <= BROADCAST_KEYS and size <= BROADCAST_BYTES:
        return wide.join(F.broadcast(keys), key, "left_semi")
    places = _places(wide, key)
    if places is not None:
        found = _at_places(wide, places.join(keys, key, "left_semi"))
        if found is not None:
            return found
    return wide.join(keys, key, "left_semi")


def rows_without_keys(wide: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wide`` whose key is not in ``keys``.

    When ``keys`` is too large to broadcast, only keys are shuffled to find out which rows remain. Those are found
    again by their key if they are few, else by their place in their file; the wide rows follow them through a
    shuffle only if they come from no files, or from too many.
    """
    names = [quoted(c) for c in key]
    keys = keys.select(*names)
    if fits_broadcast(keys):
        return wide.join(F.broadcast(keys), key, "left_anti")
    places = _places(wide, key)
    left = (wide.select(*names) if places is None else places).join(keys, key, "left_anti")
    remaining = materialize(left, "remaining-keys")
    known = F.lit(True)
    for name in names:
        known = known & name.isNotNull()
    # a row without a key is in no key set and is only found by its place
    if fits_broadcast(remaining.select(*names)) and remaining.where(~known).isEmpty():
        return wide.join(F.broadcast(remaining.select(*names)), key, "left_semi")
    if places is not None:
        found = _at_places(wide, remaining)
        if found is not None:
            return found
    return wide.join(keys, key, "left_anti")


def _places(wide: DataFrame, key: list[str]) -> DataFrame | None:
    """Keys of rows read from files, with the file and the row's number in it; None for other rows."""
    try:
        return wide.select(*[quoted(c) for c in key], F.col("_metadata.file_path").alias("_file"),
                           (F.col("_metadata.row_index") + 1).alias("_row"))
    except AnalysisException:
        return None


def _at_places(wide: DataFrame, places: DataFrame) -> DataFrame | None:
    """The rows that stand at given places of their files, which every task looks up for the files it reads.

    Places become bitmaps of 32,768 rows, a bit for each. Files are grouped so that the bitmaps of a group may be
    broadcast, and each group is a scan of its own files; None if there would be too many groups.
    """
    bitmaps = materialize(
        places.groupBy("_file", F.bitmap_bucket_number("_row").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits")), "places")
    # one row per file, of which the driver has a list anyway
    counts = bitmaps.groupBy("_file").count().orderBy("_file").collect()
    groups: list[list[str]] = []
    room = 0
    for row in counts:
        if row["count"] > room:
            groups.append([])
            room = max(BROADCAST_BYTES // BITMAP_BYTES, row["count"])
        groups[-1].append(row["_file"])
        room -= row["count"]
    if len(groups) > MOST_GROUPS or any(r["count"] * BITMAP_BYTES > BROADCAST_BYTES for r in counts):
        return None
    if not groups:
        return wide.limit(0)
    found = None
    for files in groups:
        rows = wide.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))
        own = bitmaps
        if len(groups) > 1:
            rows, own = rows.where(F.col("_metadata.file_path").isin(files)), own.where(F.col("_file").isin(files))
        rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(F.broadcast(own), ["_file", "_bucket"])
        at = F.bitmap_bit_position("_row").cast("int")
        byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.where(F.getbit(byte, at % 8) == 1).select(*[quoted(c) for c in wide.columns])
        found = rows if found is None else found.unionAll(rows)
    return found


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input is too small to fill them by itself.

    Embedding and chunking cost far more than reading, and one small file would keep one core busy.
    Inputs with enough bytes or files to fill the cores are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if estimated_bytes(df) >= cores * per_task or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
