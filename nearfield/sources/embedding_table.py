"""Embedding side tables: Parquet folders that are never changed in place, and a small pointer file.

Every write adds a folder ``gen=<name>/bucket=<b>/``; a snapshot file then says which generations are
live. Readers resolve the newest snapshot when they build their plan and keep reading the same files
while writers go on.

An update or delete writes only its new rows and its keys. Readers leave out older rows with one of
those keys, by joins with key sets of a size that may be broadcast: once there are too many of these,
the buckets they touch are rewritten and they start empty again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import CommitConflictError, NearfieldError
from nearfield.functions import vectors as V
from nearfield.functions.text import quoted, row_id
from nearfield.operators.joins import BROADCAST_BYTES, BROADCAST_KEYS, key_count
from nearfield.sources import files
from nearfield.sources.vector_lists import VectorLists


# Merges kept as folders of their own before they are joined into one.
FOLD_AFTER = 20


# Broadcasts of pending keys that a read makes at most; each holds a set of proven size.
MOST_BROADCASTS = 8


def _broadcasts(pending: list[dict]) -> list[list[tuple[dict, int, int]]]:
    """Pending sets, counted when they were written, in groups that can be broadcast each.

    A set that is too large by itself is cut into parts by hash, twice as many as its size asks for.
    """
    groups: list[list[tuple[dict, int, int]]] = []
    keys = size = 0
    for entry in pending:
        asked = max(math.ceil(entry["keys"] / BROADCAST_KEYS), math.ceil(entry["bytes"] / BROADCAST_BYTES))
        if asked > 1:
            groups += [[(entry, part, 2 * asked)] for part in range(2 * asked)]
            keys, size = BROADCAST_KEYS, BROADCAST_BYTES
            continue
        if not groups or keys + entry["keys"] > BROADCAST_KEYS or size + entry["bytes"] > BROADCAST_BYTES:
            groups.append([])
            keys = size = 0
        groups[-1].append((entry, 0, 1))
        keys, size = keys + entry["keys"], size + entry["bytes"]
    return groups


def _fits(pending: list[dict]) -> bool:
    """Whether readers can leave out the pending keys without a shuffle."""
    return len(_broadcasts(pending)) <= MOST_BROADCASTS


def _last_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that is last by ``order``."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    kept = rows.groupBy(*[quoted(c) for c in key]).agg(F.max(F.struct(*[quoted(c) for c in [*order, *rest]])).alias("_last"))
    return kept.select(*[quoted(c) for c in key], "_last.*")


@dataclass(frozen=True)
class Snapshot:
    """What is live.

    ``live`` maps a generation to its ``order`` and its buckets. ``pending`` lists key sets: a row is
    dead if a pending set with a later order holds its key.
    """

    version: int
    key_schema: str
    model: str
    model_name: str
    dims: int
    source_column: str
    chunked: bool
    buckets: int
    live: dict[str, dict] = field(default_factory=dict)
    pending: list[dict] = field(default_factory=list)
    # newest versions that added rows in bulk, and that emptied ``pending``
    appended: int = 0
    cleared: int = 0
    # last finished micro-batch per stream
    batches: dict[str, int] = field(default_factory=dict)
    # a model migration under way: its model, dimensions and finished generations
    staged: dict | None = None


class EmbeddingTable:
    """One embedding table under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- life cycle ----------------------------------------------------------

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        key_schema: T.StructType,
        model: str,
        model_name: str,
        dims: int,
        source_column: str,
        *,
        chunked: bool = False,
        buckets: int = 32,
    ) -> EmbeddingTable:
        """Create the table unless it exists; an existing table must have the same shape."""
        table = cls(spark, path)
        if table.exists():
            found = table.snapshot()
            if (found.dims, found.chunked) != (dims, chunked):
                raise NearfieldError(f"{path} exists with dims={found.dims}, chunked={found.chunked}")
            return table
        first = Snapshot(0, key_schema.json(), model, model_name, dims, source_column, chunked, buckets)
        table._publish(first)
        return table

    def exists(self) -> bool:
        return bool(self._versions())

    def drop(self) -> bool:
        return files.delete(self.spark, self.path)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or an older one that has not been cleaned up."""
        if version is None:
            versions = self._versions()
            if not versions:
                raise NearfieldError(f"no embedding table at {self.path}")
            version = versions[-1]
        return Snapshot(**json.loads(files.read_text(self.spark, f"{self.path}/_snapshots/{version}.json")))

    def lists(self) -> VectorLists:
        """The lists for approximate search, which every write of this table keeps up to date."""
        return VectorLists(self)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the newest ``keep`` snapshots uses. Not beside a writer."""
        versions = self._versions()
        used: set[str] = set()
        for version in versions[-keep:]:
            snap = self.snapshot(version)
            used |= {f"gen={g}" for g in [*snap.live, *(snap.staged or {}).get("live", {})]}
            used |= {f"_keys/{p['name']}" for p in snap.pending}
        found = [n for n in files.names(self.spark, self.path) if n.startswith("gen=")]
        found += [f"_keys/{n}" for n in files.names(self.spark, f"{self.path}/_keys")]
        unused = [n for n in found if n not in used]
        for name in unused:
            files.delete(self.spark, f"{self.path}/{name}")
        for version in versions[:-keep]:
            files.delete(self.spark, f"{self.path}/_snapshots/{version}.json")
        self.lists().vacuum({n.removeprefix("gen=") for n in used})
        return unused

    # -- shape ---------------------------------------------------------------

    @property
    def key(self) -> list[str]:
        return self.key_schema().fieldNames()

    def key_schema(self, snap: Snapshot | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads((snap or self.snapshot()).key_schema))

    def schema(self, snap: Snapshot | None = None) -> T.StructType:
        snap = snap or self.snapshot()
        fields = [T.StructField(f.name, f.dataType) for f in self.key_schema(snap).fields]
        fields.append(T.StructField("row_id", T.StringType()))
        if snap.chunked:
            fields += [T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())]
        return T.StructType(
            fields
            + [
                T.StructField("embedding", T.ArrayType(T.FloatType())),
                T.StructField("source_column", T.StringType()),
                T.StructField("model_name", T.StringType()),
                T.StructField("updated_at", T.TimestampType()),
            ]
        )

    # -- reads ---------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        snap = self.snapshot(version)
        return self._rows(snap, snap.live).drop("bucket")

    def read_buckets_of(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The buckets that can hold one of a few keys; the rest of the table is not opened."""
        snap = self.snapshot(version)
        only = [r["b"] for r in keys.select(self.bucket_of(snap).alias("b")).distinct().collect()]
        return self._rows(snap, snap.live, only).drop("bucket")

    def staged(self) -> DataFrame:
        """Rows already written by a migration that has not finished."""
        snap = self.snapshot()
        return self._rows(snap, (snap.staged or {}).get("live", {})).drop("bucket")

    def bucket_of(self, snap: Snapshot, key: list[str] | None = None):
        names = key or self.key_schema(snap).fieldNames()
        return F.pmod(F.xxhash64(*[quoted(c) for c in names]), F.lit(snap.buckets)).cast("int")

    def _rows(
        self, snap: Snapshot, live: dict[str, dict], only: list[int] | None = None, pending: list[dict] | None = None
    ) -> DataFrame:
        """Live rows of some generations, with their bucket."""
        rows = self.generations(snap, live, only)
        return self._without_dead(snap, rows, live, snap.pending if pending is None else pending).drop("gen")

    def generations(self, snap: Snapshot, live: dict[str, dict], only: list[int] | None = None) -> DataFrame:
        """Rows of some generations as they were written, dead ones too, with their bucket and generation."""
        wanted = {
            gen: sorted(set(one["buckets"]) if only is None else set(one["buckets"]) & set(only))
            for gen, one in live.items()
        }
        wanted = {gen: buckets for gen, buckets in wanted.items() if buckets}
        layout = self.schema(snap).add("gen", T.StringType()).add("bucket", T.IntegerType())
        if not wanted:
            return self.spark.createDataFrame([], layout)
        rows = (
            self.spark.read.schema(layout)
            .option("basePath", self.path)
            .parquet(*[f"{self.path}/gen={gen}" for gen in wanted])
        )
        # partition columns only, so Spark prunes folders before it lists files
        return rows.where(self._in_buckets(snap, wanted))

    def alive(self, snap: Snapshot, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (with key, bucket and generation, stored elsewhere) that the table has in this snapshot."""
        live = {gen: one for gen, one in snap.live.items() if one["buckets"]}
        if not live:
            return rows.limit(0)
        rows = rows.where(self._in_buckets(snap, {gen: one["buckets"] for gen, one in live.items()}))
        return self._without_dead(snap, rows, live, snap.pending)

    @staticmethod
    def _in_buckets(snap: Snapshot, wanted: dict[str, list[int]]) -> Column:
        keep = F.lit(False)
        for gen, buckets in wanted.items():
            one = F.col("gen") == gen
            if len(buckets) < snap.buckets:
                one = one & F.col("bucket").isin(buckets)
            keep = keep | one
        return keep

    def _without_dead(self, snap: Snapshot, rows: DataFrame, live: dict[str, dict], pending: list[dict]) -> DataFrame:
        """Rows (with their generation) without those that a later pending set holds the key of."""
        if pending and live and min(one["order"] for one in live.values()) < max(p["order"] for p in pending):
            key = self.key_schema(snap).fieldNames()
            orders = F.create_map(*[F.lit(x) for gen, one in live.items() for x in (gen, one["order"])])
            same = orders[F.col("gen")] < F.col("_order")
            for i, name in enumerate(key):
                same = same & (quoted(name) == F.col(f"_{i}"))

            def named(dead: DataFrame) -> DataFrame:
                return dead.select(*[quoted(c).alias(f"_{i}") for i, c in enumerate(key)], "_order")

            if _fits(pending):
                for group in _broadcasts(pending):
                    rows = rows.join(F.broadcast(named(self._dead(snap, group))), same, "left_anti")
            else:
                rows = rows.join(named(self._dead(snap, [(p, 0, 1) for p in pending])), same, "left_anti")
        return rows

    def _dead(self, snap: Snapshot, pending: list[tuple[dict, int, int]]) -> DataFrame:
        """Keys of the pending sets, or of one part of them, each with the order up to which it kills rows."""
        layout = T.StructType([T.StructField(f.name, f.dataType) for f in self.key_schema(snap).fields]).add("_order", T.IntegerType())
        merged = None
        for entry, part, parts in pending:
            one = self.spark.read.schema(layout).parquet(f"{self.path}/_keys/{entry['name']}")
            if parts > 1:
                hashed = F.xxhash64(*[quoted(f.name) for f in self.key_schema(snap).fields])
                one = one.where(F.pmod(hashed, F.lit(parts)) == part)
            one = one.withColumn("_order", F.coalesce("_order", F.lit(entry["order"])))
            merged = one if merged is None else merged.unionByName(one)
        return merged

    # -- writes --------------------------------------------------------------

    def append(self, rows: DataFrame, *, staged: bool = False, model: str | None = None) -> int:
        """Add rows whose keys are not in the table; nothing is rewritten. Returns the source rows added.

        Changes merged meanwhile are newer than these rows and win. Another append is a conflict,
        since both may have added the same rows. Vectors of another ``model`` than the table's are refused.
        """
        start = self.snapshot()
        self._check_model(start.staged["model"] if staged else start.model, model)
        gen, touched = self._write(start, rows, staged)
        if not touched:
            return 0
        one = {gen: {"order": start.version, "buckets": touched}}

        def change(snap: Snapshot) -> dict:
            self._refuse_after_bulk(start, snap)
            if staged:
                track = dict(snap.staged, live={**snap.staged["live"], **one})
                return {"staged": track, "appended": snap.version + 1}
            return {"live": {**snap.live, **one}, "appended": snap.version + 1}

        self._commit(change)
        return self._source_rows(start, one)

    def merge(
        self,
        upserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        *,
        stream: str | None = None,
        batch_id: int | None = None,
        model: str | None = None,
        sequence: str | None = None,
    ) -> Snapshot:
        """Replace every row that shares a key with ``upserts``, drop the keys in ``deletes``.

        In a chunked table a key has many rows, so this also replaces all chunks of a row. A key (or
        chunk) that comes several times is stored once: the row with the largest ``sequence`` if that
        column is named, else the one whose vector sorts last. With ``stream`` and ``batch_id`` a batch
        that is already in the table is left out. Vectors of another ``model`` than the table's are refused.
        """
        start = self.snapshot()
        self._check_model(start.model, model)
        if stream is not None and start.batches.get(stream, -1) >= batch_id:
            return start
        key = self.key_schema(start).fieldNames()
        gen, touched, gone = None, [], []
        if upserts is not None:
            single = [*key, "chunk_index"] if start.chunked else key
            if sequence is not None:
                upserts = _last_of_each(upserts, single, [sequence])
            gen, touched = self._write(start, upserts)
            written = self._rows(start, {gen: {"order": 0, "buckets": touched}}, pending=[])
            # seen from what was written, so that no text is embedded twice; only keys are shuffled
            if not written.groupBy(*[quoted(c) for c in single]).count().where("count > 1").isEmpty():
                gen, touched = self._write(start, _last_of_each(written.drop("bucket"), single, ["embedding"]), stamped=True)
                written = self._rows(start, {gen: {"order": 0, "buckets": touched}}, pending=[])
            gone.append(written.select(*[quoted(c) for c in key]))
        if deletes is not None:
            gone.append(deletes.select(*[quoted(c) for c in key]))
        entry = {"gen": gen if touched else None}
        if gone:
            keys = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            entry |= self._write_keys(start, keys.distinct().withColumn("_order", F.lit(None).cast("int")))
        if not touched and not entry.get("keys"):
            # nothing to change: no snapshot, so whatever was built for this one stays current
            return start

        def change(snap: Snapshot) -> dict | None:
            if stream is not None and snap.batches.get(stream, -1) >= batch_id:
                return None
            if snap.dims != start.dims or snap.model != start.model:
                raise CommitConflictError(f"{self.path} was migrated to {snap.model} meanwhile")
            order = snap.version + 1
            live = {**snap.live, gen: {"order": order, "buckets": touched}} if touched else snap.live
            pending = [*snap.pending, {**entry, "order": order}] if entry.get("keys") else snap.pending
            batches = snap.batches if stream is None else {**snap.batches, stream: batch_id}
            return {"live": live, "pending": pending, "batches": batches}

        self._commit(change)
        snap = self.snapshot()
        if not _fits(snap.pending) and snap.staged is None:
            self.compact()
        elif len(snap.pending) > FOLD_AFTER:
            self.fold()
        return self.snapshot()

    def fold(self) -> None:
        """Join the small folders of many merges into one. Costs as much as the merges, not the table."""
        start = self.snapshot()
        if len(start.pending) < 2:
            return
        small = {p["gen"]: start.live[p["gen"]] for p in start.pending if p["gen"] in start.live}
        gen, touched = self._write(start, self._rows(start, small).drop("bucket"), stamped=True)
        key = self.key_schema(start).fieldNames()
        keys = self._dead(start, [(p, 0, 1) for p in start.pending]).groupBy(*key).agg(F.max("_order").alias("_order"))
        order = max(p["order"] for p in start.pending)
        entry = {"gen": gen if touched else None, "order": order, **self._write_keys(start, keys)}
        names = {p["name"] for p in start.pending}

        def change(snap: Snapshot) -> dict | None:
            if not names <= {p["name"] for p in snap.pending} or not set(small) <= set(snap.live):
                return None
            live = {g: one for g, one in snap.live.items() if g not in small}
            if touched:
                live[gen] = {"order": order, "buckets": touched}
            return {"live": live, "pending": [entry, *[p for p in snap.pending if p["name"] not in names]]}

        self._commit(change)

    def compact(self) -> None:
        """Rewrite the buckets that hold pending keys, so that readers need not look for dead rows."""
        start = self.snapshot()
        if not start.pending or start.staged is not None:
            return
        dead = self._dead(start, [(p, 0, 1) for p in start.pending])
        # at most one row per bucket
        hit = {r["b"] for r in dead.select(self.bucket_of(start).alias("b")).distinct().collect()}
        gen, kept = self._write(start, self._rows(start, start.live, sorted(hit)).drop("bucket"), stamped=True)
        names = {p["name"] for p in start.pending}

        def change(snap: Snapshot) -> dict | None:
            if snap.staged is not None or not names <= {p["name"] for p in snap.pending}:
                return None
            if snap.appended > start.version or not set(start.live) <= set(snap.live):
                return None
            live = {
                g: dict(one, buckets=[b for b in one["buckets"] if b not in hit]) if g in start.live else one
                for g, one in snap.live.items()
            }
            live[gen] = {"order": start.version, "buckets": kept}
            live = {g: one for g, one in live.items() if one["buckets"]}
            left = [p if p["gen"] in live else dict(p, gen=None) for p in snap.pending if p["name"] not in names]
            return {"live": live, "pending": left, "cleared": snap.version + 1}

        self._commit(change)

    def begin_migration(self, model: str, model_name: str, dims: int) -> Snapshot:
        """Open a second set of rows, for another model or for fresh vectors of the same one.

        One that is already open goes on.
        """

        def change(snap: Snapshot) -> dict | None:
            if snap.staged is not None:
                if (snap.staged["model"], snap.staged["dims"]) != (model, dims):
                    raise NearfieldError(f"a migration to {snap.staged['model']} is already under way")
                return None
            return {"staged": {"model": model, "model_name": model_name, "dims": dims, "live": {}}}

        return self._commit(change)

    def finish_migration(self, seen: Snapshot | None = None) -> Snapshot:
        """Make the migrated rows the live ones.

        With ``seen``, only if nothing was written since that snapshot: a row changed meanwhile has
        to be migrated again first.
        """
        def change(snap: Snapshot) -> dict:
            if snap.staged is None:
                raise NearfieldError("no migration is under way")
            if seen is not None and snap.version != seen.version:
                raise CommitConflictError(f"{self.path} changed during its migration")
            new = snap.staged
            left = [dict(p, gen=None) for p in snap.pending]
            return {
                "model": new["model"], "model_name": new["model_name"], "dims": new["dims"], "live": new["live"],
                "pending": left, "staged": None, "appended": snap.version + 1,
            }

        return self._commit(change)

    @staticmethod
    def _refuse_after_bulk(start: Snapshot, snap: Snapshot) -> None:
        if snap.appended > start.version:
            raise CommitConflictError("another writer added rows meanwhile; run again")
        if snap.cleared > start.version:
            raise CommitConflictError("the table was compacted meanwhile; run again")

    def _commit(self, change: Callable[[Snapshot], dict | None]) -> Snapshot:
        """Publish a change of the newest snapshot; if another writer is first, apply it to theirs."""
        while True:
            snap = self.snapshot()
            changed = change(snap)
            if changed is None:
                return snap
            try:
                after = self._publish(self._after(snap, **changed))
            except CommitConflictError:
                if self.snapshot().version == snap.version:
                    raise
                continue
            if not after.live.keys() <= snap.live.keys():
                self.lists().follow()
            return after

    def _check_model(self, expected: str, given: str | None) -> None:
        if given is not None and given != expected:
            raise NearfieldError(f"{self.path} holds vectors of {expected}, not of {given}")

    def _write_keys(self, snap: Snapshot, keys: DataFrame) -> dict:
        name = self._new_name(snap)
        path = f"{self.path}/_keys/{name}"
        keys.write.parquet(path)
        count, size = key_count(self.spark.read.schema(keys.schema).parquet(path).drop("_order"))
        return {"name": name, "keys": count, "bytes": size}

    def _write(
        self, snap: Snapshot, rows: DataFrame, staged: bool = False, stamped: bool = False
    ) -> tuple[str, list[int]]:
        key = self.key_schema(snap).fieldNames()
        target = snap.staged if staged else asdict(snap)
        if not stamped:
            rows = (
                rows.withColumn("row_id", row_id(key))
                .withColumn("source_column", F.lit(snap.source_column))
                .withColumn("model_name", F.lit(target["model_name"]))
                .withColumn("updated_at", F.current_timestamp())
            )
        rows = rows.withColumn("embedding", V.checked(F.col("embedding"), target["dims"]))
        layout = self.schema(snap)
        gen = self._new_name(snap)
        folder = f"{self.path}/gen={gen}"
        (
            rows.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in layout.fields])
            .withColumn("bucket", self.bucket_of(snap))
            # splits a bucket that is too big for one task and joins small ones
            .hint("rebalance", "bucket")
            # lets a lookup by key skip row groups
            .sortWithinPartitions("bucket", *key)
            .write.partitionBy("bucket").parquet(folder)
        )
        touched = [int(n.removeprefix("bucket=")) for n in files.names(self.spark, folder) if n.startswith("bucket=")]
        return gen, sorted(touched)

    def _source_rows(self, snap: Snapshot, live: dict[str, dict]) -> int:
        """Source rows in one generation, counted from the files written, each once if chunked."""
        written = self._rows(snap, live, pending=[])
        return (written.where(F.coalesce("chunk_index", F.lit(0)) == 0) if snap.chunked else written).count()

    @staticmethod
    def _new_name(snap: Snapshot) -> str:
        """Two writers, or two tries of one writer, never share a folder."""
        return f"{snap.version + 1}-{uuid.uuid4().hex[:8]}"

    @staticmethod
    def _after(snap: Snapshot, **changes) -> Snapshot:
        return replace(snap, version=snap.version + 1, **changes)

    def _versions(self) -> list[int]:
        found = files.names(self.spark, f"{self.path}/_snapshots")
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))

    def _publish(self, snap: Snapshot) -> Snapshot:
        text = json.dumps(asdict(snap), indent=1)
        files.write_text(self.spark, f"{self.path}/_snapshots/{snap.version}.json", text, replace=False)
        return snap
