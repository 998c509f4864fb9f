"""Lists for approximate search that stay with their table through every write.

A build is a folder of its own: its quantizer, and for every generation of the table a copy of its vectors by list. It
is published by one pointer once all of it is there, so a build that broke off is never read and a second one does not
meet the first. From then on each write places its own generation and nothing else. A generation that is not placed
yet (a writer broke off, or another one is still at it) is placed while it is read, so results do not depend on it.
Which rows are dead is the table's knowledge: lists are read with the same key sets as the table itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.text import quoted
from nearfield.operators import ann
from nearfield.sources import files

if TYPE_CHECKING:
    from nearfield.sources.embedding_table import EmbeddingTable, Snapshot

# Rows a list must get from a generation on average to have a folder of its own there; else rows are sorted by list.
ROWS_PER_FOLDER = 10_000


@dataclass(frozen=True)
class Build:
    """One published set of lists, for vectors of one model."""

    name: str
    model: str
    dims: int
    lists: int
    coded: bool


class VectorLists:
    def __init__(self, table: EmbeddingTable) -> None:
        self.table, self.spark, self.root = table, table.spark, f"{table.path}/_lists"

    def current(self, snap: Snapshot | None = None) -> Build | None:
        """The published build, if it is for the model that the snapshot names."""
        path = f"{self.root}/current.json"
        if not files.exists(self.spark, path):
            return None
        build = Build(**json.loads(files.read_text(self.spark, path)))
        snap = snap or self.table.snapshot()
        return build if (build.model, build.dims) == (snap.model, snap.dims) else None

    def count(self) -> int:
        """How many lists were last built, for whatever model; 0 without a build."""
        path = f"{self.root}/current.json"
        return json.loads(files.read_text(self.spark, path))["lists"] if files.exists(self.spark, path) else 0

    def build(self, lists: int, *, centroids: Sequence | None = None, code_bytes: int | None = None) -> Build:
        """Fit new lists on the table as it is now, place its rows and publish."""
        snap = self.table.snapshot()
        quantizer = ann.fit(self.table.read(snap.version), lists, centroids=centroids, code_bytes=code_bytes)
        build = Build(uuid.uuid4().hex, snap.model, snap.dims, lists, bool(quantizer.books))
        quantizer.save(self.spark, f"{self.root}/{build.name}/quantizer")
        for gen, one in snap.live.items():
            self._place(build, quantizer, snap, gen, one)
        files.write_text(self.spark, f"{self.root}/current.json", json.dumps(asdict(build)), replace=True)
        # what was written while this build was under way
        self.follow()
        return build

    def follow(self) -> None:
        """Place the live generations that the current build does not hold yet."""
        snap = self.table.snapshot()
        build = self.current(snap)
        if build is None:
            return
        missing = {g: one for g, one in snap.live.items() if g not in self._placed(build)}
        for gen, one in missing.items():
            self._place(build, self.quantizer(build), snap, gen, one)

    def quantizer(self, build: Build) -> ann.Quantizer:
        return _load(self.spark, f"{self.root}/{build.name}/quantizer")

    def probed(self, snap: Snapshot, build: Build, query: Sequence[float], probes: int) -> DataFrame:
        """Live rows of the ``probes`` lists closest to the query: key [, chunk_index], embedding and code."""
        quantizer = self.quantizer(build)
        chosen = F.col("list_id").isin(quantizer.closest(query, probes))
        placed = self._placed(build)
        layout = self._layout(snap).add("list_id", T.IntegerType()).add("gen", T.StringType()).add("try", T.StringType())
        parts = []
        for folders in (True, False):
            paths = [path for gen, (path, own) in placed.items() if gen in snap.live and own == folders]
            if paths:
                # with folders the list is a partition column, so the other lists are not even listed
                reader = self.spark.read.schema(layout).option("basePath", f"{self.root}/{build.name}/rows")
                parts.append(reader.parquet(*paths).where(chosen).drop("try"))
        late = {gen: one for gen, one in snap.live.items() if gen not in placed}
        if late:
            rows = self.table.generations(snap, late)
            parts.append(self._with_place(snap, rows, quantizer, "gen").where(chosen))
        if not parts:
            return self.spark.createDataFrame([], layout).drop("list_id", "gen", "try", "bucket")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self.table.alive(snap, rows).drop("list_id", "gen", "bucket")

    def vacuum(self, keep: set[str]) -> None:
        """Delete all but the current build, and its rows of generations that no kept snapshot has."""
        path = f"{self.root}/current.json"
        if not files.exists(self.spark, path):
            return
        name = json.loads(files.read_text(self.spark, path))["name"]
        for other in files.names(self.spark, self.root):
            if other not in (name, "current.json"):
                files.delete(self.spark, f"{self.root}/{other}")
        for folder in files.names(self.spark, f"{self.root}/{name}/rows"):
            if folder.removeprefix("gen=") not in keep:
                files.delete(self.spark, f"{self.root}/{name}/rows/{folder}")
        for mark in files.names(self.spark, f"{self.root}/{name}/done"):
            if mark.split(".")[0] not in keep:
                files.delete(self.spark, f"{self.root}/{name}/done/{mark}")

    def _layout(self, snap: Snapshot) -> T.StructType:
        key = T.StructType([T.StructField(f.name, f.dataType) for f in self.table.key_schema(snap).fields])
        if snap.chunked:
            key = key.add("chunk_index", T.IntegerType())
        return key.add("bucket", T.IntegerType()).add("embedding", T.ArrayType(T.FloatType())).add("code", T.BinaryType())

    def _with_place(self, snap: Snapshot, rows: DataFrame, quantizer: ann.Quantizer, *more: str) -> DataFrame:
        own = [f.name for f in self._layout(snap).fields if f.name != "code"]
        present = rows.where(F.col("embedding").isNotNull()).withColumn("_place", quantizer.place(F.col("embedding")))
        return present.select(*[quoted(c) for c in own], F.col("_place.code").alias("code"),
                              F.col("_place.list_id").alias("list_id"), *more)

    def _place(self, build: Build, quantizer: ann.Quantizer, snap: Snapshot, gen: str, one: dict) -> None:
        rows = self.table.generations(snap, {gen: one})
        folders = rows.count() >= build.lists * ROWS_PER_FOLDER
        attempt = uuid.uuid4().hex[:8]
        placed = self._with_place(snap, rows, quantizer)
        key = self.table.key_schema(snap).fieldNames()
        # a list that holds a large share of the rows is split; sorted keys let a lookup skip pages
        placed = (placed.hint("rebalance", "list_id") if folders else placed.hint("rebalance")).sortWithinPartitions(
            "list_id", *[quoted(c) for c in key])
        writer = placed.write.partitionBy("list_id") if folders else placed.write
        writer.parquet(f"{self.root}/{build.name}/rows/gen={gen}/try={attempt}")
        # the name says it all, so that one listing tells what is placed
        mark = f"{gen}.{attempt}.{'folders' if folders else 'sorted'}"
        files.write_text(self.spark, f"{self.root}/{build.name}/done/{mark}", "", replace=True)

    def _placed(self, build: Build) -> dict[str, tuple[str, bool]]:
        """Path of every generation that is completely placed, and whether it has a folder per list."""
        found = {}
        for mark in sorted(files.names(self.spark, f"{self.root}/{build.name}/done")):
            if mark.count(".") == 2:  # others are still being written
                gen, attempt, kind = mark.split(".")
                found[gen] = (f"{self.root}/{build.name}/rows/gen={gen}/try={attempt}", kind == "folders")
        return found


@lru_cache(maxsize=16)
def _load(spark: SparkSession, path: str) -> ann.Quantizer:
    """A quantizer is never changed once it is written."""
    return ann.Quantizer.load(spark, path)
