"""Which tables are searchable, and how: a small JSON document read before plans are built."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import RegistryError
from nearfield.functions.chunking import MAX_WORDS, OVERLAP
from nearfield.sources import files
from nearfield.sources.embedding_table import EmbeddingTable

# Fixed value: what a table or column name may look like, and its length.
IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
IDENTIFIER_LENGTH = 128
FORMAT_VERSION = "1"


def check_identifier(name: str) -> str:
    if len(name) > IDENTIFIER_LENGTH or not IDENTIFIER.fullmatch(name):
        raise RegistryError(f"not a valid name: {name!r}")
    return name


@dataclass
class TableEntry:
    """One searchable table. ``source`` is a catalog table name or a Parquet path."""

    table: str
    source: str
    columns: list[str]
    model: str
    model_name: str
    dims: int
    path: str
    schema: str = "public"
    primary_key: list[str] = field(default_factory=lambda: ["id"])
    storage: str = "external"
    chunked: bool = False
    chunk_words: int = MAX_WORDS
    chunk_overlap: int = OVERLAP
    applied_at: str = ""

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.source) if "/" in self.source else spark.table(self.source)

    def embeddings(self, spark: SparkSession) -> EmbeddingTable:
        return EmbeddingTable(spark, self.path)


@dataclass
class Registry:
    """All entries; a table is identified by schema and name together."""

    entries: list[TableEntry] = field(default_factory=list)
    version: str = FORMAT_VERSION

    def get(self, table: str, schema: str | None = None) -> TableEntry | None:
        found = [e for e in self.entries if e.table == table and schema in (None, e.schema)]
        if len(found) > 1:
            raise RegistryError(f"{table} exists in several schemas: {[e.schema for e in found]}")
        return found[0] if found else None

    def require(self, table: str, schema: str | None = None) -> TableEntry:
        entry = self.get(table, schema)
        if entry is None:
            raise RegistryError(f"table {table!r} is not registered")
        return entry

    def put(self, entry: TableEntry) -> None:
        """Add an entry, replacing the one of the same schema and name."""
        self.remove(entry.table, entry.schema)
        self.entries.append(entry)

    def remove(self, table: str, schema: str) -> bool:
        before = len(self.entries)
        self.entries = [e for e in self.entries if (e.table, e.schema) != (table, schema)]
        return len(self.entries) < before

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The configured tables as rows."""
        columns = "table string, schema string, columns array<string>, model string, dims int, storage string, " \
                  "chunked boolean, applied_at string"
        rows = [
            (e.table, e.schema, e.columns, e.model, e.dims, e.storage, e.chunked, e.applied_at)
            for e in self.entries
        ]
        return spark.createDataFrame(rows, columns)

    def save(self, spark: SparkSession, path: str) -> None:
        files.write_text(spark, path, json.dumps(asdict(self), indent=2) + "\n", replace=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry | None:
        """None if there is no file; entries written before a field existed get its default."""
        if not files.exists(spark, path):
            return None
        known = {f.name for f in fields(TableEntry)}
        try:
            data = json.loads(files.read_text(spark, path))
            entries = [TableEntry(**{k: v for k, v in e.items() if k in known}) for e in data.get("entries", [])]
            return cls(entries, data["version"])
        except (json.JSONDecodeError, KeyError, TypeError, AttributeError) as error:
            raise RegistryError(f"cannot read registry {path}: {error}") from error
