"""Write results as CSV, JSON lines or one JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import NearfieldError
from nearfield.functions.text import quoted

# Rows that one JSON array may hold.
MOST_ROWS = 10_000


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds plain values only, so nested ones are written as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            (F.to_json(quoted(f.name)) if isinstance(f.dataType, nested) else quoted(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; null and empty text both become an empty field."""
    _flat(df).write.option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "escape", '"'
    ).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    row = F.struct(*[quoted(c) for c in df.columns])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def json_array(top: DataFrame, most: int = MOST_ROWS) -> str:
    """A bounded result, such as a top-k, as one JSON array; ``[]`` when empty.

    A result of more than ``most`` rows is refused: it belongs in files.
    """
    rows = json_lines(top).limit(most + 1).collect()
    if len(rows) > most:
        raise NearfieldError(f"more than {most} rows for one JSON array; write JSON lines instead")
    return "[" + ", ".join(r["json"] for r in rows) + "]"
