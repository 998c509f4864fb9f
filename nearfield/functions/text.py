"""Column builders for content, row identifiers and display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import NearfieldError

# Python's and SQL's idea of "text-like": what a text profile looks at.
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_columns(df: DataFrame) -> list[str]:
    """Names of the text-like columns, in the order of the schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT_TYPES)]


def has_content(columns: list[str]) -> Column:
    """True where every source column is present; an empty string is present."""
    return reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in columns])


def content(columns: list[str]) -> Column:
    """Text to embed: one column as it is, several as labelled lines; null if any is null."""
    if len(columns) == 1:
        return quoted(columns[0]).cast("string")
    lines = [F.concat(F.lit(f"{c}: "), quoted(c).cast("string")) for c in columns]
    return F.when(has_content(columns), F.concat_ws("\n", *lines))


def row_id(primary_key: list[str]) -> Column:
    """Key columns as one text, for display and lookup; joins use the real columns."""
    return F.concat_ws(",", *[quoted(c).cast("string") for c in primary_key])


def row_id_parts(column: Column, key_types: dict[str, T.DataType]) -> list[Column]:
    """Split a row id back into typed key columns; null where the arity or a cast is wrong."""
    if len(key_types) == 1:
        (name, dtype), = key_types.items()
        return [column.try_cast(dtype).alias(name)]
    parts = F.split(column, ",", -1)
    right_arity = F.size(parts) == len(key_types)
    return [
        F.when(right_arity, F.get(parts, F.lit(i)).try_cast(dtype)).alias(name)
        for i, (name, dtype) in enumerate(key_types.items())
    ]


def key_from_row_id(value: str, key_types: dict[str, T.DataType]) -> list[str]:
    """Driver-side split of one row id argument."""
    parts = [value] if len(key_types) == 1 else value.split(",")
    if len(parts) != len(key_types):
        raise NearfieldError(f"row id {value!r} needs {len(key_types)} key parts, got {len(parts)}")
    return parts


def ellipsis(column: Column, width: int) -> Column:
    """Text cut at ``width`` characters, marked with three dots when something was cut."""
    return F.when(F.length(column) > width, F.concat(F.substring(column, 1, width), F.lit("..."))).otherwise(column)


def display_value(field: T.StructField, width: int) -> Column:
    """A column as short text; arrays, maps, structs and bytes show only their kind."""
    col = quoted(field.name)
    kinds = ((T.ArrayType, "list"), (T.BinaryType, "bytes"), (T.MapType, "map"), (T.StructType, "struct"))
    for kind, label in kinds:
        if isinstance(field.dataType, kind):
            return F.when(col.isNotNull(), F.lit(label)).alias(field.name)
    return ellipsis(col.cast("string"), width).alias(field.name)


def key_after(primary_key: list[str], last: list[object]) -> Column:
    """Rows after ``last`` in key order, written so each term can reach the Parquet reader."""
    if len(primary_key) != len(last):
        raise NearfieldError(f"key needs {len(primary_key)} values, got {len(last)}")
    result = None
    for name, value in reversed(list(zip(primary_key, last))):
        later = quoted(name) > F.lit(value)
        result = later if result is None else later | ((quoted(name) == F.lit(value)) & result)
    return result
