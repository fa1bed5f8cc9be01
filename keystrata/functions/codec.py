"""Strict JSON rows and key text, by declared type and without coercion.

A body is parsed once into a variant; each declared column is then taken with
the type its JSON value has, so that 5 is no text and "5" no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.sources.tables import TYPES

NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
#: JSON types that a column type takes (fixed values).
TAKES = {"boolean": "^BOOLEAN$", "integer": "^BIGINT$", "big_integer": "^BIGINT$", "timestamp": "^BIGINT$", "float": NUMBER, "double": NUMBER, "varchar": "^STRING$"}


def parse_key(text: Column, key_type: str) -> Column:
    """The key that a text spells, null where it spells none.  Numbers have no blanks, fraction or overflow; a timestamp is micros."""
    if key_type == "varchar":
        return text
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text)
    if key_type == "timestamp":
        return F.timestamp_micros(whole.try_cast("bigint"))
    return whole.try_cast(TYPES[key_type])


def _path(name: str) -> str:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a column name with both kinds of quotes can't be asked for: {name}")
    return f"$[{quote}{name}{quote}]"


def decode(body: Column, columns: dict[str, str]) -> Column:
    """struct(row, error): the declared columns of a JSON object, or what is wrong with the first that is.

    Unknown fields are ignored.  A body that is no JSON object, or that has a
    field twice, is an error.
    """
    parsed = F.try_parse_json(body)
    cells, errors = [], [F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("body is no JSON object"))]
    for name, kind in columns.items():
        cell = F.try_variant_get(parsed, _path(name), "variant")
        found = F.schema_of_variant(cell)
        value = F.try_variant_get(parsed, _path(name), {"integer": "bigint", "timestamp": "bigint", "float": "double"}.get(kind, TYPES[kind]))
        errors.append(F.when(cell.isNull(), F.lit(f"missing column: {name}")).when(~found.rlike(TAKES[kind]), F.lit(f"column {name}: expected {kind}")))
        if kind == "integer":
            errors.append(F.when(value.try_cast("int").isNull(), F.lit(f"column {name}: value out of range for integer")))
            value = value.try_cast("int")
        elif kind == "timestamp":
            value = F.timestamp_micros(value)
        elif kind == "float":
            value = value.cast("float")
        cells.append(value.alias(name))
    error = F.coalesce(*errors)
    row = F.struct(*cells) if cells else F.struct(F.lit(None).alias("_none"))
    return F.struct(F.when(error.isNull(), row).alias("row"), error.alias("error"))


def scalar(cell: Column, kind: str) -> Column:
    """A cell as its JSON scalar: whole numbers as 64 bits, fractions as doubles, a timestamp as its micros."""
    if kind == "timestamp":
        return F.unix_micros(cell.cast("timestamp"))
    return cell.cast({"integer": "bigint", "float": "double"}.get(kind, TYPES[kind]))


def encode(columns: dict[str, str], key: str | None = None, key_type: str | None = None) -> Column:
    """A row as a JSON object: without its key as a lookup gives it, or with it first as a list does."""
    cells = {key: key_type, **columns} if key else columns
    return F.to_json(F.struct(*[scalar(F.col(f"`{c}`"), kind).alias(c) for c, kind in cells.items()]))
