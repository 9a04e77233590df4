"""Access to JSON documents by pointer, with the defaults of the query API."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(pointer: str) -> str:
    """A JSON pointer as a path: ``/a/1`` becomes ``$.a[1]``."""
    out = ["$"]
    for part in pointer.split("/")[1:] if pointer else []:
        part = part.replace("~1", "/").replace("~0", "~")
        out.append(f"[{part}]" if part.isdigit() else f".{part}" if re.fullmatch(r"[A-Za-z_]\w*", part) else f"['{part}']")
    return "".join(out)


def parsed(text: Column) -> Column:
    """The document; ``{}`` where it can't be read."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def _toml_as_json(text: str | None) -> str:
    try:
        return json.dumps(tomllib.loads(text or ""), default=str)
    except (tomllib.TOMLDecodeError, RecursionError):
        return "{}"


def json_of_toml(text: Column) -> Column:
    """A TOML document as JSON text, times as text; ``{}`` where it can't be read. Files are read in Arrow batches."""
    read = F.pandas_udf(lambda texts: texts.map(_toml_as_json), "string")
    return read(F.coalesce(text, F.lit("")))


def _at(document: Column, pointer: str, kind: str) -> Column:
    return F.try_variant_get(document, json_path(pointer), kind)


def string(document: Column, pointer: str = "", default: str = "") -> Column:
    is_text = F.schema_of_variant(F.coalesce(_at(document, pointer, "variant"), F.parse_json(F.lit("null")))) == "STRING"
    return F.when(is_text, _at(document, pointer, "string")).otherwise(F.lit(default))


def integer(document: Column, pointer: str = "", default: int = 0) -> Column:
    """A number that fits 32 bits."""
    kind = F.schema_of_variant(F.coalesce(_at(document, pointer, "variant"), F.parse_json(F.lit("null"))))
    return F.when(kind == "BIGINT", F.coalesce(_at(document, pointer, "int"), F.lit(default))).otherwise(F.lit(default))


def boolean(document: Column, pointer: str = "", default: bool = False) -> Column:
    kind = F.schema_of_variant(F.coalesce(_at(document, pointer, "variant"), F.parse_json(F.lit("null"))))
    return F.when(kind == "BOOLEAN", _at(document, pointer, "boolean")).otherwise(F.lit(default))


def value(document: Column, pointer: str = "") -> Column:
    """The part at a pointer, ``{}`` if it's missing."""
    return F.coalesce(_at(document, pointer, "variant"), F.parse_json(F.lit("{}")))


def items(document: Column, pointer: str = "") -> Column:
    return F.coalesce(_at(document, pointer, "array<variant>"), F.array().cast("array<variant>"))
