"""Parsing of list cells that are JSON, Python literals, or neither."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ITEM_FIELDS = "array<struct<id:long,name:string,job:string>>"

_LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}
# escapes that mean something else in a Python literal than in lenient JSON
_PYTHON_ESCAPE = r"\\[xXuUNabfv0-7]"


@F.pandas_udf(T.StringType())
def literal_to_json(cells: pd.Series) -> pd.Series:
    """Re-write the few cells only Python can read as JSON text; anything else becomes null."""

    def one(text):
        if text is None:
            return None
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            if isinstance(value, list) and all(isinstance(v, dict) for v in value):
                return json.dumps(value, default=str)
            return None
        return None

    return cells.map(one)


def parse_items(cell: Column, fields: str = ITEM_FIELDS) -> Column:
    """List of structs, or null where the cell cannot be read at all.

    The JVM parser takes JSON and the usual single-quoted form; only cells it refuses travel to Python.
    """
    looks_like_list = F.trim(cell).startswith("[")
    jvm = F.when(looks_like_list & ~cell.rlike(_PYTHON_ESCAPE), F.from_json(cell, fields, _LENIENT))
    rest = F.when(jvm.isNull() & looks_like_list, cell)
    return F.coalesce(jvm, F.from_json(literal_to_json(rest), fields))


def parse_items_or_empty(cell: Column, fields: str = ITEM_FIELDS) -> Column:
    return F.coalesce(parse_items(cell, fields), F.array().cast(fields))


def is_reject(cell: Column, parsed: Column) -> Column:
    """Cell had content that neither parser could read."""
    return cell.isNotNull() & parsed.isNull()


def names(items: Column) -> Column:
    return F.transform(items, lambda x: x["name"])


def first_names(items: Column, n: int = 5) -> Column:
    return F.transform(F.slice(items, 1, n), lambda x: x["name"])


def names_with_job(items: Column, job: str = "Director") -> Column:
    return F.transform(F.filter(items, lambda x: x["job"] == job), lambda x: x["name"])


def decode_list_cell(cell: Column) -> Column:
    """Text list cell, JSON or single-quoted, back to ``array<string>``; blank or bad cells are empty."""
    return F.coalesce(F.from_json(cell, "array<string>", _LENIENT), F.array().cast("array<string>"))
