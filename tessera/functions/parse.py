"""Parsing helpers: Python-literal lists of dicts, JSON fields, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_py_list(col: str | Column, schema: str = "array<struct<id:int,name:string>>") -> Column:
    """K3: parse a Python-literal list of dicts (``[{'id': 16, 'name': 'Animation'}]``).

    The JSON reader accepts single quotes; Python's ``None/True/False`` are
    rewritten to JSON outside of quoted strings first. Text that is not a list
    of dicts gives null (the caller can flag it, see ``flag_malformed``).
    """
    text = _c(col)
    # A bare constant has only whole quoted strings after it; one inside a string has not.
    outside = r"""(?=(?:[^'"]++|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+")*+$)"""
    for constant, json_value in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, r"(?<=[:\[,\s])" + constant + r"(?=\s*[,}\]])" + outside, json_value)
    return F.from_json(text, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def field_lower(arr: str | Column, field: str) -> Column:
    """K4: list of structs -> list of one lower-cased field."""
    return F.transform(_c(arr), lambda s: F.lower(s[field]))


def year_of(date_text: str | Column) -> Column:
    """K5: year of a date string (null when it does not parse)."""
    return F.year(F.try_to_timestamp(_c(date_text)))


def json_field(col: str | Column, path: str = "$.k") -> Column:
    """K3 on JSON text: one field by JSON path."""
    return F.get_json_object(_c(col), path)
