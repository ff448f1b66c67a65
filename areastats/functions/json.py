"""Fields of JSON documents held in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_json_key(document: Column | str, name: str) -> Column:
    """Whether the document has the field, even with a null value; false for a null document."""
    return F.coalesce(F.array_contains(F.json_object_keys(document), name), F.lit(False))


def json_key(document: Column | str, name: str) -> Column:
    """The field's value as text; null when the field is missing or null."""
    return F.get_json_object(document, f"$['{name}']")
