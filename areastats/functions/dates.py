"""Dates written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the text format of range bounds
DAY_PATTERN = "yyyy-MM-dd HH:mm:ss.SSS z"

_DAY_TEXT = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3} \S+")


def parse_day(text: Column | str) -> Column:
    """The UTC day of a ``yyyy-MM-dd HH:mm:ss.SSS zone`` text, whatever the session time zone.

    A Python string is a literal, checked at once and folded by Catalyst, so a filter on it
    reaches the Parquet scan.
    """
    if isinstance(text, str):
        if not _DAY_TEXT.fullmatch(text):
            raise ValueError(f"not a date of the form {DAY_PATTERN!r}: {text!r}")
        text = F.lit(text)
    instant = F.to_timestamp(text, DAY_PATTERN)
    return F.to_date(F.to_utc_timestamp(instant, F.current_timezone()))
