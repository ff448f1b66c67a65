from .arrays import array_mean, elem, int_range, slice0
from .dates import parse_day
from .json import has_json_key, json_key

__all__ = [
    "array_mean",
    "elem",
    "has_json_key",
    "int_range",
    "json_key",
    "parse_day",
    "slice0",
]
