from .collections import Resolution, count_tables, load, load_resolution, resolution_table
from .documents import to_documents

__all__ = [
    "Resolution",
    "count_tables",
    "load",
    "load_resolution",
    "resolution_table",
    "to_documents",
]
