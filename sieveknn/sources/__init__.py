from .metadata import (
    check_alignment,
    describe,
    nan_to_null,
    read_embeddings,
    read_metadata,
    require_alignment,
    row_count,
    with_global_id,
    write_bucketed,
    write_metadata,
    write_report,
)
from .npy import NpyDataSource, read_npy, write_npy

__all__ = [
    "NpyDataSource",
    "check_alignment",
    "describe",
    "nan_to_null",
    "read_embeddings",
    "read_metadata",
    "read_npy",
    "require_alignment",
    "row_count",
    "with_global_id",
    "write_bucketed",
    "write_metadata",
    "write_npy",
    "write_report",
]
