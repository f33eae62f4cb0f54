from .encoders import byte_histogram_encoder, encode_bytes, encode_images, encode_text, encode_workloads, letter_count_encoder
from .predicates import approx_eq
from .vectors import (
    cosine_distance,
    cosine_similarity,
    dot,
    l2_norm,
    l2_normalize,
    l2_sq_distance,
    pool_query,
    query_by_id,
)

__all__ = [
    "approx_eq",
    "byte_histogram_encoder",
    "cosine_distance",
    "cosine_similarity",
    "dot",
    "encode_bytes",
    "encode_images",
    "encode_text",
    "encode_workloads",
    "l2_norm",
    "l2_normalize",
    "l2_sq_distance",
    "pool_query",
    "letter_count_encoder",
    "query_by_id",
]
