"""Column-level helpers (scalar functions C2-C12) built on Spark SQL expressions."""

from .exprs import (  # noqa: F401
    contains_any, cosine_similarity, dot, micros_of_day_text, pad_codes, py_slice,
    to_yyyymmdd,
)
