"""Scalar expression builders. All return ``Column`` objects that stay inside
whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_slice(c, start: int | None, stop: int | None) -> Column:
    """Python ``s[start:stop]`` on characters, for any signs of the bounds.

    Python clamps out-of-range bounds instead of failing; the arithmetic here
    does the same, so ``s[-7:-1]`` of a 3-character string is its first two
    characters and an empty slice is ``''``.
    """
    s = _col(c)
    n = F.length(s)

    def norm(b, default):
        if b is None:
            return default
        if b < 0:
            return F.greatest(n + F.lit(b), F.lit(0))
        return F.least(F.lit(b), n)

    lo = norm(start, F.lit(0))
    hi = norm(stop, n)
    ln = F.greatest(hi - lo, F.lit(0))
    return s.substr(lo + 1, ln)


def micros_of_day_text(ts) -> Column:
    """Fixed-width ``HH:mm:ss.SSSSSS`` text of a timestamp; compares like the time of day."""
    return F.date_format(_col(ts), "HH:mm:ss.SSSSSS")


def to_yyyymmdd(d) -> Column:
    """A date or ``yyyy-MM-dd`` text as ``yyyyMMdd`` text."""
    return F.date_format(_col(d), "yyyyMMdd")


def contains_any(c, terms: Iterable[str]) -> Column:
    """True when the string holds any of ``terms`` as a substring.

    An OR chain of ``contains`` stays in codegen and needs no regex escaping.
    A null string gives false, as a skipped row would.
    """
    s = _col(c)
    terms = [t for t in terms if t]
    if not terms:
        return F.lit(False)
    hit = reduce(lambda a, b: a | b, [s.contains(t) for t in terms])
    return F.coalesce(hit, F.lit(False))


def dot(a, b) -> Column:
    """Dot product of two numeric arrays in DOUBLE, summed left to right."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_similarity(a, b) -> Column:
    """Cosine similarity of two vectors (no built-in exists in Spark 4.1).

    A zero vector gives NaN (not an error, not NULL), so a mean over a post's
    words becomes NaN and the post is dropped, as with numpy division.
    """
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(dot(a, b) / norms)


def pad_codes(c, length: int) -> Column:
    """The first ``length`` character codes of a string, zero-padded at the end."""
    # the sequence is defined by the first ``length`` characters (the cut is
    # the operator's output); measuring the cut keeps the cost O(length) per row
    s = F.substring(_col(c), 1, length)
    return F.transform(
        F.sequence(F.lit(1), F.lit(length)),
        lambda i: F.when(i <= F.length(s), F.ascii(s.substr(i, F.lit(1)))).otherwise(F.lit(0)),
    )
