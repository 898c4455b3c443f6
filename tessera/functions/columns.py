"""Column helpers, built-in expressions only: no Python runs (array lambdas are interpreted by the JVM, the rest is in whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col: str | Column, digits: int = 0) -> Column:
    """K8: banker's rounding (Python ``round``), e.g. 0.5 -> 0, 1.5 -> 2, 2.5 -> 2."""
    return F.bround(_c(col), digits)


def clip(col: str | Column, low: float, high: float) -> Column:
    """Clip to a rating scale."""
    return F.least(F.lit(high), F.greatest(F.lit(low), _c(col)))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    """Euclidean norm of a numeric array."""
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; null when either has norm 0."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def euclidean(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard index of two arrays taken as sets."""
    inter = F.size(F.array_intersect(_c(a), _c(b)))
    union = F.size(F.array_union(F.array_distinct(_c(a)), F.array_distinct(_c(b))))
    return F.when(union > 0, inter / union)


def default_when_missing(*cols: str | Column, default=None, zero_is_missing: bool = True) -> Column:
    """First present value; with ``zero_is_missing`` a 0 counts as absent."""
    parts = [F.nullif(_c(c), F.lit(0)) if zero_is_missing else _c(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def key_hash_bucket(cols: list[str], buckets: int, salt: str = "") -> Column:
    """Deterministic bucket in [0, buckets) from the md5 of the key columns.

    Spelled so the same value comes out of DuckDB:
    ``('0x' || substr(md5(<salt><k1>|<k2>...), 1, 8))::ubigint % buckets``.
    """
    parts: list[Column] = [F.lit(salt)] if salt else []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        # a null key hashes like any other value, so no side of a split loses its row
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("\\N")))
    digest = F.md5(F.concat(*parts))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("bigint")


def lit_array(values) -> Column:
    """A double-array literal parsed once on the JVM (one call, not one per value)."""
    return F.expr("array(" + ", ".join(f"{float(x):.17E}D" for x in values) + ")")
