"""Vector scalars over array columns, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. What a lambda only mentions is worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Zero when either side has no direction."""
    def of(p: Column, q: Column) -> Column:
        return let(norm(p), lambda np: let(norm(q), lambda nq: F.when((np < 1e-8) | (nq < 1e-8), 0.0).otherwise(dot(p, q) / (np * nq))))

    return let(as_double(a), lambda p: let(as_double(b), lambda q: of(p, q)))


def l2_normalise(v: Column) -> Column:
    return let(as_double(v), lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def composite_quality(v: Column, consistency: Column) -> Column:
    return v * consistency


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors (small arrays only)."""
    def of(rows: Column) -> Column:
        total = F.aggregate(
            F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), as_double(F.get(rows, F.lit(0))),
            lambda acc, v: F.zip_with(acc, as_double(v), lambda x, y: x + y),
        )
        return let(F.size(rows), lambda n: F.transform(total, lambda x: x / n))

    return let(vectors, of)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two descriptors; 1 when both are flat."""
    def centred(v: Column) -> Column:
        return let(as_double(v), lambda w: let(_sum(w) / F.size(w), lambda m: F.transform(w, lambda x: x - m)))

    def of(da: Column, db: Column) -> Column:
        spread = _sum(F.transform(da, lambda x: x * x)) * _sum(F.transform(db, lambda x: x * x))
        top = _sum(F.zip_with(da, db, lambda x, y: x * y))
        return let(spread, lambda s: F.when(F.abs(s) > 2.220446049250313e-16, top / F.sqrt(s)).otherwise(1.0))

    return let(centred(a), lambda da: let(centred(b), lambda db: of(da, db)))


def min_max(v: Column) -> Column:
    """Rescale a descriptor to [0, 1]."""
    def of(w: Column, low: Column, high: Column) -> Column:
        return F.transform(w, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))

    return let(v, lambda w: let(F.array_min(w), lambda low: let(F.array_max(w), lambda high: of(w, low, high))))
