"""Numeric column functions: stable softmax, checked sums, guarded ratios and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = 2**64 - 1


def log_softmax2(a: Column, b: Column, temperature: Column | float = 1.0) -> Column:
    """Log-probability of ``a`` against ``b`` at a temperature, without overflow."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    x, y = a / t, b / t
    return x - F.greatest(x, y) - F.log1p(F.exp(F.least(x, y) - F.greatest(x, y)))


def softmax2(a: Column, b: Column, temperature: Column | float = 1.0) -> Column:
    return F.exp(log_softmax2(a, b, temperature))


def checked_sum(c: Column) -> Column:
    """Sum as ``decimal(38,0)``; null where it leaves the unsigned 64-bit range."""
    s = F.sum(c.cast("decimal(38,0)"))
    return F.when((s >= 0) & (s <= F.lit(str(U64)).cast("decimal(38,0)")), s)


def ratio(a: Column, b: Column) -> Column:
    """a/b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a vector without length or of another dimension."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def finite(a: Column) -> Column:
    """Whether every component is a number."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
