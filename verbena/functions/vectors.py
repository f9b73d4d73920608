"""Vector metrics and late-interaction scores as Catalyst expressions.

Vectors are ``array<float>`` or ``array<double>`` columns; sums run in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN if either vector is zero, as the host engine of the contract gives."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": (cosine, False), "cosine_distance": (cosine_distance, True), "l2": (l2, True), "inner_product": (dot, False)}


def unit(a: Column) -> Column:
    """``a`` scaled to length one; a zero vector is an error."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.raise_error(F.lit("embedding rows must have a non-zero norm"))).otherwise(x.cast("double") / n))


def unit_dot(a: Column, n: Column, query: list[float]) -> Column:
    """Dot product of ``a`` scaled to length one, ``n`` being its norm, with ``query``; a zero vector is an error."""
    return F.when(n == 0, F.raise_error(F.lit("embedding rows must have a non-zero norm"))).otherwise(dot(a, F.array(*map(F.lit, query))) / n)


def finite(a: Column) -> Column:
    """True if no element is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def maxsim(query: Column, document: Column) -> Column:
    """Sum over query tokens of the largest dot product with any document token.

    Null for a null or empty side; NaN products are passed over (a token with nothing else counts as
    minus infinity).  Null tokens, null elements and unequal widths are errors.
    """
    width = F.size(F.element_at(query, 1))

    def checked(m: Column) -> Column:
        # forall() is null, not false, where a null token or element stays unknown
        fine = F.forall(m, lambda t: F.coalesce((F.size(t) == width) & F.forall(t, lambda x: x.isNotNull()), F.lit(False)))
        return F.when(fine, m).otherwise(F.raise_error(F.lit("token matrices must be rectangular and free of nulls")).cast("array<array<float>>"))

    q, d = checked(query.cast("array<array<float>>")), checked(document.cast("array<array<float>>"))
    best = F.transform(q, lambda x: F.coalesce(F.array_max(F.filter(F.transform(d, lambda y: dot(x, y)), lambda s: ~F.isnan(s))), F.lit(float("-inf"))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    present = query.isNotNull() & document.isNotNull() & (F.size(query) > 0) & (F.size(document) > 0)
    return F.when(present & (F.coalesce(width, F.lit(0)) > 0), total)
