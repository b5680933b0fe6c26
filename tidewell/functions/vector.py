"""Vector expressions.  Arithmetic is in double whatever the element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Null if either is null; elements beyond the shorter vector count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for null, empty or mismatched vectors and for a vector of zeros."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0)
    d = norm(a) * norm(b)
    return F.when(bad, 0.0).otherwise(F.when(d == 0, 0.0).otherwise(dot(a, b) / d))


def score_of_cosine(cos: Column) -> Column:
    """Search scores are 1 / (1 + cosine distance), so from 1/3 to 1."""
    return 1 / (2 - cos)


def cosine_of_score(score: float) -> float:
    return 2 - 1 / score


def unit(a: Column | str) -> Column:
    """The vector scaled to length 1, as doubles; unchanged if it is all zeros."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
