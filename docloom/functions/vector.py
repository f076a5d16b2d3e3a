"""Vector functions as column expressions; sums are made in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def l2_distance(a: Column, b: Column) -> Column:
    diff = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, diff), F.lit(0.0), lambda s, z: s + z))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v at length 1; an all-zero vector stays as it is (null elements stay null)."""
    # The length goes in as an array: inside a lambda it would be computed for every element.
    scale = F.when(norm(v) > 0, norm(v)).otherwise(1.0)
    return F.zip_with(v, F.array_repeat(scale, F.size(v)), lambda x, n: x.cast("double") / n)


def rounded(x: Column, places: int = 6) -> Column:
    """x as SQL rounds a double: half away from zero, and what is rounded to zero keeps its sign (F.round drops it)."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**places) / 10.0**places


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Each key and vector once. 0.0 equals -0.0, as in distinct(), which however makes all zeros 0.0: here the signs stay,
    and of vectors that differ in them only one is taken, the one with a plus first."""
    # The inverse tells the sign of a zero (-Infinity); comparisons and atan2 do not.
    signs = F.transform(vector, lambda x: F.pow(x, F.lit(-1.0)) < 0)
    rows = df.select(key, vector, signs.alias("_minus")).groupBy(key, vector).agg(F.min("_minus").alias("_minus"))
    return rows.select(key, F.zip_with(vector, "_minus", lambda x, minus: F.when(minus, -F.abs(x)).otherwise(x)).alias(vector))


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(values) -> Column:
    """One query vector as a constant."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def usable(v: Column, dim: int) -> Column:
    """Not null, of the dimension, finite, not all zero."""
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def to_json(v: Column) -> Column:
    """A vector as a JSON list of numbers."""
    return F.to_json(v)


def from_json(text: Column) -> Column:
    """The vector of a JSON list of numbers; null if it is none."""
    return F.from_json(text, "array<float>")
