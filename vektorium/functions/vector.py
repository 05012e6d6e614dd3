"""Column functions on vectors, kept inside the JVM. Sums run in double precision and in index order."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DTYPES = {"float32": 4, "float16": 2, "int8": 1}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _doubles(x) -> Column:
    return _col(x).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product; null where the lengths differ."""
    a, b = _doubles(a), _doubles(b)
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, lambda x, y: x * y)))


def l2_squared(a, b) -> Column:
    """Squared Euclidean distance; null where the lengths differ."""
    a, b = _doubles(a), _doubles(b)
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(v) -> Column:
    v = _doubles(v)
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def has_nonfinite(v) -> Column:
    """True if any component is NaN or infinite."""
    return F.exists(_doubles(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def normalize(v) -> Column:
    """Unit length as array<double>; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(_doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def int8_scale(v) -> Column:
    """Largest magnitude / 127 in single precision, 1 for a zero vector."""
    top = F.array_max(F.transform(_col(v), lambda x: F.abs(x.cast("float"))))
    return F.when(top > 0, (top / F.lit(127.0).cast("float")).cast("float")).otherwise(F.lit(1.0).cast("float"))


def int8_codes(v, scale) -> Column:
    """Codes in -127..127, halves rounded to even; the inverse and the product are taken in single precision."""
    inverse = (F.lit(1.0).cast("float") / _col(scale)).cast("float")
    return F.transform(_col(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x.cast("float") * inverse).cast("double")))).cast("tinyint"))


def int8_decode(codes, scale) -> Column:
    return F.transform(_col(codes), lambda c: (c.cast("float") * _col(scale)).cast("float"))


def dot_int8(q, codes, scale) -> Column:
    """The scale is applied once, after the sum."""
    return dot(q, codes) * _col(scale).cast("double")


def score(metric: str, dtype: str, q, base, scale=None) -> Column:
    """The score expression of a metric ('dot' or 'l2') for a column type, chosen when the plan is built."""
    if dtype not in DTYPES:
        raise ValueError(f"dtype is one of {sorted(DTYPES)}")
    if metric == "dot":
        return dot_int8(q, base, scale) if dtype == "int8" else dot(q, base)
    if metric == "l2":
        return l2_squared(q, int8_decode(base, scale) if dtype == "int8" else base)
    raise ValueError("metric is 'dot' or 'l2'")


def payload_bytes(dim, dtype: str):
    """Bytes of one row of this many components: elements, and 4 more for the scale of int8."""
    return dim * DTYPES[dtype] + (4 if dtype == "int8" else 0)


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions vec_dot, vec_l2_squared, vec_norm, vec_normalize and vec_has_nonfinite."""
    zip_ = "aggregate(zip_with(cast(a as array<double>), cast(b as array<double>), (x, y) -> {}), 0D, (s, v) -> s + v)"
    pair = "CREATE OR REPLACE TEMPORARY FUNCTION {}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) THEN {} END"
    square = "aggregate(transform(v, x -> x * x), 0D, (s, x) -> s + x)"
    spark.sql(pair.format("vec_dot", zip_.format("x * y")))
    spark.sql(pair.format("vec_l2_squared", zip_.format("(x - y) * (x - y)")))
    one = "CREATE OR REPLACE TEMPORARY FUNCTION {}(v ARRAY<DOUBLE>) RETURNS {} RETURN {}"
    spark.sql(one.format("vec_norm", "DOUBLE", f"sqrt({square})"))
    spark.sql(one.format("vec_normalize", "ARRAY<DOUBLE>", f"transform(v, x -> CASE WHEN sqrt({square}) > 0 THEN x / sqrt({square}) ELSE x END)"))
    spark.sql(one.format("vec_has_nonfinite", "BOOLEAN", "exists(v, x -> isnan(x) OR abs(x) = double('infinity'))"))
