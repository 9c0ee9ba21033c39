"""Guards for NULL, NaN and infinity, which Spark keeps apart."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_double(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def missing(c, kind: str) -> Column:
    """True for NULL and, in floating columns, for NaN and infinity."""
    if kind not in ("double", "float"):
        return F.col(c).isNull()
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(INFINITY))


def finite_or_null(c: str) -> Column:
    """Infinity and NaN become NULL."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(INFINITY)), F.col(c))


def valid(c) -> Column:
    """The value as double, NULL where it is NaN."""
    value = as_double(c)
    return F.when(~F.isnan(value), value)


def valid_in(df, name: str) -> Column:
    """``valid`` of a table's column; whole numbers need no NaN test."""
    return valid(name) if dict(df.dtypes)[name] in ("double", "float") else as_double(name)
