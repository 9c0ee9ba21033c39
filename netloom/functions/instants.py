"""Microseconds since the epoch, independent of the session time zone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, ts_col: str) -> Column:
    """Epoch microseconds; a zone-less timestamp counts as UTC."""
    ts = F.col(ts_col)
    if dict(df.dtypes)[ts_col] != "timestamp_ntz":
        return F.unix_micros(ts.cast("timestamp"))
    unit = lambda n: F.lit(n).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), ts)  # decimal with microseconds
    return (
        F.unix_date(ts.cast("date")) * unit(86_400_000_000)
        + F.hour(ts) * unit(3_600_000_000)
        + F.minute(ts) * unit(60_000_000)
        + (seconds * 1_000_000).cast("bigint")
    )
