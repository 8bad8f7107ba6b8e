"""Split a vehicle's rows over time so that one busy vehicle spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(ts: str, width: int) -> Column:
    """Number of the time bucket, rounded down for times before the epoch too."""
    return F.expr(f"({ts} - pmod({ts}, {width}L)) div {width}L")


def with_lookback(df: DataFrame, ts: str, width: int, reach: int) -> DataFrame:
    """Add ``bucket`` and ``owner``: each row once in its own bucket, and the rows of
    the last ``reach`` ms also in the next one, where later rows look back to them.
    """
    if reach > width:
        raise ValueError("the look-back must not be longer than a bucket")
    buckets = f"if(pmod({ts}, {width}L) >= {width - reach}, array(_own, _own + 1), array(_own))"
    return (
        df.withColumn("_own", bucket_of(ts, width))
        .selectExpr("*", f"explode({buckets}) as bucket")
        .selectExpr(*df.columns, "bucket", "bucket = _own as owner")
    )
