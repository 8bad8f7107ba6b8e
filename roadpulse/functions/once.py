"""Work out costly columns once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Like ``withColumns``, but each column (or SQL text) is evaluated once per row.

    The optimizer copies a column's expression into every filter and projection
    that uses it; for JSON parsing or a regex split that repeats the work and
    can outgrow the size limit of generated code. A one-element ``explode``
    stops the copying and stays inside whole-stage code.
    """
    made = F.struct(*[
        F.expr(f"{c} as {name}") if isinstance(c, str) else c.alias(name) for name, c in columns.items()
    ])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("_once")).select(*kept, "_once.*")
