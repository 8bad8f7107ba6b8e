"""Short hand-written lists as columns and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_map(entries: Mapping[Any, Any]) -> Column:
    """A constant map; a value may be a mapping itself, which becomes a struct."""

    def value(v: Any) -> Column:
        if isinstance(v, Mapping):
            return F.struct(*[F.lit(x).alias(name) for name, x in v.items()])
        return F.lit(v)

    return F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), value(v))])


def literal_table(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A table written out in the plan; ``schema`` is "name type, name type, ..."."""
    fields = [f.split() for f in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
