"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.session import discard, shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``, root being the smallest node of its component.

    Alternating stars: every node hands its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest. The number of rounds grows with the logarithm of the nodes. Each
    round is written to the shared folder; minima are combined before the shuffle, and a node of many
    edges is a large key of a join that Spark can split.
    """
    spark = edges.sparkSession
    paths = []

    def kept(df: DataFrame) -> DataFrame:
        """Written, with the round before the last one gone."""
        paths.append(shared_dir(spark, "components"))
        df.write.parquet(paths[-1])
        if len(paths) > 2:
            discard(spark, paths.pop(0))
        return spark.read.schema(df.schema).parquet(paths[-1])

    now = kept(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")),
                              F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = kept(small.select("e.*").where("hi <> lo").distinct())
        before, seen = seen, _mark(now)
        if before == seen:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums over them; equal if nothing moved."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 40)), F.lit(0)),
                           F.coalesce(F.bit_xor(h), F.lit(0))).first())
