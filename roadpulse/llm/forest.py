"""Nearest neighbours by inner product in a hash-prefix forest.

A vector gets one long string of hash bits per tree: the signs of its products with random
directions. Vectors are first lifted by one coordinate to equal length, so that the order of angles
to a query is the order of inner products. A tree is the array of its hash strings in order, held
as cells of equal first bits, and cells of many vectors as several arrays.

A query goes down all trees at once. How many vectors share its first 0, 1, 2, ... bits is
known from counts of prefixes; it comes up, in all trees together, from the longest prefix to the first
length at which the trees offer ``share`` of the index (and at least ``least`` vectors), and on the last bit tree by
tree, until that much is offered. The vectors that share so long a prefix are a run of each array, found by bisection, and
are scored exactly.

Equal vectors are one entry with their smallest ids, as many as could be in an answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadpulse.llm.common import saved

TREES = 24
BITS = 32
CELL = 4096  # vectors an array should hold
SHARE = 0.95
LEAST = 1000
SEED = 11


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): vectors without null or non-finite components and not all zero."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.withColumn("v", F.expr("transform(v, x -> x + 0D)"))  # -0 as 0, for equal vectors to be equal


def entries(rows: DataFrame, most: int) -> DataFrame:
    """(entry, v, ids): one row per different vector, with its ``most`` smallest ids; entry is the first of them."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("entry"), "v", "ids")


def directions(size: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, trees * bits))


def _hashed(rows: DataFrame, columns: str, longest: float, width: int, trees: int, bits: int, lift: bool) -> DataFrame:
    """Add ``codes``, the hash strings of all trees as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = directions(width + 1, trees, bits)
        weight = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").to_pylist())
            more = np.sqrt(np.maximum(longest ** 2 - (v ** 2).sum(1), 0)) if lift else np.zeros(len(v))
            signs = np.concatenate([v, more[:, None]], 1) @ planes > 0
            codes = signs.reshape(len(v), trees, bits) @ weight
            yield batch.append_column("codes", pa.array(codes.tolist(), pa.list_(pa.int64())))

    return rows.mapInArrow(run, f"{columns}, codes array<bigint>")


def search(vectors: DataFrame, queries: DataFrame, nearest: int = 20, vector: str = "embedding", key: str = "vec_id",
           trees: int = TREES, share: float = SHARE, least: int = LEAST, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``nearest`` vectors found for each query, ranks from 1, ties to the smaller vec_id.

    ``queries`` are rows like those of ``vectors``; a vector of the query's own id is no answer. Rows of one id are each an entry's id.
    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of each length have a forest of
    their own, which queries of that length ask. Fewer vectors than ``nearest`` give all that are found. Other columns don't matter.
    """
    index = saved(usable(vectors, vector, key), "forest-vectors")
    asked = usable(queries, vector, key)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in asked.select(F.size("v").alias("width")).distinct().orderBy("width").collect():
        same = F.size("v") == row.width
        if index.where(same).head(1):
            found = found.union(_search(index.where(same), asked.where(same), row.width, nearest, trees, share, least, cell))
    return found


def _search(index: DataFrame, asked: DataFrame, width: int, nearest: int, trees: int, share: float, least: int,
            cell: int) -> DataFrame:
    """``search`` over usable vectors of one length."""
    table = saved(entries(index, nearest + 1), "forest-entries")
    n, longest = table.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    # Equal queries are one question.
    ways = saved(asked.join(table.select("entry", "v"), "v", "left").select(
        "vec_id", "v", F.coalesce("entry", -F.col("vec_id") - 1).alias("q")), "forest-queries")
    questions = ways.groupBy("q").agg(F.first("v").alias("v"))
    deepest = min(BITS, max(1, math.ceil(math.log2(max(n, 2)))))
    top = min(deepest, max(0, math.floor(math.log2(max(n / cell, 1)))))
    wanted = max(least, share * n)

    stored = saved(_hashed(table, "entry long, v array<double>, ids array<bigint>", longest, width, trees, BITS, True), "forest-index")
    hashed = saved(_hashed(questions, "q long, v array<double>", longest, width, trees, BITS, False), "forest-asked")

    # Going up in all trees together: how many entries share each length of prefix with a query.
    def prefixes(df: DataFrame, *kept: str) -> DataFrame:
        rows = df.select(*kept, F.posexplode("codes").alias("tree", "code"))
        return rows.select(*kept, "tree", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"), "code").withColumn(
            "prefix", F.expr(f"shiftright(code, {BITS} - depth)")).drop("code")

    counts = saved(prefixes(stored).groupBy("tree", "depth", "prefix").agg(F.count("*").alias("n")), "forest-counts")
    met = prefixes(hashed, "q").join(counts, ["tree", "depth", "prefix"])
    offered = met.groupBy("q", "depth").agg(F.sum("n").alias("n"))
    level = offered.where(F.col("n") >= wanted).groupBy("q").agg(F.max("depth").alias("level"))
    # Up to that level not in all trees: those with the longest matches stay one bit below it once enough is offered. A tree's
    # gain is what one bit less offers more.
    near = met.join(level, "q").where(F.col("depth").between(F.col("level"), F.col("level") + 1)).groupBy("q", "tree", "level").agg(
        F.sum(F.when(F.col("depth") > F.col("level"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("depth") == F.col("level"), F.col("n")).otherwise(0)).alias("at"))
    upward = Window.partitionBy("q").orderBy(F.desc("below"), "tree")
    gained = F.coalesce(F.sum(F.col("at") - F.col("below")).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    climbed = near.withColumn("sofar", gained + F.sum("below").over(Window.partitionBy("q")))
    climbed = climbed.select("q", "tree", F.when((F.col("sofar") >= wanted) & (F.col("level") < deepest), F.col("level") + 1).otherwise(
        F.col("level")).alias("depth"))
    codes = hashed.select("q", "v", F.posexplode("codes").alias("tree", "code"))
    level = codes.join(climbed, ["q", "tree"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))

    # The arrays: a cell of many entries is cut into several.
    parts = counts.where(F.col("depth") == top).select(
        "tree", F.col("prefix").alias("cell"), F.ceil(F.col("n") / (2 * cell)).cast("int").alias("parts"))
    placed = stored.select("entry", "v", "ids", F.posexplode("codes").alias("tree", "code")).withColumn(
        "cell", F.expr(f"shiftright(code, {BITS - top})")).join(parts, ["tree", "cell"]).withColumn(
            "part", F.pmod(F.xxhash64("entry"), "parts").cast("int")).drop("parts")
    # A query whose prefix is shorter than a cell's looks at all cells below it.
    going = level.withColumn(
        "cell", F.explode(F.expr(
            f"if(depth >= {top}, array(shiftright(code, {BITS - top})), sequence(shiftleft(shiftright(code, {BITS} - depth), {top} - depth), "
            f"shiftleft(shiftright(code, {BITS} - depth) + 1, {top} - depth) - 1))"))).join(parts, ["tree", "cell"]).withColumn(
                "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    answer = nearest + 1

    def scan(key, data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asking):
            data = data.sort_values("code", kind="stable")
            code = data.code.to_numpy()
            entry = data.entry.to_numpy()
            v = np.stack(data.v.to_numpy())
            up = BITS - asking.depth.to_numpy()
            prefix = asking.code.to_numpy() >> up
            first = np.searchsorted(code, prefix << up)
            last = np.searchsorted(code, (prefix + 1) << up)
            for q, vector, a, b in zip(asking.q.to_numpy(), asking.v.to_numpy(), first, last):
                if a == b:
                    continue
                score = v[a:b] @ vector
                if b - a > answer:  # ties at the border stay in
                    edge = np.partition(score, len(score) - answer)[len(score) - answer]
                    near = np.flatnonzero(score >= edge)
                    if len(near) > answer:
                        near = near[np.lexsort((entry[a:b][near], -score[near]))[:answer]]
                else:
                    near = np.arange(b - a)
                out.append(pd.DataFrame({"q": q, "entry": entry[a:b][near]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "entry": []}, dtype="int64")

    found = placed.groupBy("tree", "cell", "part").cogroup(going.groupBy("tree", "cell", "part")).applyInPandas(
        scan, "q long, entry long").distinct()
    # Exactly, on the vectors themselves, for the few found; then the ids of equal vectors.
    exact = F.expr("aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x)")
    pairs = found.join(questions.select("q", F.col("v").alias("w")), "q").join(table, "entry").select(
        "q", "ids", exact.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = pairs.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("place", rank).where(
        F.col("place") <= answer).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    lists = ways.select("q", F.col("vec_id").alias("query_id")).join(best, "q").select(
        "query_id", F.expr(f"slice(filter(best, b -> b.vec_id <> query_id), 1, {nearest})").alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
