"""A Merkle manifest of a table: every row a leaf, a tree per source, a tree over the sources.

In a tree every ``FAN`` consecutive nodes become their hash, level by level, until one is left. On each level
the nodes of a run stand in a window ordered by place; lag and lead columns at the fixed offsets
1 to ``FAN - 1``, masked by a node's slot in its run and by the run's length, are its siblings, and the
first node of a run hashes itself and those that follow it into the parent.

``folded`` hashes a leaf up along the siblings of its place: one that differs from the manifest doesn't
lead to the root.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import saved
from roadpulse.llm.places import placed

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Hash of a row: each field as its count of UTF-8 bytes, a colon and its value, or ``-`` if it is null."""
    spelled = []
    for field in fields:
        text = field.cast("string")
        spelled.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*spelled)


def tree_of(by: Column) -> Column:
    """Name of a tree, never null, in the order of its key: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit("-"))


def in_runs(nodes: DataFrame) -> tuple[DataFrame, Window]:
    """Add slot, length and parent (``_up``) of each node's run, -1 for a node that is alone; and the window of a run."""
    up = F.when(F.col("n") > 1, F.expr(f"place div {FAN}")).otherwise(F.lit(-1))
    nodes = nodes.withColumns({"_slot": F.pmod("place", F.lit(FAN)), "_up": up}).withColumn(
        "_length", F.least(F.lit(FAN), F.col("n") - F.col("place") + F.col("_slot")))
    return nodes, Window.partitionBy("tree", "_up").orderBy("place")


def _after(window: Window) -> Column:
    """The siblings after a node: lead columns, nothing past the end of the run."""
    return F.concat(*[F.when(F.col("_slot") + k < F.col("_length"), F.lead("digest", k).over(window)).otherwise("")
                      for k in range(1, FAN)])


def _before(window: Window) -> Column:
    """The siblings before a node: lag columns, nothing before the start of the run."""
    return F.concat(*[F.when(F.col("_slot") >= k, F.lag("digest", k).over(window)).otherwise("")
                      for k in range(FAN - 1, 0, -1)])


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first node of each run hashes the run. Nodes that are alone have no parent."""
    nodes, run = in_runs(nodes.where("n > 1").select("tree", "place", "n", "digest"))
    return nodes.withColumn("_tail", _after(run)).where("_slot = 0").select(
        "tree", F.col("_up").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.col("digest"), F.col("_tail")).alias("digest"))


def levels_above(leaves: DataFrame, purpose: str) -> list[DataFrame]:
    """All levels above ``leaves`` (tree, place, n, digest), each written."""
    above, level = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = saved(parents(level), f"{purpose}-level")
        above.append(level)
        most = -(-most // FAN)
    return above


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """The node of each tree that is alone on its level."""
    alone = [level.where("n = 1").select("tree", "digest") for level in levels]
    return functools.reduce(DataFrame.unionByName, alone)


# The siblings of a node, of its parent, and so on, bottom up.
PATH = "array<struct<left:string,right:string>>"


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with the ``path`` up to the root and the ``top`` of their tree.

    ``tops`` has the path from each tree's top on (tree, top, path). It is worked out from the top down: a run of
    nodes meets the path of its parent, so the nodes that meet are a sixteenth as many from level to level, and
    the meeting is dealt as the window is, by run.
    """
    known = None
    start = tops.select(F.col("tree").alias("_tree"), F.lit(-1).cast("bigint").alias("_parent"), "top", F.col("path").alias("_path"))
    for nodes in reversed(levels):
        upper = start
        if known is not None:
            upper = upper.unionByName(known.select(
                F.col("tree").alias("_tree"), F.col("place").alias("_parent"), "top", F.col("path").alias("_path")))
        nodes, run = in_runs(nodes)
        nodes = nodes.withColumns({"_left": _before(run), "_right": _after(run)})
        met = nodes.join(upper, (nodes["tree"] == upper["_tree"]) & (nodes["_up"] == upper["_parent"]))
        here = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        known = met.withColumn("path", F.when(F.col("n") > 1, F.concat(here, "_path")).otherwise(F.col("_path"))).drop(
            "_slot", "_up", "_length", "_left", "_right", "_tree", "_parent", "_path")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, start, lambda at, step: digest(step["left"], at, step["right"]))


def proof(path: Column) -> Column:
    """Hash of the siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, by: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS,
             carried: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row: ``order``, ``leaf``, ``subroot`` of its tree, ``root`` and ``path``, the siblings on the way there.

    Rows with one value of ``by`` make a tree, null a tree of its own; a row's place in it is its rank by ``order``,
    null first. Rows that tie go by their leaves; those alike in these too are the same row to the manifest. ``carried``
    adds columns worked out from ``rows``, such as the leaf of a changed row. An empty table gives no rows. Columns of
    ``rows`` other than those named take no part, whatever their names.
    """
    kept = {f"_kept_{i}": column for i, column in enumerate((carried or {}).values())}
    leaves = rows.select(tree_of(F.col(by)).alias("tree"), F.col(order).alias("_order"),
                         leaf_of([F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in kept.items()])
    leaves = saved(placed(leaves, "tree", ["_order", "digest"], "merkle-leaves"), "merkle-placed")
    levels = [leaves, *levels_above(leaves, "merkle")]

    subroots = placed(tops_of(levels).withColumn("_all", F.lit("all")), "_all", ["tree"], "merkle-sources")
    subroots = saved(subroots.select(F.col("_all").alias("tree"), "place", "n", "digest", F.col("tree").alias("_of")), "merkle-tops")
    over = [subroots, *levels_above(subroots, "merkle-top")]
    root = tops_of(over).first()
    root = F.lit(root["digest"] if root else None)
    start = tops_of(over).select("tree", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    start = with_paths(over, start).select(F.col("_of").alias("tree"), F.col("digest").alias("top"), "path")

    return with_paths(levels, start).select(
        F.col("_order").alias(order), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path",
        *[F.col(k).alias(name) for k, name in zip(kept, carried or {})])
