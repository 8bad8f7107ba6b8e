"""Near duplicates by SimHash, found through a segment-popcount embedding.

The 64 bits of a fingerprint are 32 segments of two bits, and a fingerprint becomes the vector of
its segments' bit counts. The Manhattan distance of two such vectors is at most the number of
differing bits. The grid: the segments are dealt to ``reach + 3`` blocks, and a cell is the counts in
all but ``reach`` of the blocks. Vectors within Manhattan distance ``reach`` agree in at least
that many blocks, so they share a cell; inside a cell the distance of the counts is looked at
first and the bits themselves last.

Equal fingerprints are one node from the start. A cell of more than ``dense`` nodes (one large
family of near copies) is not compared pair by pair: its nodes meet at the values one bit away from
them, of which each node has 64. Two nodes differ in at most two bits exactly if they share such a
value or one is such a value of the other, and at most 65 nodes meet at any value. So the work
stays in proportion to the nodes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import saved, slices, texts_of
from roadpulse.llm.components import components

SEED = 42
REACH = 2
DENSE = 1024
LOW = 0x5555555555555555  # the low bit of each segment


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash over XXH64 of the word shingles, A-Z lower-cased, as an unsigned integer; 0 without words."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # both only touch ASCII
    if not found:
        return 0
    parts = [found[i:] for i in range(words)] if len(found) >= words else [[w] for w in [b" ".join(found)]]
    hashes = map(xxh64_intdigest, map(b" ".join, zip(*parts)), itertools.repeat(SEED))
    ones, count = np.zeros(64, np.int64), 0
    while len(block := np.fromiter(itertools.islice(hashes, 65536), np.uint64)):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(block)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc: str = "doc_id", words: int = 3) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed 64-bit integer. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bits": pa.array(made)})

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc].dataType.simpleString()}, bits long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cells(reach: int = REACH) -> list[int]:
    """Masks over the segments, one for each choice of blocks that must agree."""
    blocks = [sum(3 << 2 * s for s in range(32) if s % (reach + 3) == b) for b in range(reach + 3)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, 3)]


def manhattan(counts: np.ndarray) -> np.ndarray:
    """Sum over the segments of |a - b|, from a ^ b of two packed vectors of counts 0 to 2."""
    low = np.uint64(LOW)
    odd = counts & low  # 0 against 1, or 1 against 2
    return np.bitwise_count(odd) + 2 * np.bitwise_count((counts >> np.uint64(1)) & low & ~odd)


def embed(bits: np.ndarray) -> np.ndarray:
    """Counts of the 32 segments, two bits each."""
    low = np.uint64(LOW)
    return (bits & low) + ((bits >> np.uint64(1)) & low)


def _linked(bits: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a cell: (node, smallest node of its part)."""
    if len(bits) == 2:
        near = manhattan(embed(bits[:1]) ^ embed(bits[1:]))[0] <= reach and int(bits[0] ^ bits[1]).bit_count() <= reach
        return [(1, 0)] if near else []
    counts = embed(bits)
    head = np.arange(len(bits))
    for i in range(len(bits) - 1):
        near = np.flatnonzero(manhattan(counts[i + 1:] ^ counts[i]) <= reach) + i + 1
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= reach]
        if len(near):
            joined = np.unique(head[np.r_[i, near]])
            head[np.isin(head, joined)] = joined[0]
    return [(i, h) for i, h in enumerate(head.tolist()) if i != h]


def links(nodes: DataFrame, reach: int = REACH, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) that connect all nodes (column ``bits``, distinct) within ``reach`` differing bits, a > b.

    Not every pair is returned: a pair may be connected through others.
    """
    spark = nodes.sparkSession
    masks = cells(reach)
    # Segment counts by bit operations: a pair of bits counts 2 if both are set, else 1 if one is.
    low, half = F.lit(LOW), F.shiftrightunsigned("bits", 1)
    packed = F.shiftleft(F.col("bits").bitwiseAND(half).bitwiseAND(low), 1).bitwiseOR(
        F.col("bits").bitwiseXOR(half).bitwiseAND(low))
    keyed = nodes.select("bits", packed.alias("counts")).select(
        "bits", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("grid", "cell"))
    shared = saved(keyed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    rows = keyed.join(shared, ["grid", "cell"])
    pairwise = rows.where(F.col("n") <= dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, bits in _runs(batches):
            bits = np.sort(bits)
            forest = _linked(bits, reach)
            if forest:
                signed = bits.view(np.int64)
                yield pa.record_batch({
                    "a": pa.array(signed[[i for i, _ in forest]]), "b": pa.array(signed[[h for _, h in forest]])})

    near = pairwise.select("grid", "cell", "bits").repartition("grid", "cell").sortWithinPartitions(
        "grid", "cell").mapInArrow(run, "a long, b long")

    # Dense cells: nodes meet at the values one bit away; a value belongs to its own meeting too.
    if reach != 2:
        raise ValueError("the exact way for dense cells is made for two bits")
    ways = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    crowd = rows.where(F.col("n") > dense).select("bits").distinct()
    at = crowd.select("bits", F.explode(F.transform(ways, lambda w: F.col("bits").bitwiseXOR(w))).alias("value"))
    met = at.groupBy("value").agg(F.collect_list("bits").alias("all"), F.min("bits").alias("b")).where(F.size("all") > 1)
    meeting = met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return near.union(meeting).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Runs of equal (grid, cell) in sorted batches; a run may go on in the next batch."""
    key, held = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        grid = batch.column("grid").to_numpy()
        cell = batch.column("cell").to_numpy()
        bits = batch.column("bits").to_numpy().view(np.uint64)
        ends = np.r_[np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])) + 1, len(bits)]
        start = 0
        for end in ends.tolist():
            this = (int(grid[start]), int(cell[start]))
            if this != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = this, []
            held.append(bits[start:end])
            start = end
    if held:
        yield key, np.concatenate(held)


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", words: int = 3,
                    reach: int = REACH, dense: int = DENSE) -> DataFrame:
    """doc_id, bits, component_id for each row of ``docs``.

    Documents whose fingerprints differ in at most ``reach`` bits are linked, and ``component_id`` is
    the smallest doc_id reachable over links. Null and empty texts, and texts of white space, have
    fingerprint 0 and are linked like any other. A null doc_id keeps its row and is never a
    component's id, unless all its members have none. Repeated rows come out as often as they come
    in. Other columns don't matter.
    """
    marks = saved(fingerprints(docs, text, doc, words), "simhash-marks")
    nodes = saved(marks.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    groups = components(links(nodes.select("bits"), reach, dense))
    placed = nodes.join(groups, nodes.bits == groups.node, "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "root").select("bits", "component_id")
    return marks.join(classes, "bits").select("doc_id", "bits", "component_id")


def hexed(bits: str = "bits"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
