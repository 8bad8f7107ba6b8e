"""Fingerprints of texts by locally consistent parsing.

A text is parsed bottom up. On each level the symbols are names of 64 bits, at first the code points. A run of one
symbol becomes one symbol, so that neighbours differ. Deterministic coin tossing then turns names into small labels
that still differ from their left neighbours': twice the place of the lowest bit in which the two names differ, plus that bit.
A few rounds leave fewer than six labels, and a symbol whose label is larger than both neighbours' begins a
phrase. A phrase's name is a hash of the names in it, and the phrases are the symbols of the next level, until one is
left. Where a phrase is cut depends only on a few symbols around it, so equal passages have equal phrases in their
interiors wherever they stand.

A fingerprint samples the phrase names of all levels, each with its number among equal ones of the text: ``SLOTS`` slots by
hash, each with 16 bits of the smallest value that fell into it. The share of equal slots among those that either text fills
estimates what part of all phrases of the two texts, repeated ones counted each time, they have in common.

All texts of a batch are parsed together in numpy; marks at text starts keep them apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import slices, texts_of

SLOTS = 128
EMPTY = -1
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread hash of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: labels from names that differ from their left neighbours; a text's first name meets 0."""
    left = np.empty_like(names)
    left[1:], left[:1] = names[:-1], 0
    left[first] = 0
    apart = names ^ left
    # The place of the lowest set bit; equal names, as a text that begins with 0, count as apart in bit 0.
    low = np.bitwise_count(~apart & (apart - apart.dtype.type(1)))
    low[apart == 0] = 0
    bit = (names >> low.astype(names.dtype)).astype(np.uint8) & np.uint8(1)
    return low.astype(np.uint8) * np.uint8(2) + bit


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 after the start of a text: four rounds take 64 bits to 128, 14, 8 and 6 values."""
    out = _tossed(names, first)
    for _ in range(3):
        out = _tossed(out, first)
    return out


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level: (names, places of text starts). ``first`` are the places where texts start."""
    # Runs of one symbol to one symbol.
    change = np.empty(len(names), bool)
    change[1:] = names[1:] != names[:-1]
    change[first] = True
    if not change.all():
        starts = np.flatnonzero(change)
        sizes = np.diff(np.r_[starts, len(names)]).astype(np.uint64)
        first = np.searchsorted(starts, first)
        names = names[starts]
        long = sizes > 1
        names[long] = mixed(names[long] + mixed(sizes[long] * _A))
    label = labels(names, first)
    peak = np.zeros(len(names), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # A text's first symbol begins a phrase, and its last belongs to the one before.
    peak[first[1:] - 1] = False
    peak[first] = True
    starts = np.flatnonzero(peak)
    sizes = np.diff(np.r_[starts, len(names)])
    inside = np.arange(len(names)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(mixed(names ^ (inside.astype(np.uint64) * _A)), starts)
    return mixed(sums + sizes.astype(np.uint64) * _C), np.searchsorted(starts, first)


def phrase_names(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level (text, name) of every phrase of ``texts``; a text that is down to one phrase goes no further.

    An empty text has no phrase.
    """
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(raw, np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    alive = np.flatnonzero(sizes)
    sizes = sizes[alive]
    while len(alive):
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        names, first = _level(names, first)
        sizes = np.diff(np.r_[first, len(names)])
        yield np.repeat(alive, sizes), names
        more = sizes > 1
        names = names[np.repeat(more, sizes)]
        alive, sizes = alive[more], sizes[more]


def _numbered(text: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Names that also tell a phrase's number among those of its text that have the same name."""
    own = mixed(names + mixed(text.astype(np.uint64) * _A))
    order = np.argsort(own)
    change = np.r_[True, own[order[1:]] != own[order[:-1]]]
    starts = np.flatnonzero(change)
    number = np.empty(len(names), np.uint64)
    number[order] = np.arange(len(names)) - np.repeat(starts, np.diff(np.r_[starts, len(names)]))
    return mixed(names + number * _C)


def sketches(texts: list[str], slots: int = SLOTS) -> np.ndarray:
    """A row per text: 16 bits of the smallest value in each slot, EMPTY where none fell."""
    least = np.full(len(texts) * slots, NOTHING, np.uint64)
    for text, names in phrase_names(texts):
        spread = _numbered(text, names)
        at = text * slots + (spread % np.uint64(slots)).astype(np.int64)
        np.minimum.at(least, at, spread)
    out = (least >> np.uint64(16)).astype(np.uint16).astype(np.int32)
    out[least == NOTHING] = EMPTY
    return out.reshape(len(texts), slots)


def spelled(sketch: np.ndarray) -> list[str]:
    """Four hex digits a slot, dots for an empty one; nothing for a text without phrases."""
    out = []
    for row in sketch:
        digits, empty = row.astype(">u2").tobytes().hex(), row == EMPTY
        if empty.all():
            digits = ""
        elif empty.any():
            digits = "".join("...." if e else digits[4 * i:4 * i + 4] for i, e in enumerate(empty.tolist()))
        out.append(digits)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of the slots that either sketch fills the share that is equal; two empty texts are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(axis=1)
    return np.where(n > 0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1), 1.0)



def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every whole text; null counts as empty, whose fingerprint is ''.

    Equal texts have equal fingerprints. Repeated rows and ids stay. Other columns take no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                                   "fingerprint": pa.array(spelled(sketches(texts)), pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_chars long, fingerprint string")


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    part = len(text) // 4
    return text[:len(text) - part] + following[:part]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, edge, doc_id): each row of a part with the one after it; edges only follow."""
    held: tuple | None = None  # the last row so far: part, edge, id, text, sketch
    for batch in slices(batches):
        part, edge, ids = (batch.column(c).to_pylist() for c in ("part", "edge", "doc_id"))
        texts = texts_of(batch)
        sketch = sketches(texts)
        if held is not None:
            part, edge, ids, texts = [held[0], *part], [held[1], *edge], [held[2], *ids], [held[3], *texts]
            sketch = np.concatenate([held[4], sketch])
        at = [i for i in range(len(ids) - 1) if not edge[i] and part[i] == part[i + 1]]
        if at:
            after = [edited(texts[i], texts[i + 1]) for i in at]
            changed, own, following = sketches(after), sketch[at], sketch[[i + 1 for i in at]]
            yield pa.record_batch({
                "doc_id": pa.array([ids[i] for i in at], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in after], pa.string()),
                "fingerprint": pa.array(spelled(own), pa.string()),
                "edited_fingerprint": pa.array(spelled(changed), pa.string()),
                "near_edited": pa.array(likeness(own, changed)), "near_next": pa.array(likeness(own, following))})
        held = part[-1], edge[-1], ids[-1], texts[-1], sketch[-1:]


def range_of(value: str, bounds: list[int]) -> str:
    """SQL for how many of the sorted ``bounds`` are at most ``value``, by looking at about two roots of their number."""
    if not bounds:
        return "0"
    step = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def listed(values: list[int]) -> str:
        return f"array({', '.join(f'{v}L' for v in values)})"

    before = f"size(filter({listed([c[0] for c in chunks])}, b -> b <= {value}))"
    inside = f"get(array({', '.join(map(listed, chunks))}), {before} - 1)"
    return f"greatest(0, ({before} - 1) * {step} + coalesce(size(filter({inside}, b -> b <= {value})), 1))"


def compare_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint held against those of its edited text and of the next document (COMPARED).

    The next document is the one with the next larger doc_id, for the last the first; null ids come first, and rows of one id
    go by their texts. The edited text has the last quarter of its code points replaced by the start of the next text, or
    all of it. Null text counts as empty; two empty texts have likeness 1, an empty and another one 0. A table of one
    row is its own next. An empty table gives no rows. Other columns take no part.

    Documents are dealt over ``parts`` ranges of ids (as many as the session has shuffle partitions, if not given), so texts
    move once. The first document of each range goes to the range before, too. Bounds and first ids, two numbers a range, are
    all that reaches the driver.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).first()[0] if shares else None
    part = range_of("doc_id", sorted(set(found or [])))
    firsts = {r.part: r.first[0] for r in rows.groupBy(F.expr(part).alias("part")).agg(
        F.min(F.struct("doc_id")).alias("first")).collect()}
    if not firsts:
        return spark.createDataFrame([], COMPARED)
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    first_of = F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(used[-1] + 1)])
    before_of = F.array(*[F.lit(before.get(p)).cast("int") for p in range(used[-1] + 1)])

    own = F.struct(F.col("part"), F.lit(False).alias("edge"))
    ahead = F.struct(F.get(before_of, F.col("part")).alias("part"), F.lit(True).alias("edge"))
    is_first = F.get(first_of, F.col("part")).eqNullSafe(F.col("doc_id"))
    sent = rows.withColumn("part", F.expr(part)).select(
        F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"), "doc_id", "text").select(
        "to.part", "to.edge", "doc_id", "text")
    dealt = sent.repartitionById(len(shares) + 1, F.col("part")).sortWithinPartitions("part", "edge", "doc_id", "text")
    return dealt.mapInArrow(_compare, COMPARED)
