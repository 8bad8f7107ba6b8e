"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of the full length as it holds and then into one
piece for each bit of what is left, longest first. Every piece is a sequence of its own: no sequence
crosses documents and none needs padding, as each length is a power of two. Batches are then made
of pieces of one bucket, that is, of equal length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import slices, texts_of
from roadpulse.llm.vocab import LONG, SAFE, Coder, load, tokenizer

FULL = 2048
KEEP = 150_000  # chunks a task remembers
END = 1  # the id put after each document
# The pattern that splits text before the merges: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _ranked(path: str):
    """The same vocabulary in a second library, which is faster on plain text, and the bytes of each token.

    None if ids are not in the order of the merges, on which that library rests.
    """
    import tiktoken

    model = load(path)
    made = [m for _, _, m in model["merges"]]
    if made != sorted(made) or (made and max(model["byte_ids"]) > made[0]):
        return None, None
    ranks = {model["tokens"][i]: i for i in [*model["byte_ids"], *made]}
    size = np.array([len(t) for t in model["tokens"]])
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


@functools.cache
def coder(path: str) -> Coder:
    """Ids of the tokenizer library, each chunk of text worked out once.

    Chunks after a blank that end in no white space, of characters on which both libraries agree,
    are joined for the faster one: no token runs over their borders.
    """
    made = tokenizer(path)
    fast, size = _ranked(path)

    def encode(chunks):
        ids = [b""] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if fast and len(c) <= LONG and c[0] == " " and not c[-1].isspace()
                 and not c[1:2].isspace() and SAFE(c)]
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            found = np.array(fast.encode_ordinary("".join([chunks[i] for i in part])), "<u4")
            ends = np.cumsum([len(chunks[i].encode()) for i in part])
            cuts = (4 * (np.searchsorted(np.cumsum(size[found]), ends) + 1)).tolist()
            packed = found.tobytes()
            for i, start, end in zip(part, [0, *cuts], cuts):
                ids[i] = packed[start:end]
        rest = sorted(set(range(len(chunks))).difference(plain))
        for i, e in zip(rest, made.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, "<u4").tobytes()
        return ids

    return Coder(path, encode, KEEP)


def pieces(tokens: int, full: int = FULL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens."""
    cuts = [(start, full) for start in range(0, tokens - full + 1, full)]
    start, rest = tokens - tokens % full, tokens % full
    while rest:
        length = 1 << (rest.bit_length() - 1)
        cuts.append((start, length))
        start, rest = start + length, rest - length
    return cuts


def pack(docs: DataFrame, path: str, text: str = "text", doc: str = "doc_id", full: int = FULL,
         end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. ``length`` is the bucket, a power of two up
    to ``full``, itself a power of two. A null or empty text gives one piece, the end id alone.
    A null doc_id stays null. Each row of ``docs`` is cut by itself, so a repeated row gives its
    pieces again under other sequence ids; other columns don't matter. Ids of sequences number the
    rows of a partition of the input, in its order, so a task that is run again gives the same.
    """
    if full & (full - 1):
        raise ValueError("full must be a power of two")
    ending = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path)
        for batch in slices(batches):
            ids = [i + ending for i in made.ids(texts_of(batch))]
            cuts = [(row, start, length) for row, i in enumerate(ids) for start, length in pieces(len(i) // 4, full)]
            rows = pa.array([c[0] for c in cuts], pa.int32())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(rows),
                "start": pa.array([c[1] for c in cuts], pa.int64()),
                "length": pa.array([c[2] for c in cuts], pa.int64()),
                "ids": pa.array([ids[r][4 * s:4 * (s + n)] for r, s, n in cuts], pa.binary()),
                "doc_tokens": pa.array([len(ids[c[0]]) // 4 for c in cuts], pa.int64()),
            })
        made.forget()

    cut = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return cut.select("*", F.monotonically_increasing_id().alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length, from which batches of equal length are read."""
    packed.write.partitionBy("length").parquet(path)
