"""Quality by weak labels: noisy heuristics, their accuracies by expectation maximisation, a hashed linear scorer.

Eight labellers each call a document good, bad or nothing; most look for one fault and say nothing without it. How often a labeller says what about a good or a bad
document is not known; expectation maximisation estimates it from how they agree, over the
counts of all vote patterns (3 ** 8 at most, whatever the table holds). That gives each pattern a
probability of being good. A linear scorer over hashed features of words learns those
probabilities on a sample of at most ``SAMPLE`` documents of at most ``LONGEST`` characters, and
then scores every document whole, also where the labellers said nothing.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import bounded_sample, ddl, saved, slices, texts_of

GOOD, BAD, NONE = 1, 0, 2
SAMPLE = 4_000
LONGEST = 20_000
DIMENSIONS = 1 << 16
KEEP = 400_000
LABELLERS = ("symbols", "marked_words", "capitals", "shouts", "repeats", "lines", "plain", "ends")
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_MARKED = re.compile(rb"\S*[#*$%&|<>]\S*")


def different(words: list[bytes], lines: list[bytes]) -> tuple[float, float]:
    """Share of different ones among the pairs of words, and among the lines."""
    return len(set(zip(words, words[1:]))) / max(len(words) - 1, 1), len(set(lines)) / max(len(lines), 1)


def votes(text: str) -> list[int]:
    """What each labeller says of a text."""
    data = text.encode()
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [BAD] * len(LABELLERS)

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / size

    def call(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    symbols, capitals = share(_SYMBOLS), share(_CAPITALS)
    marked = len(_MARKED.findall(data)) / n if symbols else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs, distinct_lines = different(words, lines)
    ends = sum(x.rstrip()[-1:] in b".!?:\"')" for x in lines) / len(lines)
    return [
        call(False, symbols > 0.03),
        call(False, marked > 0.15),
        call(False, capitals > 0.25 and n >= 10),
        call(False, data.count(b"!!") > 0.2 * n),
        call(pairs > 0.8, pairs < 0.6 and n >= 20),
        call(False, len(lines) >= 4 and distinct_lines < 0.6),
        call(symbols < 0.002 and capitals < 0.08, False),
        call(ends > 0.7, ends < 0.2 and n >= 10),
    ]


def voted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``votes``, a letter per labeller: 1 good, 0 bad, 2 nothing. Null text counts as empty, which all call bad."""
    kept = docs.drop("votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = ["".join(map(str, votes(t))) for t in texts_of(batch, text)]
            yield batch.append_column("votes", pa.array(made, pa.string()))

    return kept.mapInArrow(run, f"{ddl(kept)}, votes string")


def estimate(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """Probability of good per vote pattern, and P(vote | bad or good) per labeller.

    The start is the majority of votes; counts are smoothed by one, and labellers are taken to err
    independently of each other.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    names = [p for p, _ in patterns]
    said = np.array([[int(c) for c in p] for p in names])
    count = np.array([n for _, n in patterns], float)
    good = ((said == GOOD).sum(1) + 1.0) / ((said != NONE).sum(1) + 2.0)
    seen = np.stack([said == v for v in range(3)], 2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        weight = np.stack([count * (1 - good), count * good])
        chance = np.einsum("cp,plv->lcv", weight, seen) + 1.0
        chance /= chance.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1.0) / (count.sum() + 2.0)
        log = np.log(prior)[:, None] + np.einsum("lcv,plv->cp", np.log(chance), seen)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        moved = np.abs(new - good).max()
        good = new
        if moved < 1e-9:
            break
    return dict(zip(names, good.tolist())), chance


_RUN = re.compile(rb"([A-Z]+)|([a-z]+)|([0-9]+)|([\x80-\xff]+)")


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, its last three bytes, its shape."""
    shape = _RUN.sub(lambda m: b"Aa9x"[m.lastindex - 1:m.lastindex], word)[:12]
    return [zlib.crc32(f) % DIMENSIONS for f in (b"w" + word, b"e" + word[-3:], b"s" + shape)]


def text_features(words: list[bytes], data: bytes) -> list[int]:
    """Hashed features of a whole text: the tenths of different pairs and lines in it."""
    pairs, lines = different(words, [x for x in data.split(b"\n") if x.strip()])
    return [zlib.crc32(b"p%d" % int(10 * pairs)) % DIMENSIONS, zlib.crc32(b"l%d" % int(10 * lines)) % DIMENSIONS]


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a document: those of words as often as they come up per word, those of the text once."""
    words = data.split()
    found, n = np.unique(list(itertools.chain.from_iterable(map(word_features, words))), return_counts=True)
    whole = text_features(words, data)
    return np.append(found, whole).astype(np.int64), np.append(n / max(len(words), 1), [1.0] * len(whole))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 120, rate: float = 0.5,
          decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer for soft labels; adaptive full-batch descent."""
    weights = np.zeros(DIMENSIONS + 1)
    if not rows:
        return weights
    column = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    wanted = np.array([r[2] for r in rows])
    total = np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, weights[column] * value, len(rows)) + weights[-1]
        off = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - wanted) / len(rows)
        step = np.append(np.bincount(column, off[row] * value, DIMENSIONS), off.sum()) + decay * weights
        total += step ** 2
        weights -= rate * step / np.sqrt(total)
    return weights


def learn(rows: DataFrame, good: dict[str, float], text: str = "text", doc: str = "doc_id",
          sample: int = SAMPLE, longest: int = LONGEST) -> np.ndarray:
    """Fit the scorer on a bounded sample of rows with votes; only hashed features reach the driver."""
    some = rows.select(F.col(text).alias("text"), "votes", F.col(doc).alias("doc")).where(
        (F.length("text") > 0) & (F.length("text") <= longest))
    picked = bounded_sample(some, sample, F.xxhash64("doc", F.length("text"))).select("text", "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t.encode()) for t in texts_of(batch)]
            yield pa.record_batch({
                "at": pa.array([m[0].tolist() for m in made], pa.list_(pa.int32())),
                "value": pa.array([m[1].tolist() for m in made], pa.list_(pa.float32())), "votes": batch.column("votes")})

    found = picked.mapInArrow(run, "at array<int>, value array<float>, votes string").toArrow()
    # In a fixed order, so that the same sample gives the same weights.
    data = sorted(zip(found.column("votes").to_pylist(), found.column("at").to_pylist(), found.column("value").to_pylist()))
    return train([(np.array(a, np.int64), np.array(v), good.get(p, 0.5)) for p, a, v in data if a])


def scored(rows: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``score``, the scorer's probability of good; 0 for a text without words. ``text`` is dropped."""
    kept = rows.drop("score", text)
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        memory: dict[bytes, float] = {}
        for batch in slices(batches, text):
            if len(memory) > KEEP:
                memory = {}
            coded = [t.encode() for t in texts_of(batch, text)]
            split = [t.split() for t in coded]
            for w in set(itertools.chain.from_iterable(split)):
                if w not in memory:
                    memory[w] = float(weights[word_features(w)].sum())
            raw = np.array([sum(map(memory.__getitem__, ws)) / len(ws) + weights[text_features(ws, t)].sum() if ws else -np.inf
                            for ws, t in zip(split, coded)])
            score = 1 / (1 + np.exp(-np.clip(raw + weights[-1], -500, 500)))
            score = np.where(np.isneginf(raw), 0.0, score)
            yield pa.record_batch({c: batch.column(c) for c in columns} | {"score": pa.array(score)})

    return rows.drop("score").mapInArrow(run, f"{ddl(kept)}, score double")


def classify(docs: DataFrame, text: str = "text", doc: str = "doc_id", keep: float = 0.5) -> DataFrame:
    """``docs`` without ``text``, with votes, label (what the labellers make of it), score and kept (score of at least ``keep``).

    A null or empty text has score 0. Repeated rows each come out; an empty table gives an empty table.
    """
    rows = voted(docs.drop("label", "score", "kept"), text)
    counts = saved(rows.groupBy("votes").count(), "quality-votes")  # 3 ** labellers rows at most
    good, _ = estimate(sorted((r["votes"], r["count"]) for r in counts.collect()))
    weights = learn(rows, good, text, doc)
    labels = docs.sparkSession.createDataFrame(sorted(good.items()), "_votes string, label double")
    out = scored(rows, weights, text).join(F.broadcast(labels), F.col("votes") == F.col("_votes"), "left").drop("_votes")
    return out.withColumn("kept", F.col("score") >= keep)
