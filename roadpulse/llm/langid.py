"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of up to ``order`` bytes counts which byte follows. A text is
words between white space; each word is coded byte by byte with the blank before it as first
context and the blank after it as last symbol, so a context never reaches over a blank. A byte seen
n times in a context of N bytes and D different ones costs -log2(n / (N + D)) bits; a byte not seen
there costs the escape, -log2(D / (N + D)), and is then coded in the next shorter context; below the
empty context every byte costs 8 bits. The counts are frozen before the first text is scored, so a
word costs the same wherever it stands. The language with the shortest code wins.

The trees are fitted on a sample of at most ``SAMPLE`` documents a language, of at most ``LONGEST``
characters each, taken by hash. The model that is sent to the tasks has 8 bytes for each context met and language.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import bounded_sample, ddl, slices

ORDER = 4
SAMPLE = 600
LONGEST = 20_000
KEEP = 200_000  # words a task remembers
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numbers such as superscripts


@dataclass
class Model:
    """Code lengths of all languages side by side.

    ``grams[k]`` are the sorted keys of k context bytes and the byte after them; ``cost[k]`` has the
    bits of that byte per language, escapes included. ``contexts[k]`` and ``escape[k]`` are the same
    for leaving a context of k bytes. A context a language lacks costs it nothing to leave.
    """

    languages: list[str]
    grams: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _packed(grams: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(g, "big") for g in grams], np.int64)


def context_counts(texts: list[str], order: int) -> Counter:
    """How often each context of 0 to ``order`` bytes was followed by each byte."""
    counts: Counter = Counter()
    words = Counter(itertools.chain.from_iterable(t.encode().split() for t in texts))
    for word, n in words.items():
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            for k in range(min(order, i) + 1):
                counts[coded[i - k:i + 1]] += n
    return counts


def fit(languages: list[str], rows: list[tuple[str, bytes, int]], order: int = ORDER) -> Model:
    """Trees from rows (language, context and byte, count)."""
    at = {name: i for i, name in enumerate(languages)}
    width = len(languages)
    by_length: list[dict[bytes, np.ndarray]] = [{} for _ in range(order + 1)]
    for name, gram, n in rows:
        by_length[len(gram) - 1].setdefault(bytes(gram), np.zeros(width))[at[name]] += n
    model = Model(languages, [], [], [], [])
    shorter = {}
    for k in range(order + 1):
        grams = by_length[k]
        total: dict[bytes, np.ndarray] = {}
        kinds: dict[bytes, np.ndarray] = {}
        for gram, n in grams.items():
            context = gram[:-1]
            total[context] = total.get(context, 0) + n
            kinds[context] = kinds.get(context, 0) + (n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = {c: np.where(total[c] > 0, -np.log2(kinds[c] / (total[c] + kinds[c])), 0.0) for c in total}
            cost = {}
            for gram, n in grams.items():
                c = gram[:-1]
                below = shorter[gram[1:]] if k else np.full(width, 8.0)
                cost[gram] = np.where(n > 0, -np.log2(n / (total[c] + kinds[c])), leave[c] + below)
        names = sorted(grams)
        model.grams.append(_packed(names))
        model.cost.append(np.array([cost[g] for g in names], float).reshape(len(names), width))
        held = sorted(leave)
        model.contexts.append(_packed(held))
        model.escape.append(np.array([leave[c] for c in held], float).reshape(len(held), width))
        shorter = cost
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def code_lengths(model: Model, words: list[bytes]) -> np.ndarray:
    """Bits of each word in each language."""
    order, width = len(model.grams) - 1, len(model.languages)
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words]) + 1  # the blank before a word ends the word before it
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    place = np.arange(1, len(data)) - np.repeat(starts, sizes)  # bytes before a symbol within its word
    bits = np.zeros((len(data) - 1, width))
    left = np.arange(len(data) - 1)
    for k in range(order, -1, -1):
        here = left[place[left] >= k]
        symbol = here + 1
        context = np.zeros(len(here), np.int64)
        for back in range(k, 0, -1):
            context = context << 8 | data[symbol - back]
        row = _find(model.grams[k], context << 8 | data[symbol])
        met = row >= 0
        bits[here[met]] += model.cost[k][row[met]]
        rest, known = here[~met], _find(model.contexts[k], context[~met])
        bits[rest[known >= 0]] += model.escape[k][known[known >= 0]]
        if k == 0:
            bits[rest] += 8.0
        done = np.zeros(len(data) - 1, bool)
        done[here[met]] = True
        left = left[~done[left]]
    return np.add.reduceat(bits, starts, axis=0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", order: int = ORDER,
          sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model from labelled rows; rows without text or language teach nothing.

    Every label is learnt, from at most ``sample`` documents each, those with the smallest hash of doc_id and text
    length. Documents over ``longest`` characters teach only where a language has no others, by their first
    ``longest`` characters up to the last white space.
    """
    start = F.substring(text, 1, longest)
    rows = docs.select(F.col(lang).alias("lang"), F.col(doc).alias("doc"), F.length(text).alias("chars"),
                       F.when(F.length(text) > longest, F.regexp_replace(start, r"(?<=\s)\S++$", "")).otherwise(start).alias("text"))
    rows = rows.where((F.col("chars") > 0) & F.col("lang").isNotNull())
    picked = bounded_sample(rows, sample, F.xxhash64("doc", "chars"), "lang", F.col("chars") <= longest).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(name, []).append(t)
        for name, texts in held.items():
            counts = context_counts(texts, order)
            yield pa.record_batch({"lang": pa.array([name] * len(counts)), "gram": pa.array(list(counts), pa.binary()),
                                   "n": pa.array(list(counts.values()), pa.int64())})

    found = picked.mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    rows = list(zip(*(found.column(c).to_pylist() for c in ("lang", "gram", "n"))))
    return fit(sorted({r[0] for r in rows}), rows, order)


class _Words:
    """Code lengths of words met before."""

    def __init__(self, model: Model):
        self.model, self.rows, self.costs = model, {}, np.zeros((0, len(model.languages)))

    def of(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        if len(self.costs) > KEEP:
            self.rows, self.costs = {}, self.costs[:0]
        split = [t.split() for t in texts]
        rows = self.rows
        new = [w for w in set(itertools.chain.from_iterable(split)) if w not in rows]
        if new:
            rows.update(zip(new, range(len(self.costs), len(self.costs) + len(new))))
            parts = [code_lengths(self.model, new[i:i + 20_000]) for i in range(0, len(new), 20_000)]
            self.costs = np.concatenate([self.costs, *parts])
        out = np.zeros((len(texts), self.costs.shape[1]))
        for i, words in enumerate(split):
            if words:
                out[i] = self.costs[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].sum(0)
        for w in new:
            if len(w) > 100:
                del rows[w]
        return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score.

    ``score`` is the share of the predicted language in 2 ** -bits over all languages; ties go to the
    first language by name. A text that is null or without a letter, and any text if nothing was
    learnt, gets ``und`` and score 0. Other columns stay, those of these two names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = _Words(model)
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            fit = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            if fit.any():
                bits = words.of([t.encode() for t, f in zip(texts, fit) if f])
                best[fit] = bits.argmin(1)
                score[fit] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            names = [model.languages[b] if f else UNKNOWN for b, f in zip(best.tolist(), fit.tolist())]
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(score))

    return kept.mapInArrow(run, f"{ddl(kept)}, lang_pred string, score double")


def held_out(doc: str = "doc_id") -> Column:
    """A third of the documents, by the check sum of the id's text; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))
