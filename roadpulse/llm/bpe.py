"""Byte-pair encoding by an automaton over tokens, and its inverse.

The automaton accepts exactly the token sequences that the merges leave. It starts with one arc
per byte from every state, and each merge, in order, adds one gadget:

* the state after the merged token takes over the arcs of the state after its right part,
* beside each arc of its left part runs an arc of the merged token,
* and the state after the left part loses its arc of the right part.

So an arc (state after u, label v) is there if it was there in the gadget it was taken over from
and no merge cut it since. The compiled form is three tables (left part, right part, merge number)
and the cut of each pair; rows of the transition table are filled from them when first asked for,
as the whole table would have one row and one column per token.

Every prefix of a word has one accepted sequence. So over bytes the automaton is deterministic too:
its state is the label that ends here with the partial labels that may go on, and what each of
those follows. A word takes one table entry per byte; the labels met then give the tokens from the
word's end to its start.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadpulse.llm.common import ddl, slices, texts_of
from roadpulse.llm.vocab import PLAIN, Coder, load, words_of

NEVER = 1 << 40
START = -1  # the state before any token


class Automaton:
    """The compiled merges of one vocabulary, and its table of transitions."""

    def __init__(self, path: str, keep: int = 1_000_000):
        model = load(path)
        size = model["size"]
        self.tokens, self.size, self.keep = model["tokens"], size, keep
        self.left, self.right, self.born = [0] * size, [0] * size, [0] * size
        self.cut: dict[int, int] = {}
        known = set(model["byte_ids"])
        for number, (u, v, merged) in enumerate(model["merges"], 1):
            if merged in known or u not in known or v not in known:
                raise ValueError(f"merge {number} doesn't make a new token of known ones")
            known.add(merged)
            self.left[merged], self.right[merged], self.born[merged] = u, v, number
            self.cut[u * size + v] = number
        self.ids = {self.tokens[i]: i for i in known}
        # Every beginning of a token, with the token's id or -1.
        self.begins = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        self.packed = np.arange(size, dtype="<u4").view("V4").tolist()
        self.arcs: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        self._clear()

    def step(self, state: int, label: int) -> bool:
        """Has the state after token ``state`` an arc ``label``?"""
        if state == START:
            return True
        key = state * self.size + label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > self.keep:
                self.arcs.clear()
            found = self.arcs[key] = self._fill(state, label)
        return found

    def _fill(self, u: int, v: int) -> bool:
        """Follow an arc back through the gadgets it was taken over in, to the arcs of bytes."""
        left, right, born, cut, size = self.left, self.right, self.born, self.cut, self.size
        until = NEVER  # the arc must stand when merge number ``until`` begins
        while True:
            if cut.get(u * size + v, NEVER) < until:
                return False
            if born[u] > born[v]:
                u, until = right[u], born[u]
            elif born[v]:
                # The arc of a merged token runs beside arcs of its left part that outlast the cut.
                v, until = left[v], born[v] + 1
            else:
                return True

    def _clear(self) -> None:
        """Empty the byte table. State 0 is the start: one partial label, the empty one, after no token."""
        self.table: dict[int, int] = {}
        self.states = {((b"", START),): 0}
        self.partials = [((b"", START),)]
        self.label = [START]

    def _next(self, state: int, byte: int) -> int:
        """Fill one entry of the byte table."""
        partials, ended, grown = [], None, bytes((byte,))
        for begun, after in self.partials[state]:
            label = self.begins.get(begun + grown)
            if label is None:
                continue
            partials.append((begun + grown, after))
            if ended is None and label >= 0 and self.step(after, label):
                ended = label
        partials.append((b"", ended))
        made = tuple(partials)
        to = self.states.get(made)
        if to is None:
            to = self.states[made] = len(self.label)
            self.partials.append(made)
            self.label.append(ended)
        self.table[state << 8 | byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """The accepted sequence of a word: one table entry per byte, then back over the labels."""
        table, state, seen = self.table.get, 0, []
        for byte in word:
            to = table(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            seen.append(state)
        path, at, label, tokens = [], len(word), self.label, self.tokens
        while at:
            made = label[seen[at - 1]]
            path.append(made)
            at -= len(tokens[made])
        path.reverse()
        return path

    def spell(self, word: bytes) -> bytes:
        """Packed ids of a word."""
        if len(self.label) > self.keep // 4:
            self._clear()
        packed = self.packed
        return b"".join([packed[i] for i in self.encode(word)])

    def of_word(self, word: bytes) -> bytes:
        """The same, kept for the next time if the word is short."""
        found = self.words.get(word)
        if found is None:
            found = self.spell(word)
            if len(word) <= 64:
                if len(self.words) > self.keep // 4:
                    self.words.clear()
                self.words[word] = found
        return found


@functools.cache
def automaton(path: str) -> Automaton:
    """Compiled once per Python worker."""
    return Automaton(path)


@functools.cache
def coder(path: str) -> Coder:
    machine = automaton(path)

    def encode(chunks):
        return [machine.spell(c.encode()) if PLAIN(c) else b"".join(map(machine.of_word, words_of(c, path)))
                for c in chunks]

    return Coder(path, encode)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``, the tokens of each whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Special texts of the vocabulary in a text get their own ids.
    ``decoded`` names a column for what ``decode`` makes of the ids, in the same pass. Other columns
    stay; columns of these names are replaced. No shuffle; repeated rows each get their ids.
    """
    kept = docs.drop(ids, *([decoded] if decoded else []))
    schema = f"{ddl(kept)}, `{ids}` binary" + (f", `{decoded}` string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path)
        for batch in slices(batches, text):
            packed = made.ids(texts_of(batch, text))
            out = batch.append_column(ids, pa.array(packed, pa.binary()))
            yield out.append_column(decoded, pa.array(_spelled(packed, path), pa.string())) if decoded else out

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the bytes of the tokens in turn; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    kept = encoded.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ids):
            made = _spelled(batch.column(ids).to_pylist(), path)
            yield batch.append_column(text, pa.array(made, pa.string()))

    return kept.mapInArrow(run, f"{ddl(kept)}, `{text}` string")


def _spelled(packed: list[bytes | None], path: str) -> list[str]:
    """The labels of the arcs gone along, as text."""
    label = load(path)["tokens"].__getitem__
    return [b"".join(map(label, np.frombuffer(i or b"", "<u4").tolist())).decode("utf-8", "replace") for i in packed]
