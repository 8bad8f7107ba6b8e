"""Ids of whole texts in a byte-level vocabulary, by a memory of blank-separated chunks.

A text is cut at each blank that stands between two other characters. A token of the byte-level
pattern begins at such a blank and never runs over it, so each chunk has ids of its own, and a
chunk met before costs one look-up.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np

# White space next to a blank, or a blank at an end: there only the other blanks are cuts.
_RUNS = re.compile(r" \s|\s |^ | $")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
# Letters and numbers below U+0250, as Unicode has them; any other character goes to the tokenizer's own pre-split.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
SAFE = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-ɏ]*").fullmatch
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
PLAIN = re.compile(f" ?[{_LETTERS}]+").fullmatch  # a chunk that is one word
LONG = 400  # chunks of more characters are not kept


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@functools.cache
def load(path: str) -> dict:
    """A tokenizer file as tables: token bytes, merges as id pairs, special texts."""
    model = json.loads(Path(path).read_text())
    if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["model"]["type"] != "BPE":
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    value = {letter: b for b, letter in enumerate(byte_letters())}
    ids = model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    spelled = [b""] * size
    for token, i in ids.items():
        if token not in special:
            spelled[i] = bytes(value[c] for c in token)
    for token, i in special.items():
        spelled[i] = token.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    return {
        "tokens": spelled, "special": special, "size": size,
        "byte_ids": [ids[c] for c in byte_letters()],
        "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges],
    }


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


def words_of(text: str, path: str) -> list[bytes]:
    """The pre-split of a text into the words that merges never cross."""
    if SAFE(text):
        return [w.encode() for w in _SPLIT.findall(text)]
    pieces = tokenizer(path).pre_tokenizer.pre_tokenize_str(text)
    value = _values()
    return [bytes(value[c] for c in piece) for piece, _ in pieces]


@functools.cache
def _values() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(byte_letters())}


class Coder:
    """Texts to ids, as little-endian unsigned 32-bit integers.

    ``encode`` gives the ids of each of a list of chunks, which hold no special text. ``keep``
    bounds the memory of chunks; a full memory starts anew.
    """

    def __init__(self, path: str, encode: Callable[[Sequence[str]], list[bytes]], keep: int = 300_000):
        self.encode, self.keep = encode, keep
        special = load(path)["special"]
        # Three kinds of keys: a chunk after a blank; a blank and the first chunk; two blanks and a special text.
        self.special = {t: "  " + t for t in special}
        self.always = {"  " + t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.memory: dict[str, bytes] = dict(self.always)
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None

    def forget(self) -> None:
        """Empty the memory, so that a worker at rest holds none."""
        self.memory = dict(self.always)

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.memory) > self.keep:
            self.forget()
        memory = self.memory
        plans = [self._plan(t) for t in texts]
        missing = [k for k in set(itertools.chain.from_iterable(plans)) if k not in memory]
        memory.update(zip(missing, self.encode([k[1:] if k[:1] == " " else " " + k for k in missing])))
        made = [b"".join(map(memory.__getitem__, p)) for p in plans]
        for k in missing:
            if len(k) > LONG:
                del memory[k]
        return made

    def _plan(self, text: str) -> list[str]:
        """The keys whose ids make up the text."""
        if self.cut and any(t in text for t in self.special):
            plan = []
            for part in self.cut.split(text):
                plan += [self.special[part]] if part in self.special else self._plan(part)
            return plan
        if not text:
            return []
        keys = _SINGLE.split(text) if _RUNS.search(text) else text.split(" ")
        keys[0] = " " + keys[0]
        return keys
