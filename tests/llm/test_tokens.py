"""Encoding, decoding and packing against the tokenizer library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadpulse.llm import bpe, packing
from roadpulse.llm.queries import op2_bpe, op10_packing, vocabulary
from roadpulse.llm.vocab import tokenizer

SF_DIR = "/root/testdata/sf0.001"
PARTS = ["a", "aa", "aaa", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "'ll", "1", "²", "é", "ß", "\x85", "\xa0", "\x1c",
         "中", "文字", "😀", "ǅ", "Ⅷ", "٣", "the", " the", "ing", "....", "!!!", "　", "​", "\r\n", "abab", "zq", "\x00"]


def library(text):
    return np.array(tokenizer(vocabulary()).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def odd_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c) * 2}1" for c in [*range(0x700), *range(0x2000, 0x2100), *range(0x1F600, 0x1F640)]]
    return [*texts, "a" * 3000, "ab " * 2000, "=-" * 500, " " * 700]


@pytest.mark.parametrize("coder", [bpe.coder, packing.coder])
def test_ids_are_the_librarys(coder):
    texts = odd_texts()
    assert coder(vocabulary()).ids(texts) == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    machine = bpe.coder(vocabulary())
    ids = machine.ids([text])
    assert ids == [library(text)]
    assert bpe._spelled(ids, vocabulary()) == [text]


def test_every_prefix_has_one_accepted_sequence():
    machine = bpe.automaton(vocabulary())
    word = b" internationalisations"
    for end in range(1, len(word) + 1):
        ids = machine.encode(word[:end])
        assert b"".join(machine.tokens[i] for i in ids) == word[:end]
        assert all(machine.step(a, b) for a, b in zip([bpe.START, *ids], ids))


def test_small_memories_change_nothing(monkeypatch):
    machine = bpe.Automaton(vocabulary(), keep=40)
    words = [f" {w}".encode() for w in "some words that are split in a machine of little memory over and over".split()]
    assert [machine.of_word(w) for w in words * 3] == [library(w.decode()) for w in words] * 3


def test_query_of_encoding(spark):
    got = {r.doc_id: r for r in op2_bpe(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, ids = got[d.doc_id], library(d.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_rows_of_encoding(spark):
    rows = [(1, None, b"x"), (2, "", b"y"), (2, "a b", b"z"), (2, "a b", b"z"), (None, "long " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    assert sorted(r.decoded for r in out) == sorted((r[1] or "") for r in rows)
    assert sorted(bytes(r.ids) for r in out) == sorted(library(r[1] or "") for r in rows)
    assert bpe.encode(df.limit(0), vocabulary()).count() == 0
    assert bpe.decode(df.select(*[c for c in ("doc_id",)]).selectExpr("*", "cast(null as binary) as ids"),
                      vocabulary()).first().decoded == ""


@given(st.integers(1, 100_000), st.sampled_from([1, 8, 2048]))
def test_pieces_cover_a_document_once(tokens, full):
    cuts = packing.pieces(tokens, full)
    assert [s for s, _ in cuts] == [0, *np.cumsum([n for _, n in cuts]).tolist()[:-1]]
    assert sum(n for _, n in cuts) == tokens
    assert all(n <= full and n & (n - 1) == 0 for _, n in cuts)
    assert [n for _, n in cuts] == sorted((n for _, n in cuts), reverse=True)


def test_query_of_packing(spark):
    got = {}
    rows = op10_packing(spark, SF_DIR).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs) and len({r.sequence_id for r in rows}) == len(rows)
    for d in docs:
        ids = library(d.text or "") + (1).to_bytes(4, "little")
        at = 0
        for r in sorted(got[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.offset == 0 and r.doc_tokens == len(ids) // 4
            assert r.length <= 2048 and r.length & (r.length - 1) == 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * at])
        assert at == len(ids) // 4


def test_rows_of_packing(spark, tmp_path):
    rows = [(1, None, 5), (1, None, 5), (None, "a", 6), (3, "word " * 5000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    out = packing.pack(df, vocabulary())
    assert out.where("doc_id = 1").count() == 2 and out.where("doc_id is null").count() == 1
    packing.write_buckets(out, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.count() == out.count() and back.where("length * 4 <> octet_length(ids)").count() == 0
    assert packing.pack(df.limit(0), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, vocabulary(), full=100)
