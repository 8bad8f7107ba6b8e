"""Fingerprints, links and components against brute force."""

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from roadpulse.llm import simhash
from roadpulse.llm.components import components
from roadpulse.llm.queries import op3_simhash

SF_DIR = "/root/testdata/sf0.01"
bits64 = st.integers(0, 2**64 - 1)


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """doc_id -> smallest doc_id reachable."""
    values = sorted(set(marks.values()))
    array = np.array(values, np.uint64)
    head = list(range(len(values)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 2) + i + 1:
            a, b = top(i), top(int(j))
            head[max(a, b)] = min(a, b)
    root = {v: top(i) for i, v in enumerate(values)}
    least = {}
    for doc, v in marks.items():
        least[root[v]] = min(least.get(root[v], doc), doc)
    return {doc: least[root[v]] for doc, v in marks.items()}


@given(bits64, bits64)
def test_counts_are_never_further_apart_than_bits(a, b):
    x = np.array([a, b], np.uint64)
    e = simhash.embed(x)
    vector = lambda v: [(int(v) >> 2 * s & 3) for s in range(32)]
    assert vector(e[0]) == [(a >> 2 * s & 1) + (a >> 2 * s + 1 & 1) for s in range(32)]
    distance = int(simhash.manhattan(e[:1] ^ e[1:])[0])
    assert distance == sum(abs(p - q) for p, q in zip(vector(e[0]), vector(e[1]))) <= (a ^ b).bit_count()


@given(bits64, st.integers(0, 63), st.integers(0, 63))
def test_near_ones_share_a_cell(a, i, j):
    b = a ^ (1 << i) ^ (1 << j) if i != j else a ^ (1 << i)
    e = simhash.embed(np.array([a, b], np.uint64))
    assert any((int(e[0]) & m) == (int(e[1]) & m) for m in simhash.cells())


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op3_simhash(spark, SF_DIR).collect()}
    marks = {d: plain_fingerprint(t or "") for d, t in docs.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{m:016x}" for d, m in marks.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_components(marks)


def family(count, seed):
    """Fingerprints in chains and clusters, many within two bits of each other."""
    rng = np.random.default_rng(seed)
    made = {int(rng.integers(0, 2**63))}
    while len(made) < count:
        start = list(made)[int(rng.integers(len(made)))] if rng.random() < 0.9 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            start ^= 1 << int(b)
        made.add(start)
    return sorted(made)


def test_links_connect_the_same_ways_in_sparse_and_dense_cells(spark):
    values = family(600, 3)
    want = plain_components({v: v for v in values})
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "bits long")
    for dense in (2, 16, 10_000):
        groups = components(simhash.links(nodes, dense=dense)).collect()
        of = {r.node: r.root for r in groups}
        parts = {}
        for v in values:
            parts.setdefault(of.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
        whole = {}
        for v in values:
            whole.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, whole.values())), dense


def test_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, None, 1), (4, "", 1), (6, " \t\n", 1), (9, text, 1), (7, text.upper(), 1), (7, text.upper(), 1), (None, text, 1),
            (8, "word " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits int")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    groups = {r.doc_id: r.component_id for r in out}
    assert groups == {5: 4, 4: 4, 6: 4, 9: 7, 7: 7, None: 7, 8: 8}
    assert {r.bits for r in out if r.doc_id in (4, 5, 6)} == {0}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    of = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(of.values()) == {0, 1000} and len(of) == 201 + 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
