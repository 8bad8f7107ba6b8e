"""Line dedup against brute force and SQL, and its store through insertions and deletions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference

from roadpulse.llm.cuckoo import CuckooFilter, Full
from roadpulse.llm.linededup import LineStore, dedup_lines
from roadpulse.llm.queries import ORACLE, op9_linededup

SF_DIR = "/root/testdata/sf0.01"
LONG = "this line is longer than forty characters, surely"


def plain(docs, shortest=40, least=5):
    """(doc, text) -> (doc, n_lines, n_dropped, kept text)."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holds = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= shortest:
                holds[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holds.get(key(x), ())) < least or doc == max(holds[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_query_and_its_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in op9_linededup(spark, SF_DIR).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == Counter({(d, n, m, hashlib.sha256(t.encode()).hexdigest()): c for (d, n, m, t), c in plain(docs).items()})
    assert difference(op9_linededup(spark, SF_DIR), connect(SF_DIR), ORACLE["op9_linededup"]) is None


def test_rows(spark):
    rows = [(i, f"  {LONG.upper() if i % 2 else LONG}\t\nown {i}\n{LONG}", "x", i) for i in range(6)]
    rows += [(2, rows[2][1], "x", 2), (None, LONG, "x", 0), (50, None, None, 1), (51, "", None, 1), (52, "\n\n", None, 1),
             (53, "é" * 39, None, 1), (54, "word " * 100_000, None, 1)]
    rows += [(60 + i, "é" * 40, None, 1) for i in range(5)] + [(70 + i, "é" * 39, None, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, _drops long")
    out = dedup_lines(df)
    assert result(out) == plain([(r[0], r[1]) for r in rows])
    assert result(dedup_lines(df, min_docs=2, shortest=5)) == plain([(r[0], r[1]) for r in rows], 5, 2)
    assert dedup_lines(df.limit(0)).count() == 0


def test_store_is_reversible(spark):
    a = [(i, f"{LONG}\nfirst {i} " + "x" * 40) for i in range(4)]
    b = [(10 + i, f"{LONG}\n{'second ' * 8}{i % 2}") for i in range(8)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = LineStore(spark, min_docs=3, shards=4)
    store.insert(frame(a))
    before = {bytes(r.key): (r.n_docs, r.keeper) for r in store.counts().collect()}
    store.insert(frame(b))
    assert result(store.apply(frame(a + b))) == plain(a + b, least=3)
    again = LineStore(spark, store.path, min_docs=3, shards=4)  # opened anew
    again.delete(frame(b).union(frame([(999, "")])))
    again.delete(frame(b))
    assert {bytes(r.key): (r.n_docs, r.keeper) for r in again.counts().collect()} == before
    assert result(again.apply(frame(a))) == plain(a, least=3)
    again.insert(frame(b[:3]))
    assert result(again.apply(frame(a + b[:3]))) == plain(a + b[:3], least=3)
    held = {r.shard: CuckooFilter.read(bytes(r.held)) for r in again.filters().collect()}
    frequent = [bytes(r.key) for r in again.frequent().collect()]
    assert sum(int((f.table > 0).sum()) for f in held.values()) == len(frequent)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, (5000, 2), np.uint64)
    f = CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 2**64, (20_000, 2), np.uint64)).mean() < 0.002
    f.remove(keys[:2500])
    assert f.holds(keys[2500:]).all() and f.holds(keys[:2500]).mean() < 0.01
    assert (CuckooFilter.read(f.bytes()).table == f.table).all()
    small = CuckooFilter.sized(1)
    with pytest.raises(Full):
        small.insert(rng.integers(0, 2**64, (200, 2), np.uint64))


@pytest.mark.parametrize("n", [2_000, 10_000, 40_000])
def test_filter_over_the_keys_of_one_shard(n):
    """Keys of a shard agree in bits; they still fill the filter of their number at the first try, with few false finds."""
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 1 << 63, (2, n, 2), dtype=np.int64).astype(np.uint64)
    keys[:, 1] = keys[:, 1] // np.uint64(64) * np.uint64(64) + np.uint64(5)
    f = CuckooFilter.sized(n)
    f.insert(keys)
    load = np.count_nonzero(f.table) / f.table.size
    assert f.holds(keys).all() and load > 0.4 and len(f.table) == len(CuckooFilter.sized(n).table)
    assert f.holds(others).mean() < 0.001
    full = CuckooFilter(np.zeros((1 << 10, 4), np.uint16))
    full.insert(keys[:3600] if n >= 3600 else np.concatenate([keys, others])[:3600])
    assert np.count_nonzero(full.table) / full.table.size > 0.85
