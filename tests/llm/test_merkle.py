"""The Merkle manifest against its SQL twin and a plain recursive one."""

import hashlib
import zlib

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from roadpulse.llm import merkle
from roadpulse.llm.queries import ORACLE, REGISTRY, op11_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, `_order` string, place long, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """Top, and for each node its siblings as (left, right), bottom up."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, upper = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start:start + 16]
            for k in range(len(run)):
                for i in members[start + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            ups.append(h(*run))
            upper.append(sum(members[start:start + 16], []))
        nodes, members = ups, upper
    return nodes[0], paths


def plain_manifest(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        given = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            lowered = text.encode().lower().decode()
            given = plain_leaf(doc_id, source, lang, n_chars, lowered)
        by_source.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, given))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: plain_tree([r[2] for r in sorted(by_source[s])]) for s in order}
    root, over = plain_tree([tops[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for (_, doc_id, leaf, given), path in zip(sorted(by_source[s]), tops[s][1]):
            at, met = given, ""
            for left, right in path + above:
                at, met = h(left, at, right), met + left + right
            out.append((doc_id, leaf, tops[s][0], root, h(met), at, at == root))
    return sorted(out, key=str)


def table(spark, tmp_path, rows):
    wide = [(*r, "x", "y", 7, 9) for r in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, op11_merkle(spark, str(tmp_path)).collect()), key=str)


def test_same_rows_as_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(REGISTRY["op11_merkle"](spark, sf_dir), connect(sf_dir), ORACLE["op11_merkle"]) is None


def test_odd_rows(spark, tmp_path):
    rows = [(i, f"Text {i} ÄB" * (i % 4), "en", "hot", i) for i in range(300)]
    rows += [(i, "A", None, f"s{i}", 1) for i in range(40)] + [(i, None, "de", None, None) for i in range(17)]
    rows += [(None, "No Id", "en", "hot", 3), (None, None, None, None, None), (7, "Other Seven", "en", "hot", 2)]
    rows += [(8, "", "en", "", 0), (9, "L" * 300_000, "en", "Ä", 5), (3, "x", "en", "z", 1), (3, "x", "en", "z", 1)]
    assert table(spark, tmp_path, rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 17, 257])
def test_sizes(spark, tmp_path, n):
    rows = [(i, "Ab", "en", "s", 2) for i in range(n)]
    assert table(spark, tmp_path, rows) == (plain_manifest(rows) if n else [])


def test_one_leaf_has_no_siblings(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle.manifest(one).withColumn("proof", merkle.proof(F.col("path"))).first()
    assert row.leaf == row.subroot == row.root and row.path == [] and row.proof == h("")
