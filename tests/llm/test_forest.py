"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from roadpulse.llm import forest
from roadpulse.llm.queries import op1_forest

SF_DIR = "/root/testdata/sf0.1"


def brute(ids, vectors, queries, nearest):
    out = {}
    for q in queries:
        score = vectors @ vectors[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:nearest]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores_of_the_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = lists(op1_forest(spark, SF_DIR))
    want = brute(ids, vectors, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert set(got) == set(want) and {len(v) for v in got.values()} == {20}
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    at = {i: v for i, v in zip(ids.tolist(), vectors)}
    assert all(abs(s - at[i] @ at[q]) < 1e-12 for q, v in got.items() for i, s in v)
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


@pytest.mark.parametrize("cell", [30, 4096])
def test_a_share_of_all_is_exact(spark, cell):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)) * rng.uniform(0.2, 5, (300, 1))  # lengths differ
    vectors[40:160] = vectors[40]  # copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = lists(forest.search(df, df.where("vec_id % 10 = 0"), nearest=25, trees=4, share=4.0, cell=cell))
    want = brute(np.arange(300), vectors, range(0, 300, 10), 25)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert [i for i, _ in got[50]][:3] == [i for i, _ in want[50]][:3] or want[50][0][1] < vectors[50] @ vectors[50] + 1e-9


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.5, 0.5], None), (4, None, "a"), (5, [0.0, 0.0], "a"),
            (6, [nan, 1.0], "a"), (7, [inf, 1.0], "a"), (8, [None, 1.0], "a"), (9, [1.0], "a"), (None, [1.0, 1.0], "a"),
            (10, [], "a"), (11, [-1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = lists(forest.search(df, df, nearest=3))
    assert got == {1: [(2, 1.0), (3, 0.5), (11, -1.0)], 2: [(1, 1.0), (3, 0.5), (11, -1.0)],
                   3: [(1, 0.5), (2, 0.5), (11, -0.5)], 11: [(3, -0.5), (1, -1.0), (2, -1.0)]}
    assert forest.search(df.limit(0), df.limit(0)).count() == 0
    assert forest.search(df, df.limit(0)).count() == 0


def test_vectors_of_each_length_have_neighbours(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(forest.search(df, df.where("vec_id in (3, 100, 104)"), nearest=3))
    assert [i for i, _ in got[100]] == [101, 102, 103] and [i for i, _ in got[104]] == [108, 107, 106]
    assert [i for i, _ in got[3]] == [6, 13, 20]
