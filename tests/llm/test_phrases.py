"""Fingerprints by locally consistent parsing against a plain parse of one text at a time."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadpulse.llm import phrases

M = (1 << 64) - 1
A, B, C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SCHEMA = "doc_id long, text string, lang string, part int, edge string, `to` int"


def mix(x):
    x = ((x ^ (x >> 30)) * B) & M
    x = ((x ^ (x >> 27)) * C) & M
    return x ^ (x >> 31)


def toss(names):
    out = []
    for left, own in zip([0, *names], names):
        apart = left ^ own
        low = (apart & -apart).bit_length() - 1 if apart else 0
        out.append(2 * low + (own >> low & 1))
    return out


def plain_phrases(text):
    """Phrase names of all levels."""
    names, out = [ord(c) + 1 for c in text], []
    while names:
        runs = []
        for n in names:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        symbols = [n if k == 1 else mix((n + mix(k * A & M)) & M) for n, k in runs]
        label = symbols
        for _ in range(4):
            label = toss(label)
        cuts = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        names = []
        for start, end in zip(cuts, [*cuts[1:], len(symbols)]):
            total = sum(mix(n ^ (i * A & M)) for i, n in enumerate(symbols[start:end]))
            names.append(mix((total + (end - start) * C) & M))
        out += names
        if len(names) == 1:
            break
    return out


TEXT = st.text(st.sampled_from("aab cdé😀\0\n"), max_size=120)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_same_phrases_as_a_plain_parse(texts):
    got = [[] for _ in texts]
    for text, names in phrases.phrase_names(texts):
        for t, n in zip(text.tolist(), names.tolist()):
            got[t].append(n)
    assert got == [plain_phrases(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=4))
def test_other_texts_play_no_part(text, others):
    alone = phrases.spelled(phrases.sketches([text]))
    among = phrases.spelled(phrases.sketches([*others, text, *others, text]))
    assert among[-1] == among[len(others)] == alone[0]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))


def test_equal_passages_share_names_at_any_offset():
    rng = np.random.default_rng(3)
    passage = prose(rng, 300)
    names = [set(plain_phrases(t)) for t in (passage, prose(rng, 57) + passage, "x" + passage + prose(rng, 11))]
    assert all(len(names[0] & other) > 0.9 * len(names[0]) for other in names[1:])


def test_likeness_follows_the_shared_part():
    rng = np.random.default_rng(4)
    a, b = prose(rng, 400), prose(rng, 400)
    sketch = phrases.sketches([a, phrases.edited(a, b), b, a[len(a) // 2:] + b[:len(b) // 2], ""])
    near = phrases.likeness(sketch[[0] * 5], sketch)
    assert near[0] == 1 and 0.45 < near[1] < 0.75 and near[2] < 0.2 and 0.2 < near[3] < 0.5 and near[4] == 0


def plain_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        part = len(text) // 4
        changed = text[:len(text) - part] + after[:part]
        sketch = phrases.sketches([text, changed, after])
        own, other, _ = phrases.spelled(sketch)
        near = phrases.likeness(sketch[[0, 0]], sketch[1:])
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, *near.tolist()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rows(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(int(i), prose(rng, int(rng.integers(0, 60)))) for i in rng.permutation(90) * 1000]
    rows += [(None, "no id"), (None, None), (-5, ""), (10**15, None), (5000, "a second text of this id"), (1000, "é😀" * 150_000)]
    rows += [rows[3]] * 40
    wide = [(*r, "en", 1, "x", 5) for r in rows]
    got = phrases.compare_next(spark.createDataFrame(wide, SCHEMA).repartition(5), parts).collect()
    assert sorted(map(tuple, got), key=str) == plain_rows(rows)


def test_few_rows(spark):
    for rows in ([], [(None, None)], [(7, "one row")], [(7, "two"), (8, "rows are here")]):
        got = phrases.compare_next(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
        assert sorted(map(tuple, got), key=str) == plain_rows(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = phrases.compare_next(docs).collect()
    assert sorted(map(tuple, got), key=str) == plain_rows([(r.doc_id, r.text) for r in docs.collect()])
    known = {r.doc_id: r.fingerprint for r in phrases.fingerprint(docs).collect()}
    assert known == {r.doc_id: r.fingerprint for r in got}
    closer = sum(r.near_edited > r.near_next for r in got)
    assert closer >= 0.99 * len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 1000])
def test_range_of(spark, n):
    bounds = sorted(np.random.default_rng(n).integers(-500, 500, n).tolist())
    rows = spark.range(-600, 600, 7).selectExpr("id", f"{phrases.range_of('id', bounds)} as part").collect()
    assert all(r.part == sum(b <= r.id for b in bounds) for r in rows)
