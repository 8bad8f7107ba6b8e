"""Language, quality rules, quality classifier and sharding."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadpulse.llm import langid, quality, rules, sharding
from roadpulse.llm.queries import SHARDS, op5_quality, op6_rules, op7_sharding, op8_langid

SF_DIR = "/root/testdata/sf0.01"


def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# --- language -----------------------------------------------------------------------------


def test_held_out_languages(spark):
    rows = op8_langid(spark, SF_DIR).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs(spark).count()
    out = [r for r in rows if r.held_out]
    assert 0.2 < len(out) / len(rows) < 0.5
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def plain_bits(counts, word, order):
    """Bits of a word by the definition, over counts of context + byte."""
    coded, bits = b" " + word + b" ", 0.0
    for i in range(1, len(coded)):
        for k in range(min(order, i), -1, -1):
            context = coded[i - k:i]
            followers = {g[-1]: n for g, n in counts.items() if len(g) == k + 1 and g[:-1] == context}
            total, kinds = sum(followers.values()), len(followers)
            if coded[i] in followers:
                bits -= np.log2(followers[coded[i]] / (total + kinds))
                break
            if total:
                bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_are_the_defined_ones():
    texts = {"a": ["the cat and the hat", "a cat"], "b": ["die katze und der hut", "eine katze"]}
    counts = {name: langid.context_counts(t, 3) for name, t in texts.items()}
    model = langid.fit(["a", "b"], [(n, g, c) for n in counts for g, c in counts[n].items()], 3)
    words = [b"cat", b"katze", b"hats", b"\xc3\xa9", b"zzz", b"t", b"thethe"]
    got = langid.code_lengths(model, words)
    assert got == pytest.approx(np.array([[plain_bits(counts[n], w, 3) for n in "ab"] for w in words]))


def test_letters():
    assert [langid.has_letter(t) for t in ("", "12 ²½Ⅷ_٣", "²a", "中", "ǅ", "!ß")] == [False, False, True, True, True, True]


def test_language_rows(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en", 0) for i in range(5)] + [(9, "le chat est sur le tapis " * 3, "fr", 0)]
    rows += [(20, None, "en", 1), (21, "", "fr", 1), (22, "12 34 !!", None, 1), (23, "chat " * 100_000, None, 1), (23, "the", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.learn(df)
    out = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert Counter(out) == Counter([(i, "en") for i in range(5)] + [(9, "fr"), (20, "und"), (21, "und"), (22, "und"), (23, "fr"), (23, "en")])
    nothing = langid.learn(df.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


# --- rules --------------------------------------------------------------------------------


def plain_repeats(words):
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return sum(any(windows[tuple(words[j:j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(words) - 5) + 1))
               for i in range(len(words)))


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    assert rules.repeated_words(words) == plain_repeats(words)


def test_rules_query(spark):
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = op6_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    lost, caught = [], []
    for r in rows:
        t = texts[r.doc_id]
        words, lines = t.encode().split(), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        repeats = plain_repeats(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (
            len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(words) < 10 or 100 * repeats > 20 * len(words))
        assert not (r.base_failed and r.kept)
        if not r.base_failed and r.doc_id in labels:
            (lost if labels[r.doc_id] else caught).append(not r.kept)
    assert np.mean(lost) < 0.02 and np.mean(caught) > 0.9


def test_sketches_merge_and_hold_their_error(spark):
    rng = np.random.default_rng(1)
    rows = [(f"l{i % 3}", f"s{i % 5}", 10, int(x)) for i, x in enumerate(rng.integers(0, 5000, 3000))]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long").selectExpr(
        "*", "0L as n_symbols", "0L as n_dup_lines", "1L as n_word_lines", "0L as n_repeat_words")
    parts = rules.sketches(df.where("word_chars % 2 = 0"), []).union(rules.sketches(df.where("word_chars % 2 = 1"), []))
    whole = rules.sketches(df, [])
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(rules.merged(parts, [])) == key(whole)
    q = {r.measure: r for r in rules.quantiles(whole, [], {"low": 0.25, "mid": 0.5}).collect()}["word_length"]
    values = np.sort([r[3] / 10 for r in rows])
    assert q.low == pytest.approx(values[749], rel=0.0101) and q.mid == pytest.approx(values[1499], rel=0.0101)


def plain_kept(rows):
    """Verdicts of rows (lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_word_lines, n_repeat_words) by sorting."""
    def values(members, m):
        over, under, _, _ = rules.MEASURES[m]
        return sorted(getattr(r, over) / getattr(r, under) for r in members if getattr(r, under) > 0)

    def quantile(members, m, q):
        found = values(members, m)
        at = found[int(np.ceil(q * len(found))) - 1] if found else None
        # What the sketch says for a value: the middle of its bucket.
        return at if not at else 2 * rules.GAMMA ** np.ceil(np.log(at) / np.log(rules.GAMMA)) / (rules.GAMMA + 1)

    kept = []
    for r in rows:
        ok = r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words
        own = [x for x in rows if (x.lang, x.source) == (r.lang, r.source)]
        near = [x for x in rows if x.lang == r.lang]
        for m, (over, under, slack, both) in rules.MEASURES.items():
            def level(q):
                parts = [(len(values(g, m)), quantile(g, m, q)) for g in (rows, near, own)]
                at = parts[0][1]
                for n, mine in parts[1:]:
                    at = (n * (mine or 0.0) + 200 * at) / (n + 200)
                return at
            if getattr(r, under) > 0:
                mid = level(0.5)
                reach = max(4 * (mid - level(0.25)), slack)
                value = getattr(r, over) / getattr(r, under)
                ok = ok and value <= mid + reach and not (both and value < mid - reach)
        kept.append(ok)
    return kept


def test_kept_against_sorting(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(420):
        long = int(rng.integers(2, 12))
        text = " ".join("x" * max(1, long + int(rng.integers(-1, 2))) + str(k) for k in range(int(rng.integers(5, 60))))
        rows.append((i, text + " #$" * int(rng.integers(0, 4)) ** 2, ["en", "de", None][i % 3], f"s{i % 7 % 4}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sorted(rules.judge(df).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in found] == plain_kept(found) and 0 < sum(r.kept for r in found) < len(found)


def test_one_document_more_moves_a_limit_little(spark):
    """Sources of 199 and of 200 documents beside a large one of the same language get nearly the same limits."""
    def limits(n):
        rows = [("en", "large", 10, 50 + i % 7) for i in range(2000)] + [("en", "small", 10, 90 + i % 5) for i in range(n)]
        df = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long").selectExpr(
            "*", "0L as n_symbols", "0L as n_dup_lines", "1L as n_word_lines", "0L as n_repeat_words")
        return {(r.source, r.measure): (r.least, r.most) for r in rules.thresholds(df).collect()}["small", "word_length"]
    for n in (1, 199, 200, 1000):
        (a, b), (c, d) = limits(n), limits(n + 1)
        assert abs(a - c) < 0.05 and abs(b - d) < 0.05


def test_rule_rows(spark):
    good = "these are words that make a sentence of fair length here"
    rows = [(1, None, "en", "a", 1), (2, "", None, None, 1), (3, " \n ", "en", None, 1), (4, good, "en", "a", 1), (4, good, "en", "a", 1),
            (5, (good + "# ") * 1, "xx", "b", 1), (6, "long words " * 100_000, "en", "a", 1)]
    rows += [(100 + i, good, "en", "a", 1) for i in range(300)] + [(900, "#### " * 3 + good, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    out = [(r.doc_id, r.base_failed, r.kept) for r in rules.judge(df).where("doc_id < 100 or doc_id = 900").collect()]
    assert Counter(out) == Counter([(1, True, False), (2, True, False), (3, True, False), (4, False, True), (4, False, True),
                                    (5, False, True), (6, True, False), (900, False, False)])
    assert rules.judge(df.limit(0)).count() == 0


# --- classifier ---------------------------------------------------------------------------


def test_accuracies_of_labellers_are_recovered():
    rnd = random.Random(4)
    right = [0.95, 0.8, 0.7, 0.6]
    counts, truth = Counter(), {}
    for _ in range(20_000):
        good = rnd.random() < 0.7
        vote = "".join("2" if rnd.random() < 0.2 else str(int(good == (rnd.random() < p))) for p in right)
        counts[vote] += 1
        truth.setdefault(vote, []).append(good)
    chances, table = quality.estimate(sorted(counts.items()))
    for i, p in enumerate(right):
        assert table[i, 1, 1] / (table[i, 1, 0] + table[i, 1, 1]) == pytest.approx(p, abs=0.05)
    assert all(abs(chances[v] - np.mean(t)) < 0.08 for v, t in truth.items() if len(t) > 500)
    assert quality.estimate([])[0] == {}


def test_classifier_query(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = op5_quality(spark, SF_DIR)
    assert rows.count() == docs(spark).count()
    judged = rows.join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.95
    assert np.mean([not r.kept for r in judged if r.quality == 0]) > 0.85


def test_classifier_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "some words that are fine.", 1), (3, "ok " * 200_000, 1)]
    df = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string, score int")
    out = quality.classify(df).collect()
    assert len(out) == 5 and [r.score for r in out if r.doc_id in (1, 2)] == [0.0, 0.0]
    assert all(0 <= r.score <= 1 for r in out)
    assert quality.classify(df.limit(0)).count() == 0


# --- shards -------------------------------------------------------------------------------


def plain_table(names, slots):
    """Turns as in the definition: in order of names, each shard takes its first free slot."""
    orders = []
    for name in sorted(names):
        start, step = sharding._hash(name, "first") % slots, sharding._hash(name, "step") % (slots - 1) + 1
        orders.append((name, [(start + i * step) % slots for i in range(slots)]))
    held = [None] * slots
    while None in held:
        for name, order in orders:
            free = [s for s in order if held[s] is None]
            if free:
                held[free[0]] = name
    return held


@pytest.mark.parametrize("names", [["a"], ["a", "b", "c"], [f"n{i}" for i in range(11)]])
def test_table_is_filled_by_turns(names):
    held = [names[i] for i in sharding.table(names, 97)]
    assert held == plain_table(names, 97)
    assert held == [n for n in (sorted(names, reverse=True)[i] for i in sharding.table(sorted(names, reverse=True), 97))]
    sizes = Counter(held).values()
    assert max(sizes) - min(sizes) <= 1


def test_a_lost_shard_moves_little_else():
    names = [f"s{i}" for i in range(20)]
    before = [names[i] for i in sharding.table(names)]
    fewer = names[:7] + names[8:]
    after = [fewer[i] for i in sharding.table(fewer)]
    moved = sum(a != b for a, b in zip(before, after) if a != "s7")
    assert moved < 0.1 * len(before)
    with pytest.raises(ValueError):
        sharding.table(names, 100)
    with pytest.raises(ValueError):
        sharding.table(["a", "a"])


def test_sharding_query(spark):
    import hashlib

    rows = op7_sharding(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs(spark).collect())
    held = sharding.table(SHARDS)
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, SHARDS[held[slot]])


def test_sharding_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 1), (1, "b", 2), (1, "b", 2)], "doc_id long, text string, slot int")
    out = sharding.place(df, "doc_id", ["x", "y", "z"], 101)
    assert out.count() == 3 and len({r.shard for r in out.where("doc_id = 1").collect()}) == 1
    sharding.write_shards(out, str(tmp_path / "out"), files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert sharding.place(df.limit(0), "doc_id", ["x"], 101).count() == 0
