"""The divergence audit against its SQL twin and plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
from compare import connect, difference

from roadpulse.llm import divergence
from roadpulse.llm.queries import ORACLE, REGISTRY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, counts int, n long"


def plain_audit(rows, min_docs=30, top=50):
    """Rows are (lang, source, text)."""
    df, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        df[lang].update(set(words))
        used[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= min_docs}
        total = Counter()
        for s in sources:
            total.update(used[lang, s])

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = share(total), {s: share(used[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)
                        if part == "pair" or i < top]
    return sorted(out)


def audited(spark, rows, **more):
    wide = [(i, text, lang, source, 1, "x", 2, 3) for i, (lang, source, text) in enumerate(rows)]
    found = divergence.audit(spark.createDataFrame(wide, SCHEMA).repartition(4), **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def test_same_rows_as_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(REGISTRY["op13_divergence"](spark, sf_dir), connect(sf_dir), ORACLE["op13_divergence"]) is None


def odd_rows():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("Ab", "ÜB", "zé", "it's", "日本") for b in "abcdefghijklm"]
    rows = []
    for i in range(240):
        source = ["hot", None, "", "Ä", "z"][min(i % 9, 4)] if i % 3 else "hot"
        rows.append((["en", None, "de"][i % 7 % 3], source, " ".join(rng.choice(words, i % 40))))
    rows += [("en", "hot", None), ("en", "quiet", "1 2 3 [\\]^_`{|}~\x7f"), ("xx", "a", "seldom"), ("xx", "b", ""), ("yy", "only", "one")]
    return rows + [rows[5]] * 30 + [("en", "long", "word Other-word " * 60_000)]


def test_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, rows, min_docs=3, top=4) == plain_audit(rows, 3, 4)
    # No language has a kept term: all pairs are there, with 0.
    none = audited(spark, rows, min_docs=1000)
    assert none == plain_audit(rows, 1000) and {r[4] for r in none} == {0}


def test_stripes_that_spill_and_blocks(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(divergence, "GROUP_TERMS", 256)
    monkeypatch.setattr(divergence, "GROUP_CELLS", 1)
    assert audited(spark, rows, min_docs=2, most_cells=10) == plain_audit(rows, 2)


def test_no_rows(spark):
    assert audited(spark, []) == []


def test_shares_do_not_overflow():
    got = divergence.shares(np.array([10**14, 0, 7]), np.array([3 * 10**14] * 3), np.int64(10**6))
    assert got.tolist() == [1 + 10**9 * (c + 5) // (3 * 10**14 + 5 * 10**6) for c in (10**14, 0, 7)]


def test_fold_hands_on_and_keeps_nothing():
    stripes = divergence.Stripes()
    stripes.add(["en", "en"], ["a", "b"], ["One two, two.", "two"])
    stripes.add(["en"], ["b"], ["Two"])
    assert stripes.cells == 4
    (batch,) = stripes.emptied()
    assert stripes.cells == 0 and not stripes.terms and not len(stripes.df)
    assert batch.to_pylist() == [
        {"lang": "en", "term": "one", "df": 1, "sources": ["a"], "counts": [1]},
        {"lang": "en", "term": "two", "df": 3, "sources": ["a", "b"], "counts": [2, 2]}]
