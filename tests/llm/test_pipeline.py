"""The pipeline against its stages worked out plainly, one after the other."""

from collections import Counter

import corpus_pipeline
from test_linededup import plain as plain_lines
from test_pii import plain as plain_spans
from test_simhash import plain_components, plain_fingerprint

from roadpulse.llm import langid, pii
from roadpulse.llm.queries import vocabulary
from roadpulse.llm.vocab import tokenizer

SF_DIR = "/root/testdata/sf0.01"


def plainly_redacted(text):
    spans, out, at = sorted((s, e, k) for k, s, e in plain_spans(text)), "", 0
    merged = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out, at = f"{out}{text[at:s]}[{k.upper()}]", e
    return out + text[at:]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    known = stage["language"](spark, docs, SF_DIR)
    model = langid.learn(docs.where(~langid.held_out()))
    want = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in known.collect()} == want and len(want) > 0.98 * docs.count()

    lines = stage["line dedup"](spark, known, SF_DIR)
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((d, t) for d, _, _, t in plain_lines(rows).elements())
    assert lines.columns == columns and lines.where("n_chars <> length(text)").count() == 0
    lines = lines.cache()

    single = stage["near duplicates"](spark, lines, SF_DIR)
    texts = {r.doc_id: r.text for r in lines.collect()}
    parts = plain_components({d: plain_fingerprint(t) for d, t in texts.items()})
    assert single.columns == columns
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter((d, texts[d]) for d in set(parts.values()))
    single = single.cache()

    clean = stage["personal data"](spark, single, SF_DIR)
    found = {r.doc_id: r for r in pii.find(single).collect()}
    got = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and set(got) == set(found)
    plain_ones = [d for d, r in found.items() if len(r.spans) == len(r.base)]
    assert all(got[d] == plainly_redacted(found[d].text) for d in plain_ones) and len(plain_ones) > 0.95 * len(found)


def test_run(spark):
    pieces = {}
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    spelled = tokenizer(vocabulary())
    for rows in pieces.values():
        rows.sort(key=lambda r: r.start)
        ids = [int.from_bytes(bytes(r.ids)[i:i + 4], "little") for r in rows for i in range(0, len(r.ids), 4)]
        assert ids[-1] == 1 and len(ids) == rows[0].doc_tokens
        text = spelled.decode(ids[:-1], skip_special_tokens=False)
        assert [s for s in plain_spans(text) if s[0] == "email"] == []


def test_rows(spark):
    text = "the cat and the dog and the hat are here today"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, text, "en", None, 1), (3, text, "en", None, 1), (4, text, None, "s", 1),
            (None, text + " with a@b.cd", "en", "s", None), (5, "word " * 50_000, "en", "s", 1), (6, "Ünd +1 (555) 010-2000", "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, least in ((df, 1), (df.limit(0), 0)):
        now = table
        for name, fn in corpus_pipeline.STAGES[:-1]:
            now = fn(spark, now, SF_DIR)
            assert now.columns == df.columns, name
        assert now.count() >= least
        if least:
            out = [(r.doc_id, r.text) for r in now.collect()]
            assert (3, text) in out and out.count((3, text)) == 1 and not any(d == 4 for d, _ in out)
            assert (None, text + " with [EMAIL]") in out and not any(d in (1, 2) for d, _ in out)
        corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR).count()


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    copied, unique = "the cat and the dog and the hat are here today", "nothing like it was ever seen before in this town"
    rows = [(3, copied, "a"), (5, copied, "b"), (5, unique, "c"), (5, unique, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_of_text` string")
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, df, SF_DIR)
    assert sorted(map(tuple, got.collect())) == [(3, copied, "a"), (5, unique, "c")]
