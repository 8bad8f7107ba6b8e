"""Personal data against a plain reading of the rules, and the discovery of more."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadpulse.llm import pii
from roadpulse.llm.queries import op4_pii

SF_DIR = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: [tuple(s) for s in r.base] for r in pii.base_spans(df).collect()}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op4_pii(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    more = 0
    for r in rows:
        base = plain(docs[r.doc_id])
        spelled = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(spelled) <= set(spans)
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)
        for k, s, e in (x.split(":") for x in set(spans) - set(spelled)):
            assert passes(k, docs[r.doc_id][int(s):int(e)])
            more += 1
    assert more < 0.2 * sum(len(plain(t)) for t in docs.values())


def test_odd_texts(spark):
    rnd = random.Random(3)
    parts = ["a", "Z9", ".", "..", "@", "@x.y", " ", "-", "+", "(1)", "255", "256.1", "1.2.3.4", "0001", "4111 1111-1111 1111",
             "é", "😀", "\n", "+1 (988) 555-2485", "a@b.c.d", "_", "%", "12", "7"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b.c.+d@e.f", "1.2.3.4.5.6.7.8", "+1+2 34567890", "+12345678-", "", None]
    got = base_of(spark, texts)
    bad = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not bad, bad[:3]


def test_long_texts(spark):
    texts = ["a@b" + ".c" * 60_000, "1 " * 60_000, "+1" + "." * 100_000, "x" * 300_000 + "@y.z", "1.2.3.4 a@b.c " * 700,
             "9" * 50_000, "a." * 60_000 + "@", "word 12345 " * 20_000]
    got = base_of(spark, texts)
    assert all(got[i] == plain(t) for i, t in enumerate(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(df).count() == len(texts)


@settings(max_examples=1000, deadline=None)
@given(st.text("0123456789 -", max_size=30))
def test_possessive_cards_match_the_same(text):
    java_like = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
    assert [m.span() for m in java_like.finditer(text)] == [m.span() for m in re.finditer(PLAIN["card"], text)]


def test_discovery_and_redaction(spark):
    def card(i):
        head = f"4{i:014d}"
        return next(head + str(d) for d in range(10) if passes("card", head + str(d)))

    rows = [(i, f"call +1 (555) 010-{2000 + i} or pay with {card(i)} today") for i in range(60)]
    rows += [(100, f"call +1 (555) 010-9999 {card(77)} today"),  # together they are no phone, and no card either
             (101, "the year 2024 and 12345 words, 123-456"), (102, None), (103, "")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, base string, _row long")
    found = pii.find(df)
    assert found.columns == ["doc_id", "text", "base", "spans"]
    by = {r.doc_id: r for r in found.collect()}
    text = rows[60][1]
    assert by[100].base == [] and [(s.kind, text[s.start:s.end]) for s in by[100].spans] == [
        ("card", card(77)), ("phone", "+1 (555) 010-9999")]
    assert by[101].spans == by[102].spans == by[103].spans == []
    assert found.count() == len(rows)
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[3] == "call [PHONE] or pay with [CARD] today" and clean[100] == "call [PHONE] [CARD] today"
    assert clean[101] == rows[61][1] and clean[102] is None and clean[103] == ""
    assert pii.find(df.limit(0)).count() == 0


def test_forms_that_no_seed_has_are_found_by_their_context(spark):
    rows = [(i, f"Write to us. Tel: +49 30 {1234000 + i} at any time") for i in range(300)]
    rows += [(1000, "Write to us. Tel: 030 1234567 at any time"), (1001, "Tel: 0049 30 1234567"), (1002, "Order: 030 1234567 came"),
             (1003, "Tel: 12 34 only"), (1004, "Tel: 1234567890123456 at any time")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, r.text[s.start:s.end]) for s in r.spans] for r in pii.find(df).collect()}
    assert found[1000] == [("phone", "030 1234567")] and found[1001] == [("phone", "0049 30 1234567")]
    assert found[1002] == found[1003] == found[1004] == []  # another context, and numbers that are no phone
    assert all(found[i] == [("phone", f"+49 30 {1234000 + i}")] for i in range(300))


def test_candidates_go_on_over_a_cut(spark):
    """Shapes known from elsewhere are found anywhere in a long row of numbers, also where it is cut."""
    phone = lambda i: f"(555) 01 0-{2000 + i}"
    rows = [(i, f"dial +1 {phone(i)} now") for i in range(40)]
    at = [12, 13, 14, 15, 16, 17, 30, 31]
    rows += [(100 + n, " ".join(["7"] * n) + f" +1 {phone(90)} " + " ".join(["7"] * 9)) for n in at]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.col("text"))
    found = pii.base_spans(df)
    rows = pii._runs(found, "text").withColumn("_row", F.col("doc_id"))
    values = {(r._row, r.value) for r in pii._candidates(rows, 4).select("_row", "value").collect()}
    assert all((100 + n, f"+1 {phone(90)}") in values for n in at)


def test_overlapping_spans_are_redacted_once(spark):
    df = spark.createDataFrame([("0123456789",)], "text string").withColumn("spans", F.expr(
        "array(named_struct('kind', 'ip', 'start', 5L, 'end', 7L), named_struct('kind', 'card', 'start', 2L, 'end', 6L),"
        " named_struct('kind', 'phone', 'start', 9L, 'end', 10L))")).withColumn("base", F.col("spans"))
    assert pii.redact(df).first().text == "01[CARD]78[PHONE]"
