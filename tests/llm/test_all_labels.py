"""Language ID learns every label, however many there are and however long their texts."""

import random

from roadpulse.llm import langid


def test_more_labels_than_256_and_rare_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)]
        rows += [(i * 10 + k, " ".join(own), f"l{i:03d}") for k in range(2 if i < 299 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.languages == sorted({r[2] for r in rows})
    rare = df.where("lang = 'l299'")
    assert [r.lang_pred for r in langid.predict(rare, model).collect()] == ["l299"]


def test_a_language_of_long_texts_only(spark):
    rows = [(1, "ab cd ab cd " * 10, "short"), (2, "xyz " * 100, "short"), (3, "uvw rst " * 50, "long"),
            (4, "one " * 500, "short"), (5, None, "none"), (6, "", "none"), (7, "some text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, longest=390)
    assert model.languages == ["long", "short"]
    assert [r.lang_pred for r in langid.predict(df.where("doc_id = 3"), model).collect()] == ["long"]
    # A language with short texts learns from those alone.
    without = langid.learn(df.where("doc_id <> 4"), longest=390)
    assert all((a == b).all() for a, b in zip(model.cost, without.cost))
