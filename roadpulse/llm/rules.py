"""Quality rules with thresholds that follow the data.

Four measures of each document go into quantile sketches per (language, source): counts per
logarithmic bucket, a hundredth wide. Sketches merge by adding counts, so those of a language and of
all documents come from the same counts, whatever the order. A group's quantiles are blended with those of its
language as if ``PRIOR`` documents more had the latter, and a language's with those of all likewise, so that limits move
smoothly from the one to the other as a group grows. A document fails a measure that lies
further from the group's median than four times the distance between median and lower quartile, or
the measure's slack if that is more. The lower half alone sets the limit, so junk above the median
doesn't raise it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadpulse.llm.common import ddl, saved, slices, texts_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20  # per hundred words
PRIOR = 200.0
SPREADS = 4.0
# measure: (numerator, denominator, slack, is a low value bad too)
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 0.03, False),
    "dup_line_share": ("n_dup_lines", "n_word_lines", 0.5, False),
    "repeat_share": ("n_repeat_words", "n_words", 0.15, False),
    "word_length": ("word_chars", "n_words", 2.0, True),
}
GAMMA = 1.01 / 0.99  # bucket borders; a quantile is off by a hundredth at most
ZERO = -100_000  # the bucket of 0


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    marks = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        marks = marks * np.uint64(0xD6E8FEB86659FD93) + mixed[i:len(words) - size + 1 + i]
    ordered = np.sort(marks)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal marks
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    often = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered[at] += 1
            covered[at + size if at + size <= len(words) else -1] -= 1
    return int((np.cumsum(covered)[:len(words)] > 0).sum())


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_word_lines, n_dup_lines, n_repeat_words; null text counts as empty."""
    names = ("n_words", "word_chars", "n_symbols", "n_word_lines", "n_dup_lines", "n_repeat_words")
    kept = docs.drop(*names)
    columns = [c for c in kept.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for t in texts_of(batch, text):
                words = t.encode().split()
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                rows.append((len(words), len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)),
                             len(lines), len(lines) - len(set(lines)), repeated_words(words)))
            yield pa.record_batch({c: batch.column(c) for c in columns} | {
                n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    return kept.mapInArrow(run, f"{ddl(kept.select(*columns))}, " + ", ".join(f"{n} long" for n in names))


def _value(measure: str) -> Column:
    over, under, _, _ = MEASURES[measure]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): the mergeable sketch of each measure per group."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _value(m).alias("value")) for m in MEASURES]))
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log("m.value") / math.log(GAMMA))).otherwise(ZERO).cast("int")
    return rows.select(*keys, each.alias("m")).where("m.value is not null").groupBy(
        *keys, F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """(keys, measure, size, one column per wanted quantile); a group has some thousand buckets at most."""
    group = Window.partitionBy(*keys, "measure")
    rows = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("size", F.sum("n").over(group))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), "bucket") / (GAMMA + 1))
    return rows.groupBy(*keys, "measure").agg(F.max("size").alias("size"), *[
        F.min(F.when(F.col("upto") >= q * F.col("size"), value)).alias(name) for name, q in wanted.items()])


def thresholds(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, least, most) for each language and source of ``rows``, null being a value too."""
    wanted = {"low": 0.25, "mid": 0.5}
    finest = saved(sketches(rows.withColumnsRenamed({lang: "lang", source: "source"}), ["lang", "source"]), "rule-sketches")
    by_source = quantiles(finest, ["lang", "source"], wanted)
    by_lang = quantiles(merged(finest, ["lang"]), ["lang"], wanted).select(
        F.col("lang").alias("l"), F.col("measure").alias("lm"), *[F.col(c).alias(f"l_{c}") for c in ("size", *wanted)])
    overall = quantiles(merged(finest, []), [], wanted).select(
        F.col("measure").alias("am"), *[F.col(c).alias(f"a_{c}") for c in ("size", *wanted)])
    joined = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm")), "left")
    joined = joined.join(overall, F.col("measure") == F.col("am"), "left")

    def level(name: str) -> Column:
        of_lang = (F.col("l_size") * F.col(f"l_{name}") + PRIOR * F.col(f"a_{name}")) / (F.col("l_size") + PRIOR)
        return (F.col("size") * F.col(name) + PRIOR * of_lang) / (F.col("size") + PRIOR)

    slack = F.create_map(*[F.lit(x) for m, (_, _, s, _) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    both = F.create_map(*[F.lit(x) for m, (_, _, _, b) in MEASURES.items() for x in (m, b)])[F.col("measure")]
    reach = F.greatest(SPREADS * (level("mid") - level("low")), slack)
    return joined.select("lang", "source", "measure", F.when(both, level("mid") - reach).alias("least"),
                         (level("mid") + reach).alias("most"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without ``text``, with the counts of ``measured`` and base_failed, failed (measures), kept.

    ``base_failed``: fewer than ten words, or over a fifth of them in repeated windows of five. ``kept``: neither
    that nor any measure outside its group's limits. A null or empty text fails; null languages and
    sources are groups like others. Repeated rows each come out; an empty table gives an empty table.
    """
    rows = saved(measured(docs.drop("base_failed", "failed", "kept"), text), "rule-counts")
    limits = thresholds(rows, lang, source).groupBy("lang", "source").agg(F.map_from_entries(
        F.collect_list(F.struct("measure", F.struct("least", "most")))).alias("_limits"))
    joined = rows.join(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}),
                       F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    outside = [
        F.when((_value(m) > F.col("_limits")[m]["most"]) | (_value(m) < F.coalesce(F.col("_limits")[m]["least"], F.lit(-1.0))),
               F.lit(m)) for m in MEASURES]
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = joined.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*outside)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lang", "_source", "_limits")
