"""Divergence of sources: how the word use of each source differs from its language's and from other sources'.

Each partition folds whole documents into stripes, one per (language, term): the number of documents that have the term,
and its count per source. A partition whose stripes outgrow ``MOST_CELLS`` hands them on and starts anew. The
parts of a stripe meet by (language, term), sorted, and merge one after the other. Merged stripes of terms in
at least ``MIN_DOCS`` documents then give the divergences of their terms to all sources of the language at once.

Shares are in billionths, smoothed: p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N the count of all kept terms in
the group, V the number of kept terms of the language. All arithmetic is on whole numbers, exact up to 9 * 10**15 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import saved, slices

MIN_DOCS = 30
ADDED = 5
SCALE_STEPS = (1000, 1000, 1000)  # their product is the scale of a share
TOP = 50
# Cells (a count of a source in a stripe) that a partition holds before it hands its stripes on.
MOST_CELLS = 1_000_000
SOURCE_BITS = 31
# Terms that meet all sources of their language in one group; fewer where there are very many sources.
GROUP_TERMS, GROUP_CELLS = 4096, 1 << 22
# Letters A-Z once lower-cased, and every byte of a character beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


class _Numbers(dict):
    """The terms of a language to their numbers; a term met for the first time gets the next one."""

    def __init__(self, lang: int, terms: list[bytes], langs: list[int]) -> None:
        self.lang, self.terms, self.langs = lang, terms, langs

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self.terms)
        self.terms.append(term)
        self.langs.append(self.lang)
        return number


class Stripes:
    """Stripes of the documents seen so far: a hash of terms, and per term its documents and its count per source."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.terms: list[bytes] = []
        self.langs: list[int] = []
        self.numbers: dict[str, _Numbers] = {}
        self.sources: dict[str, int] = {}
        self.df = np.zeros(0, np.int64)
        # Cells as (term number and source number in one, count): sorted ones first, then those of the last slices.
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.cells = 0

    def add(self, langs: list[str], sources: list[str], texts: list[str]) -> None:
        """Fold a slice of whole documents."""
        found, of = [], []
        for lang, source, text in zip(langs, sources, texts):
            numbers = self.numbers.get(lang)
            if numbers is None:
                numbers = self.numbers[lang] = _Numbers(len(self.numbers), self.terms, self.langs)
            words = TERM.findall(text.encode().lower())  # lower() of bytes touches A-Z only
            found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            of.append(self.sources.setdefault(source, len(self.sources)))
        n = len(found)
        pairs, counts = np.unique(np.concatenate(found) * n + np.repeat(np.arange(n), [len(f) for f in found]), return_counts=True)
        term, doc = np.divmod(pairs, n)
        df = np.bincount(term, minlength=len(self.terms))
        df[:len(self.df)] += self.df
        self.df = df
        self.parts.append(_summed((term << SOURCE_BITS) | np.array(of, np.int64)[doc], counts))
        self.cells += len(self.parts[-1][0])
        if self.cells > 2 * len(self.parts[0][0]) + 100_000:
            self._compact()

    def _compact(self) -> None:
        self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.cells = len(self.parts[0][0])

    def emptied(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """Hand on all stripes and hold none."""
        self._compact()
        (codes, counts), terms = self.parts[0], pa.array(self.terms, pa.binary()).cast(pa.string())
        langs = pa.array(list(self.numbers), pa.string()).take(pa.array(self.langs, pa.int64()))
        sources, df = pa.array(list(self.sources), pa.string()), self.df
        self._clear()
        starts = np.searchsorted(codes, np.arange(len(terms) + 1) << SOURCE_BITS)
        for low in range(0, len(terms), rows):
            high = min(low + rows, len(terms))
            cells = slice(starts[low], starts[high])
            yield _stripe_batch(langs[low:high], terms[low:high], df[low:high], starts[low:high + 1] - starts[low],
                                sources.take(pa.array(codes[cells] & ((1 << SOURCE_BITS) - 1))), counts[cells])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes together, sorted, their counts added."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts[order], starts)


def _stripe_batch(langs: pa.Array, terms: pa.Array, df: np.ndarray, offsets: np.ndarray, sources: pa.Array,
                  counts: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(offsets, pa.int32())
    return pa.record_batch({
        "lang": langs, "term": terms, "df": pa.array(df, pa.int64()),
        "sources": pa.ListArray.from_arrays(ends, sources), "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))})


def fold(batches: Iterator[pa.RecordBatch], most_cells: int = MOST_CELLS) -> Iterator[pa.RecordBatch]:
    """Partition to partial stripes."""
    stripes = Stripes()
    for batch in slices(batches):
        stripes.add(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")))
        if stripes.cells >= most_cells:
            yield from stripes.emptied()
    yield from stripes.emptied()


def _merged(table: pa.Table, starts: np.ndarray, df: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """The stripes of some ``groups`` of rows of equal keys, which begin at ``starts``."""
    sizes = np.diff(np.r_[starts, table.num_rows])
    chosen = np.zeros(len(starts), bool)
    chosen[groups] = True
    rows = table.filter(pa.array(np.repeat(chosen, sizes))).combine_chunks()
    group = np.repeat(np.arange(len(groups)), sizes[groups])
    sources = rows["sources"].combine_chunks()
    lengths = np.diff(sources.offsets.to_numpy())
    names = sources.flatten().dictionary_encode()
    codes, counts = _summed(
        (np.repeat(group, lengths) << SOURCE_BITS) | names.indices.to_numpy().astype(np.int64),
        rows["counts"].combine_chunks().flatten().to_numpy())
    first = pa.array(starts[groups])
    offsets = np.searchsorted(codes, np.arange(len(groups) + 1) << SOURCE_BITS)
    return _stripe_batch(table["lang"].take(first).combine_chunks(), table["term"].take(first).combine_chunks(), df[groups],
                         offsets, names.dictionary.take(pa.array(codes & ((1 << SOURCE_BITS) - 1))), counts)


def merge(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted partial stripes to whole ones; only those of terms in ``min_docs`` documents go on.

    The last key of a batch may go on in the next: what there is of it is merged and goes before the next batch.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held.cast(batch.schema), batch]).combine_chunks()
        lang, term = table["lang"].combine_chunks(), table["term"].combine_chunks()
        apart = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        starts = np.flatnonzero(np.r_[True, apart.to_numpy(zero_copy_only=False)])
        df = np.add.reduceat(table["df"].to_numpy(), starts)
        whole = np.flatnonzero(df[:-1] >= min_docs)
        if len(whole):
            yield _merged(table, starts, df, whole)
        held = _merged(table, starts, df, np.array([len(starts) - 1]))
    if held is not None and held.column("df")[0].as_py() >= min_docs:
        yield held


def stripes(docs: DataFrame, min_docs: int = MIN_DOCS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Whole stripes (lang, term, df, sources, counts) of the terms in at least ``min_docs`` documents of a language."""
    parts = docs.mapInArrow(lambda batches: fold(batches, most_cells), STRIPE)
    met = parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return met.mapInArrow(lambda batches: merge(batches, min_docs), STRIPE)


def shares(counts: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """p of each count: long division, so that nothing overflows."""
    rest, of = counts + ADDED, total + ADDED * kept
    p = np.ones(np.broadcast(rest, of).shape, np.int64)
    whole, rest = np.divmod(rest, of)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, of)
        whole = whole * step + more
    return p + whole


def emit(stripes: pa.Table, groups: pa.Table, top: int = TOP) -> list[tuple[str, str, list[str], np.ndarray]]:
    """Divergences of a block of merged stripes as (source, part, items, values): per pair of sources the sum over the
    block's terms, the smaller source first; per source its first terms.

    ``groups`` are all sources of the language, with their totals.
    """
    groups, stripes = groups.sort_by("source"), stripes.sort_by("term")
    names, terms = groups["source"].to_pylist(), stripes["term"].to_pylist()
    if not names:
        return []
    kept, of_lang = np.int64(groups["kept"][0].as_py()), np.int64(groups["lang_n"][0].as_py())
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(terms), len(names)), np.int64)
    for row, (sources, values) in enumerate(zip(stripes["sources"].to_pylist(), stripes["counts"].to_pylist())):
        counts[row, [place[s] for s in sources]] = values
    p = shares(counts, groups["n"].to_numpy(), kept) if terms else counts
    above = p - shares(counts.sum(axis=1), of_lang, kept)[:, None] if terms else counts

    found = []
    for i, name in enumerate(names):
        apart = np.abs(p[:, i + 1:] - p[:, i:i + 1]).sum(axis=0)
        over = np.flatnonzero((counts[:, i] > 0) & (above[:, i] > 0))
        # Terms are in order, so that of equal values the smaller terms come first.
        over = over[np.argsort(-above[over, i], kind="stable")[:top]]
        found.append((name, "pair", names[i + 1:], apart))
        found.append((name, "term", [terms[k] for k in over], above[over, i]))
    return found


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents with one language and source.

    Part ``pair`` has a row for every other source of the language: the sum over all kept terms of the
    absolute difference of their shares. Part ``term`` has the ``top`` terms that a source uses more than its
    language does, by how much. Null lang, source and text count as the empty text; a group without kept terms is
    there with all its pairs, which a language without any kept term gives the value 0. Ranks go by value, largest first,
    then by the item's bytes. A source that is alone in its language has no pair. Repeated rows count each time.
    An empty table gives no rows. Other columns of ``docs`` take no part, whatever their names.

    A language's sources with their totals are in every task that works on its stripes, as the result has a row
    for each pair of them; documents, terms and stripes are never together in a task.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    merged = saved(stripes(plain, min_docs, most_cells), "divergence-stripes")

    cells = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    used = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    langs = used.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(
        merged.groupBy("lang").agg(F.count("*").alias("kept")), "lang")
    groups = plain.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "kept")])
    # How many blocks the terms of a language are dealt over.
    size = F.count("*").over(Window.partitionBy("lang"))
    terms = F.greatest(F.lit(256), F.least(F.lit(GROUP_TERMS), F.floor(F.lit(GROUP_CELLS) / size)))
    groups = saved(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / terms))), "divergence-groups")

    blocks = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    dealt = merged.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    asked = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = emit(left, right, top)
        source, part = ([f[k] for f in found for _ in f[2]] for k in (0, 1))
        items, values = [i for f in found for i in f[2]], [f[3] for f in found] or [np.zeros(0, np.int64)]
        text = pa.string()
        return pa.table({"lang": pa.array([key[0].as_py()] * len(items), text), "source": pa.array(source, text),
                         "part": pa.array(part, text), "item": pa.array(items, text), "value": pa.array(np.concatenate(values))})

    found = dealt.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(
        work, "lang string, source string, part string, item string, value long")
    found = saved(found, "divergence-parts")
    # Both ways of each pair; a term has been in one block only.
    both = found.where("part = 'pair'").select("lang", "source", "part", "item", "value").unionByName(
        found.where("part = 'pair'").select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    return ranked(both, found.where("part = 'term'"), top)


def ranked(pairs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    summed = pairs.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return summed.withColumn("rank", rank).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
