"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

The store is a folder of tables:

* ``refs``: one row (key, doc_id, change) per line key of each document put in (+1) or taken out (-1).
  From it come the exact counts of a key: its live documents, and the largest of them, which keeps it.
* ``filters``: per shard of the keys, a cuckoo filter of the frequent ones. A batch of documents moves
  only keys of its own into or out of them; a shard without room is made anew from the counts.

A document's lines are first asked of the filters. What they let through, nearly only frequent keys,
meets the exact counts; so a line is dropped by an exact count, never by a filter alone.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import ddl, saved, slices, texts_of
from roadpulse.llm.cuckoo import CuckooFilter, Full
from roadpulse.session import shared_dir

BLANK = b" \t\n\v\f\r"
SHORTEST = 40
MIN_DOCS = 5
SHARDS = 64
# Filters of more bytes in all are not sent to the tasks; every key then meets the exact counts.
MOST_FILTER_BYTES = 64_000_000
SHARD_OF = "cast(conv(hex(substring(key, 15, 2)), 16, 10) as int) % {shards}"
REFS = "key binary, doc_id long, change int, batch int"
FILTERS = "shard int, held binary, version int"


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """128 bits that stand for a line: stripped, A-Z lower-cased. None for a line that is too short."""
    plain = line.strip(BLANK).lower()
    if len(plain) < shortest or (not plain.isascii() and len(plain.decode()) < shortest):
        return None
    return hashlib.md5(plain, usedforsecurity=False).digest()


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)


class LineStore:
    """Line counts over documents that come and go.

    ``insert`` takes documents not in the store, ``delete`` ids of some that are, and ``apply`` drops
    the lines of documents in the store: each line whose key has at least ``shortest`` code points and is in at
    least ``min_docs`` of the store's documents, except in the largest doc_id that holds the key. Two
    rows of one doc_id count as one document. Rows without doc_id are not counted and lose nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shortest: int = SHORTEST,
                 min_docs: int = MIN_DOCS, shards: int = SHARDS):
        self.spark, self.shortest, self.min_docs, self.shards = spark, shortest, min_docs, shards
        self.path = path or shared_dir(spark, "line-store")
        self.batch, self.version = self._last("refs", "batch"), self._last("filters", "version")

    def _last(self, table: str, number: str) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(hadoop)]
        return max([int(n.split("=")[1]) for n in names if n.startswith(f"{number}=")], default=0)

    def _keys(self, docs: DataFrame, text: str, doc: str, filters: dict[int, bytes] | None = None) -> DataFrame:
        """(doc_id, key) for the distinct line keys of each row, or for those that ``filters`` let through."""
        shortest, shards = self.shortest, self.shards
        sent = None if filters is None else self.spark.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None if sent is None else {s: CuckooFilter.read(b) for s, b in sent.value.items()}
            for batch in slices(batches):
                keys = [list({k for line in t.encode().split(b"\n") if (k := line_key(line, shortest))})
                        for t in texts_of(batch)]
                rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                flat = list(itertools.chain.from_iterable(keys))
                if held is not None and flat:
                    halves = _halves(flat)
                    shard = (halves[:, 1] & np.uint64(0xFFFF)).astype(np.int64) % shards
                    passed = np.zeros(len(flat), bool)
                    for s in np.unique(shard).tolist():
                        if s in held:
                            at = np.flatnonzero(shard == s)
                            passed[at] = held[s].holds(halves[at])
                    rows, flat = rows[passed], [flat[i] for i in np.flatnonzero(passed).tolist()]
                if flat:
                    yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(rows)),
                                           "key": pa.array(flat, pa.binary())})

        rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, key binary")

    def refs(self) -> DataFrame:
        if not self.batch:
            return self.spark.createDataFrame([], REFS)
        return self.spark.read.schema(REFS).parquet(f"{self.path}/refs")

    def counts(self, refs: DataFrame | None = None) -> DataFrame:
        """(key, n_docs, keeper) of every live key."""
        live = (self.refs() if refs is None else refs).groupBy("key", "doc_id").agg(F.sum("change").alias("change"))
        return live.where("change > 0").groupBy("key").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def frequent(self, refs: DataFrame | None = None) -> DataFrame:
        return self.counts(refs).where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame, text: str = "text", doc: str = "doc_id") -> None:
        self._add(self._keys(docs, text, doc).select("key", "doc_id", F.lit(1).alias("change")))

    def delete(self, ids: DataFrame, doc: str = "doc_id") -> None:
        """Take documents out again. Ids that are not in the store change nothing."""
        gone = ids.select(F.col(doc).cast("long").alias("doc_id")).distinct()
        there = self.refs().join(gone, "doc_id", "left_semi").groupBy("key", "doc_id").agg(
            F.sum("change").alias("change")).where("change > 0")
        self._add(there.select("key", "doc_id", (-F.col("change")).cast("int").alias("change")))

    def _add(self, rows: DataFrame) -> None:
        first = not self.batch
        number = self.batch + 1
        rows.select("key", "doc_id", "change").write.mode("overwrite").parquet(f"{self.path}/refs/batch={number}")
        self.batch = number
        if first:
            moved = self.frequent().select("key", F.lit(True).alias("add"))
        else:
            refs = self.refs()
            touched = refs.where(F.col("batch") == number).select("key").distinct()
            mine = refs.join(touched, "key", "left_semi")
            now = self.frequent(mine).select("key", F.lit(True).alias("now"))
            old = self.frequent(mine.where(F.col("batch") < number)).select("key", F.lit(True).alias("old"))
            moved = now.join(old, "key", "full").where("now is null or old is null").select(
                "key", F.col("now").isNotNull().alias("add"))
        self._move(moved)

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, held binary")
        return self.spark.read.schema("shard int, held binary").parquet(f"{self.path}/filters/version={self.version}")

    def _move(self, moved: DataFrame) -> None:
        """Bring the filters up to date with keys that became frequent or ceased to be."""
        shard = F.expr(SHARD_OF.format(shards=self.shards))

        def update(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            new, gone = keys.key[keys["add"]].tolist(), keys.key[~keys["add"]].tolist()
            mine = CuckooFilter.read(held.held.iloc[0]) if len(held) else CuckooFilter.sized(len(new))
            at = int((held if len(held) else keys).shard.iloc[0])
            try:
                mine.remove(_halves(gone))
                mine.insert(_halves(new))
            except Full:
                return pd.DataFrame({"shard": [at], "held": [None]})
            return pd.DataFrame({"shard": [at], "held": [mine.bytes()]})

        def anew(keys: pd.DataFrame) -> pd.DataFrame:
            room = len(keys)
            while True:
                mine = CuckooFilter.sized(room)
                try:
                    mine.insert(_halves(keys.key.tolist()))
                    return pd.DataFrame({"shard": [int(keys.shard.iloc[0])], "held": [mine.bytes()]})
                except Full:
                    room *= 2

        made = self.filters().groupBy("shard").cogroup(moved.withColumn("shard", shard).groupBy("shard")).applyInPandas(
            update, "shard int, held binary")
        target = f"{self.path}/filters/version={self.version + 1}"
        tried = f"{self.path}/tried/version={self.version + 1}"
        made.write.mode("overwrite").parquet(tried)
        done = self.spark.read.schema("shard int, held binary").parquet(tried)
        full = done.where("held is null").select("shard")
        rebuilt = self.frequent().withColumn("shard", shard).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(
            anew, "shard int, held binary") if full.head(1) else done.where("false")
        done.where("held is not null").union(rebuilt).coalesce(8).write.mode("overwrite").parquet(target)
        self.version += 1

    def maybe_frequent(self, docs: DataFrame, text: str, doc: str) -> DataFrame:
        """(doc_id, key) rows that the filters let through; all rows, if the filters are too large to send."""
        filters = self.filters()
        size = filters.agg(F.coalesce(F.sum(F.octet_length("held")), F.lit(0))).first()[0]
        if size > MOST_FILTER_BYTES:
            return self._keys(docs, text, doc)
        return self._keys(docs, text, doc, {r.shard: bytes(r.held) for r in filters.collect()})

    def apply(self, docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
        """``docs`` with the dropped lines gone from ``text``, and n_lines, n_dropped added.

        A null text becomes the empty text: one empty line. Other columns stay; columns named
        n_lines or n_dropped are replaced. Repeated rows each come out.
        """
        asked = self.maybe_frequent(docs, text, doc)
        # Written first: as a table of its own it leaves a key that many documents hold to be split in the join.
        frequent = saved(self.frequent().select("key", "keeper"), "line-frequent")
        drops = asked.join(frequent, "key").where("doc_id <> keeper").groupBy(
            F.col("doc_id").alias("_doc")).agg(F.collect_set("key").alias("_drops"))
        docs = docs.drop("n_lines", "n_dropped", "_doc", "_drops")
        joined = docs.join(drops, F.col(doc).cast("long") == F.col("_doc"), "left").drop("_doc")
        fields = docs.schema.fields
        schema = f"{ddl(docs)}, n_lines long, n_dropped long"
        shortest = self.shortest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                kept, n_lines, n_dropped = [], [], []
                for t, drop in zip(texts_of(batch, text), batch.column("_drops").to_pylist()):
                    lines = t.encode().split(b"\n")
                    drop = set(drop or ())
                    left = [x for x in lines if line_key(x, shortest) not in drop] if drop else lines
                    kept.append(b"\n".join(left).decode() if drop else t)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                columns = {f.name: batch.column(f.name) for f in fields} | {text: pa.array(kept, pa.string())}
                yield pa.record_batch(columns | {"n_lines": pa.array(n_lines, pa.int64()),
                                                 "n_dropped": pa.array(n_dropped, pa.int64())})

        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", **settings) -> DataFrame:
    """Put all documents in a new store and drop their lines by it."""
    store = LineStore(docs.sparkSession, **settings)
    store.insert(docs, text, doc)
    return store.apply(docs, text, doc)
