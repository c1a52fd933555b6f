"""Links of each document in the n-gram Jaccard join: how many other documents its set is similar to.

Links never leave a component, so the join's components are the blocks of a second pass. Equal texts are one class with a number
of rows; classes of a component meet chunk by chunk. A task holds one chunk as an inverted index of hashed shingles and streams
the other past it: an intersection size for every pair, no pair written, only each class's sum. Chunks grow with the root of
their component, so that a large one is repeated less often, up to a bound of memory. Time is quadratic in the distinct texts
of a component, as an exact count is; it is spread over tasks.

Sets are sets of 64-bit hashes of their shingles; these are compared in integers: 100 * intersection >= percent * union. Two shingles
of one document count as one where their hashes agree, by chance of one in 10^19 a pair.

A row's links are the other rows with a doc_id that its text links with, equal texts included. Rows that share a doc_id are
one document: theirs are added up, one another's included. Null and blank texts and null doc_ids have 0. Tables may be empty; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import store
from hourloom.llm.ngram_join import TEXTS_KEPT, WordHashes, hashed_set, join_components, needed_texts, split_words

#: Bytes of hashed sets in a chunk: at least, at most; between them the root of least / 4 times the component's.
LEAST_CHUNK, MOST_CHUNK = 1 << 20, 32 << 20
#: Bytes that a class takes besides its set.
EXTRA = 256

SUMS = pa.schema([("key", pa.binary()), ("links", pa.int64())])


def text_classes(texts: DataFrame, n: int) -> DataFrame:
    """doc_id, key (128 bits of the text's SHA-256), n, set (hashes as bytes) of rows with a set; null where the task has had an equal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for batch in batches:
            ids, keys, sizes, sets = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), store.text_bytes(batch), strict=True):
                key = hashlib.sha256(text or b"").digest()[:16]
                size, own = seen.get(key), None
                if size is None:
                    if len(seen) >= TEXTS_KEPT:
                        seen.clear()
                    s = hashed_set(split_words(text or b""), n, hashes)
                    seen[key] = size = len(s)
                    own = s.tobytes()
                if size:
                    ids.append(doc_id)
                    keys.append(key)
                    sizes.append(size)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "key", "n", "set"]
            )

    return texts.mapInArrow(run, "doc_id long, key binary, n long, set binary")


class Chunk:
    """Classes of a block, and an inverted index of their hashed sets: which of them link with a set."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.rows: list[int] = []
        self.sets: list[np.ndarray] = []

    def add(self, key: bytes, rows: int, s: np.ndarray) -> None:
        self.keys.append(key)
        self.rows.append(rows)
        self.sets.append(s)

    def build(self) -> None:
        self.weights, self.sums = np.array(self.rows, np.int64), np.zeros(len(self.rows), np.int64)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.values, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        first, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return 100 * both >= percent * (self.sizes + len(s) - both)


def compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sums by class of the linked classes' rows, from (comp, i, j, role, key, rows, set) sorted by the first four: chunk i has role 0,
    chunk j streams past it with role 1; where they are one, it meets itself."""
    block, chunk, seen, built = None, Chunk(), set(), False

    def sums() -> pa.RecordBatch:
        if chunk.keys and not built:
            chunk.build()
        if block and block[1] == block[2]:
            for k, s in enumerate(chunk.sets):
                chunk.sums[k] = chunk.weights[chunk.linked(s, percent)].sum() - chunk.rows[k]
        return pa.RecordBatch.from_arrays([pa.array(chunk.keys, pa.binary()), pa.array(chunk.sums if chunk.keys else [], pa.int64())], schema=SUMS)

    for batch in batches:
        found = []
        for comp, i, j, role, key, rows, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != (comp, i, j):
                yield sums()
                block, chunk, seen, built = (comp, i, j), Chunk(), set(), False
            if (role, key) in seen:  # a row that is stored twice may bring its set twice
                continue
            seen.add((role, key))
            s = np.frombuffer(data, np.uint64)
            if role == 0:
                chunk.add(key, rows, s)
            elif chunk.keys:
                if not built:
                    chunk.build()
                    built = True
                hit = chunk.linked(s, percent)
                chunk.sums[hit] += rows
                found.append({"key": key, "links": int(chunk.weights[hit].sum())})
        yield pa.RecordBatch.from_pylist(found, SUMS)
    yield sums()


def class_sums(classes: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """key, links: rows of other classes that link. classes: comp, key, rows, n, rep (whose row in table has the set)."""
    several = classes.groupBy("comp").agg(F.count("*").alias("members"), F.sum(8 * F.col("n") + EXTRA).alias("bytes")).where("members > 1")
    size = F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(LEAST_CHUNK), F.sqrt(F.col("bytes") * (LEAST_CHUNK / 4))))
    several = several.select("comp", F.ceil(F.col("bytes") / size).alias("chunks"))
    dealt = classes.join(several, "comp").withColumn("own", F.pmod(F.xxhash64("key"), "chunks"))
    sets = table.where("set is not null").select(F.col("doc_id").alias("rep"), "key", "set")
    dealt = dealt.join(sets, ["key", "rep"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("comp", i.alias("i"), j.alias("j"), (F.col("own") > i).cast("int").alias("role"), "key", "rows", "set")
    dealt = dealt.repartition(store.shuffle_width(table.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "role")
    return dealt.mapInArrow(lambda batches: compare(batches, percent), "key binary, links long").groupBy("key").agg(F.sum("links").alias("links"))


def join_with_counts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """join_components' columns and n_links."""
    spark = docs.sparkSession
    store.small_batches(spark)
    with store.scratch(spark):
        found = join_components(docs, n, percent)
        own = found.where("doc_id is not null and n_shingles > 0")
        several = own.groupBy(F.col("component_id").alias("comp")).agg(F.count("*").alias("members")).where("members > 1")
        linked = own.join(several, own["component_id"] == several["comp"]).select(F.col("doc_id").alias("id"), "comp").distinct()
        linked = store.materialise(linked, "linked")
        table = store.materialise(text_classes(needed_texts(docs, linked.select("id")), n), "text-classes")
        rows = store.materialise(
            table.select("doc_id", "key", "n", F.col("set").isNotNull().alias("held")).join(linked, F.col("doc_id") == F.col("id")).drop("id"), "class-rows"
        )
        classes = rows.groupBy("comp", "key").agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.min(F.when(F.col("held"), F.col("doc_id"))).alias("rep"))
        classes = store.materialise(classes, "classes")
        # A class of very many rows makes this join's one side uneven, in rows of 24 bytes; adaptive execution splits it.
        each = classes.join(class_sums(classes, table, percent), "key", "left").select("key", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
        per = rows.select("doc_id", "key").join(each, "key").groupBy(F.col("doc_id").alias("id")).agg(F.sum("links").alias("n_links"))
        out = found.join(per, found["doc_id"] == per["id"], "left").select(*found.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        return store.keep(out, "link-counts")
