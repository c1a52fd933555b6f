"""Lines that stand in many documents, dropped but for one document each.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys are hashed to 128 bits; a shuffle counts documents by hash, and
the hashes found often enough are dealt to shards by size. Each shard gets a minimal perfect hash (levels of bit arrays; a
key's place is the rank of its bit) that indexes three compact arrays: fingerprints, counts, and the largest document. Shards are
files in the shared folder, named by a manifest. Documents don't meet lines in a join: each task reads its texts in rounds of bounded
size, looks all of a round's lines up shard by shard, and keeps or drops them in place, so no text is shuffled.

Lines in too few documents never enter the index; a fingerprint of 64 bits beside a place from 64 other bits tells them from those
that do, so two different keys count as one only if all 128 bits agree.

A null or empty text is one empty line. Each row is a document: repeated rows and doc_ids count as often as they stand. A null doc_id is
below all others; rows that share the largest doc_id keep their lines, as does a document that repeats a line. Equal keys with other
blanks or letter cases are one key. Texts of any length are worked on whole. Tables may be empty; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import store

#: Code points of a key that counts, and documents that it is found in.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys in a shard (some 20 bytes each), bytes of shards that a task keeps, and of texts that it looks up at a time.
SHARD_KEYS, KEPT_BYTES, ROUND_BYTES = 1 << 17, 64 << 20, 64 << 20
#: Bits for each key of a level.
SPACE = 2
BLANKS = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def hash_keys(lines: list[bytes], least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in lines, their keys' hashes as pairs of 64-bit numbers) of the lines whose keys are long enough."""
    at, out = [], []
    for k, line in enumerate(lines):
        if len(line) >= least_chars:
            key = line.strip(BLANKS).lower()
            # A key has at least as many bytes as code points; only where it has other bytes than ASCII, these are counted.
            if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
                at.append(k)
                out.append(xxhash.xxh3_128_digest(key))
    return np.array(at, np.int64), np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def _level_place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: in each level, those alone at their place have their bit set, the others go
    on to the next level; a number's index is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            size = -(-max(SPACE * len(keys), 64) // 64) * 64
            place = _level_place(keys, len(sizes), size)
            counts = np.bincount(place.astype(np.int64), minlength=size)
            words.append(np.packbits((counts == 1).astype(np.uint8), bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[counts[place.astype(np.int64)] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; of numbers that aren't keys any index, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + _level_place(keys[left], level, int(size)).astype(np.int64)
            word, at = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> at) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << at) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (self.ranks[bit >> 6] + below)[here]
            left = left[~here]
        return out


class Shard:
    """The perfect hash of some keys and their arrays: fingerprint, count of documents, largest doc_id."""

    KINDS = (np.int64, np.uint64, np.uint64, np.int64, np.int64)

    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays
        self.hash = PerfectHash(*arrays[:2])
        self.prints, self.counts, self.last = arrays[2:]

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        found = PerfectHash.of(low)
        order = np.argsort(found.index(low))
        return cls(found.sizes, found.bits, high[order], counts[order], last[order])

    def to_bytes(self) -> bytes:
        return b"".join([np.array([a.size for a in self.arrays], np.int64).tobytes(), *[a.tobytes() for a in self.arrays]])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        sizes, at, arrays = np.frombuffer(data, np.int64, len(cls.KINDS)), 8 * len(cls.KINDS), []
        for kind, size in zip(cls.KINDS, sizes, strict=True):
            arrays.append(np.frombuffer(data, kind, int(size), at))
            at += 8 * int(size)
        return cls(*arrays)

    def look_up(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is indexed, its largest doc_id)."""
        at = self.hash.index(low)
        known = at >= 0
        known[known] = self.prints[at[known]] == high[known]
        return known, np.where(known, self.last[np.where(known, at, 0)] if len(self.last) else 0, 0)


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(33)) % np.uint64(shards)


def _hashes(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
            found = [np.unique(hash_keys(split_lines(t), least_chars)[1], axis=0) for t in store.text_bytes(batch)]
            hashes = np.concatenate([np.zeros((0, 2), np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.repeat(ids, [len(f) for f in found]))], ["low", "high", "at"])

    return run


def line_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """low, high, n, last: hashes of keys that at least so many documents have, the number of these and the largest doc_id."""
    store.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at"), "text")
    hashed = rows.mapInArrow(_hashes(least_chars), "low long, high long, at long")
    return hashed.groupBy("low", "high").agg(F.count("*").alias("n"), F.max("at").alias("last")).where(F.col("n") >= least_docs)


def build_index(counts: DataFrame) -> dict[int, str]:
    """Write a file for each shard of line_counts(); returns where each shard is: a few rows, one for SHARD_KEYS keys."""
    spark = counts.sparkSession
    counts = store.materialise(counts, "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    folder = store.new_path(spark, "line-index")

    def write(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        own = Shard.of(column("low").view(np.uint64), column("high").view(np.uint64), column("n"), column("last"))
        shard = table.column("shard")[0].as_py()
        uri = store.put_file(folder, f"shard-{shard}", iter([own.to_bytes()]))
        return pa.table({"shard": pa.array([shard], pa.int64()), "uri": [uri]})

    dealt = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 33), F.lit(shards)).cast("long"))
    written = store.materialise(dealt.groupBy("shard").applyInArrow(write, "shard long, uri string"), "line-manifest")
    return {"shards": shards, **{r["shard"]: r["uri"] for r in written.toLocalIterator()}}


class Index:
    """Shards by number, read when asked for; the least recently used go when those kept exceed KEPT_BYTES."""

    def __init__(self, manifest: dict):
        self.manifest, self.kept, self.size = manifest, OrderedDict(), 0

    def shard(self, k: int) -> Shard | None:
        if k in self.kept:
            self.kept.move_to_end(k)
        elif k in self.manifest:
            fs, path = store.filesystem(self.manifest[k])
            with fs.open_input_stream(path) as f:
                data = f.read()
            self.kept[k] = (len(data), Shard.from_bytes(data))
            self.size += len(data)
            while self.size > KEPT_BYTES and len(self.kept) > 1:
                self.size -= self.kept.popitem(last=False)[1][0]
        else:
            return None
        return self.kept[k][1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is indexed, its largest doc_id) for pairs of hashes; each shard is read once."""
        known, last = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        dealt = shard_of(hashes[:, 1], self.manifest["shards"]).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        numbers, first = np.unique(dealt[order], return_index=True)
        for k, at in zip(numbers, np.split(order, first[1:]), strict=True):
            shard = self.shard(int(k))
            if shard is not None:
                known[at], last[at] = shard.look_up(hashes[at, 0], hashes[at, 1])
        return known, last


def _rounds(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, own = 0, []
    for batch in batches:
        own.append(batch)
        held += batch.nbytes
        if held >= size:
            yield own
            held, own = 0, []
    if own:
        yield own


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines (before), n_dropped for each row of docs."""
    spark = docs.sparkSession
    manifest = spark.sparkContext.broadcast(build_index(line_counts(docs, least_chars, least_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(manifest.value)
        for own in _rounds(batches, ROUND_BYTES):
            ids = [np.array([NO_ID if i is None else i for i in store.texts(b, "doc_id")], np.int64) for b in own]
            # Only hashes of a round are held beside its batches, not its lines.
            hashed = [[hash_keys(split_lines(t), least_chars) for t in store.text_bytes(b)] for b in own]
            known, last = index.look_up(np.concatenate([np.zeros((0, 2), np.uint64), *[h for rows in hashed for _, h in rows]]))
            at = 0
            for batch, own_ids, rows in zip(own, ids, hashed, strict=True):
                kept, lines_of, dropped_of = [], [], []
                for text, i, (places, h) in zip(store.text_bytes(batch), own_ids, rows, strict=True):
                    lines, n = split_lines(text), len(h)
                    drop = places[known[at : at + n] & (last[at : at + n] != i)]
                    at += n
                    if len(drop):
                        gone = set(drop.tolist())
                        text = b"\n".join(line for k, line in enumerate(lines) if k not in gone)
                    kept.append(text or b"")
                    lines_of.append(len(lines))
                    dropped_of.append(len(drop))
                columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")
