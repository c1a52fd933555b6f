"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

File: data frames; a skippable frame with the document index; a skippable frame with the seek table, whose last 9 bytes
are the number of frames, a descriptor byte and a magic number, as in the published seekable zstandard format. A seek
table entry is compressed size, decompressed size and the low 32 bits of XXH64 of the decompressed bytes. Frames hold ids
of 16 bits where all fit, else of 32 bits; the index says which. A reader takes the tail, then only the frames of the
documents it wants.

A null text counts as empty: its one id is the end id. Null doc_ids come first. Rows of one doc_id follow in the order of
their texts' hashes; identical rows are interchangeable. An empty table gives no files and an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from hourloom.llm import store
from hourloom.llm.tokenize import default_file, encoder

#: Fixed values of the published seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_SKIPPABLE = 0x184D2A5D
#: Ids in a frame, and ids after which a new file begins.
FRAME_IDS, FILE_IDS = 1 << 16, 1 << 25


@dataclass
class Part:
    """A file being built: frames are compressed as they fill, so only one frame of ids is held."""

    end_id: int

    def __post_init__(self):
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.wide: list[int] = []
        self.ids: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.pending: list[bytes] = []
        self.held = 0
        self.total = 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4 + 1
        self.docs.append((doc_id or 0, doc_id is None, n))
        self.pending += [ids, struct.pack("<I", self.end_id)]
        self.held += n
        self.total += n
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self, last: bool = False) -> None:
        data = b"".join(self.pending)
        at = 0
        while len(data) - at >= 4 * FRAME_IDS or (last and at < len(data)):
            self.frame(np.frombuffer(data[at : at + 4 * FRAME_IDS], "<u4"))
            at += 4 * FRAME_IDS
        self.pending = [data[at:]] if at < len(data) else []
        self.held = max(0, len(data) - at) // 4

    def frame(self, ids: np.ndarray) -> None:
        wide = int(ids.max() > 0xFFFF)
        raw = ids.astype("<u4" if wide else "<u2").tobytes()
        packed = self.zstd.compress(raw)
        self.frames.append(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.wide.append(wide)
        self.ids.append(len(ids))

    def close(self) -> Iterator[bytes]:
        self.flush(last=True)
        yield from self.frames
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        index = zstandard.ZstdCompressor(level=3).compress(
            struct.pack("<QQ", len(self.frames), len(self.docs)) + bytes(self.wide) + np.array(self.ids, "<u4").tobytes() + docs.tobytes()
        )
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        yield struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index
        yield struct.pack("<II", SKIPPABLE, len(table)) + table


class Reader:
    """Random access to a token file by its tail."""

    def __init__(self, uri: str):
        fs, path = store.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table")
        table_at = size - 9 - 12 * n - 8
        self.entries = list(struct.iter_unpack("<III", self.file.read_at(12 * n, table_at + 8)))
        self.starts = np.concatenate(([0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)))
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX_SKIPPABLE:
            raise ValueError(f"{uri}: no document index")
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at + 8))
        frames, docs = struct.unpack_from("<QQ", index)
        self.wide = index[16 : 16 + frames]
        self.frame_ids = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<u4", frames, 16 + frames), dtype=np.int64)))
        table = np.frombuffer(index, "<i8", 3 * docs, 16 + 5 * frames).reshape(-1, 3)
        self.doc_ids = [None if null else int(d) for d, null in table[:, :2].tolist()]
        self.nulls, self.sorted_ids = int(table[:, 1].sum()), table[:, 0]  # null ids stand first
        self.n_tokens = table[:, 2]
        self.doc_starts = np.concatenate(([0], np.cumsum(self.n_tokens)))
        self.cached: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """Ids of frame k as little-endian 32-bit words; the last frame read is kept."""
        if self.cached[0] != k:
            size, raw_size, check = self.entries[k]
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=raw_size)
            if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum")
            self.cached = (k, raw if self.wide[k] else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
        return self.cached[1]

    def find(self, doc_id: int) -> int | None:
        """Place of the first document of an id, by bisection."""
        k = self.nulls + int(np.searchsorted(self.sorted_ids[self.nulls :], doc_id))
        return k if k < len(self.sorted_ids) and self.sorted_ids[k] == doc_id else None

    def doc(self, k: int) -> Iterator[bytes]:
        """The ids of the k-th document, by frame."""
        at, end = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
        f = int(np.searchsorted(self.frame_ids, at, "right")) - 1
        while at < end:
            first, stop = int(self.frame_ids[f]), min(end, int(self.frame_ids[f + 1]))
            yield self.frame(f)[4 * (at - first) : 4 * (stop - first)]
            at, f = stop, f + 1

    def close(self) -> None:
        self.file.close()


MANIFEST = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("roll", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
     T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType())]
)


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs' ids to files under path in ascending doc_id order; the manifest, in (part, roll) order."""
    spark = docs.sparkSession
    store.small_batches(spark)
    file = tokenizer or default_file()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll, enc = TaskContext.get().partitionId(), 0, encoder(file)
        out = Part(end_id)

        def done() -> pa.RecordBatch:
            n, total = len(out.docs), out.total
            uri = store.put_file(path, f"part-{part:06d}-{roll:04d}", out.close())
            named = [d for d, null, _ in out.docs if not null]
            row = {"part": part, "roll": roll, "path": uri, "n_docs": n, "n_tokens": total, "first_id": min(named, default=None), "last_id": max(named, default=None)}
            kinds = [("part", pa.int32()), ("roll", pa.int32()), ("path", pa.string()), *[(c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "last_id")]]
            return pa.RecordBatch.from_pylist([row], pa.schema(kinds))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                out.add(doc_id, ids)
                if out.total >= file_ids:
                    yield done()
                    out, roll = Part(end_id), roll + 1
        if out.docs:
            yield done()

    rows = docs.select("doc_id", "text")
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(store.shuffle_width(spark), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return store.materialise(dealt.mapInArrow(write, MANIFEST), "token-manifest")


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone; frames' checksums are verified."""
    before = W.orderBy("part", "roll").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(path)
                crc = []
                for k in range(len(reader.doc_ids)):
                    c = 0
                    for piece in reader.doc(k):
                        c = zlib.crc32(piece, c)
                    crc.append(c)
                reader.close()
                for k in range(0, len(crc), 8192):
                    e = min(k + 8192, len(crc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids[k:e], pa.int64()), pa.array(first + reader.doc_starts[k:e]), pa.array(reader.n_tokens[k:e]), pa.array(crc[k:e], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.repartition(store.shuffle_width(manifest.sparkSession)).mapInArrow(read, DIGESTS)


def tokens_of(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """One document's ids (end id included): the manifest says which files may hold it, and only its frames are decompressed. Of
    rows that share a doc_id the first is read."""
    for r in manifest.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "roll").select("path").collect():
        reader = Reader(r.path)
        try:
            k = reader.find(doc_id)
            if k is not None:
                return np.frombuffer(b"".join(reader.doc(k)), "<u4")
        finally:
            reader.close()
    return None
