"""Exact Jaccard join of word n-gram sets by universe partitions and the pigeonhole principle.

Sets of similar size share a band. In a band, shingles hash into m segments of the universe. Two sets that link differ in
at most H shingles, H following from the band's sizes; so with units of 1 for a segment that is compared as it is and 2 for
one that is compared up to one deletion, a set whose units exceed H shares at least one signature with every set it
links with. Which way a band's segments are compared follows from costs: segments of small sets are short and short
signatures are shared by chance, so small bands take few, long segments and their one-deletion neighbourhoods; for large
sets these would be many rows, so large bands take more segments as they are; for the smallest sets, where only so many
segments would do that hardly two shingles fall into one, each shingle is a segment of its own. Empty segments say nothing and
would be shared by everyone: bands get spare segments, so that sets can leave their empty ones out. Should a set still lack
units, its bands are signed again with more spares: no set is left to chance.

Where segments are compared as they are, a set with f full segments that may differ from its partners in d shingles shares
not one but f - d signatures with each, so its f - d - 1 most frequent signatures can be left out: by the order of
frequency, the rarest common signature is among the others on both sides.

Signatures are dealt by hash. In each group of rows with one signature, all are compared to the smallest id first, so a group
of n copies costs n comparisons; where groups then still join different components, their members are compared block by
block. Each comparison is first of parity masks, which bound how far two sets are apart; only pairs that these allow are
compared on the words themselves. A hub's partners are dealt to as many tasks as their number needs.

A signature's rows are 16 bytes each and pass a window, which spills: however frequent it is, it costs one task's time, not
memory. Rows with a null or blank text have an empty set and no links. Equal doc_ids are one document: their links are pooled.
Rows with a null doc_id have no identity: no links, null component. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.llm import store
from hourloom.llm.components import components

#: Sets up to about this size are compared by one-deletion neighbourhoods: an expected segment of 8 shingles against 3.
LOOSE_UPTO = 131
#: Ratio of a band's largest size to its smallest.
BAND_RATIO = 1.3
#: Partners of one hub that are compared in a task, about; tasks of a hub whose partners aren't counted.
CHUNK, CROSS_PARTS = 256, 16
#: Bytes of masks that stand in a chunk of a block, about.
CHUNK_BYTES = 4 << 20
#: Standard deviations of the number of full segments that bands allow for: a set lacks units about never, at any size of the
#: input, and a repeated pass stays the exception.
SLACK = 8.0
#: Bits of the filter that keeps texts that no pair needs out of the shuffle: 4 MB at most.
FILTER_BITS = 1 << 25
#: Words that a worker remembers the hash of, and texts that it remembers the digest of.
WORDS_KEPT, TEXTS_KEPT = 1_000_000, 1_000_000

#: Kinds of rows: below INFO a signature, by the number of its band.
INFO, SHARED, COPY, LACKING, DIGEST, GONE = 100, 101, 102, 103, 104, 105
#: A row's sig: its kind (for a signature, its band's number), then this many bits of hash.
SIG_BITS = 48
_LOW = (1 << SIG_BITS) - 1


def split_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() cuts at blank and 09-0D, as the word pattern does."""
    return text.lower().split()


def shingle_set(words: list[bytes], n: int) -> set[bytes]:
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def links(a: set[bytes], b: set[bytes], percent: int) -> bool:
    """100 * intersection >= percent * union, in integers; empty sets link with nothing."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % 2**64 | 1) for i in range(64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def hashed_set(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        k = np.arange(1, len(w) + 1, dtype=np.uint64)
        return mixed(np.array([(mixed(w) * (k * _MIX[0] | np.uint64(1))).sum() + np.uint64(len(w))], np.uint64))
    s = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        s += w[i : len(w) - n + 1 + i] * _odd[i]
    return np.unique(mixed(s))


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    bound: int  # most shingles by which sets that link differ, the smaller of them in this band
    segments: int  # none: each shingle is a segment of its own
    loose: int  # of these, the last ones are compared up to one deletion


def lacking_odds(size: int, segments: int, bound: int) -> float:
    """Upper bound, as a logarithm, of the chance that `size` hashed shingles give no more than `bound` units when a segment of one
    counts one and a fuller one counts two: the sum over numbers of wide and single segments that are too few."""
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    odds = [-math.inf]
    for wide in range(1, min(segments, bound // 2) + 1):
        for single in range(min(segments - wide, bound - 2 * wide, size - 2 * wide) + 1):
            ways = log_choose(segments, wide) + log_choose(segments - wide, single) + math.lgamma(size + 1) - math.lgamma(size - single + 1)
            odds.append(ways + (size - single) * math.log(wide) - size * math.log(segments))
    top = max(odds)
    return top + math.log(sum(math.exp(x - top) for x in odds)) if top > -math.inf else top


@lru_cache
def bands(percent: int, slack: float, largest: int = 1 << 31) -> list[Band]:
    """All bands, the same for each slack but for their segments; slack: how many standard deviations below its mean the number of
    full segments may be (for one-deletion segments, the chance that goes with it)."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * BAND_RATIO) - 1)
        # |A| + |B| - 2 I with I >= p U, |B| <= |A| / p
        bound = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
        m = loose = 0
        if not bound:
            m = 1
        elif high <= LOOSE_UPTO:
            m = next((m for m in range((bound + 1) // 2 + 1, high + 1) if lacking_odds(low, m, bound) <= -slack * slack / 2), 0)
            loose = m
        else:
            k = bound + 1
            while not m and k < 4 * high:
                # Full segments of the band's smallest sets: mean and variance of an occupancy count.
                one, two = (1 - 1 / k) ** low, max(0.0, 1 - 2 / k) ** low
                mean, var = k * (1 - one), k * (k - 1) * two + k * one - (k * one) ** 2
                if mean - slack * math.sqrt(max(var, 0.1)) >= bound + 1:
                    m = k
                k += 1 + k // 64
        out.append(Band(len(out), low, high, bound, m, loose))
        low = high + 1
    return out


class Signer:
    """Signatures of a hashed set, for its own band and those of smaller partners."""

    def __init__(self, percent: int, slack: float, only: frozenset[int] | None = None):
        self.percent, self.only = percent, only
        self.bands = bands(percent, slack)
        self.lows = np.array([b.low for b in self.bands])

    def sign(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(band, signatures, least number of them shared with a partner) for each band; below 1, units are lacking."""
        n = len(s)
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        first = int(np.searchsorted(self.lows, -(-n * self.percent // 100), "right")) - 1
        token = mixed(s * _MIX[0])
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(token, dtype=np.uint64)))
        high32 = s >> np.uint64(32)
        for band in self.bands[first : own + 1]:
            if self.only is not None and band.number not in self.only:
                continue
            most = min(band.high, n) if band.number < own else 100 * n // self.percent
            bound = (n + most) * (100 - self.percent) // (100 + self.percent)
            salt = np.uint64((band.number + 1) * int(_MIX[2]) % 2**64)
            if not band.segments:
                yield band.number, np.unique(mixed(token + salt)), n - bound
                continue
            m = band.segments
            segment = (high32 * np.uint64(m)) >> np.uint64(32)  # grows with the hash, so segments are runs
            cuts = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
            size = np.diff(cuts)
            total = upto[cuts[1:]] - upto[cuts[:-1]]
            key = np.arange(m, dtype=np.uint64) * _MIX[1] + salt
            full = size > 0
            sigs = mixed(total[full] + key[full])
            if band.loose:
                wide = np.flatnonzero(size > 1)
                units = int(full.sum()) + len(wide)
                inside = np.isin(segment, wide.astype(np.uint64))
                at = segment[inside].astype(np.int64)
                yield band.number, np.unique(np.concatenate((sigs, mixed(total[at] - token[inside] + key[at])))), int(units > band.bound)
            else:
                yield band.number, np.unique(sigs), int(full.sum()) - bound


ROWS = "sig long, id long, val long"


def keyed(kind: int, hashes: np.ndarray) -> np.ndarray:
    """Row keys of a kind: signatures of different bands never meet."""
    return ((hashes & np.uint64(_LOW)) | np.uint64(kind << SIG_BITS)).view(np.int64)


def kind_of(sig: Column) -> Column:
    return F.shiftright(sig, SIG_BITS)


def signature_rows(docs: DataFrame, n: int, percent: int, slack: float, only: frozenset[int] | None = None) -> DataFrame:
    """Rows (sig, id, val). Signatures have val 0; the others go by kind: INFO the size of a row's set, SHARED a band and the least
    number of signatures shared there, COPY an equal text seen before in the partition, DIGEST a text's digest, LACKING a band
    in which a set lacks units. only: bands to sign; then there are no INFO, COPY and DIGEST rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hashes, seen = Signer(percent, slack, only), WordHashes(), {}
        for batch in batches:
            sigs, ids, vals = [], [], []

            def put(kind, hashed, doc_id, val=0):
                sigs.append(keyed(kind, hashed))
                ids.append(np.full(len(hashed), doc_id, np.int64))
                vals.append(np.full(len(hashed), val, np.int64))

            for doc_id, text in zip(batch.column(0).to_pylist(), store.text_bytes(batch), strict=True):
                if doc_id is None:
                    continue
                own = np.array([xxhash.xxh3_64_intdigest(b"%d" % doc_id)], np.uint64)
                digest = hashlib.sha256(text or b"").digest()
                first, size = seen.get(digest, (None, 0))
                if first is None:
                    s = hashed_set(split_words(text or b""), n, hashes)
                    size = len(s)
                    if len(seen) >= TEXTS_KEPT:
                        seen.clear()
                    seen[digest] = (doc_id, size)
                    if size:
                        if only is None:
                            a, b = struct.unpack("<Qq", digest[:16])
                            put(DIGEST, np.array([a], np.uint64), doc_id, b)
                        for band, sig, shared in signer.sign(s):
                            put(band, sig, doc_id)
                            put(SHARED, own, doc_id, (band << 32) + max(1, shared))
                            if shared < 1:
                                put(LACKING, own, doc_id, band)
                elif size and first != doc_id and only is None:
                    put(COPY, own, doc_id, first)
                if only is None:
                    put(INFO, own, doc_id, size)
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, ids, vals)], ["sig", "id", "val"])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def shared_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of signature_rows with df, how many rows have the same sig: signatures and digests only where another id has them.

    A band in which some set lacks units is signed again with more spare segments, that band alone.
    """
    by = W.partitionBy("sig")
    slack, only, parts = SLACK, None, []
    while True:
        rows = signature_rows(docs, n, percent, slack, only)
        rows = rows.withColumn("hub", F.min("id").over(by)).withColumn("top", F.max("id").over(by)).withColumn("df", F.count("*").over(by))
        alone = kind_of(F.col("sig")).isin(INFO, SHARED, COPY, LACKING)
        now = store.materialise(rows.where(alone | (F.col("hub") < F.col("top"))).drop("hub", "top"), "shared-signatures")
        kind = kind_of(F.col("sig"))
        lacking = frozenset(r.val for r in now.where(kind == LACKING).select("val").distinct().collect())  # numbers of bands
        band = F.when(kind < INFO, kind).when(kind == SHARED, F.shiftright("val", 32))
        parts.append(now.where((kind != LACKING) & ~F.coalesce(band.isin(*lacking), F.lit(False))) if lacking else now)
        if not lacking:
            return reduce(DataFrame.unionByName, parts)
        only, slack = lacking, slack * 2


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """n_shingles of rows without a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = WordHashes()
            sizes = [len(hashed_set(split_words(t or b""), n, hashes)) for t in store.text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n_shingles"])

    return docs.select("text").mapInArrow(run, "n_shingles long")


def id_filter(ids: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap of hashed ids, of bounded size however many there are."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("p"))
    return bits.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def suspects(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """row (struct of docs' columns), doc_id, maybe: whether a row's doc_id may be among ids(id); false is certain. The bitmap that
    says so is built and broadcast by Spark, so no text is shuffled for it."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id").withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("at", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(bits, int(at div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.col("bits").isNotNull() & (byte.bitwiseAND(F.expr("shiftleft(1, int(at % 8))")) != 0)
    return rows.join(F.broadcast(id_filter(ids)), "bucket", "left").select("row", "doc_id", F.coalesce(hit, F.lit(False)).alias("maybe"))


def needed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows whose doc_id is in ids(id), and of a few others."""
    return suspects(docs.select("doc_id", "text"), ids).where("maybe").select("doc_id", "row.text")


def mask_bits(size: int) -> int:
    return max(64, 1 << (2 * size - 1).bit_length())


def mask(s: np.ndarray) -> bytes:
    """Parities of a set: bit k says whether an odd number of its hashes end in k. The parities of two sets differ in no more
    bits than the sets differ in shingles, and unlike plain bit sets they don't fill up. Bits grow with the set."""
    bits = mask_bits(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """A mask, and folded to half its bits."""

    def __init__(self, data: bytes):
        self.bits, self.own = 8 * len(data), int.from_bytes(data, "little")
        half = self.bits // 2
        self.half = (self.own >> half) ^ (self.own & ((1 << half) - 1))

    def may_link(self, size: int, other: Parities, other_size: int, percent: int) -> bool:
        """Whether the sizes and masks of two sets allow a link; sets whose masks are further apart than one fold can't link."""
        if 100 * min(size, other_size) < percent * max(size, other_size):
            return False
        if self.bits == other.bits:
            apart = self.own ^ other.own
        elif self.bits == 2 * other.bits:
            apart = self.half ^ other.own
        else:
            apart = self.own ^ other.half
        return apart.bit_count() * (100 + percent) <= (size + other_size) * (100 - percent)


def set_masks(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, n, mask of the rows that needed_texts gives; written once. Only masks are shuffled, never their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [hashed_set(split_words(t or b""), n, hashes) for t in store.text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([mask(s) for s in sets], pa.binary())], ["doc_id", "n", "mask"])

    return store.materialise(needed_texts(docs, ids).mapInArrow(run, "doc_id long, n long, mask binary"), "masks")


PAIRS = "a long, b long, parts int"


def meet(pairs: DataFrame, table: DataFrame, read: Callable, test: Callable) -> DataFrame:
    """The pairs(a, b, parts) that pass test(read(row of a), read(row of b)), with table's rows found by doc_id.

    A hub's partners are dealt to `parts` tasks; each has the hub's own rows once and streams the partners past them.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    heads = dealt.select("a", "parts", "part", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    rows = heads.union(dealt.select("a", "parts", "part", F.col("b").alias("id"), F.lit(1).alias("role")))
    names = [c for c in table.columns if c != "doc_id"]
    rows = rows.join(table, rows["id"] == table["doc_id"]).select("a", "parts", "part", "role", "id", *names)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("parts", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            found = []
            for a, parts, part, role, id_, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (a, parts, part):
                    key, heads = (a, parts, part), []
                x = read(*own)
                if role == 0:
                    heads.append(x)
                elif any(test(h, x) for h in heads):
                    found.append({"a": a, "b": id_, "parts": parts})
            yield pa.RecordBatch.from_pylist(found, schema)

    width = store.shuffle_width(pairs.sparkSession)
    return rows.repartition(width, "a", "parts", "part").sortWithinPartitions("a", "parts", "part", "role").mapInArrow(run, PAIRS)


def by_masks(pairs: DataFrame, masks: DataFrame, percent: int) -> DataFrame:
    """The pairs that masks allow."""
    return meet(pairs, masks, lambda n, m: (n, Parities(m)), lambda x, y: x[1].may_link(x[0], y[1], y[0], percent))


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link, by their words."""
    pairs = store.materialise(pairs.groupBy("a", "b").agg(F.max("parts").alias("parts")), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = store.materialise(needed_texts(docs, ids), "need-texts")
    found = meet(pairs, texts, lambda t: shingle_set(split_words((t or "").encode()), n), lambda x, y: links(x, y, percent))
    return store.materialise(found.distinct(), "links")


def cross_pairs(masks: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, parts) of different components that masks allow, among open_(sig, id, comp): groups that join several components.

    Groups with one smallest component form a block, so two sets that share a signature meet in a block however many they
    share. A block stands in chunks of bounded size; the masks of its other members stream past each later chunk.
    """
    hub = F.min("comp").over(W.partitionBy("sig"))
    members = open_.select(hub.alias("hub"), "id", "comp").distinct()
    members = store.materialise(members.join(masks, members["id"] == masks["doc_id"]).select("hub", "id", "comp", "n", "mask"), "blocks")
    sizes = members.groupBy("hub").agg(F.ceil(F.sum(F.octet_length("mask") + 256) / CHUNK_BYTES).alias("chunks"))
    members = members.join(sizes, "hub").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    stand = members.select("hub", "chunk", F.lit(0).alias("role"), "id", "comp", "n", "mask")
    later = F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))
    passing = members.where(F.col("chunk") + 1 < F.col("chunks")).select("hub", later.alias("chunk"), F.lit(1).alias("role"), "id", "comp", "n", "mask")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("parts", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for hub, chunk, role, id_, comp, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (hub, chunk):
                    key, held = (hub, chunk), []
                own = Parities(data)
                for other, other_comp, other_size, m in held:
                    if comp != other_comp and own.may_link(size, m, other_size, percent):
                        found.append({"a": other, "b": id_, "parts": CROSS_PARTS})
                if role == 0:
                    held.append((id_, comp, size, own))
            yield pa.RecordBatch.from_pylist(found, schema)

    dealt = stand.union(passing).repartition(store.shuffle_width(masks.sparkSession), "hub", "chunk")
    return dealt.sortWithinPartitions("hub", "chunk", "role").mapInArrow(run, PAIRS)


def parts_of(count: Column) -> Column:
    """Into how many tasks a hub with so many partners is dealt: a power of two, so that counts which differ a little agree."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.ceil(count / CHUNK))))).cast("int")


def open_signatures(kept: DataFrame, copies: DataFrame) -> DataFrame:
    """sig, id, hub, df of the signatures that candidates are looked for by: without copies that an equal text stands for, and of
    large sets without the most frequent ones."""
    kind = kind_of(F.col("sig"))
    band = F.when(kind < INFO, kind).when(kind == SHARED, F.shiftright("val", 32)).otherwise(F.lit(-1))
    gone = copies.select(F.lit(GONE << SIG_BITS).alias("sig"), F.col("b").alias("id"), F.lit(0).cast("long").alias("val"), F.lit(0).cast("long").alias("df")).distinct()
    rows = kept.where((kind < INFO) | kind.isin(INFO, SHARED)).unionByName(gone).withColumn("band", band)
    # One shuffle by id; a row's band and what is known of its id meet in windows. Ids with several rows keep all their signatures.
    each, mine = W.partitionBy("id"), W.partitionBy("id", "band")
    again = F.count_if(kind == INFO).over(each) > 1
    is_copy = F.count_if(kind == GONE).over(each) > 0
    shared = F.min(F.when(kind == SHARED, F.col("val").bitwiseAND(F.lit((1 << 32) - 1)))).over(mine)
    rank = F.row_number().over(mine.orderBy(kind >= INFO, "df", "sig"))
    rows = rows.select("sig", "id", again.alias("again"), is_copy.alias("is_copy"), shared.alias("shared"), rank.alias("rank"), F.count_if(kind < INFO).over(mine).alias("all"))
    rows = rows.where((kind_of(F.col("sig")) < INFO) & (F.col("again") | (~F.col("is_copy") & (F.col("rank") <= F.col("all") - F.col("shared") + 1))))
    by = W.partitionBy("sig")
    rows = rows.select("sig", "id", F.min("id").over(by).alias("hub"), F.max("id").over(by).alias("top"), F.count("*").over(by).alias("df"))
    return store.materialise(rows.where(F.col("hub") < F.col("top")).drop("top"), "signatures")


def join_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when the Jaccard similarity of their word n-gram sets
    is at least percent / 100; component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    store.small_batches(spark)
    with store.scratch(spark):
        kept = shared_rows(docs, n, percent)
        kind = kind_of(F.col("sig"))
        info = kept.where(kind == INFO).select(F.col("id").alias("doc_id"), F.col("val").alias("n_shingles"))
        # Texts of one digest (112 bits of SHA-256) are copies: the smallest id stands for the others.
        same = W.partitionBy("sig", "val")
        copies = kept.where(kind == DIGEST).select(F.min("id").over(same).alias("a"), F.col("id").alias("b"), parts_of(F.count("*").over(same)).alias("parts")).where("a < b")
        copies = store.materialise(copies, "copies")
        seen = kept.where(kind == COPY).select(F.col("val").alias("a"), F.col("id").alias("b"), F.lit(CROSS_PARTS).alias("parts"))
        signed = open_signatures(kept, copies)
        masks = set_masks(docs, signed.select("id").distinct(), n)
        first = signed.where(F.col("id") > F.col("hub")).groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.max(parts_of(F.col("df"))).alias("parts"))
        edges = store.materialise(seen.unionByName(copies).unionByName(verify(docs, by_masks(first, masks, percent), n, percent)), "links")
        labels = components(edges)
        # Groups whose members are not yet one component: their other pairs.
        ends, by = labels.withColumnRenamed("id", "node"), W.partitionBy("sig")
        named = signed.join(ends, signed["id"] == ends["node"], "left").select("sig", "id", F.coalesce("comp", "id").alias("comp"))
        open_ = named.withColumn("low", F.min("comp").over(by)).withColumn("high", F.max("comp").over(by)).where(F.col("low") < F.col("high"))
        open_ = store.materialise(open_.select("sig", "id", "comp"), "open-groups")
        more = verify(docs, cross_pairs(masks, open_, percent), n, percent)
        labels = components(edges.unionByName(more), labels)
        ends = labels.withColumnRenamed("id", "node")
        out = info.join(ends, (info["doc_id"] == ends["node"]) & (info["n_shingles"] > 0), "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
        lost = docs.where(F.col("doc_id").isNull())
        nameless = set_sizes(lost, n).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
        return store.keep(out.unionByName(nameless), "components")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs less the rows that have a smaller doc_id in their component; of rows that repeat a doc_id the one with the smallest
    hash of all its columns stays. Rows that surely stay are neither joined nor shuffled."""
    found = join_components(docs, n, percent)
    per = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("component_id") < F.col("doc_id")).alias("gone"), F.count("*").alias("rows"))
    special = store.materialise(per.where("gone or rows > 1"), "not-kept-as-they-are")
    rows = suspects(docs, special)
    sure = rows.where("not maybe").select("row.*")
    open_ = rows.where("maybe").join(special, F.col("doc_id") == F.col("id"), "left").where("gone is null or not gone")
    alone = open_.where("rows is null or rows = 1").select("row.*")
    once = open_.where("rows > 1").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return sure.unionByName(alone).unionByName(once)
