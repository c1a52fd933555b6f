"""Benchmark decontamination by a positional inverted index of the training documents.

The index has every word of the documents, so one serves any benchmark. It is partitioned by document: a row holds a block of documents and, per term, the ascending positions of the term
in the block. It is written once. A search sends the benchmark's windows to every block, takes the positions of a window's
rarest term (by its frequency in the whole corpus) as candidate places, and intersects them with the offset-adjusted
positions of the window's other terms, the next rarest first. What is left are exact phrases; with a slop, positions may
be off by as many words, which gives proximity matches.

Null and empty texts have no words. An item without words has no window. Items that share an item_id are one item. A document
is a row, so repeated rows are judged each by itself. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import store

#: Word bytes: 0-9, a-z (A-Z are lower-cased) and all of non-ASCII characters; others become blanks.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Words in a block of the index, about.
BLOCK_WORDS = 500_000
#: Bytes of benchmark text that are searched at once; a larger benchmark takes several searches of the same index. A plan takes some 130
#: times its text on the driver (measured: 125 MB for 0.96 MB) and some 30 times as a broadcast.
SEARCH_BYTES = 1 << 20
#: Longer words are hashed anew each time instead of being remembered.
LONGEST_KEPT = 64

INDEX = "block string, doc_ids array<long>, digests array<long>, starts binary, terms array<long>, counts array<int>, positions binary"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def term_of(word: bytes) -> int:
    """A term's key: a signed 64-bit hash, never 0."""
    return (xxhash.xxh3_64_intdigest(word) - (1 << 63)) or 1


class Terms(dict):
    """Word -> term; forgets all when it has grown large, which is at most some 200 MB."""

    def __missing__(self, word: bytes) -> int:
        t = term_of(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) > 1_000_000:
                self.clear()
            self[word] = t
        return t


def digest(text: bytes | None) -> int:
    """Equal to Spark's xxhash64 of the string; tells apart rows that repeat a doc_id."""
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (1 << 64) if h >> 63 else h


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs, over all their words: any benchmark can be searched in it."""
    store.small_batches(docs.sparkSession)

    def block(name: str, ids: list, digests: list, sizes: list, parts: list) -> pa.RecordBatch:
        # A gap of one position after each document keeps windows inside documents.
        starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1))).astype("<i4")
        terms = np.concatenate(parts) if parts else np.empty(0, np.int64)
        at = np.flatnonzero(terms)
        order = at[np.argsort(terms[at], kind="stable")]
        found, counts = np.unique(terms[order], return_counts=True)
        row = [[name], [ids], [digests], [starts.tobytes()], [found], [counts.astype(np.int32)], [order.astype("<i4").tobytes()]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = ["block", "doc_ids", "digests", "starts", "terms", "counts", "positions"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms, part, nth = Terms(), TaskContext.get().partitionId(), 0
        ids, digests, sizes, parts, words = [], [], [], [], 0
        gap = np.zeros(1, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), store.text_bytes(batch), strict=True):
                own = split_words(text or b"")
                ids.append(doc_id)
                digests.append(digest(text))
                sizes.append(len(own))
                parts += [np.fromiter(map(terms.__getitem__, own), np.int64, len(own)), gap]
                words += len(own) + 1
                if words >= BLOCK_WORDS:
                    yield block(f"{part}-{nth}", ids, digests, sizes, parts)
                    ids, digests, sizes, parts, words, nth = [], [], [], [], 0, nth + 1
        if ids:
            yield block(f"{part}-{nth}", ids, digests, sizes, parts)

    return store.materialise(docs.select("doc_id", "text").mapInArrow(run, INDEX), "postings")


def windows_of(items: list[tuple], length: int) -> dict[tuple[int, ...], set[str]]:
    """Each distinct window's terms and the item_ids that hold it; an item of fewer words is one window."""
    out: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        terms = [term_of(w) for w in split_words((text or "").encode())]
        for k in range(max(1, len(terms) - length + 1) if terms else 0):
            out.setdefault(tuple(terms[k : k + length]), set()).add("" if item_id is None else str(item_id))
    return out


@dataclass
class Plan:
    """Windows with their offsets in the order in which a search looks at them: the rarest term first. terms: all of theirs, sorted."""

    windows: list[tuple[int, ...]]
    items: list[list[str]]
    orders: list[list[int]]
    by_anchor: dict[int, list[int]]
    terms: np.ndarray


def plan_search(windows: dict[tuple[int, ...], set[str]], frequency: dict[int, int]) -> Plan:
    """Windows with a term that the corpus lacks occur nowhere and are left out."""
    plan = Plan([], [], [], {}, np.empty(0, np.int64))
    for terms, items in windows.items():
        if all(frequency.get(t) for t in terms):
            order = sorted(range(len(terms)), key=lambda k: (frequency[terms[k]], k))
            plan.by_anchor.setdefault(terms[order[0]], []).append(len(plan.windows))
            plan.windows.append(terms)
            plan.items.append(sorted(items))
            plan.orders.append(order)
    plan.terms = np.array(sorted({t for w in plan.windows for t in w}), np.int64)
    return plan


def near(sorted_at: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of wanted have an element of sorted_at within slop."""
    k = np.searchsorted(sorted_at, wanted - slop)
    return (k < len(sorted_at)) & (sorted_at[np.minimum(k, len(sorted_at) - 1)] <= wanted + slop)


def search_block(plan: Plan, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, exact starts, proximity starts) for each window that matches; terms of a block are sorted."""
    cuts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    _, at, _ = np.intersect1d(terms, plan.terms, assume_unique=True, return_indices=True)
    lists = {int(terms[k]): positions[cuts[k] : cuts[k + 1]].astype(np.int64) for k in at.tolist()}
    for anchor in plan.by_anchor.keys() & lists.keys():
        for w in plan.by_anchor[anchor]:
            own, order = plan.windows[w], plan.orders[w]
            if any(t not in lists for t in own):
                continue
            loose = lists[anchor] - order[0]
            exact = loose
            for k in order[1:]:
                if slop and len(loose):
                    loose = loose[near(lists[own[k]], loose + k, slop)]
                if len(exact):
                    exact = exact[near(lists[own[k]], exact + k, 0)]
                if not len(exact) and not (slop and len(loose)):
                    break
            loose = loose if slop else exact
            if len(exact) or len(loose):
                yield w, exact, loose


#: Per document: its place in the index, number of words, and merged hit ranges (position, end) with the items they come from.
FOUND = "block string, nth int, doc_id long, digest long, n_words long, ranges array<int>, items array<string>, near_items array<string>"


def search(index: DataFrame, plan: Plan, slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        # A block at a time; batches are bounded by their bytes, and lists are read in place.
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            own = {name: row.column(k)[0] for k, name in enumerate(row.schema.names)}
            starts, positions = np.frombuffer(own["starts"].as_buffer(), "<i4").astype(np.int64), np.frombuffer(own["positions"].as_buffer(), "<i4")
            terms, counts = own["terms"].values.to_numpy(), own["counts"].values.to_numpy()
            block, doc_ids, digests = own["block"].as_py(), own["doc_ids"].values, own["digests"].values
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            close: dict[int, set[str]] = {}
            for w, exact, loose in search_block(plan, terms, counts, positions, slop):
                length = len(plan.windows[w])
                for at, d in zip(exact.tolist(), (np.searchsorted(starts, exact, "right") - 1).tolist(), strict=True):
                    hits.setdefault(d, []).append((at - int(starts[d]), at - int(starts[d]) + length))
                    items.setdefault(d, set()).update(plan.items[w])
                for d in set((np.searchsorted(starts, np.maximum(loose, 0), "right") - 1).tolist()):
                    close.setdefault(d, set()).update(plan.items[w])
            n = len(doc_ids)
            sizes = np.diff(starts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * n), pa.array(range(n), pa.int32()), doc_ids, digests, pa.array(sizes),
                    pa.array([merge_ranges(hits.get(d, [])) for d in range(n)], pa.list_(pa.int32())),
                    pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    pa.array([sorted(close.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                ],
                ["block", "nth", "doc_id", "digest", "n_words", "ranges", "items", "near_items"],
            )

    return index.mapInArrow(run, FOUND)


def merge_ranges(ranges: list[tuple[int, int]]) -> list[int]:
    """Flat list of disjoint ranges that cover the same positions."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_blocks(benchmark: DataFrame, blocks: int) -> Iterator[list[tuple]]:
    """The items' texts in blocks of about SEARCH_BYTES, each small enough for the driver and a broadcast by that count; texts of
    one item may be in several."""
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()]


def frequencies(index: DataFrame, terms: set[int]) -> dict[int, int]:
    """How often each of the terms stands in the whole corpus; other terms leave before anything is shuffled."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "wanted long")
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    sums = each.join(F.broadcast(wanted), F.col("term") == F.col("wanted"), "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in sums.collect()}


def matches(docs: DataFrame, benchmark: DataFrame, length: int = 13, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), n_words, ranges, items, near_items for each row of docs. index: of docs, if there is one."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // SEARCH_BYTES + 1
    index = build_index(docs) if index is None else index
    found = None
    for items in benchmark_blocks(benchmark, blocks):
        windows = windows_of(items, length)
        part = search(index, plan_search(windows, frequencies(index, {t for w in windows for t in w})), slop)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("block", "nth", "doc_id", "digest", "n_words").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
        found = found.mapInArrow(_merge_blocks, FOUND.replace("block string, nth int, ", ""))
    return found.select("doc_id", "digest", "n_words", "ranges", "items", "near_items")


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the ranges that several searches found in a document."""
    for batch in batches:
        rows = batch.drop_columns(["block", "nth"])
        flat = [merge_ranges(list(zip(r[::2], r[1::2], strict=True))) for r in rows.column("ranges").to_pylist()]
        yield rows.set_column(rows.schema.get_field_index("ranges"), "ranges", pa.array(flat, pa.list_(pa.int32())))


def judge(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256, n_near_items and contaminated: at least one word of one_in is hit."""
    hit = F.expr("aggregate(sequence(1, greatest(size(ranges), 1)), 0L, (s, k) -> s + if(k % 2 = 0, ranges[k - 1] - ranges[k - 2], 0))")
    return found.select(
        "doc_id", "digest", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), F.size("near_items").cast("long").alias("n_near_items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, length: int = 13, one_in: int = 20) -> DataFrame:
    """docs less the contaminated rows, found again by doc_id and the text's digest."""
    with store.scratch(docs.sparkSession):
        bad = judge(matches(docs, benchmark, length), one_in).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
        bad = store.keep(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_digest"]), "left_anti").select(docs.columns)
