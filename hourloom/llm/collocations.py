"""Phrase collocations: phrases of two to five words that stand together more often than their parts let expect.

Rabin-Karp in numpy: prefix polynomials over a chunk's bytes give each word a 64-bit hash, prefix polynomials over these give every
n-gram of words its fingerprint, with its language and length mixed in. One pass a length: a task sums what it has seen, then a shuffle
sums by fingerprint. As a phrase is no more frequent than its parts, an n-gram is only shuffled if a bitmap has both its shorter n-grams
as frequent; the bitmap has a fixed size, and what it lets through in error is counted and then dropped. The pass of the next length
also brings, for the frequent fingerprints alone, a document in which each occurs as its pointer. Texts are read again only for the
documents that pointers name, to materialise the frequent phrases.

Collisions: with the pointer comes a second, independent fingerprint of each occurrence, the least and the greatest; a group in which
these differ holds several phrases and is counted again by its words themselves. Arithmetic on counts is decimal, so it is exact for
products of up to 38 digits.

A null text is empty, a null language is `und`. Repeated rows and doc_ids count as often as they stand; rows without a doc_id count too.
Texts of any length are worked on in windows that cut no phrase. Equal scores order by count and then by the phrase's bytes. Tables may
be empty; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.llm import ngram_join, store

#: Words of the longest phrase, least occurrences, rows a language.
LONGEST, LEAST, ROWS = 5, 100, 2000
#: Bits of the bitmap of frequent fingerprints (8 MB), whatever the corpus.
BITMAP = 1 << 26
#: Bytes that are hashed at a time, and occurrences that a task holds before it sums them up.
WINDOW, HELD = 1 << 20, 2_000_000
#: Rows that go from a task to Spark at a time.
SENT = 1 << 16
#: Groups that a language's phrases are dealt to before its first rows are chosen.
SALTS = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(BREAKS)] = 2
_AHEAD = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (LONGEST - 1))
_STOP = re.compile(rb"[ \t.,;:!?\n-\r]")


#: Added to a fingerprint by its number of words.
_LENGTHS = np.arange(64, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)


class Polynomial:
    """Hashes modulo 2^64 of stretches of a sequence: differences of prefix sums, brought to a common power by the base's inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                own = np.full(n, base, np.uint64)
                own[0] = 1
                setattr(self, name, np.multiply.accumulate(own))

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of values[start:end] for each start and end."""
        self._powers(len(values) + 1)
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * self.down[starts]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Two independent fingerprints; `bits` of the first are kept (fewer than 64 only in tests, to make collisions)."""

    def __init__(self, bits: int = 64):
        self.kinds = [(Polynomial(0x9E3779B97F4A7C15), Polynomial(0xD1342543DE82EF95), 11), (Polynomial(0xDA942042E4DD58B5), Polynomial(0xAF251AF3B0F025B5), 12)]
        self.mask = np.uint64((1 << bits) - 1)
        self.seeds: dict[str, list[np.uint64]] = {}

    def seed(self, lang: str) -> list[np.uint64]:
        if lang not in self.seeds:
            self.seeds[lang] = [np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=k)) for *_, k in self.kinds]
        return self.seeds[lang]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        values = data.astype(np.uint64) + np.uint64(1)
        return [_mix(by_byte.of(values, starts, ends)) for by_byte, _, _ in self.kinds]

    def grams(self, words: list[np.ndarray], seeds: list[np.ndarray], n: int, at: np.ndarray, kind: int = 0) -> np.ndarray:
        """Fingerprints of the n words from each place `at` on; seeds: of each place's language."""
        own = self.kinds[kind][1].of(words[kind], at, at + n) + seeds[kind] + _LENGTHS[n]
        return _mix(own) & self.mask if kind == 0 else _mix(own)


def segments(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """(segment, bytes of it whose words it owns): cut between pieces, or within a long piece before a word, with the next words as
    a tail that the next segment owns."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b, at, at + size) for b in (BREAKS[k : k + 1] for k in range(len(BREAKS))))
        if cut > at:
            yield text[at:cut], cut - at
            at = cut + 1
            continue
        cut = max(text.rfind(b, at, at + size) for b in (b" ", b"\t"))
        if cut <= at:
            found = _STOP.search(text, at + size)
            cut = found.start() if found else len(text)
        yield text[at : _AHEAD.match(text, cut).end()], cut - at
        at = cut
    yield text[at:], len(text) - at


class Chunk:
    """Some segments' words: hashes, pieces, documents, and whether a segment owns them."""

    def __init__(self, parts: list[tuple[int, bytes, int]], langs: list[str], prints: Fingerprints):
        self.text = b"\n".join(p[1] for p in parts)
        self.prints = prints
        data = np.frombuffer(self.text, np.uint8)
        kind = _KIND[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([1], kind, [1])) == 0))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        lengths = np.fromiter((len(p[1]) + 1 for p in parts), np.int64, len(parts))
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        part = np.searchsorted(heads, self.starts, "right") - 1
        self.owned = self.starts < (heads + np.fromiter((p[2] for p in parts), np.int64, len(parts)))[part]
        self.row = np.fromiter((p[0] for p in parts), np.int64, len(parts))[part]
        seeds = np.array([prints.seed(x) for x in langs], np.uint64).reshape(-1, 2)
        self.seeds = [seeds[self.row, k] for k in (0, 1)]
        self.words = prints.words(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def places(self, n: int) -> np.ndarray:
        """Where n owned words of one piece begin."""
        if len(self) < max(n, 1):
            return np.zeros(0, np.int64)
        if n < 2:
            return np.flatnonzero(self.owned)
        return np.flatnonzero((self.piece[n - 1 :] == self.piece[: len(self) - n + 1]) & self.owned[: len(self) - n + 1])

    def grams(self, n: int, at: np.ndarray, kind: int = 0) -> np.ndarray:
        return self.prints.grams(self.words, [s[at] for s in self.seeds], n, at, kind)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.text[s:e] for s, e in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)).decode()


def chunks(batch: pa.RecordBatch, prints: Fingerprints, size: int = WINDOW) -> Iterator[Chunk]:
    """The batch's documents (columns text and lang) in chunks; Chunk.row is the row in the batch."""
    langs = ["und" if x is None else x for x in store.texts(batch, "lang")]
    parts: list[tuple[int, bytes, int]] = []
    held = 0
    for k, text in enumerate(store.text_bytes(batch)):
        for segment, owned in segments((text or b"").lower(), size):
            parts.append((k, segment, owned))
            held += len(segment) + 1
            if held >= size:
                yield Chunk(parts, langs, prints)
                parts, held = [], 0
    if parts:
        yield Chunk(parts, langs, prints)


class Sums:
    """What a task has seen of n-grams of so many words, summed up in numpy by fingerprint: occurrences (n), or what tells collisions and
    points to documents (low and high of the second fingerprint, at)."""

    NAMES = ("n", "low", "high", "at")

    def __init__(self, words: int, *names: str):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.words, self.names, self.size = words, names, 0

    def add(self, fp: np.ndarray, *columns: np.ndarray) -> None:
        if len(fp):
            self.held.append((fp, *columns))
            self.size += len(fp)

    def sum_up(self) -> tuple[np.ndarray, ...]:
        """Column by column, each given up as it is brought together, so that a worker never has all of them twice."""
        columns = [list(c) for c in zip(*self.held, strict=True)][::-1]
        self.held = []
        fp = np.concatenate(columns.pop())
        order = np.argsort(fp)
        fp = fp[order]
        first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
        own = [fp[first]]
        del fp
        ways = {"n": np.add, "low": np.minimum, "high": np.maximum, "at": np.minimum}
        for name in self.names:
            own.append(ways[name].reduceat(np.concatenate(columns.pop())[order], first))
        self.held, self.size = [tuple(own)], len(first)
        return self.held[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All that is summed up, SENT rows at a time; nothing stays."""
        fp, *columns = self.sum_up()
        self.held, self.size = [], 0
        for k in range(0, len(fp), SENT):
            part = slice(k, k + SENT)
            n, known = len(fp[part]), {name: pa.array(c[part]) for name, c in zip(self.names, columns, strict=True)}
            rest = [known[name] if name in known else pa.nulls(n, pa.int64()) for name in self.NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.words, np.int32)), pa.array(fp[part].view(np.int64)), *rest], ["words", "fp", *self.NAMES])


def _has(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp & np.uint64(BITMAP - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _counter(n: int, longest: int, shorter: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of n-grams (none if n exceeds `longest`) whose two shorter ones `shorter` (a broadcast bitmap) has, and what is to be
    known of those shorter ones. With words go, as 0-grams, all words of their language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(bits)
        counts = {m: Sums(m, "n") for m in ((0, 1) if n == 1 else (n,)) if m <= longest}
        seen = {m: Sums(m, "low", "high", "at") for m in {1: (), 2: (0, 1)}.get(n, (n - 1,))}
        bitmap = None if shorter is None else np.frombuffer(shorter.value, np.uint8)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch, prints):
                at = chunk.places(n)
                if bitmap is not None:
                    before = chunk.places(n - 1)
                    before = before[_has(bitmap, chunk.grams(n - 1, before))]
                    for m, own in seen.items():
                        where = before if m else chunk.places(0)
                        check = chunk.grams(m, where, 1).view(np.int64)  # signed, as Spark compares it
                        own.add(chunk.grams(m, where), check, check, ids[chunk.row[where]])
                    likely = np.zeros(len(chunk) + 1, bool)
                    likely[before] = True
                    # The last word of a segment's tail isn't owned; n-grams that end there are tested by their first part alone.
                    likely_end = likely | ~np.append(chunk.owned, False)
                    at = at[likely[at] & likely_end[at + 1]]
                for m, own in counts.items():
                    own.add(chunk.grams(m, at), np.ones(len(at), np.int64))
                for own in (*counts.values(), *seen.values()):
                    if own.size > HELD:
                        own.sum_up()
                        if own.size > HELD // 2:
                            yield from own.batches()
        for own in (*counts.values(), *seen.values()):
            if own.size:
                yield from own.batches()
        store.give_back()

    return count


def _bitmap(fps: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP bits, made bytewise by Spark; at most BITMAP / 8 rows of two integers reach the driver."""
    place = F.col("fp").bitwiseAND(F.lit(BITMAP - 1))
    rows = fps.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast((fp & {BITMAP - 1}) & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def _phrases(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of the n-grams `wanted` (words, fp, check) of a document."""
    schema = pa.schema([("words", pa.int32()), ("fp", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(bits)
        for batch in batches:
            wanted, langs = batch.column(batch.schema.get_field_index("wanted")), store.texts(batch, "lang")
            out: dict[tuple, dict] = {}
            for k in range(batch.num_rows):
                words, fps, checks = (wanted[k].values.field(c).to_numpy(zero_copy_only=False) for c in ("words", "fp", "check"))
                for chunk in chunks(batch.slice(k, 1), prints):
                    for n in np.unique(words).tolist():
                        own = words == n
                        at = chunk.places(n)
                        at = at[np.isin(chunk.grams(n, at).view(np.int64), fps[own])]
                        got, check = (chunk.grams(n, at, kind).view(np.int64).tolist() for kind in (0, 1))
                        # Another phrase of this document may have the one fingerprint, but not both.
                        asked = set(zip(fps[own].tolist(), checks[own].tolist(), strict=True))
                        for i, pair in zip(at.tolist(), zip(got, check, strict=True), strict=True):
                            if pair in asked and (n, pair[0]) not in out:
                                out[n, pair[0]] = {"words": n, "fp": pair[0], "lang": langs[k], "phrase": chunk.phrase(i, n)}
            yield pa.RecordBatch.from_pylist(list(out.values()), schema)

    return find


def _by_words(n: int, fps: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each occurrence, by its words, of the n-grams whose fingerprints `fps` (a broadcast bitmap) has."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, bitmap = Fingerprints(bits), np.frombuffer(fps.value, np.uint8)
        for batch in batches:
            langs = store.texts(batch, "lang")
            for chunk in chunks(batch, prints):
                at = chunk.places(n)
                own = chunk.grams(n, at)
                hits = _has(bitmap, own)
                at, own = at[hits], own[hits]
                columns = [pa.array(own.view(np.int64)), pa.array([langs[r] for r in chunk.row[at]], pa.string()), pa.array([chunk.phrase(int(i), n) for i in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "lang", "phrase"])

    return spell


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """lang, words, phrase, f: every phrase of up to `longest` words with f >= least occurrences; of no words: all words of a language."""
    spark = docs.sparkSession
    store.small_batches(spark)
    lang = F.coalesce("lang", F.lit("und"))
    # Rows without an id are pointed at by their text, so that no pointer names them all.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("at"), lang.alias("lang"), "text")
    frequent, seen, spelled, shorter = [], [], [], None
    for n in range(1, longest + 2):
        got = rows.mapInArrow(_counter(n, longest, shorter, bits), "words int, fp long, n long, low long, high long, at long")
        sums = got.groupBy("words", "fp").agg(F.sum("n").alias("f"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("at").alias("at"))
        sums = store.materialise(sums.where((F.col("f") >= least) | F.col("at").isNotNull()), "phrase-counts")
        seen.append(sums.where("at is not null").select("words", "fp", "low", "high", "at"))
        own = sums.where("f is not null").select("words", "fp", "f")
        if n > longest or own.isEmpty():
            break
        frequent.append(own)
        shorter = spark.sparkContext.broadcast(_bitmap(own.where(F.col("words") == n)).tobytes())
    if not frequent:
        return spark.createDataFrame([], "lang string, words int, phrase string, f long")
    known = reduce(DataFrame.unionByName, frequent).join(reduce(DataFrame.unionByName, seen), ["words", "fp"])
    known = store.materialise(known, "phrase-pointers")
    several = known.where("low <> high").select("words", "fp")
    for m in sorted(r.words for r in several.select("words").distinct().collect()):
        own = several.where(F.col("words") == m).select("fp")
        texts = rows.mapInArrow(_by_words(m, spark.sparkContext.broadcast(_bitmap(own).tobytes()), bits), "fp long, lang string, phrase string")
        counts = texts.join(own, "fp", "left_semi").groupBy("lang", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)
        spelled.append(store.materialise(counts.select("lang", F.lit(m).alias("words"), "phrase", "f"), "phrase-spelled"))
    pointed = known.where("low = high").select("words", "fp", F.col("low").alias("check"), "f", "at")
    found = store.materialise(_materialise(rows, pointed, bits), "phrases")
    return reduce(DataFrame.unionByName, spelled, found)


def _materialise(rows: DataFrame, pointed: DataFrame, bits: int) -> DataFrame:
    """lang, words, phrase, f of pointed(words, fp, check, f, at): only documents that a pointer names are read for their words."""
    lists = pointed.groupBy("at").agg(F.collect_list(F.struct("words", "fp", "check")).alias("wanted"))
    texts = ngram_join.suspects(rows.withColumnRenamed("at", "doc_id"), pointed.select(F.col("at").alias("id"))).where("maybe")
    texts = texts.select(F.col("doc_id").alias("at"), "row.lang", "row.text").join(lists, "at")
    found = texts.select("lang", "text", "wanted").mapInArrow(_phrases(bits), "words int, fp long, lang string, phrase string")
    # Rows that share a doc_id may find a phrase twice.
    once = found.groupBy("words", "fp").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
    return once.join(pointed.select("words", "fp", "f"), ["words", "fp"]).select("lang", "words", "phrase", "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, rows: int = ROWS, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first rows by score.

    a: occurrences of the phrase; l and r: of its parts at the cut that scores lowest, n: words of the language; score = floor(1000 a n /
    (l r)). A phrase that a longer frequent one contains as often as it stands anywhere isn't listed.
    """
    found = frequent_phrases(docs, least, longest, bits)
    parts = found.where("words > 0").select("lang", "phrase", "f")
    listed = found.where("words > 1")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    above = listed.where("words > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    listed = listed.join(above, ["lang", "phrase"], "left").where(F.coalesce("above", F.lit(0)) < F.col("f"))
    cuts = listed.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.join(totals, "lang").withColumn("score", exact)
    lowest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best")).select("lang", "phrase", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("k", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= rows)
    best = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= rows)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
