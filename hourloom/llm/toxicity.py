"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own hash bucket and those of its character 4- and 5-grams, with word ends marked, so an unseen misspelling
shares most of its vectors with the words it was made from. A text is the average of all its subwords' vectors; two
weights rows and a softmax score it. Vectors and weights learn together by stochastic gradient steps on labelled rows.

A null or blank text has the zero vector and scores what the biases say. Labels that are null, or of doc_ids that no document
has, are not used; a doc_id that is labelled or stored twice is learnt from twice. Without both kinds of labels, all scores
are the share of label 1 (0.0 with no labels). Only the text reaches a score. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm import store

#: Most labelled rows that a fit uses (a hash sample of them if there are more) and the bytes of text it takes of them at most.
FIT_ROWS, FIT_BYTES = 11_000, 38 << 20
BUCKET_BITS = 19
BUCKETS, DIM, RATE = 1 << BUCKET_BITS, 8, 1.5
#: A mean of vectors is scaled by this, so that a few words among hundreds move it.
SCALE = 64.0
#: Texts of the fit that must hold a subword before its vector moves.
LEAST_TEXTS = 5
#: Steps of a fit and bounds of its passes over the rows.
STEPS, MIN_EPOCHS, MAX_EPOCHS = 44_000, 3, 40
SHORTEST, LONGEST = 4, 5
#: Score from which a text is rejected.
REJECT = 0.7
#: Words whose score a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 600_000, 16 << 20

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


_rng = np.random.default_rng(20)
#: Odd multipliers of characters by their place; beyond so many places they begin again.
_PLACES = _rng.integers(1, 1 << 62, 66, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every subword of non-empty words: each marked word, and its inner grams.

    All words are hashed at once, each as a whole, however long it is.
    """
    marked = [f"<{w}>" for w in words]
    if not marked:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(c)) - starts[owner]
    buckets, owners = [_bucket(np.add.reduceat(c * _PLACES[place % len(_PLACES)], starts), 0)], [np.arange(len(marked))]
    for n in range(SHORTEST, LONGEST + 1):
        if len(c) >= n:
            inside = owner[: len(c) - n + 1] == owner[n - 1 :]
            h = sum(c[k : len(c) - n + 1 + k] * _PLACES[k] for k in range(n))
            buckets.append(_bucket(h[inside], n))
            owners.append(owner[: len(c) - n + 1][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # 2 x DIM
    bias: np.ndarray  # 2

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of label 1 against label 0 before the mean is taken, and what the biases add."""
        return self.vectors @ (self.weights[1] - self.weights[0]) * SCALE, float(self.bias[1] - self.bias[0])


class Scorer:
    def __init__(self, margins: np.ndarray, base: float):
        self.margins, self.base = margins, base
        self.known: dict[str, complex] = {}  # a word's margin and number of subwords, added up as one number
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known.clear()
            self.chars = 0
        new = [w for w in set(words) if w not in self.known]
        self.chars += sum(map(len, new))
        buckets, owner = subwords(new)
        both = np.bincount(owner, self.margins[buckets], len(new)) + 1j * np.bincount(owner, minlength=len(new))
        self.known.update(zip(new, both.tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for k in range(0, len(texts), 256):
            rows = [words_of(t) for t in texts[k : k + 256]]
            self.learn([w for r in rows for w in r])
            for r in rows:
                total = sum(map(self.known.__getitem__, r), 0j)
                z = self.base + (total.real / total.imag if r else 0.0)
                out.append(1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z)))))
        return out


class Bags:
    """Each text's distinct subwords that `least` texts or more have, and their parts in the text, in flat arrays. Texts are given up
    as they are read, and arrays grow in pieces, so that little is held twice."""

    def __init__(self, texts: list[str | None], least: int, piece: int = 500):
        seen = np.zeros(BUCKETS, np.int32)
        self.n, self.piece, self.pieces = len(texts), piece, []
        for first in range(0, len(texts), piece):
            own = []
            for k in range(first, min(len(texts), first + piece)):
                buckets, counts = np.unique(subwords(words_of(texts[k]))[0], return_counts=True)
                texts[k] = None
                seen[buckets] += 1
                own.append((buckets, (counts * (SCALE / max(1, counts.sum()))).astype(np.float16)))
            cuts = np.concatenate(([0], np.cumsum([len(b) for b, _ in own])))
            self.pieces.append((np.concatenate([b for b, _ in own]), np.concatenate([p for _, p in own]), cuts))
        for k, (buckets, parts, cuts) in enumerate(self.pieces):
            which = seen[buckets] >= least
            before = np.concatenate(([0], np.cumsum(which)))
            self.pieces[k] = (buckets[which], parts[which], before[cuts])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        buckets, parts, cuts = self.pieces[k // self.piece]
        at = slice(cuts[k % self.piece], cuts[k % self.piece + 1])
        return buckets[at], parts[at].astype(np.float32)


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Joint training: each step moves the vectors of one text's subwords and the softmax rows by one gradient. texts is emptied.

    Sums run row by row and not through a linear-algebra library, whose order of adding differs between machines.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32) / SCALE, rng.uniform(-1, 1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32))
    share = sum(labels) / len(labels) if labels else 0.0
    if not 0 < share < 1:
        model.vectors[:] = 0
        model.bias[1] = 60.0 if share else -60.0
        return model
    bags = Bags(texts, min(LEAST_TEXTS, 1 + len(texts) // 200))
    y = np.array(labels)
    heavy = np.float32(min(4.0, ((1 - share) / share) ** 0.5))
    epochs = max(MIN_EPOCHS, min(MAX_EPOCHS, STEPS // len(bags)))
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for i in rng.permutation(len(bags)):
            buckets, part = bags[i]
            own = model.vectors[buckets]
            h = (part[:, None] * own).sum(0)
            z = (model.weights * h).sum(1) + model.bias
            toxic = 1 / (1 + math.exp(max(-60.0, min(60.0, float(z[0] - z[1])))))
            g = np.array([1 - toxic, toxic], np.float32)
            g[y[i]] -= 1
            if abs(g[0]) < 0.01:
                continue
            if y[i]:
                g *= heavy
            # A text of few words has large parts: its step is kept to the length that a usual text has.
            size = float((part * part).sum())
            back = (rate / max(1.0, size / 8)) * (g[:, None] * model.weights).sum(0)
            model.weights -= (rate / max(1.0, float((h * h).sum()))) * np.outer(g, h)
            model.vectors[buckets] = own - np.outer(part, back)
            model.bias -= rate * g * np.float32(0.1)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the doc_id as text, mod 3, is 1. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out.

    The sample is by a hash of the doc_id, at the rate that gives about `rows` rows and `most_bytes` of text by the counts
    and mean size of all rows, so what reaches the driver doesn't grow with the tables.
    """
    own = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    own = own.where(~held_out(F.col("label_id")))
    found = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("label_id"))
    n = own.count()
    size = docs.agg(F.coalesce(F.avg(F.octet_length("text")), F.lit(0.0))).first()[0]
    keep = min(1.0, rows / max(1, n), most_bytes / max(1.0, n * size))
    place = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    own = store.materialise(own.where(place < int(keep * (1 << 30))), "fit-labels")
    found = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("label_id")).orderBy("doc_id", "toxic").select("text", "toxic")
    got = found.toArrow()
    texts, toxic = got.column("text").to_pylist(), got.column("toxic").to_pylist()
    del got
    store.give_back()
    model = fit(texts, toxic)
    store.give_back()  # the driver goes on for long, and what the fit held would stay with it
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `score`, in one pass over the texts."""
    store.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.margins())
    at = docs.columns.index("text")
    rows = docs.select(F.col("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            out = pa.array(scorer.scores(store.texts(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "score"])

    out = rows.mapInArrow(run, schema)
    names = [c for c in docs.columns if c != "text"]
    cols = [F.col(f"rest.{c}").alias(c) for c in names]
    cols.insert(at, F.col("text"))
    return out.select(*cols, "score")


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs less the rows that score `reject` or more; all columns pass through as they are."""
    store.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.margins())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([p < reject for p in scorer.scores(store.texts(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
