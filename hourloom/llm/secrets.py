"""Secret scans: patterns, and a battery of randomness tests with length-aware false-discovery control.

Besides the base patterns, runs of LEAST_RUN or more key characters are candidates. They and the values of base spans of that length
are tested; base spans stay, whatever the tests say of them. For each, the encoding is inferred from its characters;
a chi-squared test asks whether the encoding's symbols are used evenly, a runs test whether symbols above and below the
middle alternate as chance has it, a serial-correlation test whether neighbours are unrelated. The three give one
statistic. What ordinary text reaches is taken from the corpus itself: all words of all texts are counted, drawn by these counts and joined
to the least length of each band (longer joins look less random, so that p-values err on the safe side): DRAWS simulated runs a band. Runs of letters in one case are tested against joined words, all others against identifiers: words in any case, numbers
and separators. In each band of each form, the Benjamini-Hochberg rule on these empirical p-values picks the bins that are
reported. Each word of a run is drawn from all occurrences, on the executors; only histograms, BUCKETS sums and all words of small corpora
(DRAWN_WORDS occurrences at most) reach the driver.

Null and empty texts have no spans. Documents are scanned row by row, so repeated rows repeat their spans; whole texts are
scanned, whatever their length. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import random
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import store

#: Fixed values of the base patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: Runs that may be keys, and the kind of the spans that the tests add.
LEAST_RUN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
ADDED = "random"
#: Upper ends of the length bands, bins of the statistic, and the share of false discoveries allowed.
BAND_ENDS, BINS, RATE = (20, 24, 32, 48, 64, 1 << 30), 64, 0.05
#: Forms: letters in one case, all else. Drawn null runs for each band of a form, and how they are dealt to tasks.
FORMS, DRAWS, DRAW_TASKS = 2, 20_000, 10
#: Words for the null runs, and up to how many occurrences all go along as a list. The common ones stand in where a corpus has none.
#: Words as long as a candidate give a piece, lest a key be taken for ordinary text.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]++(?![A-Za-z0-9+/_=-])")
DRAWN_WORDS, PIECE = 1 << 16, 8
#: Parts of the table of words, and a drawn word for how many characters of a run.
BUCKETS, AHEAD = 1024, 3
COMMON = "the of and to in is that for it was on with as by be at this from have are which not or an were".split()

#: Encodings by growing alphabets.
ENCODINGS = [
    ("decimal", string.digits),
    ("hex", string.digits + "abcdef"),
    ("HEX", string.digits + "ABCDEF"),
    ("lower", string.ascii_lowercase),
    ("upper", string.ascii_uppercase),
    ("base32", string.ascii_uppercase + "234567"),
    ("upper36", string.digits + string.ascii_uppercase),
    ("lower36", string.digits + string.ascii_lowercase),
    ("letters", string.ascii_letters),
    ("base62", string.digits + string.ascii_letters),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
    ("any", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"),
]
_RANKS = [(name, {c: k for k, c in enumerate(a)}, set(a)) for name, a in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, leftmost and non-overlapping for each kind; failing matches are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def infer_encoding(token: str) -> int:
    used = set(token.rstrip("=")) or {"="}
    return next(k for k, (_, _, alphabet) in enumerate(_RANKS) if used <= alphabet)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, list[float]]:
    """(encoding, p-values of chi-squared, runs and serial correlation under randomness)."""
    k = infer_encoding(token)
    name, rank, alphabet = _RANKS[k]
    x = [rank[c] for c in token.rstrip("=") or "="]
    n, m = len(x), len(alphabet)
    chi = sum(v * v for v in Counter(x).values()) * m / n - n
    # Wilson-Hilferty: a cube root of chi-squared is near normal.
    d = m - 1
    z = ((max(chi, 0.0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    p_chi = normal_tail(z)
    high = [v >= m / 2 for v in x]
    a = sum(high)
    b = n - a
    runs = 1 + sum(u != v for u, v in zip(high, high[1:], strict=False))
    mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * max(1, n - 1))
    p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    mu = sum(x) / n
    s2 = sum((v - mu) ** 2 for v in x)
    r = sum((u - mu) * (v - mu) for u, v in zip(x, x[1:], strict=False)) / s2 if s2 else 1.0
    p_serial = 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return name, [p_chi, p_runs, p_serial]


def one_case(token: str) -> bool:
    """Letters in one case (or capitalised): what words look like."""
    return token.isalpha() and (token[1:].islower() or token.isupper())


def variety(token: str) -> float:
    """How many times the kind of character (digit, lower, upper, other) changes, per place."""
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in token]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (len(token) - 1)


def statistic(token: str) -> int:
    """Bin of the combined statistic: large when no test speaks against randomness and the characters are mixed."""
    _, p = battery(token)
    logs = sum(math.log10(max(q, 1e-6)) for q in p) / 18  # 0 best, -1 worst
    mixed = 1 if one_case(token) else 0.5 + min(0.5, variety(token))
    return max(0, min(BINS - 1, int(BINS * (1 + logs) * mixed)))


def band(length: int) -> int:
    return next(k for k, end in enumerate(BAND_ENDS) if length <= end)


def cell(token: str) -> int:
    """Place in the histogram: (form * bands + band) * BINS + bin."""
    form = 0 if one_case(token) else 1
    return (form * len(BAND_ENDS) + band(len(token))) * BINS + statistic(token if form else token.lower())


@lru_cache(1 << 16)
def piece_of(word: str) -> str:
    """A word in one case in lower case, or a piece of a long one; empty for others."""
    if not one_case(word) and len(word) > 1:
        return ""
    cut = zlib.crc32(word.encode()) % max(1, len(word) - PIECE + 1)
    return (word if len(word) < LEAST_RUN else word[cut : cut + PIECE]).lower()


def words_of(text: str) -> list[str]:
    """All words of a text in one case, as often as they occur."""
    return [piece for piece in map(piece_of, WORD.findall(text)) if piece]


def null_words(counts: DataFrame, most: int = DRAWN_WORDS) -> list[str]:
    """Words as a list, each in proportion to its occurrences n in all texts, of counts(word, n): every occurrence where they are no more
    than most, and only then find() takes them from here; else a word's share of most, whose fraction is rounded by the word's hash."""
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    share = min(1.0, most / max(1, total))
    chance = F.pmod(F.xxhash64("word"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = counts.select("word", F.floor(F.col("n") * F.lit(share) + chance).alias("times")).where("times > 0").collect()
    return [r.word for r in sorted(rows, key=lambda r: r.word) for _ in range(r.times)]


def ordinary(form: int, length: int, draw: Callable[[], str], rng: random.Random) -> str:
    """A run of ordinary text without blanks: joined words; for the second form, an identifier of words and numbers."""
    if not form:
        out = ""
        while len(out) < length:
            out += draw()
        return out[:length]
    while True:
        out, join = "", rng.choice(["", "-", "_", "/"])
        while len(out) < length:
            word = draw()
            piece = rng.choice([word, word, word.capitalize(), word.upper(), str(rng.randrange(10 ** rng.randint(1, 6)))])
            out += (join if out else "") + piece
        if not one_case(out[:length]):
            return out[:length]


def form_and_length(stratum: int) -> tuple[int, int]:
    """The form of a stratum's runs and the least length of its band."""
    form, length_band = divmod(stratum, len(BAND_ENDS))
    return form, BAND_ENDS[length_band - 1] + 1 if length_band else LEAST_RUN


def drawn_cells(stratum: int, draw: Callable[[], str], rng: random.Random) -> pa.RecordBatch:
    """Histogram cells of a job's ordinary runs."""
    form, length = form_and_length(stratum)
    counts = Counter(cell(ordinary(form, length, draw, rng)) for _ in range(DRAWS // DRAW_TASKS))
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["cell", "n"])


def summed_cells(cells: DataFrame) -> dict[int, int]:
    return {r.cell: r.n for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def draw_nulls(spark: SparkSession, words: list[str], strata: list[int]) -> dict[int, int]:
    """Histogram cells of DRAWS ordinary runs, of words from a list, for each stratum (form * bands + band) of those given."""
    if not strata:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng = random.Random(k)
                yield drawn_cells(strata[k // DRAW_TASKS], lambda: rng.choice(words), rng)  # noqa: B023

    jobs = spark.range(0, len(strata) * DRAW_TASKS, 1, len(strata) * DRAW_TASKS)
    return summed_cells(jobs.mapInArrow(run, "cell int, n long"))


def drawn_words(counts: DataFrame, sizes: list[int]) -> DataFrame:
    """job, place, word: as many words for each job as sizes has, each drawn from all occurrences n in all texts of counts(word, n).

    A place falls on one of all occurrences by its hash, thus into one of the buckets that the words are dealt to, and meets the words of
    its bucket there: every word has its weight however rare it is, and no process holds more than a bucket's words.
    """
    parts = counts.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    own = {r.bucket: r.n for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    ends = np.cumsum([own.get(k, 0) for k in range(BUCKETS)])
    last = np.cumsum(sizes)

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, at = (c.to_numpy() for c in batch.columns)
            bucket = np.searchsorted(ends, at, side="right")
            columns = [np.searchsorted(last, place, side="right").astype(np.int32), place, bucket.astype(np.int32), at - np.concatenate([[0], ends])[bucket]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["job", "place", "bucket", "at"])

    def meet(places: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("word")
        found = np.searchsorted(np.cumsum(words["n"].to_numpy()), places["at"].to_numpy(), side="right")
        return places.select(["job", "place"]).append_column("word", words["word"].take(pa.array(found)))

    places = counts.sparkSession.range(int(last[-1])).select("id", F.pmod(F.xxhash64("id"), F.lit(int(ends[-1]))).alias("at"))
    places = places.mapInArrow(fall, "job int, place long, bucket int, at long")
    return places.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(meet, "job int, place long, word string")


def draw_nulls_of_all(counts: DataFrame, strata: list[int]) -> dict[int, int]:
    """draw_nulls of all words of counts(word, n), whatever their number. A job has a word for each AHEAD characters of its runs; where its
    words are shorter and run out, it begins again with the first."""
    if not strata:
        return {}
    jobs = [strata[k // DRAW_TASKS] for k in range(len(strata) * DRAW_TASKS)]
    words = drawn_words(counts, [(form_and_length(s)[1] // AHEAD + 1) * (DRAWS // DRAW_TASKS) for s in jobs])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        return pa.Table.from_batches([drawn_cells(jobs[k], cycle(table.sort_by("place")["word"].to_pylist()).__next__, random.Random(k))])

    return summed_cells(words.groupBy("job").applyInArrow(run, "cell int, n long"))


#: What the tests say of a run: its cell, encoding, p-values under randomness, and whether a base pattern has it.
TESTED = "array<struct<cell:int,start:int,stop:int,encoding:string,p_chi:double,p_runs:double,p_serial:double,base:boolean>>"
FOUND = f"doc_id long, base array<struct<kind:string,start:int,stop:int>>, runs {TESTED}, words array<string>"


def values_of(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What may be random in base spans: the value of an assignment, else the match; each place once."""
    seen = set()
    for kind, a, b in base:
        if kind == "assign":
            a = ASSIGN.match(text, a, b).start(2)
        if b - a >= LEAST_RUN and (a, b) not in seen:
            seen.add((a, b))
            yield a, b


def tested(text: str, a: int, b: int, base: bool) -> dict:
    encoding, (p_chi, p_runs, p_serial) = battery(text[a:b])
    return {"cell": cell(text[a:b]), "start": a, "stop": b, "encoding": encoding, "p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial, "base": base}


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, tested runs (base values and candidates), and all words for the null runs; in one pass."""
    store.small_batches(docs.sparkSession)
    place = [("start", pa.int32()), ("stop", pa.int32())]
    result = [("encoding", pa.string()), *[(c, pa.float64()) for c in ("p_chi", "p_runs", "p_serial")], ("base", pa.bool_())]
    kinds = [pa.int64(), pa.list_(pa.struct([("kind", pa.string()), *place])), pa.list_(pa.struct([("cell", pa.int32()), *place, *result])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs, words = [], [], []
            for text in store.texts(batch):
                text = text or ""
                own = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
                base.append([{"kind": k, "start": a, "stop": b} for k, a, b in own])
                cand = [tested(text, a, b, True) for a, b in values_of(text, own)]
                for m in CANDIDATE.finditer(text):
                    if not any(a < m.end() and m.start() < b for _, a, b in own):
                        cand.append(tested(text, *m.span(), False))
                runs.append(cand)
                words.append(words_of(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip((base, runs, words), kinds[1:], strict=True)]], ["doc_id", "base", "runs", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def discoveries(tests: dict[int, int], nulls: dict[int, int], rate: float = RATE) -> list[int]:
    """Cells whose candidates are reported: Benjamini-Hochberg in each length band of each form on empirical p-values."""
    out = []
    for k in range(FORMS * len(BAND_ENDS)):
        n_null = sum(nulls.get(k * BINS + j, 0) for j in range(BINS))
        n_test = sum(tests.get(k * BINS + j, 0) for j in range(BINS))
        above_null = above = 0
        best = None
        for j in reversed(range(BINS)):
            above_null += nulls.get(k * BINS + j, 0)
            above += tests.get(k * BINS + j, 0)
            p = (above_null + 1) / (n_null + 1)
            if above and p <= rate * above / n_test:
                best = j
        if best is not None:
            out += range(k * BINS + best, (k + 1) * BINS)
    return out


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base, added, tested: base spans and those that the tests add, each with kind, start, stop; and for each tested run, a base
    value or a candidate, its encoding, p-values and whether it counts as random (a discovery)."""
    found = store.materialise(scan(docs), "secret-scan")
    tests = {r.cell: r.n for r in found.select(F.explode("runs.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    counts = store.materialise(found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "secret-words")
    strata, spark = sorted({c // BINS for c in tests}), docs.sparkSession
    if (counts.agg(F.sum("n").alias("n")).first().n or 0) <= DRAWN_WORDS:
        nulls = draw_nulls(spark, COMMON + null_words(counts), strata)
    else:
        nulls = draw_nulls_of_all(counts.unionByName(spark.createDataFrame([(w, 1) for w in COMMON], counts.schema)), strata)
    take = discoveries(tests, nulls, rate)
    chosen = F.array(*[F.lit(c) for c in take]) if take else F.expr("cast(array() as array<int>)")
    decided = F.transform("runs", lambda r: F.struct(*[r[c].alias(c) for c in ("start", "stop", "encoding", "p_chi", "p_runs", "p_serial", "base")], F.array_contains(chosen, r["cell"]).alias("random")))
    added = F.transform(F.filter(decided, lambda r: r["random"] & ~r["base"]), lambda r: F.struct(F.lit(ADDED).alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))
    return found.select("doc_id", "base", added.alias("added"), decided.alias("tested"))
