"""Line dedup, collocations and whitening against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hourloom.llm import collocations as co
from hourloom.llm import line_dedup as ld
from hourloom.llm import whitening as wh

DOCS = "doc_id long, text string, lang string, n int"
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least_chars, least_docs):
    """[(doc_id, kept text, lines, dropped)]; a row is a document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOW)
    order = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(dict)
    for k, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)][k] = order(i)
    last = {x: max(h.values()) for x, h in holders.items() if len(h) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), order(i)) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    often = ["The same long line of forty code points or more, ünd more", "  x" * 20, "é" * 40, "\t Another line that is found in very many documents today \r", "short"]
    rows = [(None, often[0]), (None, None), (7, ""), (9, "\n\n"), (8, "é" * 39)]
    for k in range(60):
        lines = [rng.choice([*often, often[0].upper(), f"{often[3]}  ", f"line {rng.randrange(400)} with its own words here and there, so it is long"]) for _ in range(rng.randrange(1, 30))]
        rows.append((k // 2 * 3, "\n".join(lines)))
    return [*rows, rows[-1], rows[-1], (500, "\n".join(f"only here, though it is a line that is long enough {k}" for k in range(3000)))]


def test_lines_that_stay_are_those_of_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, n_lines string, last int").repartition(5)
    for least_chars, least_docs in ((40, 5), (1, 2), (57, 3)):
        got = [tuple(r) for r in ld.drop_lines(docs, least_chars, least_docs).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(got, key=key) == sorted(brute_lines(rows, least_chars, least_docs), key=key)
    assert any(r[3] for r in brute_lines(rows, 40, 5))
    assert ld.drop_lines(docs.where("doc_id < -9")).collect() == []


def test_one_document_may_repeat_a_line_and_ties_keep_theirs(spark):
    line = "a line of more than forty characters, which is repeated"
    rows = [(k, f"{line}\n{line}") for k in range(4)] + [(9, f"{line}\n{line}\n{line}"), (9, line)]
    got = [tuple(r) for r in ld.drop_lines(spark.createDataFrame([(*r, "en", 1) for r in rows], DOCS)).orderBy("doc_id", "n_lines").collect()]
    assert got == [*[(k, "", 2, 2) for k in range(4)], (9, line, 1, 0), (9, f"{line}\n{line}\n{line}", 3, 0)]


def test_perfect_hash_is_minimal_and_shards_survive_storage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 40_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        found = ld.PerfectHash.of(keys)
        assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
        high, counts, last = rng.integers(0, 1 << 63, len(keys), dtype=np.uint64), np.arange(len(keys)), np.arange(len(keys)) * 7
        shard = ld.Shard.from_bytes(ld.Shard.of(keys, high, counts, last).to_bytes())
        known, own = shard.look_up(keys, high)
        assert known.all() and own.tolist() == last.tolist()
        assert (shard.counts[shard.hash.index(keys)] == counts).all()
        assert not shard.look_up(keys, high + np.uint64(1))[0].any()
        assert not shard.look_up(keys ^ np.uint64(1 << 63), high)[0].any()


def test_shards_are_dealt_and_dropped_from_memory(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 5)
    monkeypatch.setattr(ld, "ROUND_BYTES", 1)
    monkeypatch.setattr(ld, "KEPT_BYTES", 500)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS)
    counts = ld.line_counts(docs, 1, 2)
    manifest = ld.build_index(counts)
    assert manifest["shards"] > 3
    known = [(r.low, r.high, r.last) for r in counts.collect()]
    index = ld.Index(manifest)
    found, last = index.look_up(np.array([k[:2] for k in known], np.int64).view(np.uint64))
    assert found.all() and last.tolist() == [k[2] for k in known]
    assert index.size <= 500 or len(index.kept) == 1


def brute_phrases(rows, least, longest=5):
    """Counter by (lang, words) of frequent phrases, and words of a language at (lang, ())."""
    f = Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang, ()] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    return Counter({k: v for k, v in f.items() if v >= least or k[1] == ()})


def brute_collocations(rows, least, longest=5, most=2000):
    f, out = brute_phrases(rows, least, longest), defaultdict(list)
    inside = Counter()
    for (lang, w), n in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], n)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < 100 * a:
            n = f[lang, ()]
            score, _, left, right = min((1000 * a * n // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right, n))
    return [(lang, k, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for k, (s, a, p, left, right, n) in enumerate(sorted(found)[:most], 1)]


def phrase_rows():
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "naïve", "é", "a b", "x", "state-of", "\x00"]
    fixed = ["new york city hall park", "once upon a time", "A B", "in the state-of the art"]
    rows = [(None, None, None), (1, "", "en"), (2, "  \t ", "en"), (3, ".,;", None)]
    for k in range(150):
        parts = [rng.choice([" ", "  ", "\t", " ", " "]).join(rng.choice([*vocabulary, *fixed]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))]
        rows.append((rng.choice([None, k, 4]), "".join(p + rng.choice([". ", ",", "!\n", "\r", " ? "]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize("bits", [64, 9])
def test_collocations_are_those_of_brute_force(spark, bits):
    """With 9 bits of fingerprint nearly every group holds several phrases, which are then counted by their words."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, phrase int").repartition(3)
    got = [tuple(r) for r in co.collocations(docs, least=12, rows=25, bits=bits).collect()]
    want = brute_collocations(rows, 12, most=25)
    assert sorted(got) == sorted(want) and len(want) > 40
    counts = {(r.lang, tuple(r.phrase.split(" ")) if r.words else ()): r.f for r in co.frequent_phrases(docs, 12, bits=bits).collect()}
    assert counts == {k: v for k, v in brute_phrases(rows, 12).items() if v >= 12}


def test_collocations_of_empty_tables_and_rare_words(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 1)], DOCS)
    assert co.collocations(docs).collect() == [] and co.collocations(docs.where("doc_id > 1")).collect() == []


def test_windows_cut_no_phrase():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "  ", "\t", "é", "."] if k % 3 else ["a", "b", " "]) for _ in range(400)) for k in range(30)] + ["w" * 300, "w" * 100 + " v", "", " " * 90]
    prints = co.Fingerprints()
    import pyarrow as pa

    for size in (1, 7, 40, 10_000):
        for text in texts:
            batch = pa.RecordBatch.from_pydict({"text": [text, None, text], "lang": ["en", None, "en"]})
            found = Counter()
            for chunk in co.chunks(batch, prints, size):
                for n in range(1, 6):
                    found.update(("en", tuple(chunk.phrase(int(i), n).split(" "))) for i in chunk.places(n))
            want = brute_phrases([(1, text, "en"), (1, text, "en")], 1)
            assert found == Counter({k: v for k, v in want.items() if k[1]})


def test_fingerprints_depend_on_words_not_on_place():
    import pyarrow as pa

    prints = co.Fingerprints()
    text = "one two three. zero one  two three"
    chunk = next(co.chunks(pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]}), prints))
    for kind in (0, 1):
        for n in (1, 2, 3):
            own = chunk.grams(n, np.array([0, 4]), kind)
            assert own[0] == own[1]
        assert len(set(chunk.grams(1, np.arange(7), kind).tolist())) == 4


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q.astype(np.longdouble) * np.array(values, np.longdouble)) @ q.T.astype(np.longdouble)


@pytest.mark.parametrize("values", [
    np.arange(1.0, 33), [5.0] * 8, [5.0] * 4 + [2.0] * 3 + [1.0], [1 + 1e-9 * k for k in range(10)], [1 + 1e-13 * k for k in range(10)], [1e6, 1e6 - 1e-4, 3, 3 - 1e-8, 1e-3, 0.0],
    [1.0] + [0.0] * 7, np.geomspace(1, 1e-12, 20), [7.0],
])
def test_corrected_eigenvectors_have_double_precision(values):
    a = spectrum(values)
    a = (a + a.T) / 2
    found, x = wh.eigen(a.astype(np.float64))
    size = np.abs(values).max()
    assert np.abs(found - np.sort(values)[::-1]).max() < 4e-15 * size * len(values)
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 2e-15 * len(x)
    assert np.abs(a @ x - x * found).max() < 4e-15 * size * len(values)


def test_correction_reaches_what_float32_cannot():
    """Eigenvectors of well separated values agree with those of a double precision solver; float32 ones don't."""
    a = spectrum(np.linspace(1, 2, 40)).astype(np.float64)
    a = (a + a.T) / 2
    _, rough = np.linalg.eigh(a.astype(np.float32))
    _, fine = np.linalg.eigh(a)
    _, own = wh.eigen(a)
    off = lambda x: np.abs(1 - np.abs((x * fine[:, ::-1]).sum(axis=0))).max()
    residual = lambda x: np.abs(a @ x - x * (x * (a @ x)).sum(axis=0)).max()
    assert residual(rough.astype(np.float64)) > 1e-8 and residual(own) < 1e-14 and off(own) < 1e-13


def test_close_but_unequal_values_are_told_apart():
    """Within a cluster far below float32's resolution the eigenvectors are still those of their values."""
    values = np.array([1 + 1e-10 * k for k in range(6)] + [4.0, 9.0])
    q, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(8, 8)))
    q = q.astype(np.longdouble)
    q = q @ (1.5 * np.eye(8, dtype=np.longdouble) - q.T @ q / 2)
    a = (q * values.astype(np.longdouble)) @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    found, x = wh.correct(a, rough)
    near = np.abs((q.T @ x).astype(np.float64))[:, ::1]
    assert np.abs(found[::-1] - values).max() < 1e-15 * 9
    assert np.abs(near.max(axis=0) - 1).max() < 1e-7


def embedding_rows(d=6, n=300):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(n, d)) * np.linspace(0.3, 2, d) + 0.2
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(base)]
    rows += [(k + 1000, rows[0][1]) for k in range(100)] + [(5, rows[5][1]), (None, rows[6][1])]
    odd = [(2000, None), (2001, [None] + [0.0] * (d - 1)), (2002, [float("nan")] * d), (2003, [float("inf")] + [0.0] * (d - 1)), (2004, []), (2005, [1.0])]
    return rows, odd


def test_whitened_rows_are_those_of_brute_force(spark):
    rows, odd = embedding_rows()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, n int").repartition(4)
    got = wh.whiten(table).collect()
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(axis=0)
    centred = own - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    white = (x - s / n) @ q / np.sqrt(e)
    assert len(got) == len(rows) * 6 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    want = defaultdict(list)
    for (i, _), w, row in zip(rows, white, x, strict=True):
        for k in range(6):
            want[i, k + 1].append((w[k], sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)), e[k] / np.trace(v)))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        sign.setdefault(r.component, np.sign(r.whitened) * np.sign(min(want[r.vec_id, r.component], key=lambda z: abs(abs(z[0]) - abs(r.whitened)))[0]))
    seen = defaultdict(list)
    for r in got:
        seen[r.vec_id, r.component].append((r.whitened * sign[r.component], r.deviation, r.explained))
    assert seen.keys() == want.keys()
    for key, found in seen.items():
        for a, b in zip(sorted(found), sorted(want[key]), strict=True):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9) and a[1] == b[1]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, whitened string"
    _, odd = embedding_rows()
    assert wh.whiten(spark.createDataFrame([(i, v, "x") for i, v in odd[:5]], schema)).collect() == []
    assert wh.whiten(spark.createDataFrame([], schema)).collect() == []
    same = wh.whiten(spark.createDataFrame([(k, [1.0, 2.0], "x") for k in range(5)], schema)).collect()
    assert len(same) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    line = wh.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k], "x") for k in range(5)], schema)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-10
    large = wh.whiten(spark.createDataFrame([(1, [3e38, 0.0], "x"), (2, [-3e38, 1.0], "x")], schema)).collect()
    assert {r.n for r in large} == {2} and all(r.deviation is None or r.deviation >= 0 for r in large)


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1_000_000 + 3, 1_000_000 - 5], [1_000_000, 1_000_064]])
    for n in (3, 10**9, 10**13):
        fit = wh.Fit(n, [n * 1_000_000 + 1, n * 1_000_001 - 1], np.ones(2), np.eye(2), 2.0)
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in x]
        assert fit.deviations(x) == [w if w < 1 << 63 else None for w in want]


def test_kept_digest_is_of_the_kept_text(spark, tmp_path):
    from hourloom.llm import queries

    spark.createDataFrame([(i, t, "en", 1) for i, t in line_rows() if i is not None], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, str(tmp_path)).collect())
    want = brute_lines([r for r in line_rows() if r[0] is not None], 40, 5)
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in want)


def test_false_discovery_rule_is_benjamini_hochbergs():
    """In each stratum the reported cells are those of the largest k sorted p-values with p <= rate * k / m."""
    from hourloom.llm import secrets

    rng = random.Random(6)
    for _ in range(60):
        strata = rng.sample(range(secrets.FORMS * len(secrets.BAND_ENDS)), 4)
        draw = lambda most, skew: Counter(s * secrets.BINS + min(secrets.BINS - 1, int(secrets.BINS * rng.random() ** skew)) for s in strata for _ in range(rng.randrange(1, most)))
        tests, nulls, want = draw(60, 0.6), draw(3000, 3), set()
        for s in strata:
            own = {c: n for c, n in tests.items() if c // secrets.BINS == s}
            drawn = sum(n for c, n in nulls.items() if c // secrets.BINS == s)
            p = {c: (sum(n for d, n in nulls.items() if d // secrets.BINS == s and d >= c) + 1) / (drawn + 1) for c in own}
            each = sorted(p[c] for c, n in own.items() for _ in range(n))
            fine = [v for k, v in enumerate(each, 1) if v <= 0.05 * k / len(each)]
            want |= {c for c in own if fine and p[c] <= max(fine)}
        assert {c for c in secrets.discoveries(tests, nulls) if c in tests} == want


def test_decisions_of_secret_scans_follow_from_the_rule(spark):
    """What is called random is what each run's cell, the null sample and the rule say, and nothing else."""
    from hourloom.llm import secrets

    rng = random.Random(4)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(40)]
    plain = ["some-ordinary-identifier_with_words", "anotherratherlongwordinonecase", "config/path/to/something/else", "ABCABCABCABCABCABCABCABCABCABCABCABC"]
    rows = [(k, f"{plain[k % 4]} is {keys[k]} or token={keys[-k - 1]}") for k in range(20)] + [(50, None), (51, "")]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tests = Counter(secrets.cell(t[x.start : x.stop]) for k, t in rows for x in got[k].tested)
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("size(words) > 0")
    sample = found.orderBy("doc_id").select("words").collect()
    ordered = found.selectExpr("words", "xxhash64(doc_id) AS h").collect()
    words = secrets.COMMON + [w for r in sorted(ordered, key=lambda r: (r.h, r.words)) for w in r.words]
    assert len(sample) == len(ordered)
    take = set(secrets.discoveries(tests, secrets.draw_nulls(spark, words, sorted({c // secrets.BINS for c in tests}))))
    for k, text in rows:
        for x in got[k].tested:
            own = text[x.start : x.stop]
            assert x.random == (secrets.cell(own) in take)
    called = [text[x.start : x.stop] for k, text in rows for x in got[k].tested if x.random]
    assert sum(c in keys for c in called) > 30 and not any(c in plain for c in called)


def test_null_words_stand_for_all_words_of_all_texts(spark):
    """Words far into long texts and beyond thousands of documents count as often as they occur."""
    from hourloom.llm import secrets

    rows = [(k, "alpha beta gamma delta " + "epsilon " * 20 + ("Zeta" if k % 2 else "mIxed 7x")) for k in range(200)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter({"alpha": 200, "beta": 200, "gamma": 200, "delta": 200, "epsilon": 4000, "zeta": 100})
    counts = found.selectExpr("explode(words) AS word").groupBy("word").count().withColumnRenamed("count", "n").cache()
    assert {r.word: r.n for r in counts.collect()} == want
    assert Counter(secrets.null_words(counts)) == want
    few = Counter(secrets.null_words(counts, 490))
    assert set(few) <= set(want) and all(abs(few[w] - n * 490 / 4900) < 1 for w, n in want.items())


def test_null_runs_draw_each_word_from_all_of_a_large_corpus(spark, monkeypatch):
    """Beyond what goes along as a list, no shorter list stands for the words: rare ones are drawn as often as they occur, and the same way again."""
    from hourloom.llm import secrets

    whole = secrets.null_words

    def none_left_out(counts, most=secrets.DRAWN_WORDS):
        assert counts.selectExpr("sum(n) AS n").first().n <= most
        return whole(counts, most)

    monkeypatch.setattr(secrets, "null_words", none_left_out)
    rng = random.Random(7)
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(20_000)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(40)]
    rows = [(k, " ".join(rare[k::40]) + " often" * 1500 + f" {keys[k]} some-ordinary-identifier_with_words") for k in range(40)]
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    called = [rows[r.doc_id][1][x.start : x.stop] for r in got for x in r.tested if x.random]
    assert sum(c in keys for c in called) > 30 and not any("identifier" in c for c in called)
    counts = spark.createDataFrame([(w, 1) for w in rare] + [("often", 60_000)], "word string, n long")
    drawn = [secrets.drawn_words(counts.repartition(parts), [30_000, 1, 49_999]).collect() for parts in (2, 5)]
    assert sorted(drawn[0]) == sorted(drawn[1]) and Counter(r.job for r in drawn[0]) == {0: 30_000, 1: 1, 2: 49_999}
    of = Counter(r.word for r in drawn[0])
    assert abs(of["often"] - 60_000) < 600 and abs(len(of) - 1 - 20_000 * (1 - math.exp(-1))) < 400


def test_sums_of_a_task_are_held_once_and_sent_in_parts(monkeypatch):
    """Summing up gives columns up as it goes, and no batch is as large as all that a task has seen."""
    import tracemalloc

    n, rng = 400_000, np.random.default_rng(1)
    fp, check = rng.integers(0, 1 << 63, n, np.uint64) >> np.uint64(44), rng.integers(-(1 << 62), 1 << 62, n)
    tracemalloc.start()
    own = co.Sums(2, "low", "high", "at")
    for k in range(0, n, 50_000):
        own.add(fp[k : k + 50_000].copy(), *[check[k : k + 50_000].copy() for _ in range(3)])
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    own.sum_up()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < held * 1.8
    sent = list(own.batches())
    assert max(b.num_rows for b in sent) < 70_000 < sum(b.num_rows for b in sent) == len(np.unique(fp))
    got = {r["fp"]: (r["low"], r["high"]) for b in sent for r in b.slice(0, 50).to_pylist()}
    assert all((check[fp == f].min(), check[fp == f].max()) == v for f, v in got.items()) and not own.size


def unspaced(rng, form, n):
    """Texts without blanks: han with and without stops, tables, code, one word a line, and a mix of what is hard to cut."""
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 3000, 7)]
    pieces = {
        "han": lambda: rng.choice(han), "stops": lambda: rng.choice([*han[:200], "，", "。"]), "table": lambda: rng.choice(["abc", "12", "3.5", "x_y"]) + rng.choice([",", ",", "\n"]),
        "code": lambda: rng.choice(["foo(", "bar)", ";", "\n", "\t", "if(", "x=1", "'s", "''", "don't", "{}"]), "lines": lambda: rng.choice(["word", "another", "é"]) + "\n",
        "mix": lambda: rng.choice(["'", "'s", "'re", "s", "ll", "\n", "\n\n", "\t", "\x85", "\x1c", "​", "é", "é", "９", "½", "漢", "🙂", "!", "!'", "١", "ไทย", "\U0001e900", " ", "　", "a", "Z", "0"]),
    }
    out = ""
    while len(out) < n:
        out += pieces[form]()
    return out[:n]


@pytest.mark.parametrize("form", ["han", "stops", "table", "code", "lines", "mix"])
def test_unspaced_texts_have_small_leaves(form):
    from hourloom.llm import token_counts
    from hourloom.llm.tokenize import default_file, encoder

    rng, enc = random.Random(1), encoder(default_file())
    size = lambda t: len(enc.tokenizer.encode(t, add_special_tokens=False).ids)
    text = unspaced(rng, form, 100_000)
    tree = token_counts.build(text, enc)
    assert tree.total == size(text) and (form == "mix" or max(map(len, tree.pieces)) < 1000)
    for k in range(12):
        at, insert = rng.randrange(len(text)), unspaced(rng, rng.choice([form, "mix"]), rng.randrange(6))
        delete = rng.randrange(4)
        work = token_counts.edit(tree, at, delete, insert, enc)
        text = text[:at] + insert + text[at + delete :]
        assert tree.text == text and (form == "mix" or work <= 3)
    assert tree.total == size(text)


@pytest.mark.parametrize("seed", range(3))
def test_edits_of_unspaced_texts_count_as_a_full_encoding(seed, monkeypatch):
    from hourloom.llm import token_counts
    from hourloom.llm.tokenize import default_file, encoder

    monkeypatch.setattr(token_counts, "LONG", 4)
    monkeypatch.setattr(token_counts, "PIECE", 1)
    rng, enc = random.Random(seed), encoder(default_file())
    for _ in range(150):
        form = rng.choice(["mix", "mix", "mix", "code", "han", "table"])
        text = unspaced(rng, form, rng.randrange(60)) + rng.choice(["", " ", " a", "  b"])
        assert "".join(token_counts.chunks_of(text, enc)) == text
        tree = token_counts.build(text, enc, 2)
        for _ in range(5):
            at, delete, insert = rng.randrange(len(text) + 2), rng.randrange(5), unspaced(rng, "mix", rng.randrange(4)) + rng.choice(["", "", " "])
            token_counts.edit(tree, at, delete, insert, enc, 2)
            text = text[:at] + insert + text[at + delete :]
            assert tree.text == text and tree.total == len(enc.tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_after_edits_are_those_of_the_edited_texts(spark):
    from pyspark.sql import functions as F

    from hourloom.llm import store, token_counts
    from hourloom.llm.tokenize import default_file, encoder

    rng, enc = random.Random(5), encoder(default_file())
    texts = [None, "", "one", "two words", *[" ".join(unspaced(rng, "table", rng.randrange(1, 9)).replace("\n", "") or "x" for _ in range(rng.randrange(1, 400))) for _ in range(25)], "abc,def;" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trees = store.materialise(token_counts.build_trees(docs), "trees")
    got = {r.doc_id: r for r in token_counts.apply_edits(trees, token_counts.redaction_edits(F.array_join("pieces", ""))).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        now, size = text, len(text)
        for at, delete, insert in ((size // 2, 20, "[masked]"), (0, 0, re.match(r"[^ \t\n\x0b\f\r]{0,40}", text)[0] + " "), (size // 3, 1, "")):
            now = now[:at] + insert + now[at + delete :]
        full = lambda t: len(enc.tokenizer.encode(t, add_special_tokens=False).ids)
        assert (got[k].tokens_before, got[k].tokens_after) == (full(text), full(now)) and "".join(got[k].pieces) == now


def test_scores_are_those_of_plain_sums():
    """A text's score is the sigmoid of its subwords' mean margin, subwords being written out one by one."""
    from hourloom.llm import toxicity

    rng = np.random.default_rng(3)
    margins, places = rng.normal(size=toxicity.BUCKETS), [int(p) for p in toxicity._PLACES]
    bucket = lambda h, n: int(toxicity._bucket(np.array([h % (1 << 64)], np.uint64), n)[0])

    def plain(text):
        found = []
        for word in toxicity.words_of(text):
            c = [ord(x) for x in f"<{word}>"]
            found.append(bucket(sum(v * places[k % len(places)] for k, v in enumerate(c)), 0))
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                found += [bucket(sum(c[i + k] * places[k] for k in range(n)), n) for i in range(len(c) - n + 1)]
        z = 0.25 + (np.mean([margins[b] for b in found]) if found else 0.0)
        return 1 / (1 + np.exp(-z))

    texts = [None, "", "a", "Some words, some WORDS", "naïve 漢字 🙂", "x" * 300, "repeat repeat repeat"]
    assert toxicity.Scorer(margins, 0.25).scores(texts) == pytest.approx([plain(t) for t in texts], rel=1e-9)


def test_searches_in_parts_find_what_one_search_finds(spark, monkeypatch):
    from hourloom.llm import decontaminate

    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "w" * 90, "é"]) for _ in range(n))
    items = [(k, words(rng.randrange(3, 40))) for k in range(30)]
    docs = [(k, f"{words(30)} {rng.choice(items)[1]} {words(9)}" if k % 3 else words(40)) for k in range(40)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda: sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.n_near_items) for r in decontaminate.judge(decontaminate.matches(*tables, slop=1)).collect())
    whole = told()
    monkeypatch.setattr(decontaminate, "SEARCH_BYTES", 600)
    assert told() == whole and any(r[2] for r in whole)
