"""Each registered query on a small folder: every column that its contract fixes, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hourloom.llm import queries, secrets
from hourloom.llm.tokenize import default_file, encoder
from test_operators import SECRETS, brute_components, brute_links, brute_pii, words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    base, rng = words(90, 4), random.Random(12)
    keys = [f"token = '{''.join(rng.choice('ABCDEFabcdef0123456789') for _ in range(30))}' x", "AKIA" + "Q7" * 9, "f00d" * 6, "call +1 (269) 555-3296, ip 10.2.3.4 a@b.cd 4524132264652876"]
    texts = [None, "", "one", base, base, base.replace(" ", "  "), base + " tail", words(4000, 8), "é" * 70, *keys, *[words(50 + k, 50 + k) for k in range(40)]]
    return [(3 * k + 1, t, "en", [None, "b", "a", "é"][k % 4], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("small")), corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, d % 2) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, " ".join(words(90, 4).split()[20:50])), (8, "two words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def got(spark, folder):
    return lambda name: {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op1(got):
    rows, found = corpus(), got("op1_mix_sources")
    size = {d: len(BLANK.findall(t or "")) for d, t, *_ in rows}
    own = Counter()
    for d, _, _, source, _ in rows:
        own[source] += size[d]
    taken = Counter()
    for d, _, _, source, _ in rows:
        r = found[d]
        assert (r["size"], r.source_size) == (size[d], own[source]) and r.taken in (0, size[d], 2 * size[d])
        taken[source] += r.taken
    weights, targets, left = dict(zip(["a", "b", "é", None], [5, 2, 1, 5], strict=True)), {}, 1.5 * sum(own.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in weights if x not in targets) for s in weights if s not in targets}
        over = [s for s in share if share[s] > 2 * own[s]]
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * own[s]
            left -= targets[s]
    targets |= share
    for d, _, _, source, _ in rows:
        assert found[d].target == pytest.approx(targets[source])
    assert all(abs(taken[s] - targets[s]) <= max(size[d] for d, _, _, x, _ in rows if x == s) for s in own)


def test_op2(got):
    rows, found = corpus(), got("op2_ngram_jaccard_join")
    want, n_links = brute_components(rows, 4, 85), brute_links(rows, 4, 85)
    for d, t, *_ in rows:
        w = BLANK.findall((t or "").lower())
        n = len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if len(w) > 3 else bool(w)
        assert (found[d].n_shingles, found[d].component_id, found[d].n_links) == (n, want[d], n_links[d])


def test_op3(got):
    items = {"7": " ".join(words(90, 4).split()[20:50]).lower().split(), "8": ["two", "words"]}
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = got("op3_decontaminate")
    for d, t, *_ in corpus():
        w, hit, names = plain.findall((t or "").lower()), set(), set()
        for name, item in items.items():
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(name)
        r = found[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_op4(got):
    found = got("op4_virtual_slots")
    for d, t, *_ in corpus():
        raw = (t or "").encode()
        r = found[d]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 16 and r.next_shard in (r.shard, 16)
    for s in range(16):
        own = sorted(r.slot for r in found.values() if r.shard == s)
        assert own == list(range(len(own)))


def test_op5(got):
    found, seen = got("op5_audio_features"), {}
    for d, t, *_ in corpus():
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and seen.setdefault(payload, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op6(got):
    found = got("op6_toxicity")
    for d, *_ in corpus():
        r = found[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op7(got):
    found = got("op7_personal_data")
    for d, t, *_ in corpus():
        base, r = brute_pii(t or ""), found[d]
        n = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], digest(base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_op9(got):
    found, at, tok = got("op9_token_files"), 0, encoder(default_file()).tokenizer
    for d, t, *_ in sorted(corpus()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        r = found[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10(got):
    found = got("op10_secret_scan")
    fine = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    for d, t, *_ in corpus():
        base = [(k, *m.span()) for k, p in SECRETS.items() for m in re.finditer(p, t or "") if fine[k](m)]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        n, r = Counter(k for k, *_ in base), found[d]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], digest(base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
        assert r.n_random <= r.n_tested == len([x for x in r.tests.split(",") if x])


def test_op8(got):
    found, tok = got("op8_edited_token_counts"), encoder(default_file()).tokenizer
    for d, t, *_ in corpus():
        assert found[d].tokens_before == len(tok.encode(t or "", add_special_tokens=False).ids)
