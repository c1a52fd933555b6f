"""The pipeline's stages on a small folder, each held against brute force on its own input."""

import random
import re

import corpus_pipeline
from hourloom.llm import ngram_join, store

VOCABULARY = ["".join(random.Random(k).choice("abcdeinorst") for _ in range(3 + k % 5)) for k in range(500)]
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def test_pipeline(spark, tmp_path):
    passage = text(40, 7)
    rows = [(k, text(100, k) + (" moron loser moron" if k % 5 == 0 else ""), "en", f"s{k % 3}", 1) for k in range(300)]
    rows += [(300, text(100, 1), "en", "s0", 1), (301, text(100, 2) + " x", "en", "s0", 1), (302, text(60, 9000) + " " + passage, "en", "s1", 1), (303, None, None, None, None), (304, "", "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = store.materialise(stage(spark, docs, folder), "test-stage")
        seen.append(docs)
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert all(d.columns == seen[0].columns for d in seen[:5])
    toxic = {k for k in range(0, 300, 5)}
    assert len(toxic & set(ids[1])) <= 8 and len(set(ids[0]) - toxic - set(ids[1])) <= 6
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    sets = {d: ngram_join.shingle_set(ngram_join.split_words((t or "").encode()), 5) for d, t in texts.items()}
    gone = {b for a in sets for b in sets if a < b and ngram_join.links(sets[a], sets[b], 80)}
    assert sorted(ids[2]) == sorted(set(ids[1]) - gone) and {300, 301} <= gone | (set(ids[0]) - set(ids[1]))
    words = {r.doc_id: PLAIN.findall((r.text or "").lower()) for r in seen[2].collect()}
    item = PLAIN.findall(passage.lower())
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    hits = {d: len({j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}) for d, w in words.items()}
    bad = {d for d, n in hits.items() if n and 20 * n >= len(words[d])}
    assert sorted(ids[3]) == sorted(set(ids[2]) - bad) and 302 in bad and 303 in ids[3]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(k) for k in set(ids[4])) <= 2
    assert sorted(ids[5]) == sorted(ids[4])
    assert corpus_pipeline.run(spark, folder).count() == len(ids[5])


def test_stages_on_nulls_and_empty_tables(spark, tmp_path):
    """Null ids, texts and sources, blank and repeated rows, extra columns with clashing names; then no rows at all."""
    odd = [(None, None, None, None, None, "x"), (None, "a b", None, None, 1, "y"), (1, "", "en", "s", 0, None), (1, "", "en", "s", 0, None), (2, "w " * 20_000, "en", None, 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    for name, rows in (("odd", odd), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = store.materialise(stage(spark, docs, folder), "test-stage")
            if k < 4:
                assert docs.columns == schema.replace(",", "").split(" ")[::2]
            if k < 3:
                # Rows without an id have no identity and stay; rows of one id become one at the near-copy stage.
                assert docs.count() == (len(rows) if k == 0 else max(0, len(rows) - 1))
        assert (docs.count() > 0) == bool(rows)


def test_a_fit_returns_the_drivers_memory(spark, monkeypatch):
    """What freed texts leave behind goes back to the system, before the fit and after it."""
    from pathlib import Path

    from hourloom.llm import toxicity

    held = lambda: sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())) / 1024
    texts = ["x" * (2000 + k % 3000) for k in range(30_000)]
    kept, full = texts[::500], held()
    del texts
    store.give_back()
    assert held() < full - 60 and len(kept) == 60
    calls = []
    monkeypatch.setattr(store, "give_back", lambda: calls.append("back"))
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: calls.append("fit"))
    docs = spark.createDataFrame([(k, "a b") for k in range(9)], "doc_id long, text string")
    toxicity.fit_on(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as toxic"))
    assert calls == ["back", "fit", "back"]
