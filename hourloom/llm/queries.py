"""The registered queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import collocations, decontaminate, line_dedup, link_counts, media, mixing, ngram_join, personal_data, secrets, sharding, span_text, store, token_counts
from hourloom.llm import token_files, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts.join_with_counts(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), length=13, slop=2)
    return decontaminate.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 16, grown=17).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard",
    )


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[span_text.count_of("base", k) for k in personal_data.KINDS],
        F.sha2(span_text.line(F.col("base"), personal_data.KINDS), 256).alias("base_sha256"),
        span_text.line(F.concat("base", "added"), personal_data.KINDS).alias("spans"),
    )


def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = store.materialise(token_counts.build_trees(_table(spark, sf_dir, "documents")), "token-trees")
    edited = token_counts.apply_edits(trees, token_counts.redaction_edits(F.array_join("pieces", "")))
    return edited.select("doc_id", "tokens_before", "tokens_after", "leaves", "leaves_encoded")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_files(_table(spark, sf_dir, "documents"), store.new_path(spark, "token-files"))
    return token_files.read_digests(manifest)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    every = F.concat("base", "added")
    return found.select(
        "doc_id", *[span_text.count_of("base", k) for k in secrets.KINDS],
        F.sha2(span_text.line(F.col("base"), secrets.KINDS), 256).alias("base_sha256"),
        span_text.line(every, [*secrets.KINDS, secrets.ADDED]).alias("spans"),
        F.size("tested").cast("long").alias("n_tested"), F.size(F.filter("tested", lambda r: r["random"])).cast("long").alias("n_random"),
        F.array_join(F.transform("tested", lambda r: F.format_string("%d:%d:%s:%.4f:%.4f:%.4f:%s", *[r[c] for c in ("start", "stop", "encoding", "p_chi", "p_runs", "p_serial")], r["random"].cast("string"))), ",").alias("tests"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_mix_sources, op2_ngram_jaccard_join, op3_decontaminate, op4_virtual_slots, op5_audio_features, op6_toxicity, op7_personal_data, op8_edited_token_counts,
    op9_token_files, op10_secret_scan, op11_line_dedup, op12_collocations, op13_whitening,
)

ORACLE: dict[str, str] = {}

ORACLE["op11_line_dedup"] = r"""WITH lines AS (
  SELECT row, doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5),
judged AS (SELECT r.*, o.key IS NOT NULL AND r.doc_id IS DISTINCT FROM o.last AS gone FROM keyed r LEFT JOIN often o ON o.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id"""

ORACLE["op12_collocations"] = r"""WITH pieces AS (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
spelled AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM spelled GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (
  SELECT lang, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM spelled, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
inner_ AS (SELECT lang, p, max(f) AS above FROM (
  SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : m - 1], ' '), array_to_string(string_split(phrase, ' ')[2 : m], ' ')]) AS p FROM f WHERE m > 2) GROUP BY lang, p),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1) c LEFT JOIN inner_ i ON i.lang = c.lang AND i.p = c.phrase WHERE coalesce(above, 0) < c.f),
scored AS (SELECT c.*, l.f AS l, r.f AS r, t.n, 1000::HUGEINT * a * t.n // (l.f::HUGEINT * r.f) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
