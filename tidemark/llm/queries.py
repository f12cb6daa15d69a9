"""The corpus operators as queries over the driver's tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, edit_fingerprints, extendible_shards, pii_spans, ppm_scores, quality_ranker, simhash_dedup, substring_dedup, temperature_mix, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores.score_documents(_read(spark, sf_dir, "documents"), _remainder(7) == 2)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), _remainder(3) == 1
    model = quality_ranker.fit(docs, _read(spark, sf_dir, "labels"), ~held)
    out = quality_ranker.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return extendible_shards.assign_shards(docs, size_col="n_bytes").select("doc_id", "shard", "shard_bytes", "shard_rows")


def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``group_id``: the smallest doc_id among the texts that banding and verification link; no near pair is left out."""
    out = edit_fingerprints.compare_with_edits(_read(spark, sf_dir, "documents"))
    return edit_fingerprints.near_groups(out)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix.mixing_plan(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        out = token_counts.count_tokens(_read(spark, sf_dir, "documents"), f.read())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_spans.detect_pii(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, pii_spans.KINDS), F.sha2(pii_spans.joined(base), 256).alias("base_sha256"), pii_spans.joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_ppm_scores, op3_simhash_dedup, op4_quality_ranker, op5_extendible_shards, op6_edit_fingerprints, op7_decontaminate, op8_temperature_mix, op9_token_counts, op10_pii_spans)}

_WS = "[ \\t\\n\\v\\f\\r]+"

#: DuckDB twins.
ORACLES = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '') AS w FROM documents
), win AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS g FROM d, unnest(range(1, len(w) - 11)) u(i)
), low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g
), hit AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN low USING (g), range(0, 13) r(k) WHERE m < doc_id
), gone AS (SELECT doc_id, list(i) AS x FROM hit GROUP BY doc_id
), kept AS (SELECT d.doc_id, len(w) AS n, list_filter(w, lambda v, i: NOT list_contains(coalesce(x, []), i)) AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) AS kept_sha256 FROM kept
""",
    "op5_extendible_shards": extendible_shards.ORACLE,
}
