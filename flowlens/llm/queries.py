"""The operators' registered queries: each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, fingerprint, merges, neardup, packing, pages, pieces, quality, sharding, substring, toxicity, wavelet
from .labelled import training_remainder

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.judged(docs, quality.fit_quality(docs, labels)).withColumnRenamed("id", "doc_id")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("body").withColumnRenamed("id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_digest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scores = toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).withColumnRenamed("id", "doc_id")
    return scores.select("doc_id", F.coalesce(training_remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_comparison(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents"), SHARDS).withColumnRenamed("id", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_piece_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = merges.encoded(_table(spark, sf_dir, "documents"), decode=True)
    return tokens.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality_rules, op3_minhash_near_dedup, op4_html_extraction, op5_token_files,
        op6_toxicity, op7_fingerprints, op8_packing, op9_sharding, op10_piece_paths,
        op11_merge_replay, op12_token_alignment, op13_filter_audit,
    )
}

SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
c AS (SELECT DISTINCT g.doc_id, j FROM g JOIN m USING (k), unnest(range(i, i + 50)) AS t(j) WHERE first < g.doc_id),
p AS (SELECT w.doc_id, j, list_extract(ws, j) AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j)),
k AS (SELECT p.doc_id, count(*) FILTER (c.j IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (c.j IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) AS good, max(toxic) AS bad FROM labels GROUP BY doc_id),
w AS (SELECT d.doc_id, d.part, d.t, [x FOR x IN regexp_split_to_array(d.t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws, first FROM d JOIN e ON d.t = e.t),
m AS (SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask,
    CASE WHEN good = 1 THEN 1 ELSE 0 END AS good, CASE WHEN bad = 1 THEN 1 ELSE 0 END AS bad
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, (SELECT bit FROM f WHERE letter = substr(filter_order, step, 1)) AS bit,
    coalesce((SELECT sum(bit) FROM f WHERE instr(substr(filter_order, 1, step - 1), letter) > 0), 0)::INTEGER AS before
    FROM o, range(1, 6) AS t(step)),
h AS (SELECT part, letter, sum(n * (120 // bit_count(mask))) AS shapley FROM c JOIN f ON mask & bit <> 0 GROUP BY part, letter)
SELECT c.part, s.filter_order, CAST(s.step AS INTEGER) AS step,
    CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(any_value(shapley), 0) AS BIGINT) AS shapley
FROM c CROSS JOIN s LEFT JOIN h ON h.part = c.part AND h.letter = substr(s.filter_order, s.step, 1)
GROUP BY c.part, s.filter_order, s.step
""",
}
