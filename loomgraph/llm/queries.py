"""The queries ``opN_<name>``: each operator with production parameters on its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, jaccard_join, language_model, mixing, packing, quality, sharding, suffix_dedup, token_files, url_filter

#: Host and path rules, and the list: whole sites by name, with and without a blog.
RULES = """VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)"""
LISTED_SITES = """
    SELECT prefix || name || '.example.' || top AS url
    FROM VALUES ('casino-win'), ('cheap-pills'), ('free-bets'), ('ads-track'), ('spam-farm'), ('adult-x') AS names(name)
    LATERAL VIEW explode(array('com', 'net', 'org')) tops AS top LATERAL VIEW explode(array('', 'blog.')) prefixes AS prefix"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), order=3)


def op3_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_crc32")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {RULES}"), spark.sql(LISTED_SITES)).drop("listed")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def tokenizer_json(name: str) -> str:
    """A public tokenizer's file, read by the driver and sent along with the tasks (2 MB)."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op8_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"))


def op9_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"))
    return token_files.read_ids(manifest)


QUERIES = {f.__name__: f for f in (op1_shard_ring, op2_lm_score, op3_mix_schedule, op4_jaccard_join, op5_suffix_dedup, op6_url_filter, op7_exact_dedup, op8_pack_curve, op9_quality_ratio, op10_token_files)}

ORACLES = {
    "op6_url_filter": r"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        sites(site) AS (
            SELECT prefix || name || '.example.' || top
            FROM (VALUES ('casino-win'), ('cheap-pills'), ('free-bets'), ('ads-track'), ('spam-farm'), ('adult-x')) n(name),
                 (VALUES ('com'), ('net'), ('org')) t(top), (VALUES (''), ('blog.')) p(prefix)),
        named AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') AS name FROM parts),
        best AS (
            SELECT *, (SELECT max_by({'rule': h || p, 'v': v}, length(h || p)) FROM rules
                       WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r,
                   name IN (SELECT site FROM sites) AS hit
            FROM named)
        SELECT page_id, host, path, r.rule AS rule,
               coalesce(r.v, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict
        FROM best""",
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(length(text), 0) AS cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY cp DESC, doc_id)""",
}
