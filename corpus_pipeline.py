"""A corpus pipeline over ``documents``: quality, exact and near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. The
first four return the columns of ``documents``, the last the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, jaccard_join, mixing, packing, quality
from loomgraph.llm.queries import tokenizer_json
from loomgraph.llm.shared import SPACE, WORD, stored, text_crc


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    Each row is judged on its own, repeated rows and ids too; null and empty texts go;
    columns may have any name.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return quality.judge(rows, trusted, carry=("_row",)).where("kept").select("_row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts: the longest, then the smallest id.

    Rows of one id and one normalised text are told apart by length and, if fully equal,
    by nothing: one of them stays. Null and empty texts are equal; columns may have any name.
    """
    kept = exact_dedup.dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", ""), 256)
    rows = docs.select(F.col("doc_id").alias("own_id"), sha.alias("own_sha"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.struct("*").alias("row"))
    found = rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left_semi")
    same = W.partitionBy("own_id", "own_sha").orderBy(F.desc("length"))
    return found.withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id stays.

    Rows are known by id and text: an id with a second, different text loses only the text
    that is similar to an earlier one. Of rows of one id in one group the one with the
    smallest text hash stays, of fully equal rows one. Rows without id or words are in no
    group and all stay, as do all columns, whatever their names.
    """
    rows = docs.select(F.col("doc_id"), "text", F.xxhash64("text").alias("crc"), F.struct("*").alias("row"))
    linked = jaccard_join.join(rows, carry=("crc",)).where("group_key is not null")
    stays = linked.groupBy("group_key").agg(F.min(F.struct("doc_id", "crc")).alias("first")).select("first.*")
    single = F.col("doc_id").isNull() | (F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))) == 0)
    alone = rows.where(single).select("row.*")
    first = rows.where(~single).join(stays, ["doc_id", "crc"], "left_semi")
    return first.dropDuplicates(["doc_id", "crc"]).select("row.*").unionByName(alone)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number.

    Texts without words are not taken. Rows of one id and text count once, at the most copies
    that one of them gets; columns may have any name.
    """
    mix = mixing.mix(docs).withColumn("copies", F.round(F.try_divide("taken", "size")).cast("int"))
    mix = mix.where("copies > 0").groupBy(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.col("doc_id").alias("own_id"), text_crc(F.col("text")).alias("own_crc"), F.struct("*").alias("row"))
    found = rows.join(mix, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_crc") == F.col("crc")))
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null or empty text is its end id alone, each row a
    document of its own, other columns are not read."""
    return packing.pack(docs, tokenizer_json("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing_sources),
    ("packing", packing_sequences),
]

#: Hash orders, a tokenizer and a trained ratio have no SQL form; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
