"""URL filters: a blocked Bloom filter before an exact join with listed URLs and rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words (of 64 bits) of a filter that is held as a literal in each task: 1 MB.
HELD_WORDS = 2**17
KEYS_PER_WORD = 6
PROBES = 4


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_part(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One name for the variants of a page: no ``www.`` or ``m.``, no trailing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """The bits that a key sets in its word: four of 64."""
    salted = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(salted, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0)
    for i in range(1, PROBES):
        mask = mask.bitwiseOR(bit(i))
    return mask


class BlockedBloom:
    """A Bloom filter whose probes of one key all fall into one 64-bit word."""

    def __init__(self, keys: DataFrame, column: str = "key", held_words: int = HELD_WORDS):
        count = keys.count()
        self.words = max(1, -(-count // KEYS_PER_WORD))
        self.table = keys.groupBy(_block(F.col(column), self.words).alias("block")).agg(
            F.bit_or(_mask(F.col(column))).alias("word")
        )
        self.literal = None
        if self.words <= held_words:
            dense = [0] * self.words
            for block, word in self.table.collect():  # at most held_words numbers
                dense[block] = word
            self.literal = F.from_json(F.lit(json.dumps(dense)), "array<bigint>")

    def may_hold(self, key: Column) -> Column:
        """False for most keys that were not put in, true for all that were."""
        word = F.element_at(self.literal, _block(key, self.words) + 1)
        return word.bitwiseAND(_mask(key)) == _mask(key)

    def passing(self, df: DataFrame, column: str = "key") -> DataFrame:
        """The rows whose key may have been put in; a filter too large to be held in
        each task is joined by block instead."""
        if self.literal is not None:
            return df.where(self.may_hold(F.col(column)))
        key = F.col(column)
        probed = df.withColumn("_block", _block(key, self.words)).join(
            self.table.withColumnRenamed("block", "_block"), "_block"
        )
        return probed.where(F.col("word").bitwiseAND(_mask(key)) == _mask(key)).drop("_block", "word")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """Judges every url by the longest fitting rule, else by the list.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the
    url's path starts with the rule's. ``listed(url)``: canonical URLs (see
    :func:`canonical`, without scheme) to be blocked; one without a path lists its whole host.

    A page's keys are its canonical URL, its canonical host and, for every number of labels
    that rule hosts have and every length of their paths, a rule key: as many keys as the
    rules have shapes, however long the url. The blocked Bloom filter lets possible hits
    pass to an equi-join with the exact keys, which removes false positives.

    Returns ``id_col, host, path, rule, listed, verdict``, one row per input row. A null
    url, or one without ``://``, has empty host and path, no rule and ``allow``. An
    empty rule table or list is allowed; a null in either is ignored; of two rules with one
    host and path one counts. Repeated rows and ids are judged one by one; very long urls cost
    their length once for each shape; other columns are not read, so their names may be any.
    """
    mark = F.lit("\x00")
    entry = F.concat("host", "path")
    rule_keys = rules.where("host is not null and path is not null").select(
        F.concat(F.lit("rule"), mark, entry).alias("key"), entry.alias("rule"), "verdict",
        F.length("path").alias("reach"), F.size(F.split("host", r"\.")).alias("labels"),
    ).dropDuplicates(["key"])
    list_keys = listed.where("url is not null").select(
        F.concat(F.lit("list"), mark, "url").alias("key"), F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("verdict"),
    ).distinct()
    shapes = rule_keys.select("labels", "reach").distinct().orderBy("labels", "reach").collect()  # of rules, few
    exact = rule_keys.drop("reach", "labels").unionByName(list_keys)
    bloom = BlockedBloom(exact, held_words=held_words)

    parts = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        host_of(F.col(url_col)).alias("host"), path_part(F.col(url_col)).alias("path"),
    )
    parts = stored(parts, "url-parts")  # row numbers have to stay
    labels = F.split("host", r"\.")
    named = [F.concat(F.lit("list"), mark, canonical(F.col("host"), x)) for x in (F.col("path"), F.lit(""))]
    for n, reach in shapes:
        suffix = F.concat_ws(".", F.slice(labels, -n, n))
        fits = (F.size(labels) >= n) & (F.length("path") >= reach)
        named.append(F.when(fits, F.concat(F.lit("rule"), mark, suffix, F.substring("path", 1, reach))))
    keys = F.array_compact(F.array_distinct(F.array(*named)))
    parts = parts.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")))
    if bloom.literal is not None:
        parts = parts.withColumn("keys", F.filter("keys", bloom.may_hold))
        hits = parts.select("*", F.explode_outer("keys").alias("key")).drop("keys")
        judged = hits.join(exact, "key", "left")
    else:
        hits = parts.select("*", F.explode_outer("keys").alias("key")).drop("keys")
        possible = bloom.passing(hits.select("_row", "key")).join(exact, "key")
        judged = hits.join(possible, ["_row", "key"], "left")
    by_rule = F.col("rule").isNotNull()
    best = judged.groupBy("_row", "_id", "host", "path").agg(
        F.max(F.when(by_rule, F.struct(F.length("rule"), "rule", "verdict"))).alias("best"),
        F.coalesce(F.bool_or(~by_rule & F.col("verdict").isNotNull()), F.lit(False)).alias("listed"),
    )
    return best.select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), "listed",
        F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
