"""Search and scoring of documents against query terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import tokens


def term_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, length, term)``, a row per token of each document."""
    found = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return found.select("id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, df, n)``: documents with a token and its occurrences."""
    rows = term_rows(docs, id_col, text_col).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def bm25(
    docs: DataFrame, query: list[str], id_col: str = "id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25
) -> DataFrame:
    """``(id, score)`` of documents with a query term, by Okapi BM25.

    A term in more than half of the documents would weigh less than nothing; it gets
    ``epsilon`` times the mean weight of the query's other terms.
    """
    listed = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    listed = listed.select("id", F.size("t").cast("long").alias("length"), F.filter("t", lambda x: x.isin(query)).alias("t"))
    total, mean = listed.agg(F.count("*"), F.avg("length")).first()
    tf = listed.select("id", "length", F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    floor = idf.where("idf >= 0").agg((F.coalesce(F.avg("idf"), F.lit(0.0)) * epsilon).alias("floor"))  # one row
    # at most one row per query term
    idf = idf.join(F.broadcast(floor)).select("term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    norm = k1 * (1 - b + b * F.col("length") / F.lit(mean))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return tf.join(F.broadcast(idf), "term").groupBy("id").agg(F.sum(part).alias("score"))


def overlap(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of token sets ``(id, tokens)`` with ``share``, the shared part of the left set."""
    a = left.select(F.col("id").alias("a"), F.array_distinct("tokens").alias("t"))
    a = a.select("a", F.size("t").alias("n"), F.explode("t").alias("term"))
    b = right.select(F.col("id").alias("b"), F.explode(F.array_distinct("tokens")).alias("term"))
    shared = a.join(b, "term").groupBy("a", "b", "n").agg(F.count("*").alias("shared"))
    return shared.withColumn("share", F.col("shared") / F.col("n")).where(F.col("share") >= least)


def keyword_weights(found: DataFrame, total: int) -> DataFrame:
    """``(keyword, weight)`` of ``(keyword, id)`` hits: common keywords weigh less."""
    ratio = F.col("n") / F.lit(total)
    counts = found.distinct().groupBy("keyword").agg(F.count("*").alias("n"))
    return counts.select("keyword", F.when(ratio > 0.8, 0.2).when(ratio > 0.5, 0.5).otherwise(1.0).alias("weight"))


def spread_scores(scores: DataFrame, links: DataFrame, least: float = 20.0, part: float = 0.25) -> DataFrame:
    """``(id, score)`` after each row of at least ``least`` gave its neighbours a part of its score."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    given = both.join(scores.where(F.col("score") >= least), both["src"] == scores["id"])
    given = given.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * part).alias("extra"))
    return scores.join(given, "id", "full").select("id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("score"))


def find_symbols(symbols: DataFrame, wanted: str) -> DataFrame:
    """``(id, name, tier)`` of the best tier that has rows: the name holds the wanted text; it
    shares a part of a camel- or snake-case name; a part begins with the other's."""
    from loomgraph.functions.text import identifier_parts

    low = wanted.lower()
    parts = identifier_parts(F.lit(wanted))
    own = identifier_parts(F.col("name"))
    near = F.exists(own, lambda a: F.exists(parts, lambda b: (F.length(a) >= 3) & (F.length(b) >= 3) & (F.startswith(a, b) | F.startswith(b, a))))
    tier = F.when(F.contains(F.lower("name"), F.lit(low)), 0).when(F.arrays_overlap(own, parts), 1).when(near, 2)
    found = symbols.select("id", "name", tier.alias("tier")).where("tier is not null")
    best = found.agg(F.min("tier").alias("tier"))  # one row
    return found.join(F.broadcast(best), "tier").select("id", "name", "tier")


def token_share(docs: DataFrame, query: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, share)``: the part of the query's terms that a document has."""
    terms = F.array(*[F.lit(t) for t in query])
    hit = F.size(F.array_intersect(tokens(F.coalesce(F.col(text_col), F.lit(""))), terms)) / F.lit(float(len(set(query))))
    return docs.select(F.col(id_col).alias("id"), hit.alias("share")).where("share > 0")


# Words that stand for each other in a query.
SYNONYMS = {
    "task": ["job", "process", "run", "execution"],
    "cancel": ["stop", "abort", "interrupt"],
    "progress": ["status", "poll"],
    "reload": ["refresh", "revalidate"],
    "import": ["ingest", "load", "etl"],
    "history": ["log", "audit"],
    "data": ["row", "table"],
    "failure": ["error", "exception", "failed"],
    "success": ["ok", "completed", "done"],
    "auth": ["login", "session", "token", "credential"],
    "config": ["setting", "option", "preference", "env"],
    "delete": ["remove", "destroy", "drop", "purge"],
    "create": ["add", "new", "insert", "build"],
    "update": ["edit", "modify", "change", "patch"],
    "api": ["endpoint", "route", "handler", "controller"],
    "ui": ["frontend", "component", "page", "view", "render"],
    "db": ["database", "sql", "migration", "schema"],
    "file": ["io", "read", "write", "stream", "upload", "download"],
    "queue": ["message", "event", "dispatch", "worker"],
    "cache": ["redis", "memcache", "store", "invalidate"],
}


def expand_keywords(keywords: list[str]) -> list[tuple[str, str | None]]:
    """The words of a query and their synonyms, each with the word it stands for (None: its own).

    A word's synonyms follow it; a word that is itself a synonym brings its head word and
    that word's others. The first mention of a word counts.
    """
    head = {word: key for key, words in SYNONYMS.items() for word in words}
    steps = [(w, s) for k in keywords for w, s in ((k, None), *((x, k) for x in SYNONYMS.get(k, [])))]
    steps += [(w, s) for k in keywords if k in head for w, s in ((head[k], k), *((x, head[k]) for x in SYNONYMS[head[k]] if x != k))]
    found: dict[str, str | None] = {}
    for word, source in steps:
        found.setdefault(word, source)
    return list(found.items())


def keyword_rows(spark, words: list[str]) -> DataFrame:
    """``(keyword, source, place)`` of an expanded query."""
    rows = [(w, s, i) for i, (w, s) in enumerate(expand_keywords(words))]
    return spark.createDataFrame(rows, "keyword string, source string, place int")


def file_hits(files: DataFrame, symbols: DataFrame, words: list[str]) -> DataFrame:
    """``(file, keyword, source, place, in_path, in_stem, in_token, in_symbol)`` of files that a
    word of the expanded query hits. The words of a query are few, so each file holds them
    all as an array; nothing is joined but the files of symbol hits."""
    from loomgraph.functions.text import identifier_parts, stem

    expanded = expand_keywords(words)
    listed = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(s).cast("string").alias("source"), F.lit(i).alias("place")) for i, (w, s) in enumerate(expanded)])
    hit = symbols.select("file", F.explode(F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(w)), F.lit(w)) for w, _ in expanded]))).alias("keyword")).distinct()
    rows = files.select("file").distinct().select("file", F.explode(listed).alias("k")).select("file", "k.*")
    name = stem(F.col("file"))
    rows = rows.withColumns({
        "in_path": F.contains(F.lower("file"), F.col("keyword")), "in_stem": F.contains(F.lower(name), F.col("keyword")),
        "in_token": F.exists(identifier_parts(name), lambda t: F.contains(t, F.col("keyword"))),
    })
    rows = rows.join(hit.withColumn("in_symbol", F.lit(True)), ["file", "keyword"], "left").na.fill(False, ["in_symbol"])
    return rows.where("in_path or in_stem or in_token or in_symbol")


def topic_scores(files: DataFrame, symbols: DataFrame, words: list[str], weighted: bool = True) -> DataFrame:
    """``(file, score)`` of files for a query: hits of its words, and less of their synonyms, in
    path, name, parts of the name and symbols; little for noise, less for tests.

    Words that hit most files weigh less (:func:`keyword_weights`).
    """
    from loomgraph.functions.text import is_noise_file, is_test_file

    hits = file_hits(files, symbols, words)
    if weighted:
        total = files.select("file").distinct().count()
        hits = hits.join(F.broadcast(keyword_weights(hits.select("keyword", F.col("file").alias("id")), max(1, total))), "keyword")  # a row per word
    else:
        hits = hits.withColumn("weight", F.lit(1.0))
    own = F.col("source").isNull()
    points = (
        F.when(F.col("in_path"), F.when(own, 30).otherwise(15) * F.when(F.col("in_stem"), 2).otherwise(1)).otherwise(0)
        + F.when(F.col("in_stem"), F.when(own, 25).otherwise(12)).when(F.col("in_token"), F.when(own, 15).otherwise(8)).otherwise(0)
        + F.when(F.col("in_symbol"), F.when(own, 15).otherwise(8)).otherwise(0)
    )
    found = hits.groupBy("file").agg(F.sum(points * F.col("weight")).alias("score"))
    less = F.when(is_noise_file(F.col("file")), 0.05).otherwise(1.0) * F.when(is_test_file(F.col("file")), 0.55).otherwise(1.0)
    return found.select("file", (F.col("score") * less).alias("score")).where("score > 0")


def match_reasons(files: DataFrame, symbols: DataFrame, words: list[str], most: int = 6) -> DataFrame:
    """``(file, reasons)``: why a file matches, in order of the expanded query."""
    from loomgraph.functions.text import is_test_file

    hits = file_hits(files, symbols, words)
    by = F.when(F.col("source").isNull(), F.concat(F.lit(" hit: "), "keyword")).otherwise(F.concat(F.lit(" hit: "), "source", F.lit(" -> "), "keyword"))
    kinds = [(F.col("in_path"), "path"), (F.col("in_stem"), "file name"), (~F.col("in_stem") & F.col("in_token"), "file name part"), (F.col("in_symbol"), "symbol")]
    told = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), "place", F.concat(F.lit(t), by).alias("text"))) for i, (c, t) in enumerate(kinds)]))
    listed = hits.select("file", F.explode(told).alias("r")).groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.col("r.i") == 3, F.col("r.place"), F.col("r.i"), F.col("r.text")))).alias("r"))
    reasons = F.transform("r", lambda x: x["text"])
    reasons = F.when(is_test_file(F.col("file")), F.concat(reasons, F.array(F.lit("test hit")))).otherwise(reasons)
    return listed.select("file", F.slice(reasons, 1, most).alias("reasons"))


def query_files(files: DataFrame, symbols: DataFrame, links: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``(file, score, role, reasons)`` of the best files for a query.

    Scores are spread one step over ``links(src, dst)`` of files. With fewer than three
    matches the expanded words are asked as well, if that finds more. A file outside tests
    with a score of 30 or more is core, others support it. No match gives no rows.
    """
    from loomgraph.functions.text import is_test_file

    words = query.lower().split()
    found = topic_scores(files, symbols, words)
    few = found.limit(3).count()
    if few < 3:
        more = topic_scores(files, symbols, [w for w, _ in expand_keywords(words)])
        if more.limit(few + 1).count() > few:
            found = more
    found = spread_scores(found.withColumnRenamed("file", "id"), links).withColumnRenamed("id", "file")
    role = F.when((F.col("score") >= 30) & ~is_test_file(F.col("file")), "core").otherwise("supporting")
    best = found.orderBy(F.desc("score"), "file").limit(limit).withColumn("role", role)
    return best.join(match_reasons(files, symbols, words), "file", "left").orderBy(F.desc("score"), "file")


def symbol_documents(symbols: DataFrame) -> DataFrame:
    """``(id, text)``: what a search for symbols looks at."""
    parts = ["name", "signature", "docstring", "return_type", "params", "kind"]
    return symbols.select("id", F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in parts if c in symbols.columns]).alias("text"))


def search_symbols(symbols: DataFrame, ranks: DataFrame, query: str, top: int = 20) -> DataFrame:
    """``(id, score)`` of symbols by BM25 times a factor of their rank, best first."""
    words = [w for w in re.findall(r"[^\W][\w]*", query.lower())]
    if not words:
        return ranks.select("id", F.lit(0.0).alias("score")).limit(0)
    found = bm25(symbol_documents(symbols), words).where("score > 0").join(ranks.select("id", "rank"), "id", "left")
    score = F.round(F.col("score") * (1 + 10 * F.coalesce("rank", F.lit(0.0))), 4)
    return found.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def query_reading_order(matches: DataFrame, analysis: DataFrame, limit: int = 10) -> DataFrame:
    """``(place, file, reason)`` of matches ``(file, score)``: index files, strong matches, the rest."""
    first = reduce(lambda a, b: a | b, [F.col("file").endswith(e) for e in ("index.ts", "index.tsx", "main.ts", "main.py")])
    stage = F.when(first, 0).when(F.col("score") >= 60, 1).otherwise(2)
    reason = F.when(first, "entry point or index").when((F.col("score") >= 60) & (F.col("neighbors") >= 3), "strong match, linked with many files").when(F.col("score") >= 60, "strong match").otherwise("related match")
    rows = matches.join(analysis.select("file", "neighbors"), "file", "left").withColumns({"stage": stage, "reason": reason})
    order = [F.col("stage"), F.desc("score"), F.col("file")]
    return rows.orderBy(*order).limit(limit).select(F.row_number().over(W.orderBy(*order)).cast("long").alias("place"), "file", "reason")  # at most limit rows
