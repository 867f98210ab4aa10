"""A synthetic project made of the test tables, and the operators of code on it.

Parts are symbols, brands and sizes make their files, line items are edges. The relations
are plain SQL that both engines run; the operators are the library's, the oracles write
their rules out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, joins, metrics, related, risk, search
from loomgraph.plans.catalog import query

KINDS = "CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' ELSE 'element' END"
FOLDERS = "CASE p_size % 7 WHEN 0 THEN 'src/auth' WHEN 1 THEN 'web/api/v1' WHEN 2 THEN 'tests' WHEN 3 THEN 'web/components' WHEN 4 THEN 'lib/queue' WHEN 5 THEN 'src/types' ELSE 'vendor' END"
ENDINGS = "CASE p_size % 7 WHEN 2 THEN '_test.py' WHEN 3 THEN '.tsx' WHEN 5 THEN '.d.ts' ELSE '.py' END"
NAMES = "CASE WHEN p_partkey % 10 = 0 THEN '_' || replace(p_name, ' ', '_') WHEN p_partkey % 33 = 0 THEN '__init__' ELSE replace(p_name, ' ', '_') END"
SYMBOLS = f"""SELECT p_partkey AS id, {FOLDERS} || '/' || lower(replace(p_brand, '#', '')) || {ENDINGS} AS file, {NAMES} AS name, {KINDS} AS kind,
    CAST(p_partkey % 500 AS INT) AS line, CASE WHEN p_partkey % 10 = 0 THEN 'private' WHEN p_partkey % 4 = 1 THEN 'exported' ELSE 'public' END AS visibility,
    p_retailprice / 100000.0 AS rank FROM part"""
EDGES = """SELECT DISTINCT l_partkey AS src, (l_orderkey * 31 + l_suppkey) % (SELECT count(*) FROM part) AS dst,
    CASE WHEN l_linenumber % 3 = 0 THEN 'import' ELSE 'call' END AS kind FROM lineitem"""
WITH = f"symbols AS ({SYMBOLS}), edges AS (SELECT * FROM ({EDGES}) e WHERE src <> dst), files AS (SELECT DISTINCT file FROM symbols)"


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files``, ``symbols`` and ``edges`` of the project."""
    part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    symbols = spark.sql(SYMBOLS.replace("FROM part", "FROM {part}"), part=part)
    edges = spark.sql(EDGES.replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {line}"), part=part, line=line)
    return symbols.select("file").distinct(), symbols, edges.where("src <> dst")


IS_TEST = "(regexp_matches(lower(file), '(^|/)(test|tests|__tests__)(/|$)') OR regexp_matches(lower(file), '(^|/)test_[^/]*$') OR regexp_matches(lower(file), '(_test\\.(py|go|rs)|\\.(spec|test)\\.(ts|tsx|js|jsx)|\\.(spec|test)\\.mjs)$'))"
WEIGHT = "CASE WHEN kind IN ('element', 'selector', 'class_selector', 'id_selector', 'json_key') THEN 0.002 WHEN name IN ('__init__', '__main__') THEN 0.35 WHEN name LIKE '\\_%' ESCAPE '\\' AND visibility = 'private' THEN 0.85 ELSE 1.0 END::DOUBLE"
IS_NOISE = "(regexp_matches(lower(file), 'public/monaco-editor/|\\.min\\.js|\\.bundle\\.js|\\.generated\\.|\\.d\\.ts') OR regexp_matches(lower(file), '(^|/)(monaco-editor|vendor|third_party|third-party|node_modules|\\.next|dist|build|\\.cache)(/|$)'))"
STEM = "regexp_replace(regexp_extract(file, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


@query(f"""WITH {WITH} SELECT file, {IS_TEST} AS is_test, {IS_NOISE} AS is_noise, split_part(file, '/', CASE WHEN split_part(file, '/', 1) IN ('src', 'app', 'lib') THEN 2 ELSE 1 END) AS area,
    CASE WHEN split_part(file, '/', 1) IN ('src', 'lib') AND len(string_split(file, '/')) > 2 THEN split_part(file, '/', 1) || '/' || split_part(file, '/', 2) ELSE split_part(file, '/', 1) END AS module,
    CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.tsx' THEN 'tsx' ELSE 'typescript' END AS language,
    regexp_replace(regexp_replace({STEM}, '_test$', ''), '^test_', '') AS bare, regexp_replace(file, '\\.[^./]*$', '') AS module_path, file LIKE 'web/%.tsx' AS by_glob FROM files""")
def path_rules(spark, sf_dir):
    """Every rule over paths, on every file."""
    file = F.col("file")
    return relations(spark, sf_dir)[0].select(
        "file", T.is_test_file(file).alias("is_test"), T.is_noise_file(file).alias("is_noise"), T.impact_area(file).alias("area"), T.module_bucket(file).alias("module"),
        T.language(file).alias("language"), T.bare_name(file).alias("bare"), T.module_path(file).alias("module_path"), T.fits_glob(file, "web/*.tsx").alias("by_glob"),
    )


@query(f"""WITH {WITH}, n AS (SELECT file, count(*) FILTER (visibility = 'exported') AS e, greatest(count(*) FILTER (kind = 'class'), count(*) FILTER (kind = 'interface')) AS c,
        greatest(count(*) FILTER (kind = 'function'), count(*) FILTER (kind = 'method')) AS f, count(*) AS n FROM symbols GROUP BY 1)
    SELECT file, CASE WHEN {IS_TEST} THEN 'test' WHEN regexp_matches(lower(file), '/(components|pages|views)/') THEN 'frontend-ui' WHEN regexp_matches(lower(file), '/(stores|hooks)/') THEN 'frontend-state'
        WHEN regexp_matches(lower(file), '/(server|routes|api)/|^server/') THEN 'backend' WHEN regexp_matches(lower(file), '(\\.config\\.(ts|js|tsx)|package\\.json)$') THEN 'config'
        WHEN e >= 3 THEN 'core' WHEN c >= 2 THEN 'model' WHEN f >= 3 THEN 'service' WHEN n >= 10 THEN 'core' ELSE 'other' END AS role FROM n""")
def file_roles(spark, sf_dir):
    counts = relations(spark, sf_dir)[1].groupBy("file").agg(
        F.count_if(F.col("visibility") == "exported").alias("e"), F.greatest(F.count_if(F.col("kind") == "class"), F.count_if(F.col("kind") == "interface")).alias("c"),
        F.greatest(F.count_if(F.col("kind") == "function"), F.count_if(F.col("kind") == "method")).alias("f"), F.count("*").alias("n"),
    )
    return counts.select("file", T.file_role(F.col("file"), F.col("e"), F.col("c"), F.col("f"), F.col("n")).alias("role"))


@query(f"WITH {WITH} SELECT id, {WEIGHT} AS weight FROM symbols")
def signal_weight(spark, sf_dir):
    return relations(spark, sf_dir)[1].select("id", T.signal_weight(F.col("kind"), F.col("name"), F.col("visibility")).alias("weight"))


DEGREES = """deg AS (SELECT id, coalesce(ic, 0) AS ic, coalesce(oc, 0) AS oc, coalesce(ii, 0) AS ii FROM symbols
        LEFT JOIN (SELECT dst AS id, count(*) FILTER (kind = 'call') AS ic, count(*) FILTER (kind = 'import') AS ii FROM edges GROUP BY 1) USING (id)
        LEFT JOIN (SELECT src AS id, count(*) FILTER (kind = 'call') AS oc FROM edges GROUP BY 1) USING (id)),"""
SCORED = f"""{DEGREES} scored AS (SELECT s.*, {WEIGHT} AS weight, (4 * ic + 1.5 * oc + 0.15 * least(ii, 4) + CASE visibility WHEN 'exported' THEN 1.2 WHEN 'public' THEN 0.45 ELSE 0 END
        + CASE WHEN kind = 'class' THEN 1.0 WHEN kind IN ('function', 'method') THEN 0.55 ELSE 0.2 END + 40 * rank)::DOUBLE * {WEIGHT} AS score FROM symbols s JOIN deg USING (id))"""


@query(f"WITH {WITH}, {SCORED} SELECT id, file, round(score, 6) AS score FROM scored")
def symbol_scores(spark, sf_dir):
    _, symbols, edges = relations(spark, sf_dir)
    return metrics.symbol_scores(symbols, edges).withColumn("score", F.round("score", 6))


ANALYSIS = f"""{SCORED}, ends AS (SELECT e.kind, a.file AS a, b.file AS b FROM edges e JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst),
    best AS (SELECT file, sum(score) AS impl FROM (SELECT file, score FROM scored QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, id) <= 5) GROUP BY 1),
    base AS (SELECT file, count(*) AS symbol_count, sum(weight) AS semantic_count, sum(rank * weight) AS semantic_rank, sum(CASE WHEN visibility = 'exported' THEN weight ELSE 0 END) AS exported,
        sum(CASE WHEN visibility = 'public' THEN weight ELSE 0 END) AS pub FROM scored GROUP BY 1),
    calls AS (SELECT a AS file, count(*) FILTER (kind = 'call') AS call_edges, count(*) FILTER (kind = 'call' AND a <> b) AS cross_calls, count(*) FILTER (kind = 'import' AND a <> b) AS import_edges FROM ends GROUP BY 1),
    nb AS (SELECT file, count(*) AS neighbors FROM (SELECT a AS file, b AS o FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b) GROUP BY 1),
    analysed AS (SELECT file, symbol_count, semantic_count, semantic_rank, exported, coalesce(call_edges, 0) AS call_edges, coalesce(cross_calls, 0) AS cross_calls,
        coalesce(import_edges, 0) AS import_edges, coalesce(neighbors, 0) AS neighbors, {IS_TEST} AS is_test,
        (impl + 0.8 * exported + 0.25 * pub + 0.6 * semantic_count + 0.45 * coalesce(neighbors, 0) + 0.25 * coalesce(cross_calls, 0) + 0.05 * coalesce(call_edges, 0))
            * CASE WHEN {IS_TEST} THEN 0.55 ELSE 1 END AS score
        FROM base JOIN best USING (file) LEFT JOIN calls USING (file) LEFT JOIN nb USING (file))"""


def analysed(spark, sf_dir):
    files, symbols, edges = relations(spark, sf_dir)
    found = metrics.full_analysis(files, symbols, edges)
    return found.withColumns({c: F.round(c, 9) for c in ("semantic_count", "semantic_rank", "exported", "score")})


@query(f"""WITH {WITH}, {ANALYSIS} SELECT file, symbol_count, round(semantic_count, 9) AS semantic_count, round(semantic_rank, 9) AS semantic_rank, round(exported, 9) AS exported,
    call_edges, cross_calls, import_edges, neighbors, is_test, round(score, 9) AS score FROM analysed""")
def full_analysis(spark, sf_dir):
    return analysed(spark, sf_dir).select("file", "symbol_count", "semantic_count", "semantic_rank", "exported", "call_edges", "cross_calls", "import_edges", "neighbors", "is_test", "score")


@query(f"""WITH {WITH}, {ANALYSIS} SELECT file, round(score, 9) AS score, CASE WHEN round(semantic_count, 9) >= 12 THEN 'high' WHEN round(semantic_count, 9) >= 4 THEN 'medium' ELSE 'low' END AS risk
    FROM analysed ORDER BY is_test, round(semantic_count, 9) DESC, round(score, 9) DESC, file LIMIT 10""")
def ranked_hotspots(spark, sf_dir):
    return metrics.hotspots(analysed(spark, sf_dir)).select("file", "score", "risk")


@query(f"""WITH {WITH}, {ANALYSIS}, o AS (SELECT *, round(score, 9) AS s FROM analysed)
    SELECT row_number() OVER (ORDER BY is_test, s DESC, file) AS place, file, array_to_string(list_filter([CASE WHEN neighbors >= 3 THEN 'many neighbours' END,
        CASE WHEN round(exported, 9) >= 2 THEN 'exports' END, CASE WHEN round(semantic_count, 9) >= 5 THEN 'many symbols' END, CASE WHEN is_test THEN 'test' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM o WHERE symbol_count > 0 QUALIFY place <= 12""")
def ranked_reading_order(spark, sf_dir):
    return metrics.reading_order(analysed(spark, sf_dir)).withColumn("reasons", F.concat_ws(",", "reasons"))


@query(f"""WITH {WITH}, {ANALYSIS}, m AS (SELECT *, CASE WHEN split_part(file, '/', 1) IN ('src', 'lib') AND len(string_split(file, '/')) > 2 THEN split_part(file, '/', 1) || '/' || split_part(file, '/', 2)
        ELSE split_part(file, '/', 1) END AS module FROM analysed)
    SELECT module, count(*) AS files, sum(symbol_count)::BIGINT AS symbols, round(sum(round(semantic_count, 9)), 3) AS semantic_count, min_by(file, (-round(score, 9), file)) AS representative FROM m GROUP BY 1""")
def module_overview(spark, sf_dir):
    return metrics.module_overview(analysed(spark, sf_dir)).select("module", "files", "symbols", F.round("semantic_count", 3).alias("semantic_count"), "representative")


@query(f"WITH {WITH} SELECT dst AS id, count(*) AS n FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file GROUP BY 1")
def cross_references(spark, sf_dir):
    _, symbols, edges = relations(spark, sf_dir)
    return metrics.cross_references(edges, symbols)


@query(f"""WITH {WITH}, t AS (SELECT id FROM symbols WHERE {IS_TEST}), c AS (SELECT dst AS id, count(*) AS calls FROM edges WHERE kind = 'call' GROUP BY 1),
    u AS (SELECT s.id, calls, calls * {WEIGHT} * 5.0 AS risk FROM symbols s JOIN c USING (id) WHERE id NOT IN (SELECT id FROM t) AND kind <> 'element'
        AND id NOT IN (SELECT dst FROM edges WHERE src IN (SELECT id FROM t)) AND calls >= 2)
    SELECT id, calls, round(risk, 4) AS risk, (SELECT count(*) FROM u WHERE risk >= 5) AS total, row_number() OVER (ORDER BY risk DESC, id) AS place FROM u WHERE risk >= 5 QUALIFY place <= 30""")
def untested_symbols(spark, sf_dir):
    _, symbols, edges = relations(spark, sf_dir)
    return metrics.untested_symbols(symbols, edges).withColumn("risk", F.round("risk", 4))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'O'),
    b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'F')
    SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, kind, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT src::VARCHAR, dst::VARCHAR, kind, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def edge_diff(spark, sf_dir):
    """Open line items as the old edges, filled ones as the new."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    of = lambda s: lines.where(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return metrics.edge_diff(of("O"), of("F"))


#: A query of three words; of their synonyms some occur in paths and names.
TOPIC_WORDS = ["auth", "queue", "widget"]
EXPANDED = search.expand_keywords(TOPIC_WORDS)
EXPANDED_SQL = ", ".join(f"('{w}', {'NULL' if s is None else repr(s)}, {i})" for i, (w, s) in enumerate(EXPANDED))
HITS = f"""k(word, source, place) AS (VALUES {EXPANDED_SQL}), f AS (SELECT file, lower({STEM}) AS stem, string_split(regexp_replace(lower({STEM}), '_|-|\\.', ' ', 'g'), ' ') AS tokens FROM files),
    hit AS (SELECT f.file, word, source, place, contains(lower(f.file), word) AS p, contains(stem, word) AS s, len(list_filter(tokens, lambda t: contains(t, word))) > 0 AS t,
        EXISTS (SELECT 1 FROM symbols y WHERE y.file = f.file AND contains(lower(y.name), word)) AS y FROM f, k),
    hits AS (SELECT * FROM hit WHERE p OR s OR t OR y),
    kw AS (SELECT word, CASE WHEN count(*) > 0.8 * (SELECT count(*) FROM files) THEN 0.2 WHEN count(*) > 0.5 * (SELECT count(*) FROM files) THEN 0.5 ELSE 1.0 END AS w FROM hits GROUP BY 1)"""


@query(f"""WITH {WITH}, {HITS} SELECT file, round(sum(w * (CASE WHEN p THEN CASE WHEN source IS NULL THEN 30 ELSE 15 END * CASE WHEN s THEN 2 ELSE 1 END ELSE 0 END
        + CASE WHEN s THEN CASE WHEN source IS NULL THEN 25 ELSE 12 END WHEN t THEN CASE WHEN source IS NULL THEN 15 ELSE 8 END ELSE 0 END + CASE WHEN y THEN CASE WHEN source IS NULL THEN 15 ELSE 8 END ELSE 0 END))
        * CASE WHEN {IS_NOISE} THEN 0.05 ELSE 1 END * CASE WHEN {IS_TEST} THEN 0.55 ELSE 1 END, 4)::DOUBLE AS score FROM hits JOIN kw USING (word) GROUP BY file""")
def topic_scores(spark, sf_dir):
    files, symbols, _ = relations(spark, sf_dir)
    return search.topic_scores(files, symbols, TOPIC_WORDS).withColumn("score", F.round("score", 4))


@query(f"SELECT word, source, place FROM (VALUES {EXPANDED_SQL}) k(word, source, place)")
def expanded_query(spark, sf_dir):
    return search.keyword_rows(spark, TOPIC_WORDS).withColumnRenamed("keyword", "word")


IMPORTS = "SELECT DISTINCT a.file, regexp_replace(b.file, '\\.[^./]*$', '') AS module FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE edges.kind = 'import'"


@query(f"""WITH {WITH}, tests AS (SELECT file AS t FROM files WHERE {IS_TEST}), bare AS (SELECT file, regexp_replace(regexp_replace({STEM}, '_test$', ''), '^test_', '') AS bare FROM files),
    imports AS ({IMPORTS}), refs AS (SELECT DISTINCT a.file AS t, b.file AS f FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst),
    c AS (SELECT f.file AS target_file, t AS test_file, CASE WHEN x.bare = y.bare THEN 1 WHEN regexp_replace(t, '/[^/]*$', '') = regexp_replace(f.file, '/[^/]*$', '') THEN 2
        WHEN EXISTS (SELECT 1 FROM imports i WHERE i.file = t AND i.module = regexp_replace(f.file, '\\.[^./]*$', '')) THEN 3
        WHEN EXISTS (SELECT 1 FROM refs r WHERE r.t = tests.t AND r.f = f.file) THEN 4 END AS stage
        FROM files f, tests JOIN bare x ON x.file = tests.t JOIN bare y ON y.file = f.file)
    SELECT target_file, test_file, CASE WHEN stage IN (1, 3) THEN 'high' ELSE 'medium' END AS confidence, stage FROM c WHERE stage IS NOT NULL""")
def related_tests(spark, sf_dir):
    """The tests of every file: by name, folder, import and reference."""
    files, symbols, edges = relations(spark, sf_dir)
    ends = edges.where("kind = 'import'").join(symbols.select(F.col("id").alias("src"), "file"), "src").join(
        symbols.select(F.col("id").alias("dst"), F.regexp_replace("file", r"\.[^./]*$", "").alias("module")), "dst")
    none = spark.createDataFrame([], "a string, b string, n long")
    found = related.related_tests(files, files, ends.select("file", "module").distinct(), edges, symbols, none)
    stage = F.when(F.col("reason").startswith("exact"), 1).when(F.col("reason").startswith("same"), 2).when(F.col("reason").contains("imports"), 3).otherwise(4)
    return found.select("target_file", "test_file", "confidence", stage.alias("stage"))


RISK_SQL = " + ".join(f"max(regexp_matches(lower(path), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)')::INT) * {n}" for ws, n in ((risk.HIGH_WORDS, 3), (risk.MEDIUM_WORDS, 1)) for w in ws)


@query(f"""WITH {WITH}, {ANALYSIS}, ranks AS (SELECT file, max(rank) AS top FROM symbols GROUP BY 1),
    own AS (SELECT file, CASE WHEN neighbors >= 10 THEN 4 WHEN neighbors >= 5 THEN 3 ELSE 0 END + CASE WHEN top > 0.01 THEN 1 ELSE 0 END
        + CASE WHEN is_test THEN 0 WHEN regexp_matches(file, '(\\.config\\.(ts|js)|package\\.json)$') THEN 2 WHEN regexp_matches(file, '(^|/)types(/|$)|\\.d\\.ts$') THEN 1 ELSE 0 END AS points FROM analysed JOIN ranks USING (file)),
    paths AS (SELECT file, file AS path FROM files UNION SELECT b, a FROM ends WHERE a <> b AND kind = 'import'),
    domain AS (SELECT file, {RISK_SQL} AS d FROM paths GROUP BY 1)
    SELECT file AS change_id, (points + d)::BIGINT AS risk_score, CASE WHEN points + d >= 6 THEN 'high' WHEN points + d >= 3 THEN 'medium' ELSE 'low' END AS risk FROM own JOIN domain USING (file)""")
def risk_assess(spark, sf_dir):
    """The risk of a change of each file, with the files that import it as affected."""
    files, symbols, edges = relations(spark, sf_dir)
    ranks = symbols.groupBy("file").agg(F.max("rank").alias("top_rank"))
    targets = metrics.full_analysis(files, symbols, edges).join(ranks, "file").select(F.col("file").alias("change_id"), "file", "neighbors", "top_rank")
    ends = edges.where("kind = 'import'").join(symbols.select(F.col("id").alias("src"), "file"), "src").join(symbols.select(F.col("id").alias("dst"), F.col("file").alias("change_id")), "dst")
    return risk.assess(targets, ends.where("file <> change_id").select("change_id", "file").distinct())


#: The two files that each file imports most from.
LINKS = """links AS (SELECT a.file AS src, b.file AS dst FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file AND edges.kind = 'import' GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY a.file ORDER BY count(*) DESC, b.file) <= 2)"""
TOPS = """tops AS (SELECT file, id FROM symbols QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE visibility WHEN 'exported' THEN 3 WHEN 'public' THEN 2 WHEN 'private' THEN 1 ELSE 0 END
        + CASE WHEN kind IN ('class', 'interface') THEN 4 WHEN kind IN ('function', 'method') THEN 3 ELSE 1 END DESC, line, id) <= 3)"""


def sparse(spark, sf_dir):
    """``files``, ``symbols`` and the import edges from each file to the two that it imports most
    from: of all edges, which link every file with nearly every other, those that tell files apart."""
    files, symbols, edges = relations(spark, sf_dir)
    ends = edges.where("kind = 'import'").join(symbols.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(symbols.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    counts = ends.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = metrics.top_per_group(counts, ["a"], [F.desc("n"), F.col("b")], 2).select("a", "b")
    return files, symbols, ends.join(best, ["a", "b"], "left_semi").select("src", "dst", "kind")


@query(f"WITH {WITH}, {TOPS} SELECT file, id FROM tops")
def top_symbols(spark, sf_dir):
    return graph.top_symbols(relations(spark, sf_dir)[1])


@query(f"WITH {WITH}, {LINKS}, {TOPS} SELECT DISTINCT a.id AS src, b.id AS dst, 0.35::DOUBLE AS weight, 'import' AS kind FROM links JOIN tops a ON a.file = src JOIN tops b ON b.file = dst WHERE a.id <> b.id")
def import_edges(spark, sf_dir):
    _, symbols, edges = sparse(spark, sf_dir)
    links = graph.file_edges(edges, symbols)
    return graph.import_edges(symbols, links.select(F.col("src").alias("file"), F.col("dst").alias("target_file")))


LANGUAGE = "CASE WHEN {0} LIKE '%.py' THEN 'python' WHEN {0} LIKE '%.tsx' THEN 'tsx' ELSE 'typescript' END"


@query(f"""WITH RECURSIVE {WITH}, {LINKS}, back AS (SELECT dst AS a, src AS b FROM links WHERE {LANGUAGE.format("src")} = {LANGUAGE.format("dst")}),
    seed AS (SELECT file FROM files WHERE file LIKE 'src/auth/%'),
    walk(file, hop) AS (SELECT file, 0 FROM seed UNION SELECT b, hop + 1 FROM walk JOIN back ON a = file WHERE hop < 2),
    best AS (SELECT file, min(hop) AS hop FROM walk GROUP BY 1)
    SELECT file AS test_file, hop, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.src = file AND l.dst LIKE 'src/auth/%') THEN 'imports a changed file' WHEN hop = 1 THEN 'refers to a changed file' ELSE 'depends on a changed file' END AS reason
    FROM best WHERE hop > 0 AND {IS_TEST}""")
def affected(spark, sf_dir):
    """The tests that a change of all files of src/auth reaches in two steps."""
    files, symbols, edges = sparse(spark, sf_dir)
    links = graph.file_edges(edges, symbols).select(F.col("src").alias("file"), F.col("dst").alias("target_file"))
    found = graph.affected_tests(edges, symbols, files.where("file like 'src/auth/%'"), links)
    return found.select("test_file", "hop", "reason")


@query(f"""WITH {WITH}, {LINKS}, t AS (SELECT file FROM files WHERE file LIKE 'lib/queue/%'), one AS (SELECT src AS file, 1 AS o FROM links WHERE dst IN (SELECT file FROM t)
        UNION SELECT dst, 2 FROM links WHERE src IN (SELECT file FROM t)), f AS (SELECT file, min(o) AS o FROM one WHERE file NOT IN (SELECT file FROM t) GROUP BY 1)
    SELECT file, 1 AS hop, CASE o WHEN 1 THEN 'high' ELSE 'medium' END AS confidence FROM f""")
def impact_files(spark, sf_dir):
    files, symbols, edges = sparse(spark, sf_dir)
    return graph.impact_files(edges, symbols, files.where("file like 'lib/queue/%'"))


@query(f"""WITH {WITH}, u AS (SELECT DISTINCT dst AS id, src FROM edges WHERE dst IN (SELECT id FROM symbols WHERE file LIKE 'lib/queue/%') AND src IN (SELECT id FROM symbols WHERE NOT file LIKE 'lib/queue/%')),
    p AS (SELECT id, src FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src) <= 10) SELECT id, string_agg(src, ',' ORDER BY src) AS callers FROM p GROUP BY 1""")
def type_impact(spark, sf_dir):
    files, symbols, edges = relations(spark, sf_dir)
    found = graph.type_impact(edges, symbols, files.where("file like 'lib/queue/%'"))
    return found.select("id", F.concat_ws(",", F.transform("callers", lambda x: x.cast("string"))).alias("callers"))


@query(f"""WITH {WITH}, {LINKS}, callers AS (SELECT a.id AS call_id, a.file, a.line, b.name, CASE WHEN a.id % 2 = 0 THEN 'member' ELSE 'direct' END AS call_kind
        FROM symbols a JOIN symbols b ON b.id = (a.id * 7 + 3) % (SELECT count(*) FROM part)),
    c AS (SELECT id AS target, name, kind, file AS tf, line AS tl, visibility = 'exported' AS ex FROM symbols WHERE kind IN ('function', 'method')),
    k AS (SELECT name, count(*) AS n, count(*) FILTER (ex) AS ne FROM c GROUP BY 1),
    m AS (SELECT call_id, target, tf, tl, ex, line, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.src = callers.file AND l.dst = tf) THEN 1
        WHEN callers.file = tf AND (call_kind = 'direct' OR kind = 'method') THEN 2 WHEN call_kind = 'direct' AND n = 1 THEN 3 WHEN call_kind = 'direct' AND ex AND ne = 1 THEN 4 END AS tier FROM callers JOIN c USING (name) JOIN k USING (name))
    SELECT call_id, target, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY tier, abs(line - tl), NOT ex, tf, tl, target) = 1""")
def call_targets(spark, sf_dir):
    """Every symbol calls the name of another one."""
    _, symbols, edges = sparse(spark, sf_dir)
    n = symbols.count()
    other = symbols.select(F.col("id").alias("to"), F.col("name").alias("called"))
    calls = symbols.withColumn("to", (F.col("id") * 7 + 3) % n).join(other, "to").select(
        F.col("id").alias("call_id"), "file", "line", F.col("called").alias("name"), F.when(F.col("id") % 2 == 0, "member").otherwise("direct").alias("call_kind"))
    links = graph.file_edges(edges, symbols).select(F.col("src").alias("file"), F.col("dst").alias("target_file"))
    return joins.resolve_calls(calls, symbols, links)


@query(f"""WITH {WITH}, fs AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS k FROM files),
    placed AS (SELECT event_id AS issue_id, file, (event_id * 13 % 550)::INT AS pos FROM events JOIN fs ON k = event_id % (SELECT count(*) FROM files)),
    c AS (SELECT issue_id, name, (line = pos) AS is_exact, row_number() OVER (PARTITION BY issue_id ORDER BY line <> pos, line, id) AS r FROM placed JOIN symbols USING (file) WHERE pos BETWEEN line AND line + 50)
    SELECT issue_id, name AS symbol, CASE WHEN is_exact THEN 'exact' ELSE 'line' END AS confidence FROM c WHERE r = 1""")
def diagnostic_symbols(spark, sf_dir):
    """Events as issues on lines of the project's files."""
    from pyspark.sql import Window as W

    files, symbols, edges = relations(spark, sf_dir)
    numbered = files.select("file", (F.row_number().over(W.orderBy("file")) - 1).alias("k"))  # some hundred files
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("event_id") % files.count())
    issues = events.join(numbered, "k").select(F.col("event_id").alias("issue_id"), "file", (F.col("event_id") * 13 % 550).cast("int").alias("line"))
    found = joins.diagnostic_symbols(issues, symbols.withColumn("end_line", F.col("line")), edges)
    return found.select("issue_id", "symbol", "confidence")
