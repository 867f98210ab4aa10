"""Bindings of the operators to the test tables: one query and its oracle SQL each.

The tables stand in for code: an order is a commit, a part a file or symbol, a brand or
nation a module, trade between nations the call graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, joins, metrics, risk, search
from loomgraph.plans.catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- history -------------------------------------------------------------------------


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))


CO_CHANGE = """
    c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS f FROM lineitem),
    pairs AS (SELECT x.f AS a, y.f AS b, count(*) AS n FROM c x JOIN c y ON x.o = y.o AND x.f < y.f GROUP BY 1, 2)"""


@query(f"WITH {CO_CHANGE} SELECT a, b, n FROM pairs")
def co_change(spark, sf_dir):
    return metrics.co_change(commits(spark, sf_dir))


@query(f"""WITH {CO_CHANGE}, sides AS (SELECT a AS file, b AS neighbor, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)
    SELECT file, neighbor, n, row_number() OVER (PARTITION BY file ORDER BY n DESC, neighbor) AS place
    FROM sides QUALIFY place <= 5""")
def co_change_neighbors(spark, sf_dir):
    return metrics.co_change_neighbors(metrics.co_change(commits(spark, sf_dir)), 5)


@query("""SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1""")
def file_authors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"))


@query("""SELECT DISTINCT l_partkey AS file FROM lineitem
    WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY""")
def hot_files(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    last = lines.agg((F.max("l_shipdate") - F.expr("INTERVAL 30 DAY")).alias("since"))  # one row
    return lines.join(F.broadcast(last), F.col("l_shipdate") >= F.col("since")).select(F.col("l_partkey").alias("file")).distinct()


# ---- graphs --------------------------------------------------------------------------

TRADE = """
    trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations, customers' to suppliers', by number of line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    found = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey")
    return found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def strong_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's two strongest directions of trade."""
    return metrics.top_per_group(trade(spark, sf_dir), ["src"], [F.desc("weight"), F.col("dst")], 2)


STRONG = TRADE + """,
    strong AS (SELECT src, dst, w FROM trade QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 2)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))


@query(f"""WITH RECURSIVE {TRADE},
    share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM trade),
    ranks(i, id, r) AS (
        SELECT 0, n_nationkey, 1.0::DOUBLE / count(*) OVER () FROM nation
        UNION ALL
        SELECT i, id, raw / sum(raw) OVER () FROM (
            SELECT r.i + 1 AS i, n.n_nationkey AS id,
                   0.15::DOUBLE / (SELECT count(*) FROM nation) + 0.85::DOUBLE * sum(CASE WHEN s.dst = n.n_nationkey THEN r.r * s.p ELSE 0 END) AS raw
            FROM ranks r LEFT JOIN share s ON s.src = r.id CROSS JOIN nation n WHERE r.i < 20
            GROUP BY r.i, n.n_nationkey))
    SELECT id, round(r, 6) AS rank FROM ranks WHERE i = 20""")
def pagerank(spark, sf_dir):
    ranks = graph.pagerank(nations(spark, sf_dir), trade(spark, sf_dir), iterations=20, tolerance=None)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query(None)
def pagerank_partsupp(spark, sf_dir):
    """PageRank of parts and suppliers that are sold together, ten rounds; their keys are numbers
    below 2^62, parts become even ids and suppliers odd ones."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.lit(1.0).alias("weight"))
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    vertices = edges.select(F.col("src").alias("id")).distinct()
    name = F.concat(F.when(F.col("id").bitwiseAND(1) == 0, "p").otherwise("s"), F.shiftright("id", 1).cast("string"))
    return graph.pagerank(vertices, edges, iterations=10).select(name.alias("id"), F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {STRONG}, walk(id, hop) AS (
        SELECT 0, 0 UNION SELECT s.dst, hop + 1 FROM walk JOIN strong s ON s.src = id WHERE hop < 3)
    SELECT id, min(hop) AS hop FROM walk GROUP BY 1""")
def bfs_hops(spark, sf_dir):
    return graph.reach(strong_trade(spark, sf_dir), nations(spark, sf_dir).where("id = 0"), 3)


@query(f"""WITH RECURSIVE {STRONG}, walk(id, hop, path) AS (
        SELECT 0, 0, [0] UNION ALL SELECT s.dst, hop + 1, list_append(path, s.dst) FROM walk JOIN strong s ON s.src = id WHERE hop < 4)
    SELECT id, min(hop) AS hop, array_to_string(min_by(path, [[hop], path]), '>') AS path FROM walk GROUP BY 1""")
def shortest_path(spark, sf_dir):
    found = graph.shortest_paths(strong_trade(spark, sf_dir), nations(spark, sf_dir).where("id = 0"), 4)
    return found.select("id", "hop", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {STRONG}, walk(id, hop) AS (
        SELECT n_nationkey, 0 FROM nation WHERE n_nationkey IN (3, 7)
        UNION SELECT s.src, hop + 1 FROM walk JOIN strong s ON s.dst = id WHERE hop < 2)
    SELECT id, min(hop) AS hop FROM walk GROUP BY 1 HAVING min(hop) > 0 ORDER BY hop, id LIMIT 10""")
def cascade(spark, sf_dir):
    """The first ten callers, by hop and id, of two changed nations."""
    found = graph.reach(strong_trade(spark, sf_dir), nations(spark, sf_dir).where("id in (3, 7)"), 2, reverse=True)
    return found.where("hop > 0").orderBy("hop", "id").limit(10)


@query(f"""WITH {STRONG},
    one AS (SELECT id, min(o) AS o FROM (SELECT src AS id, 1 AS o FROM strong WHERE dst = 5 UNION ALL SELECT dst, 2 FROM strong WHERE src = 5)
            WHERE id <> 5 GROUP BY 1),
    twoway AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
    two AS (SELECT DISTINCT dst AS id FROM twoway WHERE src IN (SELECT id FROM one) AND dst <> 5 AND dst NOT IN (SELECT id FROM one))
    SELECT id, 1 AS hop, CASE o WHEN 1 THEN 'high' ELSE 'medium' END AS confidence FROM one UNION ALL SELECT id, 2, 'low' FROM two""")
def impact_radius(spark, sf_dir):
    return graph.impact(strong_trade(spark, sf_dir), nations(spark, sf_dir).where("id = 5"), 2)


@query(f"""WITH {TRADE}
    SELECT src AS file, count(*) AS reached, 'imports' AS reason FROM trade
    WHERE dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
      AND src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1""")
def affected_tests(spark, sf_dir):
    """Nations of one region (the tests) that lead straight into another (the change)."""
    nation = table(spark, sf_dir, "nation")
    changed = nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("dst"))
    tests = nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("src"))
    found = trade(spark, sf_dir).join(changed, "dst", "left_semi").join(tests, "src", "left_semi")
    return found.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("reached")).withColumn("reason", F.lit("imports"))


@query(f"""WITH RECURSIVE {TRADE},
    twoway AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade) GROUP BY 1, 2),
    labels(i, id, label) AS (
        SELECT 0, n_nationkey, n_regionkey FROM nation
        UNION ALL
        SELECT i + 1, dst, label FROM (
            SELECT l.i, b.dst, l.label, sum(b.w) AS w FROM labels l JOIN twoway b ON b.src = l.id WHERE l.i < 5 GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY i, dst ORDER BY w DESC, label) = 1)
    SELECT id, label FROM labels WHERE i = 5""")
def label_prop(spark, sf_dir):
    vertices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    return graph.label_propagation(vertices, trade(spark, sf_dir), 5)


@query("""SELECT n_regionkey AS label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, n_regionkey) - 1 AS cluster FROM nation GROUP BY 1""")
def cluster_summary(spark, sf_dir):
    return graph.cluster_summary(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("label")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to parts whose kind is the order's priority."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    orders = table(spark, sf_dir, "orders")
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_custkey") - 1).alias("src"), F.col("o_orderpriority").alias("kind"))
    return lines.join(orders, "l_orderkey").select("src", "dst", "kind")


@query("""WITH e AS (SELECT -o_custkey - 1 AS src, l_partkey AS dst, o_orderpriority AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ends AS (SELECT dst AS id, kind, 1 AS i FROM e UNION ALL SELECT src, kind, 0 FROM e)
    SELECT id, count(*) FILTER (i = 1 AND kind = '1-URGENT') AS in_urgent, count(*) FILTER (i = 0 AND kind = '1-URGENT') AS out_urgent,
           count(*) FILTER (i = 1 AND kind = '5-LOW') AS in_low, count(*) FILTER (i = 0 AND kind = '5-LOW') AS out_low FROM ends GROUP BY 1""")
def degree_by_kind(spark, sf_dir):
    found = graph.degrees(sales(spark, sf_dir), ["1-URGENT", "5-LOW"])
    return found.toDF("id", "in_urgent", "out_urgent", "in_low", "out_low")


@query("""SELECT DISTINCT -o_custkey - 1 AS src, l_partkey AS dst, o_orderpriority AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def distinct_edges(spark, sf_dir):
    return graph.distinct_edges(sales(spark, sf_dir))


@query("""SELECT DISTINCT -o_custkey - 1 AS src, l_partkey AS dst, o_orderpriority AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def consistency(spark, sf_dir):
    """Edges to parts that a smaller catalogue lacks."""
    parts = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return graph.broken_edges(graph.distinct_edges(sales(spark, sf_dir)), parts).select("src", "dst", "kind")


@query(f"""WITH {TRADE} SELECT dst AS file, sum(w)::BIGINT AS severity FROM trade GROUP BY 1""")
def severity_index(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("call").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("src"))
    buyers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("file"))
    sellers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    return metrics.severity_index(lines.join(orders, "l_orderkey"), buyers.unionByName(sellers))


# ---- files and symbols ---------------------------------------------------------------

KINDS = "CASE WHEN p_size % 3 = 0 THEN 'exported' WHEN p_size % 3 = 1 THEN 'public' ELSE 'private' END"
FILES = f"""
    s AS (SELECT p_partkey AS id, p_brand AS file, p_size::DOUBLE AS score, {KINDS} AS vis,
                 CASE WHEN p_size > 40 THEN 0.85 ELSE 1.0 END::DOUBLE AS weight, p_retailprice / 1000 AS rank FROM part),
    e AS (SELECT DISTINCT l_suppkey % (SELECT count(*) FROM part) AS src, l_partkey AS dst FROM lineitem),
    j AS (SELECT a.file AS fa, b.file AS fb FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst),
    f AS (SELECT file, count(*) AS symbol_count, sum(weight) AS semantic_count, sum(rank * weight) AS semantic_rank,
                 sum(CASE WHEN vis = 'exported' THEN weight ELSE 0 END) AS exported, sum(CASE WHEN vis = 'public' THEN weight ELSE 0 END) AS public
          FROM s GROUP BY 1),
    b AS (SELECT file, sum(score) AS implementation FROM (SELECT file, score FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, id) <= 5) GROUP BY 1),
    c AS (SELECT fa AS file, count(*) AS call_edges, count(*) FILTER (fa <> fb) AS cross_calls FROM j GROUP BY 1),
    n AS (SELECT file, count(*) AS neighbors FROM (SELECT fa AS file, fb AS o FROM j WHERE fa <> fb UNION SELECT fb, fa FROM j WHERE fa <> fb) GROUP BY 1),
    files AS (SELECT f.*, implementation, coalesce(call_edges, 0) AS call_edges, coalesce(cross_calls, 0) AS cross_calls, coalesce(neighbors, 0) AS neighbors,
        implementation + 0.8 * exported + 0.25 * public + 0.6 * semantic_count + 0.45 * coalesce(neighbors, 0) + 0.25 * coalesce(cross_calls, 0) + 0.05 * coalesce(call_edges, 0) AS score
        FROM f JOIN b USING (file) LEFT JOIN c USING (file) LEFT JOIN n USING (file))"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").cast("double").alias("score"),
        F.when(size == 0, "exported").when(size == 1, "public").otherwise("private").alias("visibility"),
        F.when(F.col("p_size") > 40, 0.85).otherwise(1.0).alias("weight"), (F.col("p_retailprice") / 1000).alias("rank"),
    )


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols(spark, sf_dir)
    n = table(spark, sf_dir, "part").count()
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % n).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return metrics.file_analysis(found, edges.withColumn("kind", F.lit("call")))


@query(f"""WITH {FILES} SELECT file, symbol_count, round(semantic_count, 4) AS semantic_count, round(semantic_rank, 4) AS semantic_rank,
    round(exported, 4) AS exported, round(implementation, 4) AS implementation, call_edges, cross_calls, neighbors, round(score, 4) AS score FROM files""")
def file_analysis(spark, sf_dir):
    found = analysed(spark, sf_dir)
    rounded = [F.round(c, 4).alias(c) for c in ("semantic_count", "semantic_rank", "exported", "implementation", "score")]
    return found.select("file", "symbol_count", *rounded, "call_edges", "cross_calls", "neighbors")


@query(f"""WITH {FILES} SELECT left(file, 7) AS module, count(*) AS files, sum(symbol_count)::BIGINT AS symbols, round(sum(score), 4) AS score,
    min_by(file, (-round(score, 6), file)) AS representative FROM files GROUP BY 1""")
def module_summary(spark, sf_dir):
    files = analysed(spark, sf_dir).withColumn("module", F.substring("file", 1, 7)).withColumn("score", F.round("score", 6))
    return metrics.module_summary(files).withColumn("score", F.round("score", 4))


@query(f"""WITH {FILES} SELECT file, round(score, 4) AS score, CASE WHEN semantic_count >= 12 THEN 'high' WHEN semantic_count >= 4 THEN 'medium' ELSE 'low' END AS risk
    FROM files ORDER BY round(semantic_count, 6) DESC, round(files.score, 6) DESC, file LIMIT 10""")
def hotspots(spark, sf_dir):
    found = analysed(spark, sf_dir).withColumn("risk", T.level(F.col("semantic_count"), 12, 4))
    top = found.orderBy(F.desc(F.round("semantic_count", 6)), F.desc(F.round("score", 6)), "file").limit(10)
    return top.select("file", F.round("score", 4).alias("score"), "risk")


@query("""SELECT p_brand AS file, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part QUALIFY place <= 3""")
def top_k_per_file(spark, sf_dir):
    return metrics.top_per_group(symbols(spark, sf_dir), ["file"], [F.desc("score"), F.col("id")], 3).select("file", "id", "place")


@query(f"""WITH {FILES}, o AS (SELECT file, CASE WHEN file LIKE '%1' THEN 0 ELSE 1 END AS stage, score FROM files)
    SELECT file, row_number() OVER (ORDER BY stage, round(score, 6) DESC, file) AS place FROM o QUALIFY place <= 12""")
def reading_order(spark, sf_dir):
    """Entry points first, then files by score; twelve in all."""
    found = analysed(spark, sf_dir).withColumn("stage", F.when(F.col("file").endswith("1"), 0).otherwise(1))
    top = found.orderBy("stage", F.desc(F.round("score", 6)), "file").limit(12)
    order = W.orderBy("stage", F.desc(F.round("score", 6)), "file")
    return top.select("file", F.row_number().over(order).cast("long").alias("place"))


ORPHAN_KINDS = ["function", "class", "impl", "interface", "variable", "element"]


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment || '/' || c_custkey || CASE c_custkey % 11 WHEN 0 THEN '.json' WHEN 1 THEN '.test.py' ELSE '.py' END AS file,
        ['function', 'class', 'impl', 'interface', 'variable', 'element'][c_nationkey % 6 + 1] AS kind,
        CASE WHEN c_acctbal < 0 THEN 'private' WHEN c_acctbal > 9000 THEN 'exported' ELSE 'public' END AS visibility FROM customer),
    s AS (SELECT id, greatest(0, least(100, CASE kind WHEN 'function' THEN 60 WHEN 'class' THEN 40 WHEN 'impl' THEN 15 WHEN 'interface' THEN 35 ELSE 30 END
        - CASE WHEN contains(lower(file), 'test') THEN 20 ELSE 0 END - CASE WHEN ends_with(file, '.json') THEN 50 ELSE 0 END
        + CASE WHEN visibility = 'private' THEN 10 ELSE 0 END + CASE WHEN kind IN ('class', 'impl') THEN 25 ELSE 0 END)) AS score, kind, file, visibility FROM c)
    SELECT id, score FROM s WHERE kind <> 'element' AND visibility <> 'exported' AND NOT ends_with(file, '.json') AND score >= 40
        AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def orphans(spark, sf_dir):
    """Customers without pending orders as symbols of all kinds."""
    number = F.col("c_custkey")
    ending = F.when(number % 11 == 0, ".json").when(number % 11 == 1, ".test.py").otherwise(".py")
    customers = table(spark, sf_dir, "customer").select(
        number.alias("id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("/"), number.cast("string"), ending).alias("file"),
        F.get(F.array(*[F.lit(k) for k in ORPHAN_KINDS]), F.col("c_nationkey") % 6).alias("kind"),
        F.when(F.col("c_acctbal") < 0, "private").when(F.col("c_acctbal") > 9000, "exported").otherwise("public").alias("visibility"),
    )
    edges = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    edges = edges.select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 1).alias("dst"), F.lit("call").alias("kind"))
    return metrics.orphans(customers, edges, least=40)


@query("""SELECT l_partkey AS id, count(*) AS calls, count(*) * 5.0::DOUBLE AS risk FROM lineitem WHERE l_partkey NOT IN (
        SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    GROUP BY 1 HAVING count(*) >= 2""")
def untested(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    orders = orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    tested = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi").select(F.col("l_partkey").alias("id"))
    calls = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("calls"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("weight"))
    return metrics.untested(parts, calls, tested)


@query("""WITH old AS (SELECT p_partkey::VARCHAR AS id, p_brand AS file, p_name AS name, p_type AS kind, p_size AS sig FROM part WHERE p_partkey % 10 <> 3),
    new AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id, p_brand AS file, p_name AS name, p_type AS kind,
                   CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS sig FROM part WHERE p_partkey % 10 <> 4),
    gone AS (SELECT *, row_number() OVER (PARTITION BY file, name, kind ORDER BY id) AS n FROM old WHERE id NOT IN (SELECT id FROM new)),
    come AS (SELECT *, row_number() OVER (PARTITION BY file, name, kind ORDER BY id) AS n FROM new WHERE id NOT IN (SELECT id FROM old))
    SELECT o.id, n.id AS new_id, 'modified' AS change FROM old o JOIN new n ON o.id = n.id WHERE o.sig <> n.sig
    UNION ALL
    SELECT g.id, c.id, CASE WHEN c.id IS NULL THEN 'removed' WHEN g.id IS NULL THEN 'added' ELSE 'modified' END
    FROM gone g FULL JOIN come c ON g.file = c.file AND g.name = c.name AND g.kind = c.kind AND g.n = c.n""")
def snapshot_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    shape = [F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")]
    old = part.where(key % 10 != 3).select(key.cast("string").alias("id"), *shape, F.col("p_size").alias("sig"))
    moved = F.when(key % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string"))
    sig = F.when(key % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    new = part.where(key % 10 != 4).select(moved.alias("id"), *shape, sig.alias("sig"))
    return metrics.snapshot_diff(old, new, ["sig"])


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 AND p_brand LIKE '%1' THEN 'HIGH' WHEN p_size % 2 = 1 AND coalesce(n, 0) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def breaking_risk(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("callers"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 1).alias("signature_changed"), F.col("p_brand").endswith("1").alias("exported")
    )
    return metrics.breaking_risk(part.join(calls, "id", "left").na.fill(0, ["callers"])).select("id", "risk")


# ---- search --------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
QUERY_TERMS = ["the", "tion", "einen", "erthe"]
LISTED_TERMS = ", ".join(f"'{t}'" for t in QUERY_TERMS)


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM c GROUP BY 1""")
def doc_tokens_df(spark, sf_dir):
    return search.document_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH d AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), m AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT id, len(t) AS len, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) WHERE term IN ({LISTED_TERMS}) GROUP BY 1, 2, 3),
    df AS (SELECT term, ln(any_value(m.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, m GROUP BY 1),
    i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * coalesce((SELECT avg(idf) FROM df WHERE idf >= 0), 0) ELSE idf END AS idf FROM df)
    SELECT id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m.mean))), 4) AS score FROM tf JOIN i USING (term), m
    GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")
def bm25(spark, sf_dir):
    found = search.bm25(table(spark, sf_dir, "documents"), QUERY_TERMS, "doc_id")
    return found.select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"""WITH a AS (SELECT item_id AS a, unnest(list_distinct({TOKENS})) AS term FROM benchmark), n AS (SELECT a, count(*) AS n FROM a GROUP BY 1),
    b AS (SELECT doc_id AS b, unnest(list_distinct({TOKENS})) AS term FROM documents)
    SELECT a, b, any_value(n) AS n, count(*) AS shared, round(count(*) / any_value(n), 6) AS share FROM a JOIN b USING (term) JOIN n USING (a)
    GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.5""")
def token_overlap(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    found = search.overlap(left, right, 0.5)
    return found.select("a", "b", F.col("n").cast("long").alias("n"), "shared", F.round("share", 6).alias("share"))


#: Words of a topic and their synonyms.
TOPIC = [("casino", "orig"), ("bets", "synonym"), ("pills", "orig"), ("cheap", "synonym"), ("en", "orig")]
TOPIC_SQL = ", ".join(f"('{w}', '{s}')" for w, s in TOPIC)


@query(f"""WITH k(word, src) AS (VALUES {TOPIC_SQL}), hit AS (SELECT word, src, page_id FROM pages, k WHERE contains(lower(url), word)),
    w AS (SELECT word, CASE WHEN count(*) / (SELECT count(*) FROM pages) > 0.8 THEN 0.2 WHEN count(*) / (SELECT count(*) FROM pages) > 0.5 THEN 0.5 ELSE 1.0 END AS weight FROM hit GROUP BY 1)
    SELECT page_id, round(sum(CASE src WHEN 'orig' THEN 30 ELSE 15 END * weight), 4) AS score FROM hit JOIN w USING (word) GROUP BY 1""")
def topic_score(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("path"))
    words = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(30 if s == "orig" else 15).alias("points")) for w, s in TOPIC])
    hits = pages.select("page_id", "path", F.inline(words)).where(F.contains("path", F.col("keyword")))
    weights = search.keyword_weights(hits.select("keyword", F.col("page_id").alias("id")), pages.count())
    scored = hits.join(weights, "keyword").groupBy("page_id").agg(F.sum(F.col("points") * F.col("weight")).alias("score"))
    return scored.withColumn("score", F.round("score", 4))


@query(f"""WITH {STRONG}, s AS (SELECT src AS id, sum(w)::DOUBLE AS score FROM strong GROUP BY 1),
    twoway AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
    g AS (SELECT dst AS id, sum(0.25 * score) AS extra FROM twoway JOIN s ON s.id = src WHERE score >= 20 GROUP BY 1)
    SELECT id, round(coalesce(score, 0) + coalesce(extra, 0), 4) AS score FROM s FULL JOIN g USING (id)""")
def spread_scores(spark, sf_dir):
    edges = strong_trade(spark, sf_dir)
    scores = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("score"))
    return search.spread_scores(scores, edges).withColumn("score", F.round("score", 4))


# ---- extraction ----------------------------------------------------------------------


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages),
    n AS (SELECT page_id, lower(tag) AS tag FROM t) SELECT page_id, tag, count(*) AS n FROM n GROUP BY 1, 2""")
def html_symbols(spark, sf_dir):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    found = table(spark, sf_dir, "pages").select("page_id", tags.alias("tag"))
    return found.select("page_id", F.lower("tag").alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
        generate_subscripts(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), 1) AS i FROM pages)
    SELECT page_id, i - 1 AS pos, tag || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS id
    FROM t WINDOW w AS (PARTITION BY page_id, tag ORDER BY i)""")
def html_symbol_ids(spark, sf_dir):
    tags = F.posexplode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    found = table(spark, sf_dir, "pages").select("page_id", tags.alias("pos", "tag"))
    again = F.row_number().over(W.partitionBy("page_id", "tag").orderBy("pos"))
    mark = F.when(again > 1, F.concat(F.lit("#"), again)).otherwise("")
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), F.concat("tag", mark).alias("id"))


@query("""SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.explode(F.from_json("props", "map<string,string>"))).select("event_id", "key", "value")


@query(r"""SELECT DISTINCT page_id AS src, href AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def link_graph(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), links.alias("dst")).distinct()


@query(r"""WITH u AS (SELECT page_id AS use_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages),
    r(template, pattern) AS (VALUES ('/en/:id', '^/en/[^/]+$'), ('/:lang/:id', '^/[^/]+/[^/]+$'), ('/fr/:id', '^/fr/[^/]+$')),
    m AS (SELECT use_id, min(template) AS template, 'medium' AS confidence FROM u JOIN r ON regexp_matches(path, pattern) GROUP BY 1),
    h(template, head) AS (VALUES ('/en/:id', '/en'), ('/:lang/:id', '/{lang}'), ('/fr/:id', '/fr'))
    SELECT * FROM m UNION ALL SELECT use_id, min(template), 'low' FROM u JOIN h ON starts_with(path, head) AND length(path) > length(head) + 1
    WHERE use_id NOT IN (SELECT use_id FROM m) GROUP BY 1""")
def route_match(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    uses = table(spark, sf_dir, "pages").select(F.col("page_id").alias("use_id"), path.alias("path"))
    routes = spark.createDataFrame([("/en/:id",), ("/:lang/:id",), ("/fr/:id",)], "template string")
    return joins.match_routes(routes, uses)


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events),
    s AS (SELECT event_id AS span, user_id, t AS a, t + 60 * (3600 % (event_id % 97 + 30)) + 3600 AS b FROM e)
    SELECT e.event_id, s.span FROM e JOIN s ON e.user_id = s.user_id AND t BETWEEN a AND b
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY b - a, a DESC, span) = 1""")
def enclosing_interval(spark, sf_dir):
    """For each event the shortest session of its user that holds it; every event begins one."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", seconds.alias("t"))
    length = 60 * (3600 % (F.col("event_id") % 97 + 30)) + 3600
    spans = events.select(F.col("event_id").alias("span"), "user_id", F.col("t").alias("a"), (F.col("t") + length).alias("b"))
    found = joins.enclosing(events, spans, "user_id", "t", "a", "b", 86400, ["event_id"], [F.col("span")])
    return found.select("event_id", "span")


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT s_nationkey AS n, n_regionkey AS r, min_by(s_suppkey, (-s_acctbal, s_suppkey)) AS k, max(s_acctbal) AS bal
          FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT c_custkey AS id, k AS target, CASE WHEN c.n = s.n THEN 0 ELSE 1 END AS stage FROM c JOIN s ON c.r = s.r
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY stage, bal DESC, k) = 1""")
def ranked_match(spark, sf_dir):
    """For each customer the best supplier of its nation, else of its region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    best = graph.smallest(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")])
    best = best.select(F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    near = customers.join(best.drop("n_regionkey"), "n_nationkey").select("id", "target", "bal")
    rest = customers.join(near.select("id"), "id", "left_anti")
    far = rest.join(best.drop("n_nationkey"), "n_regionkey").select("id", "target", "bal")
    return joins.best_tier([near, far], ["id"], [F.desc("bal"), F.col("target")]).select("id", "target", "stage")


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), b AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
    x AS (SELECT DISTINCT item_id, list_slice(t, i, i + least(len(t), 5) - 1) AS h FROM b, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS r(i) WHERE len(t) > 0),
    n AS (SELECT item_id, count(*) AS total, min(len(h)) AS size FROM x GROUP BY 1),
    sizes AS (SELECT DISTINCT size FROM n),
    g AS (SELECT DISTINCT doc_id, list_slice(t, i, i + size - 1) AS h FROM d, sizes, unnest(range(1, len(t) - size + 2)) AS r(i)),
    c AS (SELECT item_id, doc_id, count(*) AS k FROM x JOIN g USING (h) GROUP BY 1, 2)
    SELECT item_id, doc_id, CASE WHEN size < 5 THEN 2 WHEN k = total THEN 0 ELSE 1 END AS stage, k AS n_shared FROM c JOIN n USING (item_id)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY stage, n_shared DESC, doc_id) = 1""")
def test_match(spark, sf_dir):
    """For each benchmark item the best document: one that holds all its distinct runs of
    five tokens, else the one that holds most of them; an item of fewer tokens is matched
    whole. Runs are compared as 64-bit hashes."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))

    def runs(df, id_, n):
        found = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.xxhash64(F.slice("t", i, n)))
        return df.where(F.size("t") >= n).select(id_, F.explode(F.array_distinct(found)).alias("h"))

    wanted = runs(items, "item_id", 5).distinct()
    shared = runs(docs, "doc_id", 5).join(wanted, "h").groupBy("item_id", "doc_id").agg(F.countDistinct("h").alias("n"))
    shared = shared.join(wanted.groupBy("item_id").agg(F.count("*").alias("of")), "item_id")
    short = items.where(F.size("t") < 5).select("item_id", F.size("t").alias("size"), "t")
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # at most four
    stages = [shared.where("n = of"), shared.where("n < of")]
    for n in sorted(sizes, reverse=True):
        found = runs(docs, "doc_id", n).join(runs(short.where(F.col("size") == n), "item_id", n), "h")
        stages.append(found.select("item_id", "doc_id", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("of")).distinct())
    order = [F.desc("n"), F.col("doc_id")]
    best = joins.best_tier([s.select("item_id", "doc_id", "n") for s in stages], ["item_id"], order)
    return best.select("item_id", "doc_id", F.least("stage", F.lit(2)).alias("stage"), F.col("n").alias("n_shared"))


#: Lines as four diagnostic tools print them.
DIAGNOSTICS = [
    "src/a.ts(12,5): error TS2304: Cannot find name 'x'.",
    "src/b.ts(3,1): warning TS6133: 'y' is declared but never used.",
    "app/m.py:7:10: F401 'os' imported but unused",
    "pkg/z.go:44:2: undefined: foo",
    "note: nothing to see here",
]
DIAGNOSTIC_SQL = ", ".join("('" + line.replace("'", "''") + "')" for line in DIAGNOSTICS)


@query(rf"""WITH l(line) AS (VALUES {DIAGNOSTIC_SQL}),
    p AS (SELECT line, regexp_extract(line, '^([^(:]+)[(:](\d+)[,:](\d+)\)?: ', 1) AS file, regexp_extract(line, '^([^(:]+)[(:](\d+)[,:](\d+)\)?: ', 2) AS row,
          regexp_extract(line, '^([^(:]+)[(:](\d+)[,:](\d+)\)?: ', 3) AS col FROM l)
    SELECT file, row::BIGINT AS line, col::BIGINT AS col, CASE WHEN line LIKE '%warning%' THEN 'warning' ELSE 'error' END AS severity FROM p WHERE file <> ''""")
def diag_parse(spark, sf_dir):
    from loomgraph.sources.diagnostics import parse

    lines = spark.createDataFrame([(line,) for line in DIAGNOSTICS], "line string")
    return parse(lines).select("file", "line", "col", "severity")


HIGH_SQL = " + ".join(f"3 * regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)')::INT" for w in risk.HIGH_WORDS)
MEDIUM_SQL = " + ".join(f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)')::INT" for w in risk.MEDIUM_WORDS)


@query(f"""WITH s AS (SELECT conv_id, turn, {HIGH_SQL} + {MEDIUM_SQL} + CASE WHEN length(text) > 200 THEN 3 ELSE 0 END AS score FROM conversations)
    SELECT conv_id, turn, score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def risk_score(spark, sf_dir):
    """The risk of each turn by all words of the rules; a long turn stands for five neighbours."""
    score = risk.domain_points(F.col("text")) + risk.file_points(F.lit("x"), F.when(F.length("text") > 200, 5).otherwise(0), F.lit(0.0))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", score.alias("score"))
    return found.withColumn("risk", T.level(F.col("score"), 6, 3))


@query("""SELECT CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'cpp' WHEN 3 THEN 'ruby' END AS language, count(*) AS files
    FROM documents WHERE doc_id % 5 < 4 GROUP BY 1 ORDER BY files DESC, language LIMIT 3""")
def language_histogram(spark, sf_dir):
    """Documents as files of four languages and one that is none."""
    ending = F.get(F.array(*[F.lit(e) for e in (".py", ".tsx", ".hh", ".RB", ".txt")]), (F.col("doc_id") % 5).cast("int"))
    return metrics.language_histogram(table(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), "doc_id", ending).alias("file")))


METHODS = {"click": "get", "view": "POST", "error": "Put", "signup": "DELETE", "purchase": "patch"}
METHOD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v.upper()}'" for k, v in METHODS.items()) + " END"


@query(f"""WITH r AS (SELECT user_id AS file, {METHOD_SQL} AS m FROM events) SELECT file, count(*) FILTER (m = 'GET') AS get, count(*) FILTER (m = 'POST') AS post,
    count(*) FILTER (m = 'PUT') AS put, count(*) FILTER (m = 'DELETE') AS delete, count(*) FILTER (m = 'PATCH') AS patch, count(*) AS total FROM r GROUP BY 1""")
def route_histogram(spark, sf_dir):
    """Events as routes of their user's file, by method."""
    method = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("event_type")]
    return metrics.route_histogram(table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), method.alias("method")))


SEVERITY_SQL = "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END"


def issues(spark, sf_dir):
    """Events as issues of their user's file."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), severity.alias("severity"))


@query(f"""WITH i AS (SELECT user_id AS file, {SEVERITY_SQL} AS s FROM events)
    SELECT count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(DISTINCT file) AS files,
    CASE WHEN count(*) FILTER (s = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (s = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS status FROM i""")
def diagnostics_summary(spark, sf_dir):
    return metrics.diagnostics_summary(issues(spark, sf_dir), spark.createDataFrame([("linter", "ran")], "tool string, state string"))


@query(f"""WITH i AS (SELECT user_id AS file, {SEVERITY_SQL} AS s FROM events)
    SELECT file, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings FROM i GROUP BY 1 ORDER BY errors + warnings DESC, file LIMIT 20""")
def diagnostics_by_file(spark, sf_dir):
    return metrics.diagnostics_by_file(issues(spark, sf_dir))


@query("""SELECT concat_ws('/', source, concat_ws('.', doc_id::VARCHAR, lang)) AS path,
    CASE WHEN doc_id % 2 = 1 OR source IS NULL THEN '(root)' ELSE source END AS module, concat_ws('/', source, concat_ws('.', doc_id::VARCHAR, lang)) AS file FROM documents""")
def module_bucket(spark, sf_dir):
    """The module of every document; one without a language has a path without an ending."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    named = docs.select(path.alias("path"), F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.concat("doc_id", F.lit(".x"))).alias("p"))
    return named.select("path", T.module_bucket(F.col("p")).alias("module"), F.col("path").alias("file"))


@query("""SELECT p_partkey AS id, p_name AS name, 0 AS tier FROM part WHERE contains(lower(p_name), 'blue')""")
def find_symbols(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.find_symbols(found, "blue")


@query(f"""WITH d AS (SELECT doc_id AS id, list_distinct({TOKENS}) AS t FROM documents)
    SELECT id, round(len(list_filter([{LISTED_TERMS}], lambda x: list_contains(t, x))) / 4, 4) AS share FROM d
    WHERE len(list_filter([{LISTED_TERMS}], lambda x: list_contains(t, x))) > 0""")
def token_share(spark, sf_dir):
    found = search.token_share(table(spark, sf_dir, "documents"), QUERY_TERMS, "doc_id")
    return found.select("id", F.round("share", 4).alias("share"))


@query(f"""WITH {STRONG}, o AS (SELECT DISTINCT l_orderkey AS o, s_nationkey AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    along AS (SELECT x.f AS file, y.f AS neighbor FROM o x JOIN o y ON x.o = y.o AND x.f <> y.f GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY x.f ORDER BY count(*) DESC, y.f) <= 3),
    every AS (SELECT src AS file, 'caller' AS reason FROM strong WHERE dst IN (3, 7) UNION SELECT neighbor, 'co-change' FROM along WHERE file IN (3, 7))
    SELECT file, min(reason) AS reason FROM every WHERE file NOT IN (3, 7) GROUP BY 1""")
def missed_files(spark, sf_dir):
    """Nations that trade into two changed ones, or whose suppliers mostly share orders with theirs."""
    edges = strong_trade(spark, sf_dir).withColumn("kind", F.lit("call"))
    home = nations(spark, sf_dir).select("id", F.col("id").alias("file"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("file"))
    together = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").select(F.col("l_orderkey").alias("commit_id"), "file")
    along = metrics.co_change_neighbors(metrics.co_change(together), 5)
    return risk.missed_files(edges, home, home.where("file in (3, 7)").select("file"), along)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'covered' WHEN doc_id % 4 = 0 THEN 'missed' ELSE 'unexpected' END AS outcome FROM documents
    WHERE doc_id % 4 = 0 OR (doc_id % 3 = 0 AND doc_id % 5 <> 0)""")
def session_compare(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    found = risk.compare_sessions(files.where("file % 5 = 0"), files.where("file % 4 = 0"), files.where("file % 3 = 0"))
    return found.withColumnRenamed("file", "id")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from loomgraph.streaming.events import windowed_counts

    found = windowed_counts(table(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
