"""Iterative operators on edge relations ``(src, dst, weight)``.

A loop keeps only reached vertices and joins the frontier with the edges; edges and
frontier are partitioned by join key, and lineage is cut at each round through the shared
checkpoint folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a job go at its end, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    _shared(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame, write) -> str:
    """A fresh folder into which ``write(writer, folder)`` has put the rows."""
    spark = df.sparkSession
    folder, before = f"{_shared(spark)}/{uuid.uuid4().hex}", spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        write(df.write.option("compression", "zstd"), folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return folder


def _deleted(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-6) -> DataFrame:
    """``(id, rank)`` by weighted power iteration; ranks are divided by their sum each round.

    Sources whose total weight is not a positive number send nothing. ``tolerance`` ends
    the loop once no rank moves by more; None runs all iterations. Edges are exchanged once
    and lie in the shared folder in buckets by source, sorted and compressed. A round brings
    each bucket the ranks of its sources, sums by target and writes the vertices alone; the
    vertices of the round before and its shuffle files are deleted.
    """
    spark = vertices.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"loomgraph_edges_{uuid.uuid4().hex}"
    sent = edges.select("src", "dst", "weight").repartition(buckets, "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    there = _written(
        sent.sortWithinPartitions("src", "dst"),
        lambda writer, folder: writer.bucketBy(buckets, "src").sortBy("src", "dst").option("path", folder).saveAsTable(name),
    )
    kept = lambda df: _written(df, lambda writer, folder: writer.parquet(folder))
    try:
        links = spark.table(name)
        out = links.groupBy("src").agg(F.sum("weight").cast("double").alias("total"))
        out = out.where((F.col("total") > 0) & ~F.isnan("total") & (F.col("total") < float("inf")))
        ids = vertices.select("id").distinct()
        ranks = ids.join(out, ids["id"] == out["src"], "left").select("id", "total", F.lit(1.0).alias("old"), F.lit(1.0).alias("raw"))
        shape, folder = ranks.schema, kept(ranks)
        ranks = spark.read.schema(shape).parquet(folder)
        n = total = ranks.count()
        for _ in range(iterations if n else 0):
            rank = F.col("raw") / F.lit(float(total))
            pushed = ranks.where("total is not null").select(F.col("id").alias("src"), (rank / F.col("total")).alias("push"))
            got = links.join(pushed.hint("shuffle_hash"), "src").groupBy("dst").agg(F.sum(F.col("push") * F.col("weight")).alias("got"))
            value = F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))
            last, folder = folder, kept(ranks.join(got, ranks["id"] == got["dst"], "left").select("id", "total", rank.alias("old"), value.alias("raw")))
            _deleted(spark, last)
            ranks = spark.read.schema(shape).parquet(folder)
            total = ranks.agg(F.sum("raw")).first()[0]
            if tolerance is not None and ranks.agg(F.max(F.abs(F.col("raw") / F.lit(total) - F.col("old")))).first()[0] < tolerance:
                break
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _deleted(spark, there)
    return ranks.select("id", (F.col("raw") / F.lit(float(total or 1))).alias("rank"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """``(id, hop)`` of all vertices within ``depth`` steps of the seeds, seeds at hop 0."""
    ends = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).distinct()
    found = _cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    front = found
    for hop in range(1, depth + 1):
        new = steps.join(front, steps["a"] == front["id"]).select(F.col("b").alias("id")).distinct()
        front = _cut(new.join(found, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(id, hop, path)``: of the shortest paths from a seed the least in order of ids."""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    found = _cut(seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.array("id").alias("path")))
    front = found
    for hop in range(1, depth + 1):
        longer = steps.join(front, steps["a"] == front["id"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        best = longer.groupBy("id").agg(F.min("path").alias("path")).join(found, "id", "left_anti")
        front = _cut(best.select("id", F.lit(hop).alias("hop"), "path"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """``(id, hop, confidence)`` of what a change of the seeds may touch.

    One step against the edges is high, one along them medium (high wins), what lies
    deeper in either direction low.
    """
    links = edges.select("src", "dst").distinct()
    into = links.join(seeds, links["dst"] == seeds["id"], "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("order"))
    from_ = links.join(seeds, links["src"] == seeds["id"], "left_semi").select(F.col("dst").alias("id"), F.lit(2).alias("order"))
    first = into.unionByName(from_).groupBy("id").agg(F.min("order").alias("order")).join(seeds, "id", "left_anti")
    names = F.when(F.col("order") == 1, "high").otherwise("medium")
    found = _cut(first.select("id", F.lit(1).alias("hop"), names.alias("confidence")))
    if depth > 1:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        beyond = reach(both, seeds, depth).where("hop > 1").join(found, "id", "left_anti")
        found = found.unionByName(beyond.select("id", "hop", F.lit("low").alias("confidence")))
    return found


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(id, label)``: every vertex takes the label with the most weight around it.

    All vertices move at once, ties go to the smallest label, and a vertex without
    neighbours keeps its own. Edges count in both directions.
    """
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    both = _cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = _cut(vertices.select("id", F.col("label") if "label" in vertices.columns else F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels, both["src"] == labels["id"]).groupBy("dst", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("dst").agg(F.min(F.struct(-F.col("w"), F.col("label"))).alias("b"))
        moved = labels.join(best, labels["id"] == best["dst"], "left")
        labels = _cut(moved.select("id", F.coalesce("b.label", "label").alias("label")))
    return labels


def cluster_summary(labels: DataFrame) -> DataFrame:
    """``(cluster, label, size)``: clusters numbered by falling size, then by label."""
    from pyspark.sql import Window as W

    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    # numbers inside each size, after the clusters of all larger sizes: no window holds all clusters
    larger = sizes.groupBy("size").agg(F.count("*").alias("n"))
    before = larger.select("size", (F.sum("n").over(W.orderBy(F.desc("size"))) - F.col("n")).alias("before"))  # a row per size
    place = F.row_number().over(W.partitionBy("size").orderBy("label")) - 1
    return sizes.join(before, "size").select("label", "size", (F.col("before") + place).cast("long").alias("cluster"))


#: Names that say little about where a call goes.
COMMON_NAMES = ["get", "set", "init", "main", "test", "setup", "teardown", "run", "start", "stop"]


def file_links(files: DataFrame, imports: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` between files: 1 for each resolved import ``(file, target_file)``, half for
    each call ``(file, name)`` and file that defines its name; common names only between linked files."""
    known = files.select("file").distinct()
    by_import = imports.join(known, "file", "left_semi").join(known.withColumnRenamed("file", "target_file"), "target_file", "left_semi")
    by_import = by_import.where("file <> target_file").groupBy(F.col("file").alias("src"), F.col("target_file").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    defined = symbols.select("name", F.col("file").alias("dst")).distinct()
    # calls of a name are counted per file before they meet the files that define it
    called = calls.groupBy(F.col("file").alias("src"), "name").agg(F.count("*").alias("n"))
    by_call = called.join(defined, "name").where("src <> dst")
    common = F.col("name").isin(COMMON_NAMES)
    both = by_import.select("src", "dst").unionByName(by_import.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    by_call = by_call.where(~common).unionByName(by_call.where(common).join(both, ["src", "dst"], "left_semi"))
    by_call = by_call.groupBy("src", "dst").agg((F.sum("n") * 0.5).alias("weight"))
    return by_import.unionByName(by_call).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def file_clusters(files: DataFrame, links: DataFrame, rounds: int = 20) -> DataFrame:
    """``(file, cluster)``: label propagation from the first two parts of paths; clusters are
    numbered by size. Fewer than three files are one cluster."""
    parts = F.split("file", "/")
    start = F.concat_ws("/", F.slice(parts, 1, 2))
    known = files.select("file").distinct()
    if known.limit(3).count() < 3:
        return known.withColumn("cluster", F.lit(0).cast("long"))
    labels = label_propagation(known.select(F.col("file").alias("id"), start.alias("label")), links, rounds)
    numbers = cluster_summary(labels).select("label", "cluster")
    return labels.join(numbers, "label").select(F.col("id").alias("file"), "cluster")


def describe_clusters(clusters: DataFrame, members: int = 5) -> DataFrame:
    """``(cluster, size, top_dir, label, files)``: the commonest folder, its last part, and the
    first files that are no tests, or if there are none the first ones."""
    from loomgraph.functions.text import parent

    plain = ~F.contains(F.lower("file"), F.lit("test"))
    from loomgraph.operators.metrics import top_per_group

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.bool_or(plain).alias("has_plain"))
    folders = clusters.groupBy("cluster", parent(F.col("file")).alias("folder")).agg(F.count("*").alias("n"))
    best = folders.groupBy("cluster").agg(F.min_by("folder", F.struct(-F.col("n"), F.col("folder"))).alias("top_dir"))
    shown = top_per_group(clusters.join(sizes, "cluster").where(plain | ~F.col("has_plain")), ["cluster"], [F.col("file")], members)
    shown = shown.groupBy("cluster").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sizes.join(best, "cluster").join(shown, "cluster").select("cluster", "size", "top_dir", F.substring_index("top_dir", "/", -1).alias("label"), "files")


def top_symbols(symbols: DataFrame, top: int = 3) -> DataFrame:
    """``(file, id)``: the symbols that stand for a file, by visibility and kind, then by line."""
    from loomgraph.functions.text import KIND_RANKS, VISIBILITY_RANKS
    from loomgraph.operators.metrics import top_per_group

    rank = lambda column, table, default: reduce(lambda c, k: c.when(F.col(column) == k, table[k]), list(table)[1:], F.when(F.col(column) == next(iter(table)), next(iter(table.values())))).otherwise(default)
    score = rank("visibility", VISIBILITY_RANKS, 0) + rank("kind", KIND_RANKS, 1)
    return top_per_group(symbols.withColumn("_s", score), ["file"], [F.desc("_s"), F.col("line"), F.col("id")], top).select("file", "id")


def import_edges(symbols: DataFrame, imports: DataFrame, bound: DataFrame | None = None, top: int = 3) -> DataFrame:
    """``(src, dst, weight, kind)`` of resolved imports ``(file, target_file)``: from each symbol that
    stands for the one file to each that stands for the other, and to the symbols that the
    file binds by name, ``bound(file, target_file, target_name)``."""
    from loomgraph.functions.text import EDGE_WEIGHTS

    tops = top_symbols(symbols, top)
    pairs = imports.select("file", "target_file").distinct().where("file <> target_file")
    ends = pairs.join(tops.withColumnRenamed("id", "src"), "file").join(tops.select(F.col("file").alias("target_file"), F.col("id").alias("dst")), "target_file")
    found = ends.select("src", "dst")
    if bound is not None:
        named = bound.join(symbols.select(F.col("file").alias("target_file"), F.col("name").alias("target_name"), F.col("id").alias("dst")), ["target_file", "target_name"])
        found = found.unionByName(named.where("file <> target_file").join(tops.withColumnRenamed("id", "src"), "file").select("src", "dst"))
    return distinct_edges(found.select("src", "dst", F.lit(EDGE_WEIGHTS["import"]).alias("weight"), F.lit("import").alias("kind")))


def file_edges(edges: DataFrame, home: DataFrame) -> DataFrame:
    """``(src, dst)``: files whose symbols are linked, without those inside one file."""
    ends = edges.join(home.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(home.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def impact_files(edges: DataFrame, symbols: DataFrame, targets: DataFrame, depth: int = 1, many: int = 50) -> DataFrame:
    """``(file, hop, confidence)`` of files that a change of ``targets(file)`` may touch: those that
    use them high, those they use medium, deeper ones low. With more than ``many`` symbols
    in one target only the first step is taken."""
    depth = max(1, min(3, depth))
    large = symbols.join(targets, "file", "left_semi").groupBy("file").count().where(F.col("count") > many)
    if depth > 1 and not large.isEmpty():
        depth = 1
    found = impact(file_edges(edges, symbols), targets.select(F.col("file").alias("id")).distinct(), depth)
    return found.withColumnRenamed("id", "file")


def affected_tests(edges: DataFrame, symbols: DataFrame, targets: DataFrame, imports: DataFrame, depth: int = 2, glob: str | None = None) -> DataFrame:
    """``(test_file, hop, reason, via)``: tests that reach changed files against the edges.

    Steps stay within the language of the change. ``via`` is the chain from the changed file,
    the least of the shortest ones; the reason says whether the test imports a changed
    file, ``imports(file, target_file)``, refers to one, or reaches it over others.
    """
    from loomgraph.functions.text import fits_glob, is_test_file, language

    depth = max(1, min(5, depth))
    links = file_edges(edges, symbols)
    spoken = lambda c: F.coalesce(language(F.col(c)), F.lit("unknown"))
    back = links.where(spoken("src") == spoken("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = shortest_paths(back, targets.select(F.col("file").alias("id")).distinct(), depth).where("hop > 0")
    found = found.where(is_test_file(F.col("id")))
    found = found.where(fits_glob(F.col("id"), glob)) if glob else found
    named = imports.join(targets.select(F.col("file").alias("target_file")), "target_file", "left_semi").select(F.col("file").alias("id")).distinct().withColumn("imports", F.lit(True))
    reason = F.when(F.col("imports"), "imports a changed file").when(F.col("hop") == 1, "refers to a changed file").otherwise("depends on a changed file")
    return found.join(named, "id", "left").select(F.col("id").alias("test_file"), "hop", reason.alias("reason"), F.col("path").alias("via"))


def type_impact(edges: DataFrame, symbols: DataFrame, targets: DataFrame, callers: int = 10) -> DataFrame:
    """``(id, callers)``: symbols of changed files that other files use, with the first users."""
    changed = symbols.join(targets.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("dst"))
    outside = symbols.join(targets.select("file").distinct(), "file", "left_anti").select(F.col("id").alias("src"))
    used = edges.join(changed, "dst", "left_semi").join(outside, "src", "left_semi").select(F.col("dst").alias("id"), "src").distinct()
    place = top_sources(used, callers)
    return place.groupBy("id").agg(F.sort_array(F.collect_list("src")).alias("callers"))


def top_sources(used: DataFrame, top: int) -> DataFrame:
    from loomgraph.operators.metrics import top_per_group

    return top_per_group(used, ["id"], [F.col("src")], top).select("id", "src")


def references(edges: DataFrame, symbols: DataFrame, target, limit: int = 50) -> DataFrame:
    """``(id, name, file, line, kind)``: what links to a symbol, in order of file and line."""
    found = edges.where(F.col("dst") == target).select(F.col("src").alias("id"), F.col("kind").alias("edge")).distinct()
    found = found.join(symbols.select("id", "name", "file", "line"), "id").select("id", "name", "file", "line", F.col("edge").alias("kind"))
    return found.orderBy("file", "line", "id", "kind").limit(limit)


def trace(edges: DataFrame, symbols: DataFrame, source, target, depth: int = 5) -> DataFrame:
    """``(id, hop, path)`` of the shortest path of calls to a symbol; where there is none, up to
    ten neighbours of each end with hop -1."""
    calls = edges.where("kind in ('call', 'method_call', 'import_call')")
    one = symbols.where(F.col("id") == source).select("id")
    found = shortest_paths(calls, one, depth).where(F.col("id") == target)
    if not found.isEmpty():
        return found
    near = calls.where(F.col("src").isin(source, target)).select(F.col("dst").alias("id")).unionByName(calls.where(F.col("dst").isin(source, target)).select(F.col("src").alias("id")))
    return near.distinct().orderBy("id").limit(20).select("id", F.lit(-1).alias("hop"), F.array("id").alias("path"))


def degrees(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """``(id, in_<kind>, out_<kind>, ...)`` counts of edges by direction and kind."""
    ends = edges.select(F.col("dst").alias("id"), "kind", F.lit("in").alias("way")).unionByName(
        edges.select(F.col("src").alias("id"), "kind", F.lit("out").alias("way"))
    )
    counts = [
        F.count_if((F.col("way") == way) & (F.col("kind") == kind)).alias(f"{way}_{kind}") for kind in kinds for way in ("in", "out")
    ]
    return ends.groupBy("id").agg(*counts)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges without self loops, one for each source, target and kind."""
    return edges.where("src <> dst").dropDuplicates(["src", "dst", "kind"])


def broken_edges(edges: DataFrame, vertices: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose target is no vertex."""
    some = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return some.join(vertices.select(F.col("id").alias("dst")), "dst", "left_anti")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without any edge to or from another."""
    ends = [edges.where("src <> dst").select(F.col(c).alias("id")) for c in ("src", "dst")]
    return reduce(lambda v, e: v.join(e, "id", "left_anti"), ends, vertices)


def smallest(candidates: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with equal ``by`` columns the first in ``order``."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return candidates.withColumn("_first", first).where("_first = 1").drop("_first")
