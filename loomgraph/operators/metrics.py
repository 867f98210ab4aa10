"""Aggregates and rules over symbols, edges, files and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def co_change(commits: DataFrame, most_files: int | None = None) -> DataFrame:
    """``(a, b, n)``: how often two files change in one commit, ``a < b``.

    Commits with more than ``most_files`` files, where that is given, say little and keep
    their first files in order of name.
    """
    rows = commits.select("commit_id", "file").distinct()
    if most_files:
        place = F.row_number().over(W.partitionBy("commit_id").orderBy("file"))
        rows = rows.withColumn("_n", place).where(F.col("_n") <= most_files).drop("_n")
    left, right = rows.select("commit_id", F.col("file").alias("a")), rows.select("commit_id", F.col("file").alias("b"))
    return left.join(right, "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def co_change_neighbors(pairs: DataFrame, top: int = 5) -> DataFrame:
    """``(file, neighbor, n, place)``: the files that change most with each file."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("neighbor"), "n").unionByName(
        pairs.select(F.col("b").alias("file"), F.col("a").alias("neighbor"), "n")
    )
    return top_per_group(both, ["file"], [F.desc("n"), F.col("neighbor")], top, "place")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], top: int, place: str = "place") -> DataFrame:
    """The first ``top`` rows of each group with their place."""
    numbered = df.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    return numbered.where(F.col(place) <= top)


def file_analysis(symbols: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """Per file: symbols, their weights and ranks, links to other files, and a score.

    ``symbols(id, file, name, score, weight, rank, visibility)`` and ``edges(src, dst,
    kind)``. The implementation score is the sum of the ``top`` best symbol scores.
    """
    best = top_per_group(symbols, ["file"], [F.desc("score"), F.col("id")], top, "_place")
    best = best.groupBy("file").agg(F.sum("score").alias("implementation"))
    files = symbols.groupBy("file").agg(
        F.count("*").alias("symbol_count"), F.sum("weight").alias("semantic_count"),
        F.sum(F.col("rank") * F.col("weight")).alias("semantic_rank"),
        F.sum(F.when(F.col("visibility") == "exported", F.col("weight")).otherwise(0.0)).alias("exported"),
        F.sum(F.when(F.col("visibility") == "public", F.col("weight")).otherwise(0.0)).alias("public"),
    )
    home = symbols.select("id", "file")
    ends = edges.join(home.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src")
    ends = ends.join(home.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    calls = ends.where("kind = 'call'").groupBy(F.col("src_file").alias("file")).agg(
        F.count("*").alias("call_edges"), F.count_if(F.col("src_file") != F.col("dst_file")).alias("cross_calls")
    )
    across = ends.where("src_file <> dst_file").select("src_file", "dst_file").distinct()
    sides = across.select(F.col("src_file").alias("file"), F.col("dst_file").alias("other")).unionByName(
        across.select(F.col("dst_file").alias("file"), F.col("src_file").alias("other"))
    )
    neighbors = sides.distinct().groupBy("file").agg(F.count("*").alias("neighbors"))
    joined = files.join(best, "file").join(calls, "file", "left").join(neighbors, "file", "left").na.fill(
        0, ["call_edges", "cross_calls", "neighbors"]
    )
    # fixed values: weights of a file's score
    score = (
        F.col("implementation") + 0.8 * F.col("exported") + 0.25 * F.col("public") + 0.6 * F.col("semantic_count")
        + 0.45 * F.col("neighbors") + 0.25 * F.col("cross_calls") + 0.05 * F.col("call_edges")
    )
    return joined.withColumn("score", score)


def severity_index(edges: DataFrame, home: DataFrame) -> DataFrame:
    """``(file, severity)``: calls that reach a file's symbols from other files."""
    ends = edges.where("kind = 'call'").join(home.select(F.col("id").alias("src"), F.col("file").alias("a")), "src")
    ends = ends.join(home.select(F.col("id").alias("dst"), F.col("file").alias("file")), "dst")
    return ends.where("a <> file").groupBy("file").agg(F.count("*").alias("severity"))


def module_summary(files: DataFrame) -> DataFrame:
    """``(module, files, symbols, score, representative)`` of ``files(module, file, symbol_count, score)``."""
    best = F.min_by("file", F.struct(-F.col("score"), F.col("file")))
    return files.groupBy("module").agg(
        F.count("*").alias("files"), F.sum("symbol_count").alias("symbols"), F.sum("score").alias("score"), best.alias("representative")
    )


def untested(symbols: DataFrame, calls_in: DataFrame, tested: DataFrame, least_calls: int = 2, least_risk: float = 5.0) -> DataFrame:
    """``(id, calls, risk)``: symbols that no test reaches though others call them."""
    found = symbols.join(tested.select("id").distinct(), "id", "left_anti").join(calls_in, "id")
    found = found.withColumn("risk", F.col("calls") * F.col("weight") * 5.0)
    return found.where((F.col("calls") >= least_calls) & (F.col("risk") >= least_risk)).select("id", "calls", "risk")


def snapshot_diff(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """``(id, new_id, change)`` between two snapshots of symbols.

    Rows are matched by id; rows left over are matched again by file, name and kind, the
    first left with the first right in order of id, and count as modified. Matched rows
    are modified if a ``compared`` column differs.
    """
    keys = ["file", "name", "kind"]
    a = old.select([F.col(c).alias(f"old_{c}") for c in ["id", *keys, *compared]])
    b = new.select([F.col(c).alias(f"new_{c}") for c in ["id", *keys, *compared]])
    same = a.join(b, a["old_id"] == b["new_id"])
    differs = ~F.array(*[F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compared]).eqNullSafe(
        F.array(*[F.lit(True)] * len(compared))
    )
    same = same.where(differs).select(F.col("old_id").alias("id"), "new_id", F.lit("modified").alias("change"))
    gone = old.join(new.select("id"), "id", "left_anti")
    come = new.join(old.select("id"), "id", "left_anti")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    gone = gone.select("id", *keys, place.alias("_n"))
    come = come.select(F.col("id").alias("new_id"), *keys, place.alias("_n"))
    both = gone.join(come, [*keys, "_n"], "full")
    change = F.when(F.col("new_id").isNull(), "removed").when(F.col("id").isNull(), "added").otherwise("modified")
    return same.unionByName(both.select("id", "new_id", change.alias("change")))


def breaking_risk(changes: DataFrame) -> DataFrame:
    """Adds ``risk`` to ``(signature_changed, exported, callers)`` rows."""
    changed = F.col("signature_changed")
    return changes.withColumn(
        "risk", F.when(changed & F.col("exported"), "HIGH").when(changed & (F.col("callers") >= 3), "MEDIUM").otherwise("LOW")
    )


# Points of a symbol without edges.
ORPHAN_EXCLUDED_KINDS = ["element", "json_key", "module", "handler"]
ORPHAN_EXCLUDED_ENDINGS = [".json", ".toml", ".yaml", ".yml", ".html", ".css", ".scss", ".less"]
ORPHAN_TEST_MARKS = ["test", "spec", "e2e", "__test__", "__tests__"]
ORPHAN_TEST_NAMES = ["test_", "it_", "should_", "test"]
ORPHAN_BASE = {
    "function": 60, "method": 60, "struct": 40, "enum": 40, "class": 40, "type": 40, "interface": 35,
    "anonymous_function": 30, "variable": 30, "const": 30, "impl": 15, "trait": 35,
}
ORPHAN_PAIRED = ["impl", "struct", "enum", "class", "type"]


def orphan_score(kind: Column, file: Column, name: Column, visibility: Column, paired: Column) -> Column:
    """How likely a symbol without edges is dead, 0 to 100: by kind, less in tests and in
    markup, more if private, or ``paired`` with an orphan of its name for a type or its impl."""
    low, any_of = F.lower(file), lambda tests: reduce(lambda a, b: a | b, tests)
    base = reduce(lambda c, k: c.when(kind == k, ORPHAN_BASE[k]), list(ORPHAN_BASE)[1:], F.when(kind == "function", 60)).otherwise(30)
    score = (
        base - F.when(any_of([F.contains(low, F.lit(m)) for m in ORPHAN_TEST_MARKS]), 20).otherwise(0)
        - F.when(any_of([low.endswith(e) for e in ORPHAN_EXCLUDED_ENDINGS]), 50).otherwise(0)
        - F.when(any_of([F.lower(name).startswith(n) for n in ORPHAN_TEST_NAMES]), 30).otherwise(0)
        + F.when(visibility == "private", 10).otherwise(0) + F.when(kind.isin(ORPHAN_PAIRED) & paired, 25).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def orphans(symbols: DataFrame, edges: DataFrame, least: int = 70) -> DataFrame:
    """``(id, score)`` of symbols without call or import edges that are likely dead.

    Excluded are ``main``, exported symbols, and structural kinds and files.
    """
    from loomgraph.operators.graph import isolated

    some = symbols.where(~F.col("kind").isin(ORPHAN_EXCLUDED_KINDS) & (F.col("name") != "main") & (F.col("visibility") != "exported"))
    some = some.where(~reduce(lambda a, b: a | b, [F.lower("file").endswith(e) for e in ORPHAN_EXCLUDED_ENDINGS]))
    alone = isolated(some, edges.where("kind in ('call', 'import')"))
    score = orphan_score(F.col("kind"), F.col("file"), F.col("name"), F.col("visibility"), F.lit(True))  # its own name is an orphan's
    return alone.select("id", score.alias("score")).where(F.col("score") >= least)


def symbol_scores(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, file, score)``: how telling a symbol is, by its edges, visibility, kind and rank.

    ``symbols(id, file, name, kind, visibility, rank)``.
    """
    from loomgraph.functions.text import signal_weight
    from loomgraph.operators.graph import degrees

    joined = symbols.join(degrees(edges, ["call", "import"]), "id", "left").na.fill(0, ["in_call", "out_call", "in_import"])
    score = (
        4 * F.col("in_call") + 1.5 * F.col("out_call") + 0.15 * F.least("in_import", F.lit(4))
        + F.when(F.col("visibility") == "exported", 1.2).when(F.col("visibility") == "public", 0.45).otherwise(0.0)
        + F.when(F.col("kind") == "class", 1.0).when(F.col("kind").isin("function", "method"), 0.55).otherwise(0.2) + 40 * F.col("rank")
    )
    return joined.select("id", "file", (score * signal_weight(F.col("kind"), F.col("name"), F.col("visibility"))).alias("score"))


def full_analysis(files: DataFrame, symbols: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """:func:`file_analysis` of every file, those without symbols too, with the edges between
    files and a lower score for tests.

    ``symbols(id, file, name, kind, visibility, rank)``, ``files(file)``.
    """
    from loomgraph.functions.text import is_test_file, signal_weight

    weight = signal_weight(F.col("kind"), F.col("name"), F.col("visibility"))
    rated = symbols.withColumn("weight", weight).join(symbol_scores(symbols, edges).select("id", "score"), "id")
    found = file_analysis(rated, edges, top)
    home = symbols.select("id", "file")
    imports = edges.where("kind = 'import'").join(home.select(F.col("id").alias("src"), "file"), "src").join(
        home.select(F.col("id").alias("dst"), F.col("file").alias("to")), "dst")
    imports = imports.where("file <> to").groupBy("file").agg(F.count("*").alias("import_edges"))
    names = top_per_group(rated, ["file"], [F.desc("score"), F.col("name"), F.col("id")], 3)
    names = names.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("top_names"))
    every = files.select("file").distinct().join(found, "file", "left").join(imports, "file", "left").join(names, "file", "left")
    counted = [c for c in every.columns if c not in ("file", "top_names")]
    test = is_test_file(F.col("file"))
    every = every.na.fill(0, counted).withColumn("top_names", F.coalesce("top_names", F.array().cast("array<string>")))
    return every.withColumns({"is_test": test, "score": F.col("score") * F.when(test, 0.55).otherwise(1.0)})


def hotspots(files: DataFrame, limit: int = 10) -> DataFrame:
    """The files of :func:`full_analysis` to look at first, tests last, with a risk."""
    from loomgraph.functions.text import level

    order = [F.col("is_test"), F.desc("semantic_count"), F.desc("score"), F.col("file")]
    return files.withColumn("risk", level(F.col("semantic_count"), 12, 4)).orderBy(*order).limit(limit)


def reading_order(files: DataFrame, limit: int = 12) -> DataFrame:
    """``(place, file, reasons)``: entry points by name, then files with symbols by score, tests last."""
    from loomgraph.functions.text import is_entry_point

    entry = is_entry_point(F.col("file"))
    flags = [
        (entry, "entry point"), (F.col("neighbors") >= 3, "many neighbours"), (F.col("exported") >= 2, "exports"),
        (F.col("semantic_count") >= 5, "many symbols"), (F.col("is_test"), "test"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in flags]))
    some = files.where(entry | (F.col("symbol_count") > 0)).withColumns({"entry": entry, "reasons": reasons})
    order = [F.desc("entry"), F.when(F.col("entry"), False).otherwise(F.col("is_test")), F.when(F.col("entry"), 0.0).otherwise(-F.col("score")), F.col("file")]
    first = some.orderBy(*order).limit(limit)
    return first.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("place"), "file", "reasons")  # at most limit rows


def module_overview(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules of :func:`full_analysis` rows by weight, each with its best file and that file's names."""
    from loomgraph.functions.text import module_bucket

    best = F.min_by(F.struct("file", "top_names"), F.struct(-F.col("score"), F.col("file"))).alias("best")
    found = files.withColumn("module", module_bucket(F.col("file"))).groupBy("module").agg(
        F.count("*").alias("files"), F.sum("symbol_count").alias("symbols"), F.sum("semantic_rank").alias("semantic_rank"),
        F.sum("semantic_count").alias("semantic_count"), best,
    )
    found = found.select("module", "files", "symbols", "semantic_rank", "semantic_count", F.col("best.file").alias("representative"), F.col("best.top_names").alias("top_names"))
    found = found.orderBy(F.desc("semantic_rank"), F.desc("semantic_count"), "module")
    return found.limit(limit) if limit else found


def cross_references(edges: DataFrame, home: DataFrame) -> DataFrame:
    """``(id, n)``: edges of any kind that reach a symbol from other files."""
    ends = edges.join(home.select(F.col("id").alias("src"), F.col("file").alias("a")), "src")
    ends = ends.join(home.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return ends.where("a <> b").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def untested_symbols(symbols: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """``(place, id, calls, risk, total)``: the first symbols outside tests that no test reaches
    though others call them, and how many there are."""
    from loomgraph.functions.text import LOW_SIGNAL_KINDS, is_test_file, signal_weight

    inside = symbols.where(is_test_file(F.col("file"))).select("id")
    some = symbols.join(inside, "id", "left_anti").where(~F.col("kind").isin(LOW_SIGNAL_KINDS))
    some = some.withColumn("weight", signal_weight(F.col("kind"), F.col("name"), F.col("visibility")))
    reached = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    calls = edges.where("kind = 'call'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    found = untested(some, calls, reached)
    first = found.crossJoin(found.agg(F.count("*").alias("total"))).orderBy(F.desc("risk"), "id").limit(limit)  # a row beside each
    return first.withColumn("place", F.row_number().over(W.orderBy(F.desc("risk"), "id")).cast("long"))  # at most limit rows


def edge_diff(old: DataFrame, new: DataFrame, symbols: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(src, dst, kind, change)``: edges added and removed between two snapshots.

    Ids hold line numbers. With the two snapshots' ``symbols`` edges are compared by file,
    name, kind and place among equals of their ends, so a moved line is no change.
    """
    def keyed(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
        if nodes is None:
            return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind").distinct()
        place = F.row_number().over(W.partitionBy("file", "name", "kind").orderBy("line", "id"))
        keys = nodes.select("id", F.concat_ws("::", "file", "name", "kind", place.cast("string")).alias("key"))
        ends = edges.join(keys.select(F.col("id").alias("src"), F.col("key").alias("a")), "src").join(keys.select(F.col("id").alias("dst"), F.col("key").alias("b")), "dst")
        return ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").distinct()

    a, b = keyed(old, symbols and symbols[0]), keyed(new, symbols and symbols[1])
    on = ["src", "dst", "kind"]
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


def language_histogram(files: DataFrame, top: int = 3) -> DataFrame:
    """``(language, files)`` of ``files(file)``, the most frequent first."""
    from loomgraph.functions.text import language

    found = files.select(language(F.col("file")).alias("language")).where("language is not null")
    return found.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(top)


#: The methods that a route histogram has columns for.
ROUTE_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]


def route_histogram(routes: DataFrame) -> DataFrame:
    """Per file the number of its routes by method."""
    counts = [F.count_if(F.upper("method") == m).alias(m.lower()) for m in ROUTE_METHODS]
    return routes.groupBy("file").agg(*counts, F.count("*").alias("total"))


def diagnostics_by_file(issues: DataFrame, top: int = 20) -> DataFrame:
    """``(file, errors, warnings)`` of the files with most ``issues(file, severity)``."""
    counted = issues.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counted.orderBy(F.desc(F.col("errors") + F.col("warnings")), "file").limit(top)


def diagnostics_summary(issues: DataFrame, tools: DataFrame) -> DataFrame:
    """One row ``(errors, warnings, files, status)``: failed with errors or a failed tool, warning,
    skipped if every tool of ``tools(tool, state)`` was skipped, else passed."""
    found = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct("file").alias("files"))
    ran = tools.agg(F.count_if(F.col("state") == "failed").alias("broken"), F.count_if(F.col("state") != "skipped").alias("ran"))
    status = F.when((F.col("errors") > 0) | (F.col("broken") > 0), "failed").when(F.col("warnings") > 0, "warning").when(F.col("ran") == 0, "skipped").otherwise("passed")
    return found.crossJoin(ran).select("errors", "warnings", "files", status.alias("status"))  # one row each


def scan_stats(listed: DataFrame, symbols: DataFrame, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of counters of a scan."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return reduce(DataFrame.crossJoin, [one(listed, "files"), one(symbols, "symbols"), one(edges, "edges"), one(skipped, "skipped")])  # one row each


def edge_confidence(edges: DataFrame) -> DataFrame:
    """``(src, dst, confidence)``: the least confidence of the call edges between two symbols."""
    own = F.col("confidence") if "confidence" in edges.columns else F.lit(1.0)
    return edges.where("kind = 'call'").groupBy("src", "dst").agg(F.min(own).alias("confidence"))


def path_digest(files: DataFrame) -> DataFrame:
    """One row ``(digest)`` of a listing ``files(path, mtime, size)``.

    The rows' digests are hashed in 4096 groups by path and these once more, so no list of
    all files is made.
    """
    row = F.sha2(F.concat_ws("\0", "path", F.col("mtime").cast("string"), F.col("size").cast("string")), 256)
    part = F.pmod(F.xxhash64("path"), F.lit(4096))
    parts = files.groupBy(part.alias("part")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(row))), 256).alias("d"))
    return parts.agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])), 256).alias("digest"))
