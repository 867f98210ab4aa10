"""Rules over changes: risks, missing checks, status, and reports of what was missed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_test_file

# Words of a path that raise its risk, three points and one point each.
HIGH_WORDS = ["auth", "token", "session", "password", "security", "migration", "database", "schema", "persistence"]
MEDIUM_WORDS = ["terminal", "websocket", "pty", "input", "config", "build", "deploy", "ci"]
CONFIG_ENDINGS = [".config.ts", ".config.js", "package.json"]
#: Files whose change the contract rules name as configuration.
CONFIG_FILE = r"(^|/)(package\.json|tsconfig[^/]*\.json|pyproject\.toml|Cargo\.toml|go\.mod|[^/]*\.ya?ml)$"


def word_points(text: Column, words: list[str], points: int) -> Column:
    """Points for each word that a text holds, once each; ``_`` joins words."""
    found = [F.when(text.rlike(rf"(?i)\b{word}\b"), points).otherwise(0) for word in words]
    return reduce(lambda a, b: a + b, found)


def domain_points(text: Column) -> Column:
    return word_points(text, HIGH_WORDS, 3) + word_points(text, MEDIUM_WORDS, 1)


def file_points(file: Column, neighbors: Column, top_rank: Column) -> Column:
    """Points of one changed file: how many files it is linked with, a symbol of high rank,
    and what kind of file it is; tests have no points for their kind."""
    config = reduce(lambda a, b: a | b, [file.endswith(e) for e in CONFIG_ENDINGS])
    types = F.array_contains(F.split(file, "/"), "types") | file.endswith(".d.ts")
    kind = F.when(is_test_file(file), 0).when(config, 2).when(types, 1).otherwise(0)
    return F.when(neighbors >= 10, 4).when(neighbors >= 5, 3).otherwise(0) + F.when(top_rank > 0.01, 1).otherwise(0) + kind


def assess(targets: DataFrame, affected: DataFrame) -> DataFrame:
    """``(change_id, risk_score, risk)`` of sets of changes.

    ``targets(change_id, file, neighbors, top_rank)`` give points each; words count once over
    the paths of targets and ``affected(change_id, file)`` together.
    """
    own = targets.groupBy("change_id").agg(F.sum(file_points(F.col("file"), F.col("neighbors"), F.col("top_rank"))).alias("points"))
    paths = targets.select("change_id", "file").unionByName(affected.select("change_id", "file"))
    marks = [F.max(F.when(F.col("file").rlike(rf"(?i)\b{w}\b"), n).otherwise(0)) for ws, n in ((HIGH_WORDS, 3), (MEDIUM_WORDS, 1)) for w in ws]
    domain = paths.groupBy("change_id").agg(reduce(lambda a, b: a + b, marks).alias("domain"))
    score = (F.col("points") + F.coalesce("domain", F.lit(0))).cast("long")
    scored = own.join(domain, "change_id", "left").select("change_id", score.alias("risk_score"))
    return scored.withColumn("risk", F.when(F.col("risk_score") >= 6, "high").when(F.col("risk_score") >= 3, "medium").otherwise("low"))


def missing_checks(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """``(language)`` of changes ``changed(file)`` without a test among ``tests(test_file)`` of their
    language; TypeScript and Python are looked at."""
    ends = lambda c, x: reduce(lambda a, b: a | b, [F.col(c).endswith(e) for e in x])
    kinds = {"typescript": (".ts", ".tsx"), "python": (".py",)}
    has = changed.agg(*[F.coalesce(F.bool_or(ends("file", x)), F.lit(False)).alias(k) for k, x in kinds.items()])
    met = tests.agg(*[F.coalesce(F.bool_or(ends("test_file", x)), F.lit(False)).alias(f"{k}_t") for k, x in kinds.items()])
    both = has.crossJoin(met)  # one row each
    listed = F.array_compact(F.array(*[F.when(F.col(k) & ~F.col(f"{k}_t"), F.lit(k)) for k in kinds]))
    return both.select(F.explode(listed).alias("language"))


def contract_risks(symbols: DataFrame, references: DataFrame, routes: DataFrame, changed: DataFrame) -> DataFrame:
    """``(file, rule, risk)``: one row for each rule that a changed file meets.

    ``references(id, n)`` counts links from other files. A changed route is HIGH; an
    exported or public symbol with many references HIGH or MED; any much-used one MED;
    a configuration file MED; a change of tests alone LOW, of code without tests MED.
    """
    touched = symbols.join(changed, "file", "left_semi").join(references, "id")
    open_ = F.col("visibility").isin("exported", "public")
    level = F.when(open_ & (F.col("n") >= 20), "HIGH").when(open_ & (F.col("n") >= 3), "MED").when(F.col("n") >= 10, "MED")
    used = touched.select("file", F.lit("references").alias("rule"), level.alias("risk")).where("risk is not null")
    route = routes.join(changed, "file", "left_semi").select("file", F.lit("route").alias("rule"), F.lit("HIGH").alias("risk"))
    config = changed.where(F.col("file").rlike(CONFIG_FILE)).select("file", F.lit("config").alias("rule"), F.lit("MED").alias("risk"))
    tests = changed.agg(F.count_if(is_test_file(F.col("file"))).alias("t"), F.count("*").alias("n")).where("n > 0")
    alone = F.when(F.col("t") == F.col("n"), "LOW").when(F.col("t") == 0, "MED")
    tests = tests.select(F.lit("*").alias("file"), F.lit("tests").alias("rule"), alone.alias("risk")).where("risk is not null")
    return reduce(DataFrame.unionByName, [used, route, config, tests]).distinct()


def missed_files(edges: DataFrame, home: DataFrame, changed: DataFrame, neighbors: DataFrame) -> DataFrame:
    """``(file, reason)``: files outside the change whose symbols call into it, or that
    mostly change along, ``neighbors(file, neighbor, place)``."""
    ends = edges.where("kind = 'call'").join(home.select(F.col("id").alias("src"), F.col("file").alias("caller")), "src")
    ends = ends.join(home.select(F.col("id").alias("dst"), "file"), "dst").join(changed, "file", "left_semi")
    callers = ends.select(F.col("caller").alias("file"), F.lit("caller").alias("reason"))
    along = neighbors.where("place <= 3").join(changed, "file", "left_semi").select(F.col("neighbor").alias("file"), F.lit("co-change").alias("reason"))
    found = callers.unionByName(along).join(changed, "file", "left_anti")
    return found.groupBy("file").agg(F.min("reason").alias("reason"))


def compare_sessions(targets: DataFrame, affected: DataFrame, changed: DataFrame) -> DataFrame:
    """``(file, outcome)``: affected files are covered or missed by the change; what was
    neither target nor affected is unexpected."""
    sides = [t.select("file").distinct().withColumn(n, F.lit(True)) for t, n in ((targets, "t"), (affected, "a"), (changed, "c"))]
    both = sides[0].join(sides[1], "file", "full").join(sides[2], "file", "full")
    outcome = F.when(F.col("a") & F.col("c"), "covered").when(F.col("a"), "missed").when(F.col("c") & F.col("t").isNull(), "unexpected")
    return both.select("file", outcome.alias("outcome")).where("outcome is not null")


def verify_status(figures: DataFrame) -> DataFrame:
    """Adds ``status`` to ``(failed, changed, missing_checks, breaking, warnings, missed)`` counts."""
    doubt = F.col("missing_checks") + F.col("breaking") + F.col("warnings") + F.col("missed") > 0
    status = F.when(F.col("failed") > 0, "failed").when(F.col("changed") == 0, "unchanged").when(doubt, "warning").otherwise("passed")
    return figures.withColumn("status", status)
