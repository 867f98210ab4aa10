"""Which tests belong to which files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import bare_name, is_boilerplate_test, is_test_file, module_path, parent, share_test_dir
from loomgraph.operators.graph import smallest


def related_tests(files: DataFrame, targets: DataFrame, imports: DataFrame, edges: DataFrame, home: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(target_file, test_file, confidence, reason)`` by the first rule that fits.

    Rules in order: the same bare name; a folder beside each other; an import that holds
    the target's module path, ``imports(file, module)``; an edge from a symbol of the test to
    one of the target; three or more common commits, ``pairs(a, b, n)``. Every rule is an
    equi-join: bare names, folders, trailing parts of module paths, ids.
    """
    tests = files.select(F.col("file").alias("test_file")).distinct().where(is_test_file(F.col("test_file")) & ~is_boilerplate_test(F.col("test_file")))
    wanted = targets.select(F.col("file").alias("target_file")).distinct()
    tagged = lambda df, stage, level, reason: df.select("target_file", "test_file", F.lit(stage).alias("stage"), F.lit(level).alias("confidence"), F.lit(reason).alias("reason"))

    named = wanted.withColumn("bare", bare_name(F.col("target_file"))).join(tests.withColumn("bare", bare_name(F.col("test_file"))), "bare")
    above = F.regexp_extract(parent(F.col("test_file")), r"^(.*)/(?:__tests__|tests|test)$", 1)
    homes = tests.select("test_file", F.explode(F.array_distinct(F.array(parent(F.col("test_file")), above))).alias("folder"))
    beside = wanted.withColumn("folder", parent(F.col("target_file"))).where("folder <> ''").join(homes, "folder")
    beside = beside.where(share_test_dir(F.col("test_file"), F.col("target_file")))

    # an import holds the module path: the path is one of the import's stretches of parts
    parts = F.split(F.regexp_replace("module", r"^(\.{1,2}/)+", ""), "/")
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.transform(F.sequence(F.lit(1), F.size("p") - i + 1), lambda n: F.concat_ws("/", F.slice("p", i, n)))))
    held = imports.join(tests.withColumnRenamed("test_file", "file"), "file", "left_semi").select(F.col("file").alias("test_file"), parts.alias("p"))
    held = held.select("test_file", F.explode(stretches).alias("path")).distinct()
    imported = wanted.withColumn("path", module_path(F.col("target_file"))).join(held, "path")

    ends = edges.join(home.select(F.col("id").alias("src"), F.col("file").alias("test_file")), "src").join(tests, "test_file", "left_semi")
    ends = ends.join(home.select(F.col("id").alias("dst"), F.col("file").alias("target_file")), "dst").join(wanted, "target_file", "left_semi")
    both = pairs.where("n >= 3").select(F.col("a").alias("test_file"), F.col("b").alias("target_file")).unionByName(
        pairs.where("n >= 3").select(F.col("b").alias("test_file"), F.col("a").alias("target_file")))
    along = both.join(tests, "test_file", "left_semi").join(wanted, "target_file", "left_semi")
    stages = [
        tagged(named, 1, "high", "exact filename match"), tagged(beside, 2, "medium", "same test directory"),
        tagged(imported, 3, "high", "test imports target module"), tagged(ends.distinct(), 4, "medium", "test references target"),
        tagged(along, 5, "medium", "git co-changed"),
    ]
    every = stages[0]
    for other in stages[1:]:
        every = every.unionByName(other)
    return smallest(every.distinct(), ["target_file", "test_file"], [F.col("stage")]).select("target_file", "test_file", "confidence", "reason")
