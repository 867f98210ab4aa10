"""From a folder of source files to a ranked code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import EDGE_WEIGHTS
from loomgraph.operators import graph, joins
from loomgraph.sources import python_code


def call_edges(found: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """``(src, dst, weight, kind)``: each call from its smallest enclosing symbol to its target."""
    symbols = found["symbols"]
    calls = found["calls"].withColumn("call_id", F.concat_ws(":", "file", "line", "col", "name"))
    spans = symbols.select("file", F.col("id").alias("src"), F.col("line").alias("start"), F.greatest("line", "end_line").alias("end"), F.col("name").alias("owner_name"))
    holders = joins.enclosing(calls.drop("owner"), spans, "file", "line", "start", "end", 64, ["call_id"], [F.col("owner_name")])
    resolved = joins.resolve_imports(found["imports"], files).select("file", "target_file")
    targets = joins.resolve_calls(calls, symbols, resolved)
    edges = holders.join(targets, "call_id").select("src", F.col("target").alias("dst"))
    edges = edges.select("src", "dst", F.lit(EDGE_WEIGHTS["call"]).alias("weight"), F.lit("call").alias("kind"))
    return graph.distinct_edges(edges)


def scan(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relations of a folder of Python files, with ``files``, ``edges`` and ``ranks``."""
    listed = python_code.list_files(spark, root)
    records = python_code.extract(listed).persist()
    found = python_code.relations(records)
    found["files"] = listed.select("path")
    found["edges"] = call_edges(found, found["files"])
    found["ranks"] = graph.pagerank(found["symbols"].select("id"), found["edges"], iterations=20)
    return found
