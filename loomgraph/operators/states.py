"""Where the values of enumerations are written and read, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines_of(files: DataFrame) -> DataFrame:
    """``(file, line, text)`` of ``files(file, content)``, lines from 1."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def python_states(symbols: DataFrame, files: DataFrame, reach: int = 80) -> DataFrame:
    """``(id, value, file, line, role)``: values that class bodies assign, and their uses.

    A value is a ``NAME = literal`` line in the first ``reach`` lines of a class. A line
    with ``Class.NAME`` writes if it assigns or returns, else it reads.
    """
    lines = lines_of(files)
    classes = symbols.where("kind = 'class'").select("id", F.col("name").alias("owner"), "file", F.col("line").alias("start"), F.least("end_line", F.col("line") + reach).alias("end"))
    body = lines.join(classes, "file").where("line > start and line <= end")
    name = F.regexp_extract("text", r"^\s+([A-Z][A-Z0-9_]*)\s*=\s*['\"\d(\[{tTfFnN-]", 1)
    values = body.select("id", "owner", name.alias("value"), "file", "line").where("value <> ''")
    defined = values.select("id", "value", "file", "line", F.lit("value").alias("role"))
    used = lines.select("file", "line", "text", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*\.[A-Z][A-Z0-9_]*)\b"), F.lit(1))).alias("use"))
    used = used.join(values.select("id", F.concat_ws(".", "owner", "value").alias("use"), "value"), "use")
    writes = F.regexp("text", F.lit(r"(^|[^=!<>])=([^=]|$)|\breturn\b"))
    uses = used.select("id", "value", "file", "line", F.when(writes, "writer").otherwise("reader").alias("role"))
    return defined.unionByName(uses).distinct()
