"""Lines of compilers and linters as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``file(line,col): `` or ``file:line:col: ``, then severity, code and message.
PLACE = r"^([^(:]+)[(:](\d+)[,:](\d+)\)?: "


def parse(lines: DataFrame) -> DataFrame:
    """``(file, line, col, severity, code, message)`` of the lines that name a place."""
    group = lambda i: F.regexp_extract("line", PLACE, i)
    rest = F.regexp_replace("line", PLACE, "")
    found = lines.select(
        group(1).alias("file"), F.nullif(group(2), F.lit("")).cast("long").alias("row"), F.nullif(group(3), F.lit("")).cast("long").alias("col"),
        F.when(F.contains("line", F.lit("warning")), "warning").otherwise("error").alias("severity"),
        F.regexp_extract(rest, r"\b([A-Z]+\d+)\b", 1).alias("code"), rest.alias("message"),
    )
    return found.where("file <> ''").withColumnRenamed("row", "line")
