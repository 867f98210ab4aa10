"""Python source files as relations: symbols, imports, calls, routes."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of a parse.
MAX_BYTES, LARGEST_PARSE = 512 * 1024, 10 * 1024 * 1024
ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "route")
SCHEMA = (
    "file string, record string, id string, name string, kind string, line int, end_line int, col int, "
    "visibility string, docstring string, signature string, return_type string, extra string"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def list_files(spark: SparkSession, root: str, suffix: str = ".py", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, length, content)`` of the files below a folder that are not too large.

    Size and name filters reach the scan; contents of other files are never read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").removeprefix("file://") + "/", "")
    return found.where(F.col("length") <= max_bytes).select(relative.alias("path"), "length", "content")


def decode(content: bytes) -> str:
    """The text of a file: the first encoding that leaves few replacement characters."""
    for name in ("utf-8-sig", "gbk", "latin-1"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


class _Reader(ast.NodeVisitor):
    """Collects one file's rows."""

    def __init__(self, path: str):
        self.path, self.rows, self.scope = path, [], []

    def add(self, record: str, **values) -> None:
        self.rows.append(dict.fromkeys(COLUMNS) | {"file": self.path, "record": record} | values)

    def symbol(self, node, kind: str) -> None:
        arguments = ast.unparse(node.args) if hasattr(node, "args") else ", ".join(map(ast.unparse, node.bases))
        word = "class" if kind == "class" else "def"
        private = node.name.startswith("_") and not node.name.startswith("__")
        self.add(
            "symbol", id=f"{self.path}::{node.name}::{node.lineno}", name=node.name, kind=kind, line=node.lineno, end_line=node.end_lineno,
            col=node.col_offset, visibility="private" if private else "public", docstring=ast.get_docstring(node) or "",
            signature=f"{word} {node.name}({arguments})", return_type=ast.unparse(node.returns) if getattr(node, "returns", None) else "",
            extra=".".join(self.scope),
        )

    def inside(self, node) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        self.symbol(node, "class")
        self.scope.append("class " + node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        in_class = bool(self.scope) and self.scope[-1].startswith("class ")
        self.symbol(node, "method" if in_class else "function")
        for mark in node.decorator_list:
            self.route(mark, node)
        self.inside(node)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def route(self, mark, node) -> None:
        called = isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.func.attr in ROUTE_METHODS
        if called and mark.args and isinstance(mark.args[0], ast.Constant) and str(mark.args[0].value).startswith("/"):
            method = "GET" if mark.func.attr == "route" else mark.func.attr.upper()
            self.add("route", name=node.name, kind=method, line=node.lineno, extra=str(mark.args[0].value))

    def visit_Import(self, node) -> None:  # noqa: N802
        for name in node.names:
            self.add("import", name=name.name, kind="module", line=node.lineno, extra=name.asname or name.name)

    def visit_ImportFrom(self, node) -> None:  # noqa: N802
        module = node.module or ""
        level = "" if not node.level else "." if node.level == 1 else "/".join([".."] * (node.level - 1))
        target = f"{level}/{module.replace('.', '/')}" if node.level else module
        for name in node.names:
            self.add("import", name=target, kind="from", line=node.lineno, extra=name.name)

    def visit_Call(self, node) -> None:  # noqa: N802
        if isinstance(node.func, ast.Name):
            self.add("call", name=node.func.id, kind="direct", line=node.lineno, col=node.col_offset)
        elif isinstance(node.func, ast.Attribute):
            owner = node.func.value.id if isinstance(node.func.value, ast.Name) else ""
            self.add("call", name=node.func.attr, kind="member", line=node.lineno, col=node.col_offset, extra=owner)
        self.generic_visit(node)


def read_file(path: str, content: bytes) -> list[dict]:
    """One file's rows; a file that cannot be parsed gives one row that says why."""
    reader = _Reader(path)
    try:
        if len(content) > LARGEST_PARSE:
            raise ValueError("too large")
        reader.visit(ast.parse(decode(content)))
    except (SyntaxError, ValueError, RecursionError) as error:
        reader.rows = []
        reader.add("skipped", extra=str(error)[:200])
    return reader.rows


def extract(files: DataFrame) -> DataFrame:
    """All records of ``files(path, content)``, file by file."""

    def run(batches):
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in read_file(path, content)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def relations(records: DataFrame) -> dict[str, DataFrame]:
    """``symbols``, ``imports``, ``calls``, ``routes`` and ``skipped`` of extracted records."""
    of = lambda kind: records.where(F.col("record") == kind)
    return {
        "symbols": of("symbol").select(*[c for c in COLUMNS if c not in ("record", "extra")], F.col("extra").alias("scope")),
        "imports": of("import").select("file", F.col("name").alias("module"), F.col("extra").alias("imported"), "line"),
        "calls": of("call").select("file", "name", "line", "col", F.col("kind").alias("call_kind"), F.col("extra").alias("owner")).distinct(),
        "routes": of("route").select(F.col("kind").alias("method"), F.col("extra").alias("path"), F.col("name").alias("handler"), "file", "line"),
        "skipped": of("skipped").select("file", F.col("extra").alias("reason")),
    }
