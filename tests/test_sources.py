"""A small project on disk, text predicates, streams and the driver contract."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import text as T
from loomgraph.plans import code_graph
from loomgraph.sources import diagnostics, python_code
from loomgraph.streaming import events


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "pkg").mkdir()
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "util.py").write_text('def shared(x):\n    """Doc."""\n    return x\n\n\ndef _hidden():\n    return shared(1)\n')
    (root / "main.py").write_text(
        "from pkg.util import shared\n\n\nclass App:\n    def go(self):\n        return self.step()\n\n    def step(self) -> int:\n        return shared(2)\n\n\n"
        "@app.get('/users/{id}')\nasync def users(id: int):\n    return App().go()\n\n\nshared(3)\n"
    )
    (root / "broken.py").write_text("def f(:\n")
    return str(root)


def test_scan_of_a_project(spark, project):
    found = code_graph.scan(spark, project)
    symbols = {r.name: r for r in found["symbols"].collect()}
    assert set(symbols) == {"shared", "_hidden", "App", "go", "step", "users"}
    assert symbols["_hidden"].visibility == "private" and symbols["step"].kind == "method" and symbols["step"].return_type == "int"
    assert [r.file for r in found["skipped"].collect()] == ["broken.py"]
    assert [(r.method, r.path, r.handler) for r in found["routes"].collect()] == [("GET", "/users/{id}", "users")]
    edges = {(r.src.split("::")[1], r.dst.split("::")[1]) for r in found["edges"].collect()}
    assert {("_hidden", "shared"), ("step", "shared"), ("go", "step")} <= edges
    assert not any(src == "App" for src, _ in edges)
    ranks = {r.id.split("::")[1]: r["rank"] for r in found["ranks"].collect()}
    assert max(ranks, key=ranks.get) == "shared"


def test_encodings():
    assert python_code.decode("é".encode()) == "é" and python_code.decode("中文".encode("gbk")) == "中文"


def check(spark, rows, column):
    got = spark.createDataFrame([(r,) for r in rows], "p string").select(column.alias("x")).collect()
    return dict(zip(rows, [r.x for r in got], strict=True))


def test_path_predicates(spark):
    p = F.col("p")
    tests = check(spark, ["tests/a.py", "a_test.go", "src/test_x.py", "x.spec.ts", "src/contest.py", "__tests__/q.js"], T.is_test_file(p))
    assert tests == {"tests/a.py": True, "a_test.go": True, "src/test_x.py": True, "x.spec.ts": True, "src/contest.py": False, "__tests__/q.js": True}
    assert check(spark, ["main.py", "src/a/b.py", "docs/x.md", "src/a.py"], T.module_bucket(p)) == {"main.py": "(root)", "src/a/b.py": "src/a", "docs/x.md": "docs", "src/a.py": "src"}
    assert check(spark, ["src/foo.test.ts", "test_bar.py", "x/baz.py"], T.bare_name(p)) == {"src/foo.test.ts": "foo", "test_bar.py": "bar", "x/baz.py": "baz"}
    assert check(spark, ["camelCaseName", "snake_case", "HTTPServer"], T.identifier_parts(p))["snake_case"] == ["snake", "case"]
    assert check(spark, ["src/a", "src/ab"], T.under_prefix(p, "src/a")) == {"src/a": True, "src/ab": False}


def test_diagnostics(spark):
    lines = spark.createDataFrame([("src/a.ts(12,5): error TS2304: Cannot find",), ("pkg/z.go:44:2: undefined: foo",), ("nothing",)], "line string")
    got = {(r.file, r.line, r.col, r.severity, r.code) for r in diagnostics.parse(lines).collect()}
    assert got == {("src/a.ts", 12, 5, "error", "TS2304"), ("pkg/z.go", 44, 2, "error", "")}


def test_changed_files(spark):
    old = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"1")], "path string, content binary")
    new = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("d", b"1")], "path string, content binary")
    assert {(r.path, r.change) for r in events.changed_files(old, new).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "added")}


def test_a_stream_counts_as_a_batch_does(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = events.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.start, r.event_type, r.n) for r in events.windowed_counts(batch).collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.table("counted").collect()} == want


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() == 25
