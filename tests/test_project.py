"""Resolution, clusters and queries of a project on small tables."""

from __future__ import annotations

from loomgraph.operators import graph, joins, metrics, search


def test_synonyms_follow_their_word_and_its_head():
    found = search.expand_keywords(["job", "cache"])
    assert found[:2] == [("job", None), ("cache", None)] or found[0] == ("job", None)
    assert dict(found)["task"] == "job" and dict(found)["process"] == "task" and dict(found)["redis"] == "cache"
    assert len(found) == len(dict(found))


def test_import_stages(spark):
    files = spark.createDataFrame([(p,) for p in ("web/src/ui/a.ts", "web/lib/b.ts", "com/ex/Foo.java", "pkgs/core/src/x.ts", "vendor/v.go", "q/v.py")], "path string")
    imports = spark.createDataFrame([
        ("web/src/main.ts", "@ui/a"), ("web/src/main.ts", "lib/b"), ("com/Main.java", "com.ex.Foo"), ("web/src/main.ts", "@co/core/x"), ("z.py", "v"), ("web/src/main.ts", "../lib/b.js")], "file string, module string")
    rules = spark.createDataFrame([("web/tsconfig.json", "web", "@ui/*", "./src/ui/*"), ("tsconfig.json", "", "@ui/*", "nowhere/*")], "config_path string, config_dir string, alias_pattern string, target_pattern string")
    exports = spark.createDataFrame([("@co/core", "./*", "./pkgs/core/src/*.ts")], "package string, subpath string, target string")
    bundler = spark.createDataFrame([("lib", "./web/lib")], "alias string, target string")
    got = {r.module: (r.target_file, r.stage) for r in joins.resolve_imports(imports, files, rules, exports, bundler).collect()}
    assert got == {"@ui/a": ("web/src/ui/a.ts", 3), "lib/b": ("web/lib/b.ts", 2), "com.ex.Foo": ("com/ex/Foo.java", 1), "@co/core/x": ("pkgs/core/src/x.ts", 4), "v": ("q/v.py", 6), "../lib/b.js": ("web/lib/b.ts", 0)}


def test_exports_are_followed_and_marked(spark):
    exports = spark.createDataFrame([
        ("index.ts", "go", None, "mid.ts", "wildcard"), ("mid.ts", "go", "run", "deep.ts", "reexport"), ("deep.ts", "run", "run", None, "local")],
        "file string, exported_name string, source_name string, target_file string, kind string")
    wanted = spark.createDataFrame([("index.ts", "go")], "file string, name string")
    assert [(r.target_file, r.target_name) for r in joins.follow_exports(wanted, exports).collect()] == [("deep.ts", "run")]
    symbols = spark.createDataFrame([("1", "run", "deep.ts", "public"), ("2", "other", "deep.ts", "public")], "id string, name string, file string, visibility string")
    assert {r.id: r.visibility for r in joins.mark_exported(symbols, exports).collect()} == {"1": "exported", "2": "public"}


def test_file_clusters(spark):
    names = ["a/x/1.py", "a/x/2.py", "a/x/test_3.py", "b/y/1.py", "b/y/2.py"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    imports = spark.createDataFrame([(names[0], names[1]), (names[1], names[2]), (names[3], names[4])], "file string, target_file string")
    calls = spark.createDataFrame([(names[0], "get"), (names[3], "get")], "file string, name string")
    symbols = spark.createDataFrame([("get", names[1])], "name string, file string")
    links = graph.file_links(files, imports, calls, symbols)
    assert {(r.src, r.dst): r.weight for r in links.collect()} == {(names[0], names[1]): 1.5, (names[1], names[2]): 1.0, (names[3], names[4]): 1.0}
    clusters = graph.file_clusters(files, links)
    assert {r.file: r.cluster for r in clusters.collect()} == dict(zip(names, [0, 0, 0, 1, 1], strict=True))
    got = {r.cluster: (r["size"], r.label, r.files) for r in graph.describe_clusters(clusters).collect()}
    assert got == {0: (3, "x", names[:2]), 1: (2, "y", names[3:])}


def test_edges_of_moved_lines_are_no_change(spark):
    kind = "id string, file string, name string, kind string, line int"
    old = spark.createDataFrame([("f::a::1", "f", "a", "function", 1), ("f::b::5", "f", "b", "function", 5)], kind)
    new = spark.createDataFrame([("f::a::2", "f", "a", "function", 2), ("f::b::9", "f", "b", "function", 9)], kind)
    edge = lambda a, b: spark.createDataFrame([(a, b, "call")], "src string, dst string, kind string")
    a, b = edge("f::a::1", "f::b::5"), edge("f::a::2", "f::b::9")
    assert metrics.edge_diff(a, b).count() == 2 and metrics.edge_diff(a, b, (old, new)).count() == 0


def test_a_path_digest_changes_with_any_row(spark):
    rows = [("a", 1, 2), ("b", 3, 4)]
    digest = lambda x: metrics.path_digest(spark.createDataFrame(x, "path string, mtime long, size long")).first()[0]
    assert digest(rows) == digest(rows[::-1]) != digest([("a", 1, 2), ("b", 3, 5)])


def test_issues_meet_few_spans_however_many_hold_them(spark):
    import random

    rng = random.Random(5)
    names = [("f", i, f"n{i}", rng.randint(0, 130), rng.choice([None, 0, 400, rng.randint(0, 300)])) for i in range(900)] + [("g", 901, "late", 200, 210), ("g", 902, "n", None, None)]
    symbols = spark.createDataFrame(names, "file string, id long, name string, line int, end_line int")
    issues = [(i, rng.choice(["f", "./f", "g", "h", None]), rng.choice([None, rng.randint(-5, 420)])) for i in range(700)]
    edges = spark.createDataFrame([(901, 5, "call"), (3, 5, "call"), (3, 901, "call"), (5, 901, "import")], "src long, dst long, kind string")
    want = {}
    for i, file, at in issues:
        held = [(at != start, start, k, name) for f, k, name, start, end in names if None not in (file, at, start) and f == file.removeprefix("./") and start <= at <= max(end or 0, start + 50)]
        if held:
            late, _, k, name = min(held)
            want[i] = (name, "line" if late else "exact", {901: ["n3"], 5: ["late", "n3"]}.get(k, []))
    got = joins.diagnostic_symbols(spark.createDataFrame(issues, "issue_id long, file string, line int"), symbols, edges)
    assert {r.issue_id: (r.symbol, r.confidence, r.callers) for r in got.collect()} == want and len(want) > 100
    spans = symbols.selectExpr("file", "id", "name", "line AS start", "greatest(end_line, line + 50) AS end")
    assert max(len(r._first) for r in joins.first_spans(spans, 64).collect()) <= 128
