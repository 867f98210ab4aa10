"""Graph loops and aggregates against plain versions."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, joins, metrics, search

EDGES = "src string, dst string, weight double, kind string"


def edge_table(spark, rows):
    return spark.createDataFrame([(a, b, float(w), k) for a, b, w, k in rows], EDGES)


def vertices(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def plain_pagerank(names, edges, rounds):
    total = collections.Counter()
    for a, _, w in edges:
        total[a] += w
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        got = collections.Counter()
        for a, b, w in edges:
            if math.isfinite(total[a]) and total[a] > 0:
                got[b] += rank[a] * w / total[a]
        raw = {n: 0.15 / len(names) + 0.85 * got[n] for n in names}
        rank = {n: r / sum(raw.values()) for n, r in raw.items()}
    return rank


def test_pagerank_matches_a_plain_loop(spark):
    rng = random.Random(1)
    names = [f"v{i}" for i in range(12)]
    edges = [(rng.choice(names), rng.choice(names), rng.randint(1, 5), "call") for _ in range(40)]
    got = graph.pagerank(vertices(spark, names), edge_table(spark, edges), iterations=8, tolerance=None)
    want = plain_pagerank(names, [(a, b, float(w)) for a, b, w, _ in edges], 8)
    assert all(abs(r["rank"] - want[r["id"]]) < 1e-12 for r in got.collect())


@pytest.mark.parametrize("weight", [float("nan"), -5.0, 0.0, float("inf")])
def test_pagerank_ignores_sources_without_a_proper_weight(spark, weight):
    got = graph.pagerank(vertices(spark, "ab"), edge_table(spark, [("a", "b", weight, "call")])).collect()
    assert sorted(r["rank"] for r in got) == [0.5, 0.5]
    assert graph.pagerank(vertices(spark, []), edge_table(spark, [])).count() == 0


def test_reach_and_paths(spark):
    edges = edge_table(spark, [("a", "b", 1, "call"), ("b", "c", 1, "call"), ("a", "x", 1, "call"), ("x", "c", 1, "call"), ("c", "a", 1, "call"), ("c", "d", 1, "call")])
    seeds = vertices(spark, "a")
    assert {(r.id, r.hop) for r in graph.reach(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("x", 1), ("c", 2)}
    assert {(r.id, r.hop) for r in graph.reach(edges, vertices(spark, "d"), 9, reverse=True).collect()} == {("d", 0), ("c", 1), ("b", 2), ("x", 2), ("a", 3)}
    paths = {r.id: r.path for r in graph.shortest_paths(edges, seeds, 5).collect()}
    assert paths["d"] == ["a", "b", "c", "d"]
    got = {r.id: r.confidence for r in graph.impact(edges, vertices(spark, "c"), 2).collect()}
    assert got == {"b": "high", "x": "high", "a": "medium", "d": "medium"}


def test_clusters(spark):
    edges = edge_table(spark, [(a, b, 1, "import") for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.5, "call")])
    labels = {r.id: r.label for r in graph.label_propagation(vertices(spark, "abcxyzq"), edges, 6).collect()}
    assert len({labels[v] for v in "abc"}) == 1 and labels["q"] == "q"


def test_degrees_and_broken_edges(spark):
    edges = edge_table(spark, [("a", "b", 1, "call"), ("a", "b", 1, "call"), ("a", "a", 1, "call"), ("b", "gone", 1, "import")])
    assert graph.distinct_edges(edges).count() == 2
    assert [r.dst for r in graph.broken_edges(edges, vertices(spark, "ab")).collect()] == ["gone"]
    assert [r.id for r in graph.isolated(vertices(spark, "abq"), edges).collect()] == ["q"]
    got = {r.id: r for r in graph.degrees(edges, ["call"]).collect()}
    assert (got["a"].in_call, got["a"].out_call, got["b"].in_call) == (1, 3, 2)


def test_severity_counts_calls_from_other_files_only(spark):
    home = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3")], "id string, file string")
    edges = edge_table(spark, [("a", "b", 1, "call"), ("b", "a", 1, "call"), ("c", "c", 1, "call"), ("c", "b", 1, "import"), ("ghost", "a", 1, "call")])
    assert {r.file: r.severity for r in metrics.severity_index(edges, home).collect()} == {"f1": 1, "f2": 1}


def test_smallest_enclosing_span(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 500), ("f", "inner", 60, 70), ("f", "twin", 65, 75), ("g", "other", 1, 9)], "file string, span string, a int, b int")
    points = spark.createDataFrame([(1, "f", 66), (2, "f", 300), (3, "f", 501), (4, "g", 9)], "id int, file string, at int")
    got = {r.id: r.span for r in joins.enclosing(points, spans, "file", "at", "a", "b", 64, ["id"], [F.col("span")]).collect()}
    assert got == {1: "twin", 2: "outer", 4: "other"}


SYMBOLS = "id string, name string, kind string, file string, line int, visibility string"


def test_call_targets(spark):
    symbols = spark.createDataFrame([
        ("s1", "run", "function", "a.py", 1, "public"), ("s2", "run", "function", "b.py", 5, "public"), ("s3", "only", "function", "c.py", 1, "public"),
        ("s4", "save", "method", "a.py", 9, "public"), ("s5", "test", "json_key", "d.json", 1, "public"), ("s6", "pub", "function", "x.ts", 1, "exported"),
        ("s7", "pub", "function", "y.ts", 1, "public"),
    ], SYMBOLS)
    calls = spark.createDataFrame([
        ("c1", "a.py", 3, "run", "direct"), ("c2", "z.py", 3, "only", "direct"), ("c3", "a.py", 3, "save", "member"), ("c4", "z.py", 3, "save", "member"),
        ("c5", "a.py", 3, "test", "direct"), ("c6", "z.py", 3, "run", "direct"), ("c7", "q.py", 3, "run", "direct"), ("c8", "z.py", 1, "pub", "direct"),
    ], "call_id string, file string, line int, name string, call_kind string")
    imported = spark.createDataFrame([("q.py", "b.py")], "file string, target_file string")
    got = {r.call_id: r.target for r in joins.resolve_calls(calls, symbols, imported).collect()}
    assert got == {"c1": "s1", "c2": "s3", "c3": "s4", "c7": "s2", "c8": "s6"}


def test_import_targets(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "pkg/mod.py", "pkg/__init__.py", "lib/util.py", "lib/util.ts")], "path string")
    imports = spark.createDataFrame([("src/main.ts", "./a"), ("src/main.ts", "./b"), ("src/main.ts", "../../out"), ("x.py", "pkg.mod"), ("x.py", "pkg"), ("x.py", "util"), ("x.py", "absent")], "file string, module string")
    got = collections.defaultdict(set)
    for r in joins.resolve_imports(imports, files).collect():
        got[r.module].add(r.target_file)
    assert got == {"./a": {"src/a.ts"}, "./b": {"src/b/index.ts"}, "pkg.mod": {"pkg/mod.py"}, "pkg": {"pkg/__init__.py"}, "util": {"lib/util.py"}}


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "id string, file string, name string, kind string, line int, signature string")


def test_snapshot_diff_follows_line_drift(spark):
    old = snapshot(spark, [("a::f::10", "a", "f", "function", 10, "f()"), ("a::g::1", "a", "g", "function", 1, "g()"), ("a::h::2", "a", "h", "function", 2, "h()"), ("a::o::3", "a", "o", "function", 3, "o(x)"), ("a::o::4", "a", "o", "function", 4, "o(y)")])
    new = snapshot(spark, [("a::f::20", "a", "f", "function", 20, "f()"), ("a::g::1", "a", "g", "function", 1, "g(x)"), ("a::n::9", "a", "n", "function", 9, "n()"), ("a::o::5", "a", "o", "function", 5, "o(x)"), ("a::o::6", "a", "o", "function", 6, "o(y)")])
    got = {(r.id, r.new_id, r.change) for r in metrics.snapshot_diff(old, new, ["line", "signature"]).collect()}
    assert got == {("a::f::10", "a::f::20", "modified"), ("a::g::1", "a::g::1", "modified"), ("a::h::2", None, "removed"), (None, "a::n::9", "added"), ("a::o::3", "a::o::5", "modified"), ("a::o::4", "a::o::6", "modified")}
    assert metrics.snapshot_diff(old, old, ["line", "signature"]).count() == 0


def test_co_change(spark):
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "commit_id int, file string")
    pairs = metrics.co_change(commits)
    assert {(r.a, r.b, r.n) for r in pairs.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {(r.file, r.neighbor) for r in metrics.co_change_neighbors(pairs, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "a")}


def test_untested_keeps_what_no_test_reaches(spark):
    symbols = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("k", 0.002)], "id string, weight double")
    calls = spark.createDataFrame([("a", 2), ("b", 9), ("k", 50)], "id string, calls long")
    tested = spark.createDataFrame([("b",)], "id string")
    assert [(r.id, r.risk) for r in metrics.untested(symbols, calls, tested).collect()] == [("a", 10.0)]


def test_bm25_scores_vary_and_need_a_term(spark):
    docs = spark.createDataFrame([(i, ("ws_handler websocket " * (i % 3 == 0) + f"other words {i} " * (i + 1))) for i in range(20)], "id long, text string")
    scores = {r.id: r.score for r in search.bm25(docs, ["websocket", "absent"]).collect()}
    assert set(scores) == {i for i in range(20) if i % 3 == 0} and len({round(s, 6) for s in scores.values()}) >= 3
    assert search.bm25(docs, ["nothing"]).count() == 0


def test_route_matching(spark):
    routes = spark.createDataFrame([("/users/:id",), ("/users/me",)], "template string")
    uses = spark.createDataFrame([(1, "/users/me"), (2, "/users/7"), (3, "/users/{id}"), (4, "/none")], "use_id long, path string")
    got = {r.use_id: (r.template, r.confidence) for r in joins.match_routes(routes, uses).collect()}
    assert got == {1: ("/users/me", "high"), 2: ("/users/:id", "medium"), 3: ("/users/:id", "high")}


def test_pagerank_keeps_its_edges_once_and_packed(spark):
    import os

    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400), 1.0, "call") for _ in range(60_000)]
    edges = spark.createDataFrame(pairs, "src int, dst int, weight double, kind string")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in fs)
    graph.pagerank(vertices(spark, "ab"), edge_table(spark, []))
    before, tables = held(), len(spark.catalog.listTables())
    ids = spark.range(401).selectExpr("cast(id as int) id")
    got = {r["id"]: r["rank"] for r in graph.pagerank(ids, edges, iterations=3, tolerance=None).collect()}
    want = plain_pagerank(list(range(401)), [(a, b, w) for a, b, w, _ in pairs], 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert held() - before < 100_000 and len(spark.catalog.listTables()) == tables  # the last vertices alone are left
