"""Risk rules and state maps on small tables."""

from __future__ import annotations

from loomgraph.operators import risk, states


def files(spark, names):
    return spark.createDataFrame([(n,) for n in names], "file string")


def test_assess(spark):
    targets = [(1, "src/auth/token.py", 12, 0.0), (2, "auth_service.py", 0, 0.0), (3, "package.json", 5, 0.5), (4, "tests/types/x.py", 5, 0.0), (5, "src/types/x.ts", 4, 0.0), (5, "y.config.ts", 0, 0.02)]
    affected = [(2, "src/session/a.py"), (2, "x/session/b.py"), (3, "ci/run.py"), (5, "build/x.js")]
    rows = spark.createDataFrame(targets, "change_id int, file string, neighbors int, top_rank double")
    got = {r.change_id: (r.risk_score, r.risk) for r in risk.assess(rows, spark.createDataFrame(affected, "change_id int, file string")).collect()}
    # 5: types 1, config 2 with a high rank 1, the words config and build 1 each
    assert got == {1: (10, "high"), 2: (3, "medium"), 3: (7, "high"), 4: (3, "medium"), 5: (6, "high")}


def test_missing_checks(spark):
    changed, tests = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c, names in (("file", ["a.ts", "b.py", "c.go"]), ("test_file", ["b_test.py"])))
    assert [r.language for r in risk.missing_checks(changed, tests).collect()] == ["typescript"]
    assert risk.missing_checks(changed.limit(0), tests.limit(0)).count() == 0


def test_contract_risks(spark):
    symbols = spark.createDataFrame([("a", "x.py", "exported"), ("b", "x.py", "private"), ("c", "y.py", "public")], "id string, file string, visibility string")
    refs = spark.createDataFrame([("a", 20), ("b", 9), ("c", 50)], "id string, n long")
    routes = spark.createDataFrame([("x.py", "/")], "file string, path string")
    got = {tuple(r) for r in risk.contract_risks(symbols, refs, routes, files(spark, ["x.py", "go.mod"])).select("file", "rule", "risk").collect()}
    assert got == {("x.py", "references", "HIGH"), ("x.py", "route", "HIGH"), ("go.mod", "config", "MED"), ("*", "tests", "MED")}


def test_sessions_and_status(spark):
    got = {r.file: r.outcome for r in risk.compare_sessions(files(spark, "t"), files(spark, "ab"), files(spark, "tax")).collect()}
    assert got == {"a": "covered", "b": "missed", "x": "unexpected"}
    rows = [(1, 1, 0, 0, 0, 0, "failed"), (0, 0, 3, 0, 0, 0, "unchanged"), (0, 1, 0, 0, 0, 2, "warning"), (0, 1, 0, 0, 0, 0, "passed")]
    made = spark.createDataFrame(rows, "failed int, changed int, missing_checks int, breaking int, warnings int, missed int, want string")
    assert all(r.status == r.want for r in risk.verify_status(made).collect())


def test_missed_files(spark):
    home = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("c", "c.py")], "id string, file string")
    edges = spark.createDataFrame([("b", "a", "call"), ("c", "b", "call")], "src string, dst string, kind string")
    near = spark.createDataFrame([("a.py", "z.py", 1), ("a.py", "q.py", 4)], "file string, neighbor string, place long")
    assert {(r.file, r.reason) for r in risk.missed_files(edges, home, files(spark, ["a.py"]), near).collect()} == {("b.py", "caller"), ("z.py", "co-change")}


def test_states(spark):
    code = "class Status:\n    READY = 1\n    DONE = 'd'\n\ndef f(s):\n    s.state = Status.READY\n    if s.state == Status.DONE:\n        pass\n"
    symbols = spark.createDataFrame([("m::Status::1", "Status", "class", "m.py", 1, 3)], "id string, name string, kind string, file string, line int, end_line int")
    got = {(r.value, r.line, r.role) for r in states.python_states(symbols, spark.createDataFrame([("m.py", code)], "file string, content string")).collect()}
    assert got == {("READY", 2, "value"), ("DONE", 3, "value"), ("READY", 6, "writer"), ("DONE", 7, "reader")}


def test_ignore_rules(spark):
    from pyspark.sql import functions as F

    from loomgraph.sources.history import ignored

    rules = ["*.log", "/build", "node_modules/", "docs/**/tmp", "!keep.log", "# no rule"]
    want = {"a.log": True, "x/b.log": True, "keep.log": False, "build/x": True, "src/build/x": False, "a/node_modules/b.js": True, "docs/a/b/tmp": True, "src/main.py": False}
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.x for r in rows.select("p", ignored(F.col("p"), rules).alias("x")).collect()} == want


def test_history(spark, tmp_path):
    from loomgraph.sources import history

    for step in (["init", "-q"], ["config", "user.email", "a@example.org"], ["config", "user.name", "A"]):
        history.git(str(tmp_path), *step)
    for name in ("one.py", "two.py"):
        (tmp_path / name).write_text("x = 1\n")
    history.git(str(tmp_path), "add", ".")
    history.git(str(tmp_path), "commit", "-qm", "first")
    assert {r.file for r in history.commits(spark, str(tmp_path)).collect()} == {"one.py", "two.py"}
    lines = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ("?? b.py",)], "line string")
    assert {(r.status, r.file) for r in history.status_rows(lines).collect()} == {("M", "a.py"), ("R", "new.py"), ("??", "b.py")}
