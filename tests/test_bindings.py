"""Queries without oracle SQL against plain versions on small tables."""

from __future__ import annotations

import collections
import itertools

import pyarrow.parquet as pq

from loomgraph.operators import risk
from loomgraph.plans import bindings

SMALL = "/root/testdata/sf0.001"


def test_match_all_reads_whole_items(spark, tmp_path):
    texts = {1: "a b c d e f g", 2: "x x c d e f g y", 3: "b c d e f g", 4: "p q r", 5: "z a b c d e f g", 6: None, 7: "q r s t p q"}
    items = {10: "a b c d e f g", 11: "N o c d e f g", 12: "q R", 13: "no such", 14: "", 15: "p", 16: None, 17: "q r s t", 18: "a a a a a b c d e f"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    runs = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    want = {}
    for i, text in items.items():
        t = (text or "").lower().split()
        wanted = runs(t, min(5, len(t))) if t else set()
        found = [(-len(wanted & runs((d or "").split(), min(5, len(t)))), j) for j, d in texts.items()]
        if wanted and min(found)[0]:
            n, j = min(found)
            want[i] = (j, 2 if len(t) < 5 else int(-n < len(wanted)), -n)
    got = {r.item_id: (r.doc_id, r.stage, r.n_shared) for r in bindings.test_match(spark, str(tmp_path)).collect()}
    assert got == want and {s for _, s, _ in got.values()} == {0, 1, 2}


def test_every_event_begins_a_session(spark, tmp_path):
    events = [(i, i % 3, 1_700_000_000 + (i * 7919) % 90_000) for i in range(1, 121)]
    made = spark.createDataFrame(events, "event_id long, user_id long, t long")
    made.selectExpr("event_id", "user_id", "timestamp_seconds(t) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    spans = [(i, u, t, t + 60 * (3600 % (i % 97 + 30)) + 3600) for i, u, t in events]
    want = {i: min((b - a, -a, s) for s, v, a, b in spans if v == u and a <= t <= b)[2] for i, u, t in events}
    got = [tuple(r) for r in bindings.enclosing_interval(spark, str(tmp_path)).collect()]
    assert len(got) == len(events) and dict(got) == want


def test_module_bucket_has_every_document(spark, tmp_path):
    docs = [(1, "de", "web"), (2, "de", "web"), (3, "en", "mail"), (4, "en", "mail"), (5, None, "web"), (6, None, "web"), (8, "fr", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path, r.module) for r in bindings.module_bucket(spark, str(tmp_path)).collect()}
    assert got == {("web/1.de", "(root)"), ("web/2.de", "web"), ("mail/3.en", "(root)"), ("mail/4.en", "mail"), ("web/5", "(root)"), ("web/6", "web"), ("8.fr", "(root)")}


def test_risk_score_counts_each_word_of_the_rules(spark, tmp_path):
    texts = ["persistence and Schema", "auth token auth", "ci of the db", "api " + "x" * 200, "nothing", None]
    rows = [(1, k, t or "") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for _, k, text in rows:
        words = set((text or "").lower().split())
        n = 3 * len(words & set(risk.HIGH_WORDS)) + len(words & set(risk.MEDIUM_WORDS)) + 3 * (len(text or "") > 200)
        want[k] = (n, "high" if n >= 6 else "medium" if n >= 3 else "low")
    assert {r.turn: (r.score, r.risk) for r in bindings.risk_score(spark, str(tmp_path)).collect()} == want
    assert want[0] == (6, "high")


def test_missed_files_has_callers_and_co_change_neighbours(spark):
    lines = pq.read_table(f"{SMALL}/lineitem.parquet", columns=["l_orderkey", "l_suppkey"]).to_pylist()
    home = {r["s_suppkey"]: r["s_nationkey"] for r in pq.read_table(f"{SMALL}/supplier.parquet").to_pylist()}
    orders = collections.defaultdict(set)
    for r in lines:
        orders[r["l_orderkey"]].add(home[r["l_suppkey"]])
    pairs = collections.Counter(p for o in orders.values() for p in itertools.permutations(sorted(o), 2))
    got = {r.file: r.reason for r in bindings.missed_files(spark, SMALL).collect()}
    want = {b for changed in (3, 7) for _, b in sorted((-n, b) for (a, b), n in pairs.items() if a == changed)[:3]} - {3, 7}
    assert want <= set(got) and all(f in want for f, reason in got.items() if reason == "co-change")
