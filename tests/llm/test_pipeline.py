"""The pipeline's stages on a small fixture, each judged on its own input."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from loomgraph.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import PROSE, brute_components, brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    prose = PROSE.split()
    texts = [" ".join(prose[(k * (i + 1)) % 23] + (f"{i}" if k % 3 else "") for k in range(60)) for i in range(20)]
    texts += [texts[0], texts[1] + " ", texts[2] + " more", "too short", None, "", (PROSE + "\n") * 9, " ".join(["$$$ ###"] * 40)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert set(range(23)) <= kept and not kept & {23, 24, 25, 26, 27}

    table = [tuple(r) for r in docs.collect()]
    once = stages["exact dedup"](spark, docs, folder)
    _, groups, best = brute_groups(table)
    assert sorted(r.doc_id for r in once.collect()) == sorted(table[k][0] for k in best.values())
    assert once.columns == docs.columns

    apart = stages["n-gram Jaccard join"](spark, docs, folder)
    want = brute_components(table)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, c in want.items() if i == c)

    mixed = stages["mixing sources"](spark, once, folder)
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(counts.values()) <= 2

    packed = stages["packing"](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in table}


def test_whole_run_and_empty_input(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r.doc_id for r in got} <= set(range(23))
    none = str(tmp_path / "none")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_awkward_rows_and_any_columns(spark):
    prose = PROSE.split()
    texts = [" ".join(prose[(k * (i + 1)) % 23] + (f"{i}" if k % 3 else "") for k in range(60)) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0] + " "), (1, texts[5] + " tail"), (9, texts[5] + " tail two"), (10, None), (11, ""), (None, texts[2]), (None, texts[2])]
    names = ["_id", "_sha", "_n", "_crc", "_copies", "_copy", "row", "id", "sha", "crc", "copies", "own_id", "place", "length", "group_id"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["keep"] * len(names)) for i, t in rows], ["doc_id", "text", "lang", "source", "n_chars", *names])
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact dedup"](spark, docs, "")
    apart = stages["n-gram Jaccard join"](spark, docs, "")
    mixed = stages["mixing sources"](spark, docs, "")
    for got in (once, apart, mixed):
        assert got.columns == docs.columns
        assert got.select(*[f"`{n}`" for n in names]).distinct().collect() == [tuple(["keep"] * len(names))]
    assert sorted(str(r.text and r.text.strip()) for r in once.collect()) in (sorted([*texts, rows[8][1], rows[9][1], x]) for x in ("", "None"))
    stays = [(r.doc_id, r.text) for r in apart.collect()]
    assert len([s for s in stays if s[0] == 0]) == 1 and (1, texts[1]) in stays and (5, texts[5]) not in stays and (1, rows[8][1]) in stays
    assert (9, rows[9][1]) not in stays and (10, None) in stays and (11, "") in stays and stays.count((None, texts[2])) == 2
    none = docs.limit(0)
    assert all(stages[k](spark, none, "").count() == 0 for k in ("exact dedup", "n-gram Jaccard join", "mixing sources", "packing"))
