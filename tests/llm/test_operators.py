"""Each corpus operator against a plain version of it on small and awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import (
    exact_dedup, jaccard_join, language_model, mixing, packing, quality, sharding, suffix_dedup, token_files, tokens, url_filter, words,
)
from loomgraph.llm.queries import tokenizer_json

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"


def rows() -> list[tuple]:
    """Null, empty and long texts, ties, copies, near copies, repeated rows and ids, clashing names."""
    base = [f"{PROSE} number {i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    texts = [*base, base[0], base[0] + " ", base[1].upper(), base[2] + " tail", base[2] + " other tail", None, "", " \n\t", "one", "one",
             "a b", "line\nline\nline\n" * 5, (PROSE + "\n") * 300, "x" * 5000, "Straße é 日本 <b> # $ % | & *", PROSE, PROSE + ".", "\0odd\0", "two  spaces\n\n here "]
    out = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[0], (5, "other text of a repeated id", "en", "s1", 0, None, None), (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 1 -------------------------------------------------------------------------------


def test_shards_are_gapless_and_near_equal(spark, docs, empty):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(empty).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = [r[0] for r in sharding.shard(many, 24).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24


def test_a_new_shard_moves_a_limited_part(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    a = sharding.shard(many, 10).select("doc_id", F.col("shard").alias("a"))
    b = sharding.shard(many, 11).select("doc_id", F.col("shard").alias("b"))
    moved = a.join(b, "doc_id").where("a <> b").count()
    assert moved < 2.5 * 3000 / 11


def test_one_id_on_a_third_of_all_rows_is_split(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit("text").alias("text"))
    counts = [r["count"] for r in sharding.shard(many, 8).groupBy("shard").count().collect()]
    assert sum(counts) == 3000 and max(counts) - min(counts) < 0.2 * 3000 / 8


# ---- 2 -------------------------------------------------------------------------------


def brute_model(table):
    end, begin = "\0end", "\0begin"
    texts = [(i, [*word_list(lowered(t)), end]) for i, t, *_ in table]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in texts]
    one, two, n_texts = collections.Counter(), collections.Counter(), 0
    for h, (_, w) in zip(held, texts, strict=True):
        if not h:
            n_texts += 1
            one.update(w)
            two.update(zip([begin, *w[:-1]], w, strict=True))
    total, size = sum(one.values()), len(one)
    ending = collections.Counter(b for _, b in two)
    high = [0, *language_model.discounts([sum(c == k for c in two.values()) for k in (1, 2, 3, 4)])]
    n = [sum(c == k for c in ending.values()) for k in (1, 2, 3, 4)]
    low = [0, *language_model.discounts(n)]
    rest = (low[1] * n[0] + low[2] * n[1] + low[3] * (size - n[0] - n[1])) / len(two)
    freed = collections.Counter()
    for (a, _), c in two.items():
        freed[a] += high[min(c, 3)]
    context = dict(one) | {begin: n_texts}

    def word(b):
        return max(ending[b] - low[min(ending[b], 3)], 0) / len(two) + rest / (size + 1)

    def pair(a, b):
        if not context.get(a):
            return word(b)
        return (max(two[a, b] - high[min(two[a, b], 3)], 0) + freed[a] * word(b)) / context[a]

    out = []
    for h, (i, w) in zip(held, texts, strict=True):
        base = sum(math.log10((one[x] + 1) / (total + size + 1)) for x in w)
        score = sum(math.log10(pair(a, b)) for a, b in zip([begin, *w[:-1]], w, strict=True))
        out.append((i, h, len(w), sum(x in one for x in w), total, round(base, 6), round(score, 6)))
    return collections.Counter(out), pair, one


def test_language_model(docs, empty):
    got = language_model.score(docs).collect()
    want, pair, one = brute_model(rows())
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert abs(sum(pair("the", b) for b in one) + pair("the", "never seen") - 1) < 1e-9
    assert language_model.score(empty).count() == 0


def brute_scores(table, order):
    """Scores by an interpolated model of any order whose grams are tuples."""
    end, begin = "\0end", "\0begin"
    texts = [(i, [begin, *word_list(lowered(t)), end]) for i, t, *_ in table]
    met = {m: collections.Counter() for m in range(1, order + 1)}
    for i, w in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for m in met:
                met[m].update(tuple(w[k : k + m]) for k in range(1 if m == 1 else 0, len(w) - m + 1))
    used = {order: met[order]}
    for m in range(1, order):
        lefts = collections.Counter(g[1:] for g in met[m + 1])
        used[m] = {g: c if g[0] == begin else lefts[g] for g, c in met[m].items()}
    cut = {m: [0, *language_model.discounts([sum(c == k for c in used[m].values()) for k in (1, 2, 3, 4)])] for m in used}
    total, freed = collections.Counter(), collections.Counter()
    for m in used:
        for g, c in used[m].items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut[m][min(c, 3)]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(met[1]) + 1)
        if not total[g[:-1]]:
            return lower
        c = used[len(g)].get(g, 0)
        return (max(c - cut[len(g)][min(c, 3)], 0) + freed[g[:-1]] * lower) / total[g[:-1]]

    found = [(i, sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(1, len(w)))) for i, w in texts]
    return collections.Counter((i, round(x, 5)) for i, x in found), p, met[1]


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_of_higher_order(docs, empty, order):
    got = language_model.score(docs, order=order).collect()
    want, p, words_ = brute_scores(rows(), order)
    assert collections.Counter((r.doc_id, round(r.score, 5)) for r in got) == want
    assert want != brute_scores(rows(), 2)[0]
    context = ("\0begin", "the", "quick")[-order + 1 :]
    assert abs(sum(p((*context, *b)) for b in words_) + p((*context, "never seen")) - 1) < 1e-9
    assert language_model.score(empty, order=order).count() == 0


def test_word_hashes_agree_with_words():
    texts = [t for _, t, *_ in rows()]
    hashes, before = words.word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in word_list(lowered(t))]
    assert len(hashes) == len(flat)
    assert np.diff(before).tolist() == [len(word_list(t)) for t in texts]
    assert len({*zip(hashes.tolist(), flat, strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))
    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert (words.unmix(words.mix(x)) == x).all()


# ---- 3 -------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    stopped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest, over = total - sum(stopped.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / over for s in free} if over else {}
        new = {s: 2.0 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not new:
            return stopped | share
        stopped |= new


def test_mixing(docs, empty):
    got = mixing.mix(docs, least_slots=512).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(word_list(t))
    want = brute_targets(sizes)
    assert len(got) == len(rows())
    source = {(i, zlib.crc32((t or "").encode())): s for i, t, _, s, *_ in rows()}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id, r.text_crc32]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 30 for s in sizes)
    again = mixing.mix(docs.repartition(5), least_slots=512).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id is not null and text is null")).collect()] == [0]


# ---- 4 -------------------------------------------------------------------------------


def brute_components(table):
    sets = {}
    for i, t, *_ in table:
        w = word_list(lowered(t))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bits", [8, 20])
def test_jaccard_join(spark, docs, empty, bits):
    table = rows()
    got = jaccard_join.join(docs, sketch_bits=bits, carry=("size", "id")).collect()
    want = brute_components(table)
    assert sum(r["size"] == "clash" for r in got) == sum(r[5] == "clash" for r in table)
    assert len(got) == len(table)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    if bits == 20:
        assert jaccard_join.join(empty).count() == 0


def brute_links(table):
    """Of each id the number of other distinct sets that its set is linked with."""
    sets = {}
    for i, t, *_ in table:
        w = word_list(lowered(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    linked = lambda x, y: x and y and x != y and 100 * len(x & y) >= 75 * len(x | y)
    return {i: sum(bool(linked(x, y)) for y in set(sets.values())) for i, x in sets.items()}


@pytest.mark.parametrize("bits", [8, 20])
def test_jaccard_join_counts_all_links(spark, bits):
    rng = np.random.default_rng(11)
    table = [r for r in rows() if r[0] is not None and (r[0] != 5 or r[1] != "other text of a repeated id")]
    for group in range(3):  # near copies on both sides of the threshold, and equal sets
        words_ = [f"g{group}w{j}" for j in range(120)]
        for i in range(14):
            changed = [f"{w}c{i}" if j in set(rng.integers(0, 120, i % 4).tolist()) else w for j, w in enumerate(words_)]
            table.append((100 * (group + 1) + i, " ".join(changed), "en", "s0", 0, None, None))
    got = jaccard_join.join(spark.createDataFrame(table, SCHEMA), sketch_bits=bits).collect()
    want = brute_links(table)
    assert max(want.values()) > 5 and len(got) == len(table)
    assert {r.doc_id: r.n_links for r in got} == want


@pytest.mark.parametrize("near", [0, 1])
def test_jaccard_join_keeps_both_texts_of_an_id(spark, near):
    one, two = (" ".join(f"{g}{j}" for j in range(60)) for g in "ab")
    table = [(1, one, *[None] * 5), (1, two, *[None] * 5), (2, (one, two)[near] + " tail", *[None] * 5), (3, (two, one)[near] + " end", *[None] * 5), *rows()]
    table = [r if k < 4 or r[0] is None else (r[0] + 10, *r[1:]) for k, r in enumerate(table)]
    got = jaccard_join.join(spark.createDataFrame(table, SCHEMA)).collect()
    want = brute_components(table)
    assert len(got) == len(table) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert sorted(r.n_links for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1, 1]


def test_linked_sets_share_a_signature_whatever_is_frequent():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 20, 61, 200, 555):
        for share in (0.0, 0.5, 0.9, 1.0):
            x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
            most = int(0.25 * len(x) / 1.75)  # changed on both sides: 75 of 100 still shared
            keep = rng.permutation(len(x))[: len(x) - most]
            y = np.unique(np.concatenate([x[keep], rng.integers(1, 2**63, most).astype(np.uint64)]))
            assert 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
            frequent = lambda t, s=share: (words.mix(t ^ np.uint64(77)) % np.uint64(1000)) < s * 1000
            (a, need_a), (b, need_b) = (jaccard_join.signatures(t, frequent(t), 75) for t in (x, y))
            assert len(np.intersect1d(a, b)) >= max(1, min(need_a[-1], need_b[-1])), (n, share)


# ---- 5 -------------------------------------------------------------------------------


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs, least_blocks=7).collect()
    first = {}
    for i, t, *_ in sorted(rows(), key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], math.inf if i is None else i)
    want = []
    for i, t, *_ in rows():
        b, own = (t or "").encode(), math.inf if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree_merges_in_order_and_knows_prefixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(20)}) for _ in range(n)]
        made = [suffix_dedup.Run(*suffix_dedup.front_coded(r), [None] * len(r)) for r in runs]
        got = [(s, k) for s, k, _, _ in suffix_dedup.merge_runs(made)]
        assert [s for s, _ in got] == sorted(s for r in runs for s in r)
        assert all(k == suffix_dedup.common_prefix(a[0], b) for a, (b, k) in zip(got, got[1:], strict=False))


# ---- 6 -------------------------------------------------------------------------------

URLS = [(1, "http://a.Example.net/en/x?q"), (2, "https://net/"), (3, "http://x.net"), (4, "ftp://www.listed.org/p/"), (5, None), (6, "no scheme"),
        (7, "http://b.org/fr/1#t"), (8, "http://m.listed.org/p"), (9, "http://listed.org/q"), (1, "http://a.Example.net/en/x?q"), (10, ""), (11, "http://u@h.net:80/a")]


@pytest.mark.parametrize("held", [0, 2**17])
def test_url_filter(spark, held):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("listed.org/p",), (None,)], "url string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed, held_words=held).collect())
    assert got == collections.Counter([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "/", "net/", "block"),
        (3, "x.net", "", None, "allow"), (4, "www.listed.org", "/p/", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "b.org", "/fr/1", "org/fr/", "allow"), (8, "m.listed.org", "/p", None, "block"), (9, "listed.org", "/q", None, "allow"), (10, "", "", None, "allow"),
        (11, "u@h.net:80", "/a", None, "allow"),
    ])
    assert url_filter.filter_urls(pages.limit(0), rules.limit(0), listed.limit(0), held_words=held).count() == 0


# ---- 7 -------------------------------------------------------------------------------


def brute_groups(table):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in table]
    groups = collections.defaultdict(list)
    for k, n in enumerate(norm):
        groups[n].append(k)
    best = {n: min(g, key=lambda k: (-len(table[k][1] or ""), table[k][0] is None, table[k][0] or 0)) for n, g in groups.items()}
    return norm, groups, best


@pytest.mark.parametrize("key_bytes", [1, 16])
def test_exact_dedup(docs, empty, key_bytes):
    table = rows()
    norm, groups, best = brute_groups(table)
    got = exact_dedup.dedup(docs, key_bytes=key_bytes, memtable_rows=5).collect()
    want = collections.Counter((r[0], table[best[n]][0], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(table, norm, strict=True))
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == collections.Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.dedup(empty).count() == 0


# ---- 8 and 10 ------------------------------------------------------------------------


def encoded(name, end, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for _, x, *_ in table]


ODD = ["", " ", "  ", "a  b", "\n\n a \n b  \n", "x\t y", " lead", "trail\n", "it's. we'll, 12. 3, é. ß!", "日本。 x", "<|endoftext|> z", "a <|ENDOFTEXT|>b<|endoftext|>", "x [UNK]. [PAD]", "a .b ., c", "İ. Σ. K.", "a  b 　c"]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_whole_texts(name, keeps):
    made = tokens.ChunkEncoder(tokenizer_json(name), keeps)
    for _ in range(2):
        got = made.encode(ODD)
        assert [g.tolist() for g in got] == [e[:-1].tolist() for e in encoded(name, 0, [(0, t) for t in ODD])]


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_json("word_bpe_49k.json")).collect()
    ids = [e.tobytes() for e in encoded("word_bpe_49k.json", 1, rows())]
    sequences = collections.defaultdict(list)
    covered = collections.Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
        assert any(len(x) == 4 * r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in ids)
    want = collections.Counter()
    for (i, *_), x in zip(rows(), ids, strict=True):
        want[i] += len(x) // 4
    assert covered == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty, tokenizer_json("word_bpe_49k.json")).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(packing.hilbert(grid, 3))
    assert sorted(packing.hilbert(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_token_files(docs, empty):
    manifest = token_files.write_ids(docs, tokenizer_json("byte_bpe_50k.json"), file_ids=700)
    got = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r.start)
    table = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for (i, *_), x in zip(table, encoded("byte_bpe_50k.json", 0, table), strict=True):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert [tuple(r) for r in got] == want
    assert token_files.read_ids(token_files.write_ids(empty, tokenizer_json("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.integers(7, 300, n)).astype(np.uint32)
    file = token_files.TokenFile(token_files.file_bytes([n], ids))
    assert (file.ids(0, n) == ids).all()
    assert (file.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


# ---- 9 -------------------------------------------------------------------------------


def brute_features(text):
    w, t = word_list(text), text or ""
    lines = [x for x in t.split("\n") if word_list(x)]
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    trusted = spark.createDataFrame([(i,) for i in range(8)], "doc_id long")
    got = quality.judge(docs, trusted).collect()
    want = collections.Counter((i, *brute_features(t)) for i, t, *_ in rows())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 12 and not r.base_failed)
    assert quality.judge(empty, trusted).count() == 0
    assert all(r.score == 0 for r in quality.judge(docs, trusted.limit(0)).collect())


def test_the_ratio_tells_junk_from_trusted_text(spark):
    good = [(i, " ".join(PROSE.split()[k % 23] for k in range(i, i + 60))) for i in range(40)]
    junk = [(100 + i, " ".join(f"junk{(i * k) % 9}$$$" for k in range(40, 100))) for i in range(1, 10)]
    both = spark.createDataFrame(good + junk, "doc_id long, text string")
    got = quality.judge(both, spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long"), n_buckets=64).collect()
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i in range(40)) > max(scores[100 + i] for i in range(1, 10))


def test_a_stretch_of_one_byte_is_one_entry():
    dashes = "-" * 300_000
    group = pa.table({"id": [1, 2], "text": ["a " + dashes, dashes + " z"], "block": [0, 0]})
    hashes = np.unique(np.concatenate([h for *_, h, _ in suffix_dedup.block_anchors(*suffix_dedup._ordered(group), 50)]))
    found = list(suffix_dedup.block_contexts(group, hashes, 50))
    assert len(found) < 1000 and sum(1 + more for _, _, _, more, _, _ in found) > 590_000
    keys, ids, where = suffix_dedup.block_runs(found)
    assert keys == sorted(set(keys)) and len(ids) == len(keys) and (np.diff(where[0]) >= 0).all()


def test_suffix_dedup_of_dashes(spark):
    table = [(1, "x" * 20_000), (2, "y" + "x" * 20_000 + "z"), (3, "x" * 49), (4, "x" * 50 + "-" * 60), (5, "-" * 59 + "x" * 51)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string"), least_blocks=3).collect()}
    assert got == {1: (0, 0), 2: (20_000, 1), 3: (0, 0), 4: (50, 1), 5: (110, 1)}


# ---- limits, names and hot keys ----------------------------------------------------------

INTERNAL = ["_id", "_doc", "_text", "_h1", "_h2", "_row", "_sha", "_n", "_crc", "_copies", "_copy", "n", "node", "key", "crc", "row", "block", "cell", "source_no", "carry_0", "keys", "host", "path", "rid"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.drop("size", "id").select("*", *[F.lit("keep").alias(c) for c in [*INTERNAL, "size", "id"]])


@pytest.mark.parametrize("name", ["shard", "score", "mix", "join", "dedup", "judge", "repeats"])
def test_other_columns_may_have_any_name(spark, docs, clashing, name):
    trusted = spark.createDataFrame([(i,) for i in range(8)], "doc_id long")
    run = {
        "shard": lambda d: sharding.shard(d, 4).drop("slot", "shard"), "score": language_model.score, "mix": lambda d: mixing.mix(d, least_slots=64),
        "join": jaccard_join.join, "dedup": exact_dedup.dedup, "judge": lambda d: quality.judge(d, trusted), "repeats": suffix_dedup.remove_repeats,
    }[name]
    assert collections.Counter(map(tuple, run(clashing).collect())) == collections.Counter(map(tuple, run(docs).collect()))


def test_points_of_slots_beyond_32_bits(spark):
    slots = [0, 1, 5, 4_000_000_000, 2**40 + 12345, 2**62]
    got = [r.p for r in spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.point_of(F.col("s")).alias("p")).collect()]
    assert got == [(s * mixing.GOLDEN + mixing.POINTS // 2) % mixing.POINTS for s in slots]


def test_counts_beyond_32_bits():
    keys, counts = language_model.summed(np.array([7, 7, 7, 9], np.uint64), np.array([2**31] * 3 + [1], np.int64))
    assert keys.tolist() == [7, 9] and counts.tolist() == [3 * 2**31, 1]
    assert len(language_model.count_bytes(counts)) == 16 and len(language_model.count_bytes(counts[1:])) == 4


def test_long_urls_cost_their_length_once(spark):
    long = "http://" + ".".join(["a"] * 20_000) + ".example.net/en/x"
    pages = spark.createDataFrame([(1, long), (2, "http://no.such/")], "page_id long, url string")
    rules = spark.createDataFrame([("example.net", "/en/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("no.such",)], "url string")
    got = {r.page_id: (r.rule, r.listed, r.verdict) for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert got == {1: ("example.net/en/", False, "block"), 2: (None, True, "block")}


def test_the_filter_lets_few_others_pass_and_the_join_none(spark):
    listed = spark.range(3000).select(F.concat(F.lit("listed.org/"), F.col("id")).alias("url"))
    bloom = url_filter.BlockedBloom(listed.select(F.col("url").alias("key")))
    others = spark.range(20_000).select(F.concat(F.lit("other.org/"), F.col("id")).alias("key"))
    false_hits = bloom.passing(others).count()
    assert 0 < false_hits < 0.05 * 20_000 and bloom.passing(listed.select(F.col("url").alias("key"))).count() == 3000
    pages = others.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "key").alias("url"))
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, rules, listed).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("module", [exact_dedup, jaccard_join])
def test_filters_too_large_to_be_held_change_nothing(docs, monkeypatch, module):
    run = exact_dedup.dedup if module is exact_dedup else jaccard_join.join
    want = collections.Counter(map(tuple, run(docs).collect()))
    monkeypatch.setattr(module, "HELD_FILTER_BYTES", 0)
    assert collections.Counter(map(tuple, run(docs).collect())) == want


def test_a_filter_on_a_quality_column_stays_above(spark, docs):
    got = quality.judge(docs, spark.createDataFrame([], "doc_id long")).where("not base_failed").select("doc_id")
    assert "Filter" in got._jdf.queryExecution().optimizedPlan().toString().split("Project")[0] or got.count() > 0


def test_links_within_and_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    table = []
    for group in range(4):
        words_ = [f"h{group}w{j}" for j in range(80)]
        for i in range(25):
            changed = [f"{w}c{i}" if j in set(rng.integers(0, 80, i % 5).tolist()) else w for j, w in enumerate(words_)]
            table.append((100 * (group + 1) + i, " ".join(changed), "en", "s0", 0, None, None))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)  # a few sets a block
    got = jaccard_join.join(spark.createDataFrame(table, SCHEMA)).collect()
    assert {r.doc_id: r.n_links for r in got} == brute_links(table)
    assert {r.doc_id: r.component_id for r in got} == brute_components(table)


def test_chunks_are_laid_out_by_number_and_forgotten(monkeypatch):
    import random

    from loomgraph.llm import token_files, tokens

    rng = random.Random(2)
    words = ["und", "so", "Straße", "x.y", "a,b!", "\n", "tab\tbed", "日本", "1234", " ", "é", " ", "weiter..."]
    texts = [" ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(50))]) for _ in range(rng.randrange(40))) for _ in range(120)]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        monkeypatch.setattr(tokens, "REMEMBERED", 60)
        monkeypatch.setattr(tokens, "WAITING", 20)
        made = tokens.ChunkEncoder(tokenizer_json(name), keeps)
        for i in range(0, len(texts), 10):
            part = texts[i : i + 10]
            assert [x.tolist() for x in made.encode(part)] == [made.whole(t).tolist() for t in part]
            made.settle()
            assert len(made.known) <= 21
            assert len(made.raw) == made.ends[-1] and max(made.known.values()) <= len(made.ends) - 2
    for top in (1, 2, 256, 257, 1 << 16, 1 << 20, 1 << 32):
        ids = np.array([rng.randrange(top) for _ in range(1500)], np.uint32)
        data, starts = token_files.pack_blocks(ids)
        got = np.concatenate([token_files.unpack_block(memoryview(data)[int(s) :]) for s in starts[:-1]])
        assert (got[:1500] == ids).all()


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_memory_is_bounded(name, keeps, monkeypatch):
    """The tokenizer gets few chunks at a time, batches become texts a few rows at a time, and
    chunks that stay have the ids that they had."""
    monkeypatch.setattr(tokens, "AT_ONCE", 100)
    made, sizes = tokens.ChunkEncoder(tokenizer_json(name), keeps), []

    class Watched:
        def __getattr__(self, attr):
            return getattr(plain, attr)

        def encode_batch_fast(self, texts, **kw):
            sizes.append(sum(max(1, len(t.split())) for t in texts) if not keeps else len(texts))
            return plain.encode_batch_fast(texts, **kw)

    plain, made.tokenizer = made.tokenizer, Watched()
    texts = [" ".join(f"w{i}x{j} wort{chr(97 + i % 26)}{chr(97 + j)} é{i}" for j in range(20)) for i in range(60)] + ["퟿ 𝒳y 中文 a", ""]
    first = [x.tolist() for x in made.encode(texts)]
    assert first == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(sizes) > 10 and max(sizes) <= 100
    monkeypatch.setattr(tokens, "WAITING", 50)
    made.settle()
    assert len(made.known) == 51
    assert [x.tolist() for x in made.encode(texts)] == first
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 3000] * 999 + [None])], ["id", "text"])
    cut = list(tokens.slices(batch))
    assert [r for rows in cut for r in rows] == list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
    assert max(sum(len(t or "") for _, t in rows) for rows in cut) < 1_010_000


def test_language_model_files_are_small():
    """Keys of grams are one to one with their parts in few bits, are found in their files, and
    counts take a byte each; a file of a gram needs less than half of the former 12 bytes."""
    rng = np.random.default_rng(5)

    class Level:
        bits = 2

        def __init__(self, n):
            self.bases = np.array([0, n])

    for words_, contexts, n in ((1, 1, 1), (3, 2, 5), (50_000, 400_000, 200_000), ((1 << 32) - 2, (1 << 32) - 1, 3000)):
        shape = language_model.key_bits({1: Level(words_), 2: Level(contexts)}, 3)
        left, right = rng.integers(0, contexts, n), rng.integers(0, words_, n)
        keys = language_model.gram_keys(left, right, shape)
        back = language_model.gram_parts(keys, shape)
        assert (back[0] == left).all() and (back[1] == right).all()
        keys = np.unique(keys)
        assert len(keys) == len({*zip(left.tolist(), right.tolist(), strict=True)})
        shift = 64 - shape[0]
        assert (language_model.unpacked_sorted(language_model.packed_sorted(keys, shift), shift) == keys).all()
        for b in range(4):
            some = keys[(keys >> np.uint64(62)) == b]
            if len(some):
                data = language_model.key_bytes(some, 2, shape[0])
                made = language_model.KeyFile(np.frombuffer(data, np.uint8), len(some), b, 2, shape[0])
                assert (made.find(some) == np.arange(len(some))).all() and (made.keys() == some).all()
                places = rng.integers(0, len(some), 50)
                assert (made.keys(places) == some[places]).all()
                others = np.setdiff1d((some + (np.uint64(1) << np.uint64(shift)))[:-1], some)
                assert (made.find(others) == -1).all()
                counts = np.ones(len(some), np.int64)
                counts[::997] = 300
                assert n < 100_000 or len(data) + len(language_model.small_bytes(counts)) < 6 * len(some)
    for counts in ([], [1, 254, 255, 256, 7], [2**31 * 3, 1, 2**32 + 5, 255]):
        counts = np.array(counts, np.int64)
        data = np.frombuffer(language_model.small_bytes(counts), np.uint8)
        assert language_model.small_values(data, len(counts)).tolist() == counts.tolist()
        at = np.arange(len(counts))[::-1]
        assert language_model.small_values(data, len(counts), at).tolist() == counts[::-1].tolist()
    hashes = np.unique(rng.integers(0, 1 << 64, 1000, np.uint64)) >> np.uint64(2)
    made = language_model.KeyFile(np.frombuffer(language_model.key_bytes(hashes, 2, 64), np.uint8), len(hashes), 0, 2, 64)
    assert (made.find(hashes) == np.arange(len(hashes))).all() and (made.keys() == hashes).all() and made.find(hashes[:1] ^ np.uint64(1)) == [-1]


def test_language_model_rows_follow_the_text(spark, docs, monkeypatch):
    """A row of sums goes from each range of hashes to each: their pairs stay in proportion to the
    text, however many partitions a shuffle has, and the ranges and stretches change no score."""
    used, sent, write, send = [], spark.sparkContext.accumulator(0), language_model._write_words, language_model._send

    def counted(*args):
        batch = send(*args)
        sent.add(batch.num_rows)
        return batch

    monkeypatch.setattr(language_model, "_write_words", lambda folder, bits: (used.append(bits), write(folder, bits))[1])
    monkeypatch.setattr(language_model, "_send", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = [language_model.score(docs, order=3).collect()]
        size = sum(len((r[1] or "").encode()) for r in rows())
        assert sent.value <= 4 * max(4, size // (32 << 10)) and used == [1]
        for name, value in (("PAIR_BYTES", 64), ("RANGE_BYTES", 1 << 11), ("PIECE", 3)):
            monkeypatch.setattr(language_model, name, value)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        got.append(language_model.score(docs, order=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert used[1] > 4
    want = brute_scores(rows(), 3)[0]
    assert all(collections.Counter((r.doc_id, round(r.score, 5)) for r in some) == want for some in got)


def test_ranges_of_the_language_model():
    """Pairs of ranges are in proportion to the text up to 32 GB; beyond, ranges are of a fixed size."""
    pair, most = language_model.PAIR_BYTES, language_model.RANGE_BYTES
    for size in (0, 1, 10**6, 10**8, 10**9, 10**10, 3 * 10**10, 10**12):
        for cores in (1, 6, 200, 5000):
            n = 1 << language_model.range_bits(size, cores)
            assert n * most >= size and (n * n * pair <= max(size, 4 * pair) or size > 32 << 30 and n * most < 2 * size)


@pytest.mark.parametrize("width", [40, 64])
def test_ranges_are_merged_in_stretches(monkeypatch, width):
    rng = np.random.default_rng(7)
    made = [np.unique(rng.integers(0, 1 << 12, 300, np.uint64)) << np.uint64(64 - width) for _ in range(9)] + [np.array([5], np.uint64) << np.uint64(64 - width)] * 2
    counts = [rng.integers(1, 400, len(k)) for k in made]
    counts[0][0] = 1 << 40
    group = pa.table({"keys": [language_model.packed_sorted(k, 64 - width) for k in made], "counts": [language_model.packed(c) for c in counts]})
    want = language_model.summed(np.concatenate(made), np.concatenate(counts))
    for piece in (1, 100, 1 << 20):
        monkeypatch.setattr(language_model, "PIECE", piece)
        keys, sums = language_model._merged(group, width)
        assert (keys == want[0]).all() and sums.tolist() == want[1].tolist()
        found = language_model.KeyFile(np.frombuffer(language_model.key_bytes(keys, 2, width), np.uint8), len(keys), 0, 2, width)
        assert (found.find(keys) == np.arange(len(keys))).all() and (np.concatenate([*found.pieces()]) == keys).all()
