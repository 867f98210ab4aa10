"""N-gram Jaccard join by token-combination prefixes, and the components of its links."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.exact_dedup import FILTER_BITS, HELD_FILTER_BYTES, filter_of, may_hold
from loomgraph.llm.language_model import packed, unpacked
from loomgraph.llm.shared import gone, let_go, stored
from loomgraph.llm.words import mix, word_hashes

#: Cells of the frequency sketch: 2**SKETCH_BITS counters of four bytes.
SKETCH_BITS, SKETCH_PARTS = 24, 64
#: Sets that a task remembers, to leave out copies of them.
REMEMBERED = 1 << 20
#: Shingles for each range of signatures, at most: a task merges one range.
RANGE_SHINGLES = 8_000_000
_STEPS_APART = np.arange(1, 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one shingle, all its words; without words the set is empty.
    """
    hashes, before = word_hashes(column)
    out = []
    scaled = [mix(hashes + _STEPS_APART[k]) for k in range(width)]
    for low, high in zip(before[:-1], before[1:], strict=True):
        n = high - low
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(n, width)
        made = scaled[0][low : high - size + 1].copy()
        for k in range(1, size):
            made += scaled[k][low + k : high - size + 1 + k]
        out.append(np.unique(mix(made ^ np.uint64(size))))
    return out


def _groups(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def node_of(tokens: np.ndarray) -> int:
    """The node of a set: 64 bits of its digest. Equal sets are one node, whatever their ids."""
    return int.from_bytes(hashlib.sha256(tokens.tobytes()).digest()[:8], "little", signed=True)


def _new_sets(batches, width: int):
    """The nodes and sets of texts, most copies left out: those of sets that the task remembers."""
    seen: set[int] = set()
    for batch in batches:
        for part in _groups(batch):
            out = []
            for tokens in shingle_sets(part.column(0), width):
                if len(tokens) and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    out.append((node, tokens))
            yield out
            if len(seen) > REMEMBERED:
                seen.clear()


#: Bits of the shingle hashes in a short set.
SHORT_BITS = 24


def short_set(tokens: np.ndarray) -> bytes:
    """The distinct first bits of the shingles of a set, as differences: a fourth of its size."""
    heads = (tokens >> np.uint64(64 - SHORT_BITS)).astype(np.uint32)
    heads = heads[np.concatenate([[True], heads[1:] != heads[:-1]])]
    return packed(np.diff(heads, prepend=np.uint32(0)))


def _survey(width: int, bits: int, parts: int, kind: pa.Schema):
    """A map of (text, id, ...) to (number of shingles, node of the set, its short set, id, ...)
    and, in rows of their own, to counts of shingles by cell, for ``parts`` stretches of cells.

    Copies of sets that the task remembers have no short set and are not counted.
    """

    def run(batches):
        let_go("encoders")
        waiting: list[np.ndarray] = []
        seen: set[int] = set()
        each = (1 << bits) // parts

        def count():
            cells, n = np.unique((np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            waiting.clear()
            cuts = np.searchsorted(cells, np.arange(parts + 1) * each)
            some = [slice(cuts[k], cuts[k + 1]) for k in range(parts)]
            told = {"part": pa.array(range(parts), pa.int32()), "counts": pa.array([packed_counts(cells[x] - np.uint32(k * each), n[x]) for k, x in enumerate(some)], pa.binary())}
            return pa.RecordBatch.from_arrays([told[f.name] if f.name in told else pa.nulls(parts, f.type) for f in kind], schema=kind)

        for batch in batches:
            for part in _groups(batch):
                sets = shingle_sets(part.column(0), width)
                nodes, shorts = [], []
                for tokens in sets:
                    node = node_of(tokens)
                    new = len(tokens) > 0 and node not in seen
                    if new:
                        seen.add(node)
                        waiting.append(tokens)
                    nodes.append(node)
                    shorts.append(short_set(tokens) if new else None)
                made = [pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(shorts, pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([*made, *[c.cast(f.type) for c, f in zip(part.columns[1:], list(kind)[5:], strict=True)]], schema=kind)
                if sum(map(len, waiting)) > 1 << 20:
                    yield count()
                if len(seen) > REMEMBERED:
                    seen.clear()
        if waiting:
            yield count()

    return run


def packed_counts(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells as differences, and their counts."""
    made = packed(np.diff(cells, prepend=np.uint32(0)).astype(np.uint32))
    return len(made).to_bytes(8, "little") + made + packed(counts.astype(np.uint32))


def _add_sketches(size: int):
    """Adds the counts of a stretch of ``size`` cells."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint32)
        for data in group["counts"].to_pylist():
            cut = 8 + int.from_bytes(data[:8], "little")
            total[np.cumsum(unpacked(data[8:cut], np.uint32), dtype=np.uint32)] += unpacked(data[cut:], np.uint32)
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    return run


def allowed_losses(n: int, percent: int) -> int:
    """How many of its ``n`` shingles a set may miss in a partner of at least ``percent``."""
    return n - -(-percent * n // 100)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set: two linked sets have one in common.

    Rare tokens come first, in order of hash, and frequent ones after them. A set that
    may lose e tokens and has e + 1 rare ones is indexed by these one by one. Else all
    its rare tokens count, and frequent ones extend the prefix: they fall into classes
    by hash, and of each class the prefix indexes pairs of tokens. Losing all pairs of a
    class takes all its tokens but one, so the prefix is extended until rare tokens plus,
    for each class, tokens less one make e + 1. The number of classes follows the size of
    the set, by steps of 4/3 so that linked sets are in the same step or the next one;
    each set is indexed for its own and the next step.

    Also gives how many of its signatures a set shares at least with a partner in which it
    misses 4, 5, 6 or 7 sevenths of what it may lose (see ``least_shared``).
    """
    losses = allowed_losses(len(tokens), percent)
    rare = tokens[~frequent]
    if len(rare) > losses:
        return rare[: losses + 1], least_shared(np.ones(losses + 1, np.int64), losses)
    common = tokens[frequent]
    out, needs = [rare], []
    step = int(np.floor(np.log(len(tokens)) / np.log(100 / percent)))
    for at in (step, step + 1):
        classes = max(1, int((100 / percent) ** at / 8))
        salted = mix(common ^ np.uint64(at + 1))
        kind = (salted % np.uint64(classes)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        new = np.zeros(len(common), bool)
        new[order[np.concatenate([[True], np.diff(kind[order]) > 0])]] = True  # first of its class
        gains = len(rare) + np.cumsum(~new)
        reach = int(np.searchsorted(gains, losses + 1)) + 1
        if gains[-1] < losses + 1:  # too few per class: single tokens, marked by the step
            some = common[: losses + 1 - len(rare)]
            out.append(mix(some ^ np.uint64(at << 8)))
            needs.append(least_shared(np.ones(len(rare) + len(some), np.int64), losses))
            continue
        prefix, kinds = salted[:reach], kind[:reach]
        order = np.argsort(kinds, kind="stable")
        prefix, kinds = prefix[order], kinds[order]
        for apart in range(1, reach):  # pairs of places in a class, by distance
            same = kinds[apart:] == kinds[:-apart]
            if not same.any():
                break
            out.append(mix(prefix[:-apart][same] + mix(prefix[apart:][same])))
        sizes = np.unique(kinds, return_counts=True)[1]
        # losing tokens of a class of m one by one takes m - 1, m - 2, ... pairs
        takes = np.concatenate([np.ones(len(rare), np.int64), *[np.arange(m - 1, -1, -1) for m in sizes]])
        needs.append(least_shared(takes, losses))
    return np.unique(np.concatenate(out)), np.minimum(*needs)


#: Parts, in sevenths, of the losses of a set for which the signatures left are told.
STEPS = (4, 5, 6, 7)


def least_shared(takes: np.ndarray, losses: int) -> np.ndarray:
    """How many signatures at least are left when a set loses the given parts of its losses;
    ``takes`` has what each token, lost in the worst order, takes along."""
    taken = np.cumsum(np.sort(takes)[::-1])
    lost = np.array([-(-losses * k // STEPS[-1]) for k in STEPS])
    return takes.sum() - np.where(lost > 0, taken[np.minimum(lost, len(taken)) - 1], 0)


def _frequent_cells(cells: np.ndarray) -> np.ndarray:
    """Cells well above the mean: some shingle in them is in many texts."""
    return cells > cells.mean() + 6 * np.sqrt(cells.mean()) + 16


def _index(width: int, bits: int, percent: int, table: bytes, buckets: int, sent: int):
    """A map of (text) to packed signatures with the nodes of their sets, by range of hashes,
    and, in ranges beyond these, to nodes with their sizes and needs."""
    kind = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])

    def run(batches):
        cells = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
        made, owners, facts = [], [], []
        count = 0

        def flush():
            keys, nodes = np.concatenate(made), np.repeat(np.array([f[0] for f in facts], np.int64), owners)
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order], nodes[order]
            cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            rows = [(b, packed(keys[cuts[b] : cuts[b + 1]]), packed(nodes[cuts[b] : cuts[b + 1]])) for b in range(buckets) if cuts[b + 1] > cuts[b]]
            told = np.array(facts, np.int64)
            place = (told[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(place):
                some = told[place == b]
                rows.append((buckets + int(b), packed(np.ascontiguousarray(some[:, 1:]).reshape(-1).astype(np.uint32)), packed(np.ascontiguousarray(some[:, 0]))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for some in _new_sets(batches, width):
            for node, tokens in some:
                frequent = cells[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
                keys, needs = signatures(tokens, frequent, percent)
                made.append(keys)
                owners.append(len(keys))
                facts.append((node, len(tokens), *needs.tolist()))
                count += len(keys)
            if count > sent:
                yield flush()
                made, owners, facts, count = [], [], [], 0
        if facts:
            yield flush()

    return run


def _shared_keys(buckets: int):
    """The signatures of a range that two or more sets have, with these sets; of a range of
    nodes these, once, with their sizes and needs and no signature."""
    names = ["n", *[f"need{k}" for k in STEPS]]
    kind = pa.schema([("key", pa.int64()), ("node", pa.int64()), *[(c, pa.int64()) for c in names]])

    def run(group: pa.Table) -> pa.Table:
        nodes = np.concatenate([unpacked(k, np.int64) for k in group["nodes"].to_pylist()])
        if group["bucket"][0].as_py() >= buckets:
            values = np.concatenate([unpacked(k, np.uint32).reshape(-1, len(names)) for k in group["keys"].to_pylist()]).astype(np.int64)
            nodes, first = np.unique(nodes, return_index=True)
            columns = [pa.nulls(len(nodes), pa.int64()), pa.array(nodes), *[pa.array(np.ascontiguousarray(values[first, k])) for k in range(len(names))]]
            return pa.Table.from_arrays(columns, schema=kind)
        keys = np.concatenate([unpacked(k, np.uint64) for k in group["keys"].to_pylist()])
        order = np.lexsort([nodes, keys])  # copies that several tasks sent come together
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        same = keys[1:] == keys[:-1]
        kept = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        columns = [pa.array(keys[kept].view(np.int64)), pa.array(nodes[kept]), *[pa.nulls(int(kept.sum()), pa.int64()) for _ in names]]
        return pa.Table.from_arrays(columns, schema=kind)

    return run


def _sets(width: int, held: tuple[bytes, int] | None):
    """A map of (text, id) to (node, its set), of ids that the filter may hold."""
    kind = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            if held is not None and batch.num_rows:
                ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                batch = batch.filter(pa.array(may_hold(np.frombuffer(held[0], np.uint8), mix(ids), held[1])))
            for some in _new_sets([batch], width):
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array([x.tobytes() for _, x in some], pa.binary())], schema=kind)

    return run


def sets_of(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(node, tokens)``, the sets of ``texts(text, id)`` with one of ``ids(id)``, and of some others.

    A Bloom filter of the ids, unless it were too large, leaves out most other texts; a
    join by node has to leave out the rest. Rows of one node have equal sets.
    """
    count, held = ids.count(), None
    if count * FILTER_BITS <= 8 * HELD_FILTER_BYTES:
        bits = max(64, count * FILTER_BITS)
        wanted = np.fromiter((r[0] for r in ids.toLocalIterator()), np.int64, count).view(np.uint64)  # bounded above
        held = (filter_of(mix(wanted), bits).tobytes(), bits)
    return texts.mapInArrow(_sets(width, held), "node long, tokens binary").dropDuplicates(["node"])


#: Shingles, and as many more for each set, of one block; a task compares two blocks.
BLOCK_SHINGLES, SET_WEIGHT = 1 << 20, 64


def blocks_of(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(node, block)``: blocks of bounded size for the nodes of ``shared(key, node)``.

    A node's label is the least node that it shares a signature with; near copies of one
    text mostly have one label. Small labels are dealt to blocks whole, large ones in parts.
    """
    least = shared.groupBy("key").agg(F.min("node").alias("low"))
    labels = shared.join(least, "key").groupBy("node").agg(F.min("low").alias("label"))
    nodes = stored(labels.join(sizes, "node").select("node", "label", (F.col("n") + SET_WEIGHT).alias("w")), "jaccard-labels")
    blocks = max(8, -(-(nodes.agg(F.sum("w")).first()[0] or 0) // BLOCK_SHINGLES))
    parts = nodes.groupBy("label").agg(F.ceil(F.sum("w") / BLOCK_SHINGLES).alias("parts"))
    block = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("parts"))), F.lit(blocks))
    out = stored(nodes.join(parts, "label").select("node", block.alias("block")), "jaccard-blocks")
    gone(nodes)
    return out


class Postings:
    """Which of the nodes 0, 1, ... have each of some items, from pairs of the two."""

    def __init__(self, items: np.ndarray, nodes: np.ndarray, n: int, listed: np.ndarray):
        """``listed`` marks the nodes that are found; the others only search."""
        distinct, items = np.unique(items, return_inverse=True)
        order = np.argsort(nodes, kind="stable")
        self.items, self.ends = items[order], np.searchsorted(nodes[order], np.arange(n + 1))
        kept = listed[nodes]
        order = np.argsort(items[kept], kind="stable")
        self.nodes = nodes[kept][order]
        self.starts = np.searchsorted(items[kept][order], np.arange(len(distinct) + 1))
        self.n = n

    def common(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The listed nodes that share items with ``i``, and how many."""
        own = self.items[self.ends[i] : self.ends[i + 1]]
        low, length = self.starts[own], self.starts[own + 1] - self.starts[own]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(own) else low
        found = self.nodes[at]
        if 8 * len(found) < self.n:
            nodes, counts = np.unique(found, return_counts=True)
        else:
            counts = np.bincount(found, minlength=self.n)
            nodes = np.flatnonzero(counts)
            counts = counts[nodes]
        other = nodes != i
        return nodes[other], counts[other]


def _survivors(percent: int):
    """Of the rows ``(key, node)`` of two blocks, the nodes that share as many signatures with
    a node of the other block (for one block with itself, another node) as a link needs."""
    kind = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("node", pa.int64()), ("side", pa.int32())])

    def run(met: pa.Table, facts: pa.Table) -> pa.Table:
        facts = facts.rename_columns([c.removeprefix("of_") for c in facts.column_names]).sort_by("node")
        nodes, side, n = (facts[c].to_numpy() for c in ("node", "side", "n"))
        needs = np.stack([facts[f"need{k}"].to_numpy() for k in STEPS], axis=1)
        p, q = facts["p"][0].as_py(), facts["q"][0].as_py()
        listed = side == (0 if p == q else 1)
        table = Postings(met["key"].to_numpy(), np.searchsorted(nodes, met["node"].to_numpy()), len(nodes), listed)
        losses = n - -(-percent * n // 100)

        def need(at, overlap):
            lost = n[at] - overlap
            step = np.clip(-(-lost * STEPS[-1] // np.maximum(losses[at], 1)) - STEPS[0], 0, len(STEPS) - 1)
            return needs[at, step]

        alive = np.zeros(len(nodes), bool)
        for i in np.flatnonzero(side == 0):
            j, shared = table.common(i)
            overlap = -(-percent * (n[i] + n[j]) // (100 + percent))
            fits = (overlap <= np.minimum(n[i], n[j])) & (shared >= np.minimum(need(np.full(len(j), i), overlap), need(j, overlap)))
            if fits.any():
                alive[i] = True
                alive[j[fits]] = True
        kept = np.flatnonzero(alive)
        fixed = lambda x: pa.array(np.full(len(kept), x))
        return pa.Table.from_arrays([fixed(p), fixed(q), pa.array(nodes[kept]), pa.array(side[kept])], schema=kind)

    return run


def _rest(percent: int):
    """Of the short sets of two blocks those that have a partner in reach: shingles that have no
    equal among a partner's short ones are not shared, which bounds the overlap."""
    kind = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("node", pa.int64()), ("side", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        nodes, side, n = (group[c].to_numpy() for c in ("node", "side", "n"))
        sets = [np.cumsum(unpacked(x, np.uint32), dtype=np.uint32) for x in group["short"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        table = Postings(np.concatenate(sets), np.repeat(np.arange(len(n)), sizes), len(n), side == (0 if p == q else 1))
        merged, alive = n - sizes, np.zeros(len(n), bool)
        for i in np.flatnonzero(side == 0):
            j, overlap = table.common(i)
            most = overlap + np.minimum(merged[i], merged[j])
            j = j[100 * most >= percent * (n[i] + n[j] - most)]
            alive[i] |= len(j) > 0
            alive[j] = True
        kept = np.flatnonzero(alive)
        fixed = lambda x: pa.array(np.full(len(kept), x))
        return pa.Table.from_arrays([fixed(p), fixed(q), pa.array(nodes[kept]), pa.array(side[kept])], schema=kind)

    return run


def _compare(percent: int):
    """Links among the sets of two blocks: the number of each node's, and those that tie together
    what links tie together here, which are fewer than the nodes."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()]
        n = np.array([len(x) for x in sets])
        table = Postings(np.concatenate(sets), np.repeat(np.arange(len(n)), n), len(n), side == (0 if p == q else 1))
        degree, root, ties = np.zeros(len(n), np.int64), np.arange(len(n)), []
        for i in np.flatnonzero(side == 0):
            j, overlap = table.common(i)
            j = j[100 * overlap >= percent * (n[i] + n[j] - overlap)]
            degree[i] += len(j)
            if p != q:
                degree[j] += 1
            others, first = np.unique(root[j], return_index=True)
            for label, k in zip(others.tolist(), first.tolist(), strict=True):
                if label != root[i]:
                    ties.append((i, j[k]))
                    root[root == label] = root[i]
        linked, ties = np.flatnonzero(degree), np.array(ties, np.int64).reshape(-1, 2)
        a = np.concatenate([nodes[linked], nodes[ties[:, 0]]])
        b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(nodes[ties[:, 1]], pa.int64())])
        links = pa.concat_arrays([pa.array(degree[linked]), pa.nulls(len(ties), pa.int64())])
        return pa.Table.from_arrays([pa.array(a), b, links], schema=kind)

    return run


def linked(index: DataFrame, shorts: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b, links)``: ties that connect what links connect, and, without ``b``, each node's
    number of links.

    ``index`` has the shared signatures of nodes, ``shorts(node, n, short)`` their short sets,
    ``classes(node, class)`` an id among ``texts(text, id)``. Two blocks of nodes meet in one
    task if they share a signature, first with the shared signatures alone, then with the
    short sets and at last with the sets of those nodes that have a partner left. So
    pairs are enumerated inside tasks of bounded size and never become rows, and a set
    is sent to the blocks it may be linked with. Every candidate pair is compared.
    """
    needed = ["n", *[f"need{k}" for k in STEPS]]
    known = index.where("key is null").select("node", *needed)
    shared = index.where("key is not null").select("key", "node")
    blocked = blocks_of(shared, known)
    placed = stored(shared.join(blocked, "node"), "jaccard-placed")
    held = placed.groupBy("key", "block").agg(F.count("*").alias("m"))
    other = held.select("key", F.col("block").alias("q"))
    pairs = held.join(other, "key").where("block < q or (block = q and m > 1)")
    pairs = pairs.select("key", F.col("block").alias("p"), "q")
    ends = pairs.select("*", F.col("p").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.where("p <> q").select("*", F.col("q").alias("block"), F.lit(1).alias("side")))
    met = stored(placed.join(ends, ["key", "block"]).select("p", "q", "key", "node", "side"), "jaccard-met")
    facts = met.select("p", "q", "node", "side").distinct().join(known, "node")
    facts = facts.select(*[F.col(c).alias(f"of_{c}") for c in facts.columns])
    alive = met.select("p", "q", "key", "node").groupBy("p", "q").cogroup(facts.groupBy("of_p", "of_q"))
    shape = "p long, q long, node long, side int"
    alive = stored(alive.applyInArrow(_survivors(percent), shape), "jaccard-alive")
    gone(blocked, placed, met)
    sent = alive.join(shorts.dropDuplicates(["node"]), "node")
    rest = stored(sent.groupBy("p", "q").applyInArrow(_rest(percent), shape), "jaccard-rest")
    gone(alive)
    ids = stored(rest.select("node").distinct().join(classes, "node").select(F.col("class").alias("id")).distinct(), "jaccard-ids")
    sent = rest.join(sets_of(texts, ids, width), "node")
    links = stored(sent.groupBy("p", "q").applyInArrow(_compare(percent), "a long, b long, links long"), "jaccard-links")
    gone(rest, ids)
    return links


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``links(a, b)``.

    Large-star and small-star rounds: each node's neighbours are tied to the smallest of
    them, which keeps the number of links and takes a few rounds whatever their shape.
    Ties are made by aggregate and join, so a node of many links is no single group.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-large")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "cc-edges")
        state = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        changed, before = state != before, state
        gone(edges, large)
        edges = new
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    sketch_bits: int = SKETCH_BITS,
    sent: int = 1_000_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Documents with equal sets form a class, which takes part once. A
    sketch of fixed size counts the shingles of all texts and tells frequent from rare;
    any division gives right results, a good one few candidates. :func:`signatures` are
    exchanged as packed arrays; documents that share one are candidates. All candidates
    whose sizes fit and which share as many signatures as a link needs at least are
    compared, so no link is lost (see :func:`linked`); a group of near copies costs a
    comparison for each of its pairs of different sets, but no row.

    Returns ``id_col, n_shingles, class_id, component_id, n_links, group_key``, and columns
    named by ``carry``, one row per input row: the first document of the class, the smallest
    id reachable by links, the number of other classes that are linked with this one, and a
    number that texts tied by links share. Component and group divide rows alike unless rows of
    one id have different texts: these have one component, but may be in different groups.
    A null or empty text has no shingles and is its own class, without a group; a null id
    takes part in no link and gets no component and no group. Very long texts are sets like others, in the
    memory of one task; further columns are not read, so their names may be any. Ids are
    64-bit numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    base = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    made = [("n", T.LongType()), ("node", T.LongType()), ("short", T.BinaryType()), ("part", T.IntegerType()), ("counts", T.BinaryType())]
    shape = T.StructType([*[T.StructField(*c) for c in made], *[T.StructField(f.name, f.dataType) for f in base.schema.fields[1:]]])  # all may be null
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survey = stored(base.mapInArrow(_survey(width, sketch_bits, SKETCH_PARTS, to_arrow_schema(shape)), shape), "jaccard-survey")
    rows = survey.where("part is null").drop("short", "part", "counts")
    parts = max(parts, (rows.agg(F.sum("n")).first()[0] or 0) // RANGE_SHINGLES)
    # texts without shingles are linked with nothing
    classes = rows.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("class"))
    classes = stored(classes, "jaccard-classes")
    shorts = survey.where("short is not null").select("node", "n", "short")
    texts = base.where("id is not null").select("text", "id")

    cells = survey.where("part is not null").select("part", "counts")
    cells = stored(cells.groupBy("part").applyInArrow(_add_sketches((1 << sketch_bits) // SKETCH_PARTS), "part int, counts binary"), "jaccard-sketch")
    counted = [unpacked(bytes(r["counts"]), np.uint32) for r in cells.orderBy("part").collect()]  # 2**sketch_bits counters
    flags = np.packbits(_frequent_cells(np.concatenate(counted))).tobytes() if counted else bytes(1 << sketch_bits >> 3)
    gone(cells)

    index = texts.select("text").mapInArrow(_index(width, sketch_bits, percent, flags, parts, sent), "bucket int, keys binary, nodes binary")
    needed = ["n", *[f"need{k}" for k in STEPS]]
    # a pair that is similar enough shares all but a part of a prefix, that of the set whose
    # prefix ends first, and so at least as many signatures as one of the two sets keeps at
    # its losses in this pair
    index = stored(index.groupBy("bucket").applyInArrow(_shared_keys(parts), "key long, node long, " + ", ".join(f"{c} long" for c in needed)), "jaccard-index")
    links = linked(index, shorts, classes, texts, width, percent)
    gone(index)

    # groups are of sets: of each the smallest id of its classes
    found = components(links.where("b is not null").select("a", "b"))
    of_set = classes.join(found, "node", "left").select("node", "class", F.coalesce("component", "node").alias("component"))
    degrees = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    smallest = of_set.groupBy("component").agg(F.min("class").alias("group"))
    of_set = of_set.join(smallest, "component").join(degrees, "node", "left").select("node", "class", "group", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    tied = rows.withColumn("node", F.when(F.col("n").eqNullSafe(0) | F.col("id").isNull(), None).otherwise(F.col("node"))).join(of_set, "node", "left")
    tied = stored(tied.drop("node").withColumnRenamed("component", "group_key"), "jaccard-groups")
    gone(survey, classes, links)
    # components are of ids: an id with texts in several groups ties these together
    of_id = tied.where("group is not null").groupBy("id").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    several = of_id.where("low <> high").select("id")
    ties = tied.join(several, "id", "left_semi").where("group is not null").select("id", "group").distinct().join(of_id, "id")
    joined = components(ties.select(F.col("low").alias("a"), F.col("group").alias("b")))
    joined = joined.select(F.col("node").alias("low"), "component")
    of_id = of_id.join(joined, "low", "left").select("id", F.coalesce("component", "low").alias("component"))
    out = tied.join(of_id, "id", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("class_id"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("group_key"), *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)],
    )
