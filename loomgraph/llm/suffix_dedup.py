"""Removal of byte strings repeated from earlier documents, by a distributed suffix sort.

A block of documents sorts suffixes of its own and exchanges them as front-coded runs; the
tasks that receive the runs of a range, between two splitters, merge them with loser trees that
use the common prefixes they know instead of comparing again. Not every suffix is exchanged: any string
of the sought length holds an anchor, the smallest of its k-byte hashes, so sorting the
suffixes at anchors, with the bytes before them, meets every repeated string. A first
exchange of anchor hashes leaves those that occur in two documents or more, and only their
suffixes are sent (prefix lengths told apart by fingerprints before strings are sent).
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.language_model import packed, unpacked
from loomgraph.llm.words import mix, raw_bytes

#: Bytes of an anchor.
ANCHOR = 16
#: Texts of about so many bytes are hashed at a time.
PIECE = 1 << 20
#: A null id is later than any other.
LAST = (1 << 63) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    for width in (1, 2, 4, 8):  # of 1, 2, 4, 8 bytes to of twice as many
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * _FACTOR + h[width:]
        h ^= h >> np.uint64(29)
    return mix(h)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each stretch of ``width`` items, by doubling."""
    n, wide, out = len(x) - width + 1, 1, x
    while 2 * wide <= width:
        out = op(out[:-wide], out[wide:])
        wide *= 2
    return op(out[:n], out[width - wide : width - wide + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of texts laid end to end: places, and hashes of their bytes.

    A place is an anchor if, in some string of ``length`` bytes inside a text, no gram
    hash is smaller than its own: the largest of the strings' least hashes is its hash.
    Equal strings have their anchors at the same places.
    """
    hashes = np.maximum(gram_hashes(data), np.uint64(1))
    window = length - ANCHOR + 1
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(np.minimum, hashes, window)
    change = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    change[offsets[long]] += 1
    change[offsets[long + 1] - length + 1] -= 1
    least *= np.cumsum(change[: len(least)]).astype(np.uint64)  # 0 where no string starts
    edge = np.zeros(window - 1, np.uint64)
    places = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), window) == hashes)
    return places, hashes[places]


def pieces(ids: list, column: pa.Array):
    """Stretches of a block's documents of bounded size: bytes, offsets, ids."""
    data, offsets = raw_bytes(column)
    low = 0
    while low < len(ids):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ids[low:high]
        low = high


def block_anchors(ids: list, column: pa.Array, length: int, wanted: np.ndarray | None = None):
    """For each stretch of a block its anchors, all or those with a wanted hash."""
    for low, data, offsets, some in pieces(ids, column):
        places, hashes = anchors_of(data, offsets, length)
        if wanted is not None and len(places):
            at = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
            kept = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
            places, hashes = places[kept], hashes[kept]
        texts = np.searchsorted(offsets, places, "right") - 1
        yield low, data, offsets, some, places, hashes, texts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ordered(group: pa.Table) -> tuple[list, pa.Array]:
    """Ids and texts of a block's documents in order of id; null ids last."""
    group = group.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = group["text"].chunk(0) if group.num_rows else pa.array([], group.schema.field("text").type)
    return group["id"].to_pylist(), text


def _send_hashes(length: int, buckets: int):
    """A block's anchor hashes by range, each with whether two of its documents have it."""
    kind = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        ids, column = _ordered(group)
        found = []
        for _, _, _, _, _, hashes, texts in block_anchors(ids, column, length):
            order = np.argsort(hashes, kind="stable")  # texts of equal hashes stay in order
            hashes, texts = hashes[order], texts[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
            found.append(hashes[new])
        rows = [[], [], [], []]
        if found:
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                some = slice(cuts[b], cuts[b + 1])
                for c, v in zip(rows, (b, group["block"][0].as_py(), packed(hashes[some]), np.packbits(counts[some] > 1).tobytes()), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind, strict=True)], schema=kind)

    return run


def _repeated_hashes(group: pa.Table) -> pa.Table:
    """To each block the hashes of the range that occur in two documents or more."""
    blocks = group["block"].to_pylist()
    sent = [unpacked(h, np.uint64) for h in group["hashes"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(s)).astype(bool) for t, s in zip(group["twice"].to_pylist(), sent, strict=True)]
    every, counts = np.unique(np.concatenate(sent), return_counts=True)
    repeated = np.union1d(every[counts > 1], np.concatenate([s[t] for s, t in zip(sent, twice, strict=True)]))
    rows = [(b, packed(kept)) for b, s in zip(blocks, sent, strict=True) if len(kept := s[np.isin(s, repeated, assume_unique=True)])]
    bucket = pa.array([-1] * len(rows), pa.int32())
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": bucket, "data": pa.array([r[1] for r in rows], pa.binary())})


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, known to be ``start`` at least."""
    end = min(len(a), len(b))
    differing = int.from_bytes(a[start:end], "big") ^ int.from_bytes(b[start:end], "big")
    return end - (differing.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """A sorted run: the common prefix of each string with the one before, and its rest."""
    prefixes, rests, before = [], [], b""
    for s in strings:
        k = common_prefix(before, s)
        prefixes.append(k)
        rests.append(s[k:])
        before = s
    return prefixes, rests


class Run:
    """Reads a front-coded run one string at a time."""

    def __init__(self, prefixes: list[int], rests: list[bytes], payload: list):
        self.prefixes, self.rests, self.payload = prefixes, rests, payload
        self.at, self.string, self.known = -1, b"", 0
        self.advance()

    def advance(self) -> None:
        """Goes to the next string; ``known`` is its common prefix with the one before."""
        self.at += 1
        if self.at < len(self.prefixes):
            self.known = self.prefixes[self.at]
            self.string = self.string[: self.known] + self.rests[self.at]
        else:
            self.string = None


def merge_runs(runs: list[Run]):
    """Merges sorted runs with a loser tree: yields (string, common prefix with the one
    before, run, its place in the run).

    Each loser keeps its common prefix with the string that beat it. On the winner's path
    all these prefixes and the new string's own refer to the string given out last: the
    longer one is smaller, and only equal prefixes are compared, from their end on.
    """
    n = len(runs)
    if not n:
        return
    losers = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = runs[a], runs[b]
        if x.string is None or y.string is None:
            return (b, a) if x.string is None else (a, b)
        if x.known != y.known:
            return (a, b) if x.known > y.known else (b, a)
        k = common_prefix(x.string, y.string, x.known)
        if (x.string[k : k + 1], a) < (y.string[k : k + 1], b):
            y.known = k
            return a, b
        x.known = k
        return b, a

    for run in runs:
        run.known = 0
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if n > 1 else 0
    while runs[top].string is not None:
        run = runs[top]
        yield run.string, run.known, top, run.at
        run.advance()
        node = (top + n) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def classes(prefixes: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the classes of sorted strings that agree in their first ``length`` bytes."""
    return np.cumsum(prefixes < length)


def earliest(suffixes: list[bytes], prefixes: np.ndarray, before: list[bytes], ids: np.ndarray, length: int):
    """For sorted suffixes, with the common prefix of each with the one before it, and the
    bytes before them: which strings around an anchor an earlier document may have.

    A string that starts ``left`` bytes before the anchor is known by the class of its
    suffix at ``length - left`` bytes and that of the bytes before, read backwards, at
    ``left``; both follow from sorted order and common prefixes alone. Gives arrays
    (entry, low, high, id): for each entry the stretches of ``left`` for which the string
    has the same smallest id.
    """
    n, most = len(suffixes), length - ANCHOR
    backwards = [b[::-1] for b in before]
    distinct = sorted(set(backwards))
    place = {b: k for k, b in enumerate(distinct)}
    ranks = np.array([place[b] for b in backwards], np.int64)
    known = np.array([0, *(common_prefix(x, y) for x, y in zip(distinct, distinct[1:], strict=False))], np.int64)
    reach, room = np.array([len(s) for s in suffixes]), np.array([len(b) for b in before])
    first = np.full((most + 2, n), -1, np.int64)  # the last row stays empty
    for left in range(most + 1):
        valid = np.flatnonzero((room >= left) & (reach >= length - left))
        if not len(valid):
            continue
        keys = (classes(prefixes, length - left) * (len(distinct) + 1) + classes(known, left)[ranks])[valid]
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        least = np.minimum.reduceat(ids[valid][order], starts)
        first[left, valid[order]] = np.repeat(least, np.diff(np.append(starts, len(order))))
    change = np.ones(first.shape, bool)
    change[1:] = first[1:] != first[:-1]
    low, entry = np.nonzero((change & (first >= 0)).T)[::-1]
    high = np.nonzero((np.concatenate([change[1:], np.ones((1, n), bool)]) & (first >= 0)).T)[1]
    return entry, low, high, first[low, entry]


def _wanted(replies: pa.Table) -> np.ndarray:
    """A block's repeated anchors, from the replies of the first exchange (bucket -1)."""
    parts = [unpacked(d, np.uint64) for d, b in zip(replies["data"].to_pylist(), replies["bucket"].to_pylist(), strict=True) if b < 0]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def alike(data: np.ndarray, places: np.ndarray, texts: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether each place but the first has the context of the place before it, since both lie
    in a stretch of one byte that reaches beyond their contexts."""
    change = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    stretch = np.searchsorted(change, places, "right") - 1
    begin = np.maximum(change[stretch], offsets[texts])
    end = np.minimum(np.append(change, len(data))[stretch + 1], offsets[texts + 1])
    inside = (places - (length - ANCHOR) >= begin) & (places + length <= end)
    return inside[1:] & inside[:-1] & (places[1:] == places[:-1] + 1) & (texts[1:] == texts[:-1])


def block_contexts(group: pa.Table, wanted: np.ndarray, length: int):
    """The block's suffixes at wanted anchors: (document, its id, place, how many more places
    after it have the same context, suffix, bytes before)."""
    ids, column = _ordered(group)
    back = length - ANCHOR
    for low, data, offsets, some, places, _, texts in block_anchors(ids, column, length, wanted):
        if not len(places):
            continue
        first = np.flatnonzero(np.concatenate([[True], ~alike(data, places, texts, offsets, length)]))
        more = np.diff(np.append(first, len(places))) - 1
        places, texts = places[first], texts[first]
        raw = data.tobytes()
        begins, ends = offsets[texts], offsets[texts + 1]
        stops, heads = np.minimum(ends, places + length), np.maximum(begins, places - back)
        rows = (texts, places, places - begins, more, stops, heads)
        for text, place, at, n, stop, head in zip(*(x.tolist() for x in rows), strict=True):
            yield low + text, some[text], at, n, raw[place:stop], raw[head:place]


def block_runs(contexts) -> tuple[list[tuple[bytes, bytes]], np.ndarray, np.ndarray]:
    """Distinct suffixes with the bytes before them, sorted; their smallest ids; and where they
    are: rows (entry, document, place, more places, id), by entry.

    A passage is one entry however many of a block's documents hold it.
    """
    found: dict[tuple[bytes, bytes], int] = {}
    least, where = array("q"), [array("q") for _ in range(5)]
    for text, id_, place, more, suffix, before in contexts:
        id_ = LAST if id_ is None else id_
        k = found.setdefault((suffix, before), len(found))
        if k == len(least):
            least.append(id_)
        elif id_ < least[k]:
            least[k] = id_
        for column, value in zip(where, (k, text, place, more, id_), strict=True):
            column.append(value)
    keys = sorted(found)
    order = np.array([found[k] for k in keys], np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    rows = np.stack([np.frombuffer(c, np.int64) for c in where]) if len(least) else np.zeros((5, 0), np.int64)
    rows[0] = rank[rows[0]]
    return keys, np.frombuffer(least, np.int64)[order] if len(least) else order, rows[:, np.argsort(rows[0], kind="stable")]


def _send_runs(length: int, splitters: list[bytes]):
    """A block's suffixes at repeated anchors as front-coded sorted runs, one per range, and
    where the block has them."""
    kind = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("run", pa.binary()), ("own", pa.binary())])

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = [[], [], [], []]
        if group.num_rows and replies.num_rows:
            keys, ids, where = block_runs(block_contexts(group, _wanted(replies), length))
            cuts = [0, *[bisect_left(keys, (s, b"")) for s in splitters], len(keys)]
            places = np.searchsorted(where[0], cuts)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                low, high = cuts[b], cuts[b + 1]
                own = where[:, places[b] : places[b + 1]].copy()
                own[0] -= low
                for c, v in zip(rows, (b, group["block"][0].as_py(), _encode_run(keys[low:high], ids[low:high]), packed(own.reshape(-1))), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind, strict=True)], schema=kind)

    return run


def splitters_of(docs: DataFrame, count: int, length: int, buckets: int, sample: int) -> list[bytes]:
    """Strings that divide the anchors of texts into ranges of about equal numbers.

    From the beginnings of about ``sample`` of ``count`` documents, chosen by hash: they
    decide which task merges what, not what is found.
    """
    some = docs.where(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(max(1, count // sample))) == 0)
    texts = [r[0].encode() for r in some.where("text is not null").select(F.substring("text", 1, 2048)).collect()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    places, _ = anchors_of(data, offsets, length) if texts else (np.zeros(0, np.int64), None)
    raw = data.tobytes()
    known = sorted(raw[p : p + ANCHOR] for p in places.tolist())
    return sorted({known[len(known) * k // buckets] for k in range(1, buckets)}) if known else []


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(data)) as source:
        return source.read_all()


def _encode_run(keys: list[tuple[bytes, bytes]], ids: np.ndarray) -> bytes:
    prefixes, rests = front_coded([k[0] for k in keys])
    columns = {"prefix": pa.array(prefixes, pa.uint16()), "rest": pa.array(rests, pa.binary()),
               "before": pa.array([k[1] for k in keys], pa.binary()), "id": pa.array(ids, pa.int64())}
    return _to_bytes(pa.record_batch(columns))


def _decode_run(data: bytes) -> Run:
    prefixes, rests, before, ids = (c.to_pylist() for c in _from_bytes(data).columns)
    return Run(prefixes, rests, list(zip(before, ids, strict=True)))


def spans_of(own: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The stretches ``(document, start, stop)`` that earlier documents have, for the rows
    ``own(entry, document, place, more places, id)`` of one run; ``places`` are entries."""
    begin = np.searchsorted(places, own[0])
    n = np.searchsorted(places, own[0], "right") - begin
    row = np.repeat(np.arange(own.shape[1]), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
    earlier = first[at] < own[4][row]
    row, at = row[earlier], at[earlier]
    start = own[2][row] - high[at]
    return np.stack([own[1][row], start, own[2][row] + own[3][row] - low[at] + length])


def _merge_range(length: int):
    """Merges the runs of a range and answers each block which stretches of its documents are
    in an earlier document."""
    kind = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        blocks, bucket = group["block"].to_pylist(), group["bucket"][0].as_py()
        runs = [_decode_run(r) for r in group["run"].to_pylist()]
        suffixes, prefixes, before, ids, owners, places = [], [], [], [], [], []
        for suffix, known, r, k in merge_runs(runs):
            suffixes.append(suffix)
            prefixes.append(known)
            before.append(runs[r].payload[k][0])
            ids.append(runs[r].payload[k][1])
            owners.append(r)
            places.append(k)
        entry, low, high, first = earliest(suffixes, np.array(prefixes), before, np.array(ids, np.int64), length)
        owner, place = np.array(owners, np.int64)[entry], np.array(places, np.int64)[entry]
        order = np.lexsort([place, owner])
        owner, place, low, high, first = owner[order], place[order], low[order], high[order], first[order]
        cuts = np.searchsorted(owner, np.arange(len(runs) + 1))
        rows = []
        for r, own in enumerate(group["own"].to_pylist()):
            some = slice(cuts[r], cuts[r + 1])
            found = spans_of(unpacked(own, np.int64).reshape(5, -1), place[some], low[some], high[some], first[some], length)
            if found.shape[1]:
                rows.append((blocks[r], bucket, packed(found.reshape(-1))))
        return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)}, schema=kind)

    return run


def _remove(with_text: bool):
    """Removes from a block's documents the stretches that an earlier document holds."""
    names = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    kind = pa.schema(names)

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        ids, column = _ordered(group)
        data, offsets = raw_bytes(column)
        depth = np.zeros(len(data) + 1, np.int32)
        for reply in replies["data"].to_pylist():
            text, start, stop = unpacked(reply, np.int64).reshape(3, -1)
            np.add.at(depth, offsets[text] + start, 1)
            np.add.at(depth, offsets[text] + stop, -1)
        removed = np.cumsum(depth, dtype=np.int32)[:-1] > 0
        rows = []
        for k, id_ in enumerate(ids):
            text, gone = data[offsets[k] : offsets[k + 1]], removed[offsets[k] : offsets[k + 1]]
            n = int(np.count_nonzero(gone))
            starts = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(gone[0]) if n else 0
            kept = (text[~gone] if n else text).tobytes()
            rows.append((id_, len(text), n, starts, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind) if rows else kind.empty_table()

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    block_bytes: int = 8 << 20,
    least_blocks: int = 48,
    with_text: bool = False,
    sample: int = 1000,
) -> DataFrame:
    """Removes every byte in a ``length``-byte string that also starts in a document with a
    smaller id.

    Texts are judged as UTF-8 on the input, strings never cross documents. Returns
    ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, ``with_text``, the ``kept``
    bytes; one row per input row. A null text is empty; of rows with the same id none is
    earlier than another; a null id is later than all. Ids are 64-bit numbers;
    ``length`` is at least 32 (two anchors) and at most 255. Long texts are hashed in
    pieces and a stretch of one byte is one entry, so memory follows the block; other
    columns are not read. about ``sample`` documents give the splitters of the ranges.
    """
    if not 2 * ANCHOR <= length <= 255:
        raise ValueError("length must lie between 32 and 255")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total, count = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(least_blocks, -(-total // block_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, blocks)
    # all steps are one plan, in which the shuffle of the texts by block is made once
    by_block = base.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks))).groupBy("block")
    hashes = by_block.applyInArrow(_send_hashes(length, buckets), "bucket int, block long, hashes binary, twice binary")
    reply = "block long, bucket int, data binary"
    repeated = hashes.groupBy("bucket").applyInArrow(_repeated_hashes, reply)
    splitters = splitters_of(base, count, length, buckets, sample)
    runs = by_block.cogroup(repeated.groupBy("block")).applyInArrow(_send_runs(length, splitters), "bucket int, block long, run binary, own binary")
    answers = runs.groupBy("bucket").applyInArrow(_merge_range(length), reply)
    shape = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(_remove(with_text), shape)
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
