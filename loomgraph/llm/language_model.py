"""An interpolated modified Kneser-Ney model of any order in sorted hash arrays.

The corpus is counted in one exchange of packed arrays for each order. The counts lie in files of sorted
keys in the shared folder, one for each range of keys, which workers map into
memory and search; no task ever holds the model. A word's key is its 64-bit hash; a gram's has as many bits
as the rank of its context and the id of its last word need. A file holds an index over the high bits of its
keys and the low bits in whole bytes, and a byte for each count that fits one.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import dropped, get_file, new_folder, process_cache, put_file, stored
from loomgraph.llm.words import word_hashes

#: The hash that stands for the end of a text among the word hashes.
END = np.uint64(0x5BD1E9955BD1E995)
#: Distinct keys that a task collects before it sends them off.
COLLECTED = 2_000_000
#: Odd factors that spread the bits of a gram's key.
_FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of text for each range of hashes, at most: a task merges the grams of one range.
RANGE_BYTES = 64 << 20
#: Bytes of text for each pair of ranges, at least, as long as ``RANGE_BYTES`` allows: each range
#: sends a row of sums to each, and so many bytes keep the rows in proportion to the text.
PAIR_BYTES = 32 << 10
#: Keys that a task works on at once when it goes through those of a range.
PIECE = 1 << 20
_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def packed(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed: the high bytes of sorted numbers hardly differ."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, dtype) -> np.ndarray:
    n, dtype = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    raw = pa.Codec("zstd").decompress(data[8:], n * dtype.itemsize, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def packed_sorted(x: np.ndarray, shift: int = 0) -> bytes:
    """A sorted array as the differences of its values, without ``shift`` low bits, which are 0."""
    x = x.astype(np.uint64) >> np.uint64(shift)
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes, shift: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64) << np.uint64(shift)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def range_bits(size: int, cores: int) -> int:
    """The bits that number the ranges of hashes of ``size`` bytes of text: two ranges for each
    core, fewer if pairs of ranges had less than ``PAIR_BYTES``, more if a range had over ``RANGE_BYTES``."""
    pairs = (size // PAIR_BYTES).bit_length() - 1
    return max(1, min((2 * cores - 1).bit_length(), pairs // 2), (-(-size // RANGE_BYTES) - 1).bit_length())


class Collector:
    """Counts keys and gives them out as packed arrays by range of hashes."""

    def __init__(self, bits: int, width: int = 64):
        self.bits, self.shift, self.parts, self.held = bits, 64 - width, [], 0

    def add(self, keys: np.ndarray):
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts))
        self.held += len(found)
        if self.held > 2 * COLLECTED:
            self.merge()
        if self.held > COLLECTED:
            yield from self.flush()

    def merge(self):
        if len(self.parts) > 1:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def flush(self):
        self.merge()
        if not self.held:
            return
        keys, counts = self.parts[0]
        buckets = (keys >> np.uint64(64 - self.bits)).astype(np.int32)
        cuts = np.searchsorted(buckets, np.arange((1 << self.bits) + 1))
        out = [[], [], []]
        for b in range(1 << self.bits):
            low, high = cuts[b], cuts[b + 1]
            if high > low:
                out[0].append(b)
                out[1].append(packed_sorted(keys[low:high], self.shift))
                out[2].append(packed(counts[low:high]))
        self.parts, self.held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED, strict=True)], schema=_PACKED)


def is_held_out(ids: list) -> np.ndarray:
    """Rows whose id, as text, has a CRC-32 that leaves 2 when divided by 7 (null: empty text)."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def _with_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the number of tokens before each text."""
    hashes, before = word_hashes(column)
    tokens = np.insert(hashes, before[1:], END)
    return tokens, before + np.arange(len(before))


def _pieces(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(~is_held_out(batch.column(0).to_pylist())))


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file, mapped into memory. One of a remote store is copied first into a
    nameless file, which ends with the worker and is fetched anew by any other."""
    kept = process_cache("mapped files")
    if uri not in kept:
        place = urlparse(uri)
        if place.scheme in ("", "file"):
            path = unquote(place.path)
            kept[uri] = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        else:
            held = tempfile.TemporaryFile()
            held.write(get_file(uri))
            kept[uri] = np.memmap(held, np.uint8, "r") if held.tell() else np.zeros(0, np.uint8)
    return kept[uri]


def count_bytes(counts: np.ndarray) -> bytes:
    """Counts of four bytes each, or eight where one needs more."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64).tobytes()


def small_bytes(counts: np.ndarray) -> bytes:
    """Counts as they lie in a file: a byte each. 255 stands for one that is listed behind
    them, after the list of places; the width of these tells the size."""
    over = np.flatnonzero(counts >= 255)
    listed = len(over).to_bytes(8, "little") + over.astype(np.uint64).tobytes() + count_bytes(counts[over])
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + listed


def small_values(data: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The counts that :func:`small_bytes` wrote of ``n``, all or at some places."""
    out = (data[:n] if at is None else data[:n][at]).astype(np.uint64)
    over = np.flatnonzero(out == 255)
    if len(over):
        k = int(data[n : n + 8].view(np.uint64)[0])
        places, values = data[n + 8 : n + 8 + 8 * k].view(np.uint64), data[n + 8 + 8 * k :]
        values = values.view(np.uint64 if len(values) == 8 * k else np.uint32)
        out[over] = values[np.searchsorted(places, (over if at is None else at[over]).astype(np.uint64))]
    return out


def key_shape(n: int, rest: int) -> tuple[int, int]:
    """Of ``n`` keys of a range that differ in ``rest`` bits: the low bytes that are kept of
    each, and the bits above these, over which there is an index."""
    low = -(-max(1, rest - max(0, n.bit_length() - 2)) // 8)
    return low, max(0, rest - 8 * low)


def key_bytes(keys: np.ndarray, bits: int, width: int) -> bytes:
    """The file of a range's keys: where each value of the high bits begins, then the low bytes."""
    low, high = key_shape(len(keys), width - bits)
    heads = np.arange(1 << high, dtype=np.uint64) << np.uint64(8 * low + 64 - width) if high else np.zeros(1, np.uint64)
    if len(keys):
        heads |= keys[0] >> np.uint64(64 - bits) << np.uint64(64 - bits)
    starts = np.append(np.searchsorted(keys, heads).astype(np.uint32), np.uint32(len(keys)))
    lows = np.zeros(len(keys) * low + 8, np.uint8)
    for at in range(0, len(keys), PIECE):
        plain = (keys[at : at + PIECE] >> np.uint64(64 - width)) & np.uint64((1 << (width - bits)) - 1)
        lows[at * low : (at + len(plain)) * low] = plain.view(np.uint8).reshape(-1, 8)[:, :low].reshape(-1)
    return b"".join([starts, lows])


class KeyFile:
    """The keys of one range as :func:`key_bytes` wrote them, searched where they lie."""

    def __init__(self, data: np.ndarray, n: int, bucket: int, bits: int, width: int):
        self.n, self.rest, self.shift = n, width - bits, np.uint64(64 - width)
        self.low, high = key_shape(n, self.rest)
        self.head = bucket << self.rest
        size = 4 * ((1 << high) + 1)
        self.starts = data[:size].view(np.uint32)
        self.lows = np.ndarray((n,), "<u8", data[size:], strides=(self.low,))
        self.mask = np.uint64((1 << 8 * self.low) - 1)

    def slots(self, plain: np.ndarray) -> np.ndarray:
        return (plain >> np.uint64(8 * self.low)).astype(np.int64) if self.low < 8 else np.zeros(len(plain), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        plain = (keys >> self.shift) & np.uint64((1 << self.rest) - 1)
        slot, want = self.slots(plain), plain & self.mask
        at, end = self.starts[slot].astype(np.int64), self.starts[slot + 1].astype(np.int64)
        size = end - at
        while size.any():  # the first of at, .. at + size that is not less lies among them
            half = size >> 1
            less = (size > 0) & ((self.lows[np.minimum(at + half, self.n - 1)] & self.mask) < want)
            at = np.where(less, at + half + 1, at)
            size = np.where(less, size - half - 1, half)
        met = (at < end) & ((self.lows[np.minimum(at, self.n - 1)] & self.mask) == want)
        return np.where(met, at, -1)

    def keys(self, at: np.ndarray | None = None) -> np.ndarray:
        """The keys, all or at some places."""
        if at is None:
            slot, low = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts.astype(np.int64))), self.lows & self.mask
        else:
            slot, low = np.searchsorted(self.starts, at, "right") - 1, self.lows[at] & self.mask
        high = slot.astype(np.uint64) << np.uint64(8 * self.low) if self.low < 8 else np.uint64(0)
        return (np.uint64(self.head) | high | low) << self.shift

    def pieces(self):
        """All keys in order, ``PIECE`` at a time."""
        for at in range(0, self.n, PIECE):
            yield self.keys(np.arange(at, min(self.n, at + PIECE)))


class HashArrays:
    """Sorted keys in one file per range, with arrays of counts beside them. Keys have ``width``
    bits, the highest of 64; the low ones of a gram's key are its word before it is mixed."""

    def __init__(self, folder: str, kind: str, bits: int, sizes: dict[int, int], width: int = 64):
        self.folder, self.kind, self.bits, self.width = folder, kind, bits, width
        self.sizes = np.array([sizes.get(b, 0) for b in range(1 << bits)], np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.sizes)])

    def file(self, bucket: int, column: str) -> np.ndarray:
        return np.asarray(mapped(f"{self.folder}/{self.kind}-{column}-{bucket:05d}"))

    def key_file(self, bucket: int) -> KeyFile:
        return KeyFile(self.file(bucket, "keys"), int(self.sizes[bucket]), bucket, self.bits, self.width)

    def counts(self, bucket: int, column: str, at: np.ndarray | None = None) -> np.ndarray:
        return small_values(self.file(bucket, column), int(self.sizes[bucket]), at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each of the sorted keys its rank among all, or -1."""
        found = np.full(len(keys), -1, np.int64)
        cuts = np.searchsorted((keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if self.sizes[b]:
                at = self.key_file(b).find(keys[cuts[b] : cuts[b + 1]])
                found[cuts[b] : cuts[b + 1]] = np.where(at >= 0, at + self.bases[b], -1)
        return found

    def values(self, ranks: np.ndarray, *columns: str) -> list[np.ndarray]:
        """The keys or counts at ranks, 0 for rank -1, column by column."""
        out = [np.zeros(len(ranks), np.uint64) for _ in columns]
        known = np.flatnonzero(ranks >= 0)
        order = known[np.argsort(ranks[known], kind="stable")]
        cuts = np.searchsorted(ranks[order], self.bases)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[b] : cuts[b + 1]]
            at = ranks[some] - self.bases[b]
            for column, to in zip(columns, out, strict=True):
                to[some] = self.key_file(b).keys(at) if column == "keys" else self.counts(b, column, at)
        return out


def _ids(vocab: HashArrays, tokens: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(tokens, return_inverse=True)
    return vocab.find(distinct)[back]


def _count_words(bits: int):
    def run(batches):
        collector = Collector(bits)
        for batch in batches:
            for part in _pieces(batch):
                yield from collector.add(_with_ends(_training(part).column(1))[0])
        yield from collector.flush()

    return run


def gram_steps(levels: dict, ids: np.ndarray, before: np.ndarray, order: int):
    """For orders 2 to ``order`` the grams that end with each token.

    A gram is the rank of its context among the grams of one order less and the id of its
    last word; the context of a first token is the beginning of a text, whose rank is the
    number of words, and no gram reaches beyond it. Gives ``(m, left, known, keys, ranks)``:
    ranks of contexts or -1, the tokens whose gram has a key, these keys, and the ranks of
    the grams, -1 if unknown; no ranks if the order has no table yet.
    """
    begin = int(levels[1].bases[-1])
    place = np.arange(len(ids)) - np.repeat(before[:-1], np.diff(before))
    ranks = ids
    for m in range(2, order + 1):
        left = np.concatenate([[begin], ranks[:-1]])
        left[place < m - 2] = -1
        if m == 2:
            left[before[:-1]] = begin
        known = (left >= 0) & (ids >= 0)
        keys = gram_keys(left[known], ids[known], key_bits(levels, m))
        ranks = None
        if m in levels:
            distinct, back = np.unique(keys, return_inverse=True)
            ranks = np.full(len(ids), -1, np.int64)
            ranks[known] = levels[m].find(distinct)[back]
        yield m, left, known, keys, ranks


def key_bits(levels: dict, m: int) -> tuple[int, int]:
    """The bits of a key of ``m`` words, and those of them that the last word's id needs."""
    right = int(levels[1].bases[-1]).bit_length()
    return max(int(levels[m - 1].bases[-1]).bit_length() + right, levels[1].bits), right


def gram_keys(left: np.ndarray, right: np.ndarray, bits: tuple[int, int]) -> np.ndarray:
    """One to one, with the high bits spread: the halves are folded and multiplied in ``bits[0]`` bits."""
    width, low = bits
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    x = (left.astype(np.uint64) << np.uint64(low)) | right.astype(np.uint64)
    for factor in _FACTORS:
        x = ((x ^ (x >> half)) * np.uint64(factor)) & mask
    return (x ^ (x >> half)) << np.uint64(64 - width)


def gram_parts(keys: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    width, low = bits
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    x = keys >> np.uint64(64 - width)
    for factor in reversed(_FACTORS):
        x = ((x ^ (x >> half)) * np.uint64(pow(factor, -1, 1 << 64))) & mask
    x = x ^ (x >> half)
    return (x >> np.uint64(low)).astype(np.int64), (x & np.uint64((1 << low) - 1)).astype(np.int64)


def suffix_ranks(levels: dict, m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ranks, among grams of one order less, of grams of order ``m`` without their first word."""
    if m == 2:
        return right
    bits = key_bits(levels, m - 1)
    inner = suffix_ranks(levels, m - 1, *gram_parts(levels[m - 1].values(left, "keys")[0], bits))
    distinct, back = np.unique(gram_keys(inner, right, bits), return_inverse=True)
    return levels[m - 1].find(distinct)[back]


def _count_grams(bits: int, levels: dict, m: int):
    def run(batches):
        collector = Collector(bits, key_bits(levels, m)[0])
        for batch in batches:
            for part in _pieces(batch):
                tokens, before = _with_ends(_training(part).column(1))
                if len(tokens):
                    for *_, keys, _ in gram_steps(levels, _ids(levels[1], tokens), before, m):
                        pass
                    yield from collector.add(keys)
        yield from collector.flush()

    return run


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


def _merged(group: pa.Table, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts, a stretch of keys at a time."""
    keys = [unpacked_sorted(k.as_py(), 64 - width) for k in group["keys"]]
    counts = [narrow(unpacked(c.as_py(), np.int64)) for c in group["counts"]]
    some = np.sort(np.concatenate([k[:: 1 + PIECE // 1024] for k in keys]))  # at least one of each
    n = sum(map(len, keys)) // PIECE
    edges = np.unique(some[np.arange(1, n + 1) * len(some) // (n + 1)])
    cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k in keys]
    parts = []
    for i in range(len(edges) + 1):
        stretch = [slice(c[i], c[i + 1]) for c in cuts]
        of_keys, of_counts = (np.concatenate([x[part] for x, part in zip(xs, stretch, strict=True)]) for xs in (keys, counts))
        found, sums = summed(of_keys, of_counts.astype(np.int64))
        parts.append((found, narrow(sums)))
    del keys, counts
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _write_words(folder: str, bits: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        keys, counts = _merged(group)
        put_file(folder, f"words-keys-{bucket:05d}", key_bytes(keys, bits, 64))
        put_file(folder, f"words-counts-{bucket:05d}", small_bytes(counts))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    return run


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def _write_grams(folder: str, m: int, bits: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        keys, counts = _merged(group, width)
        put_file(folder, f"grams{m}-keys-{bucket:05d}", key_bytes(keys, bits, width))
        put_file(folder, f"grams{m}-raw-{bucket:05d}", small_bytes(counts))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "counts": pa.array([_counts_of_counts(counts)], pa.list_(pa.int64()))})

    return run


def _final(level: HashArrays, bucket: int, top: bool) -> np.ndarray:
    """The counts that the model uses: as met for the highest order, else of distinct words
    to the left; grams at the beginning of a text have none and keep the count as met."""
    raw = level.counts(bucket, "raw")
    if top:
        return raw
    lower = level.counts(bucket, "lower")
    return np.where(lower > 0, lower, raw)


_SUMS = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())])


def _send(to: HashArrays, ranks: np.ndarray, counts: np.ndarray | None = None):
    """Sums by rank and range, a row for each range: how often a rank is met or, if there are
    counts, in four cells for each rank the sum of these and how many are 1, 2, 3 or more."""
    if counts is None:
        ranks = np.sort(ranks)
    else:
        order = np.argsort(ranks)
        ranks, counts = ranks[order], counts[order]
        del order
    cuts = np.searchsorted(ranks, to.bases.astype(ranks.dtype))
    parts = np.flatnonzero(to.sizes).tolist()
    rows = [[], []]
    for p in parts:
        cells, weights = ranks[cuts[p] : cuts[p + 1]].astype(np.int64), None
        if counts is not None:
            weights = counts[cuts[p] : cuts[p + 1]].astype(np.int64)
            cells = np.concatenate([cells * 4, cells * 4 + np.minimum(weights, 3)])
            weights = np.concatenate([weights, np.ones(len(weights), np.int64)])
        cells, sums = summed(cells, np.ones(len(cells), np.int64) if weights is None else weights)
        rows[0].append(packed_sorted(cells))
        rows[1].append(packed(sums))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[pa.array(r, pa.binary()) for r in rows]], schema=_SUMS)


def _ranks_of(keys: KeyFile, of) -> np.ndarray:
    """``of`` each key of a file, a rank of a lower order: these are below 2**32."""
    return np.concatenate([of(k).astype(np.uint32) for k in keys.pieces()])


def _suffixes(levels: dict, m: int):
    """For ranges of grams, how many distinct ones end with each gram of one order less."""

    def run(batches):
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                if levels[m].sizes[bucket]:
                    yield _send(levels[m - 1], _ranks_of(levels[m].key_file(bucket), lambda k: suffix_ranks(levels, m, *gram_parts(k, key_bits(levels, m)))))

    return run


def _contexts(levels: dict, m: int, contexts: HashArrays, top: bool):
    """For ranges of grams, by context: the sum of counts, and how many are 1, 2, 3 or more."""

    def run(batches):
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                if levels[m].sizes[bucket]:
                    counts = narrow(_final(levels[m], bucket, top))
                    if not top:
                        put_file(levels[m].folder, f"grams{m}-counts-{bucket:05d}", small_bytes(counts))
                    yield _send(contexts, _ranks_of(levels[m].key_file(bucket), lambda k: gram_parts(k, key_bits(levels, m))[0]), counts)

    return run


def _summed_table(group: pa.Table, to: HashArrays, width: int) -> tuple[int, np.ndarray]:
    part = group["part"][0].as_py()
    flat = np.zeros(int(to.sizes[part]) * width, np.int64)
    for cells, sums in zip(group["cells"], group["sums"], strict=True):
        flat[unpacked_sorted(cells.as_py()).astype(np.int64) - width * int(to.bases[part])] += unpacked(sums.as_py(), np.int64)
    return part, flat.reshape(-1, width)


def _write_lower(to: HashArrays):
    def run(group: pa.Table) -> pa.Table:
        part, table = _summed_table(group, to, 1)
        put_file(to.folder, f"{to.kind}-lower-{part:05d}", small_bytes(table[:, 0]))
        final = table[:, 0] if to.kind == "words" else _final(to, part, False)
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([_counts_of_counts(final)], pa.list_(pa.int64()))})

    return run


#: What is kept of a context: the sum of counts, and how many are 1, 2, 3 or more.
_OF_CONTEXT = ("total", "ones", "twos", "more")


def _write_contexts(to: HashArrays):
    def run(group: pa.Table) -> pa.Table:
        part, table = _summed_table(group, to, 4)
        for i, column in enumerate(_OF_CONTEXT):
            put_file(to.folder, f"{to.kind}-{column}-{part:05d}", small_bytes(table[:, i]))
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of
    keys with counts 1 to 4; where these are too few to tell, halves of the counts."""
    if min(n) <= 0:
        return np.array([0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    found = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(found, [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])


def _score(levels: dict, contexts: dict, model: dict, id_type):
    names = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    types = (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    kind = pa.schema(list(zip(names, types, strict=True)))
    vocab, order = levels[1], max(levels)
    size = int(vocab.bases[-1]) + 1
    losses = {m: np.concatenate([[0], d]) for m, d in model["discounts"].items()}

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                tokens, before = _with_ends(part.column(1))
                distinct, back = np.unique(tokens, return_inverse=True)
                found = vocab.find(distinct)
                count, ending = (x.astype(np.float64) for x in vocab.values(found, "counts", "lower"))
                base = np.log10((count + 1) / (model["tokens"] + size))
                # words: distinct left neighbours, discounted; the rest spread evenly over all words and one unknown
                kept = np.maximum(ending - losses[1][np.minimum(ending, 3).astype(int)], 0) / max(1, model["pairs"])
                p = (kept + model["word_rest"] / size)[back]
                for m, left, _, _, ranks in gram_steps(levels, found[back], before, order):
                    some, again = np.unique(left, return_inverse=True)
                    total, *numbers = contexts[m - 1].values(some, *_OF_CONTEXT)
                    total, freed = total.astype(np.float64)[again], (np.stack(numbers, axis=1).astype(np.float64) @ losses[m][1:])[again]
                    seen = levels[m].values(ranks, "raw" if m == order else "counts")[0].astype(np.float64)
                    direct = np.maximum(seen - losses[m][np.minimum(seen, 3).astype(int)], 0)
                    met = (total > 0) & ((freed > 0) | (direct > 0))
                    p = np.where(met, (direct + freed * p) / np.where(met, total, 1.0), p)
                sums = lambda x: np.add.reduceat(x, before[:-1])  # noqa: B023, E731
                n = np.diff(before)
                columns = (part.column(0), is_held_out(part.column(0).to_pylist()), n, sums((count[back] > 0).astype(np.int64)),
                           np.full(len(n), model["tokens"]), sums(base[back]), sums(np.log10(p)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Learns the model from all documents that are not held out and scores all of them.

    Tokens are words, A-Z lower-cased, and one end per text; the first token's context is
    the beginning of a text. Every gram of up to ``order`` words is counted, none is pruned.
    The probability of a gram is its discounted count over that of its context, plus the
    mass so freed times the probability of the gram without its first word. Counts of
    grams below the highest order are numbers of distinct words to the left, except at the
    beginning of a text; that of words is interpolated with the even distribution over all
    words and an unknown one.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` per
    row; scores are log10 probabilities of whole texts. Null and empty texts are an end
    alone; a null id counts as training; without training rows all words are unknown.
    Repeated rows and ids are counted and scored one by one, very long texts whole; other
    columns are not read. Words, and grams of less than ``order`` words, may number 2**32;
    beyond that the operator stops with an error instead of mixing them up.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    folder = new_folder(spark, "language-model")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(size, spark.sparkContext.defaultParallelism)
    shape, sums = "bucket int, keys binary, counts binary", "part int, cells binary, sums binary"
    found = stored(
        rows.mapInArrow(_count_words(bits), shape).groupBy("bucket").applyInArrow(_write_words(folder, bits), "bucket int, n long, total long"), "lm-words"
    ).collect()  # a row per range of hashes
    vocab = HashArrays(folder, "words", bits, {r["bucket"]: r["n"] for r in found})
    tokens = sum(r["total"] for r in found)
    if int(vocab.bases[-1]) >= (1 << 32) - 1:
        raise ValueError("more than 2**32 words: their numbers would not fit into keys")
    buckets = spark.range(0, 1 << bits, 1, 1 << bits)
    total = lambda rows_: [sum(r["counts"][i] for r in rows_) for i in range(4)]
    levels, seen = {1: vocab}, {}
    for m in range(2, order + 1):
        width, _ = key_bits(levels, m)
        heads = stored(
            rows.mapInArrow(_count_grams(bits, levels, m), shape).groupBy("bucket").applyInArrow(
                _write_grams(folder, m, bits, width), "bucket int, n long, counts array<bigint>"), "lm-grams"
        ).collect()
        levels = levels | {m: HashArrays(folder, f"grams{m}", bits, {r["bucket"]: r["n"] for r in heads}, width)}
        if m < order and int(levels[m].bases[-1]) >= 1 << 32:
            raise ValueError(f"more than 2**32 grams of {m} words: their numbers would not fit into keys")
        seen[m] = total(heads)
        ends = buckets.mapInArrow(_suffixes(levels, m), sums).groupBy("part")
        seen[m - 1] = total(stored(ends.applyInArrow(_write_lower(levels[m - 1]), "part int, counts array<bigint>"), "lm-lower").collect())
    found_discounts = {m: discounts(n) for m, n in seen.items()}
    contexts = {m: levels[m] for m in range(2, order)}
    # the beginning of a text is a context beside the words
    last = {(1 << bits) - 1: int(vocab.sizes[-1]) + 1} if tokens else {}
    contexts[1] = HashArrays(folder, "words", bits, dict(enumerate(vocab.sizes.tolist())) | last)
    for m in range(2, order + 1):
        by_context = buckets.mapInArrow(_contexts(levels, m, contexts[m - 1], m == order), sums).groupBy("part")
        stored(by_context.applyInArrow(_write_contexts(contexts[m - 1]), "part int"), "lm-contexts")
        for b in np.flatnonzero(levels[m].sizes):
            for column in ("raw", "lower") if m < order else ():
                dropped(spark, f"{folder}/grams{m}-{column}-{b:05d}")
    of_words, low = seen[1], found_discounts[1]
    n_pairs, n_words = int(levels[2].bases[-1]), int(vocab.bases[-1])
    more = n_words - of_words[0] - of_words[1]
    rest = (low[0] * of_words[0] + low[1] * of_words[1] + low[2] * max(0, more)) / n_pairs if n_pairs else 1.0
    model = {"tokens": tokens, "pairs": n_pairs, "discounts": found_discounts, "word_rest": rest}
    shape = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(levels, contexts, model, to_arrow_type(kind)), shape).withColumnRenamed("id", id_col)
