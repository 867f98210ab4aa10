"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import stored, trimmed
from loomgraph.llm.tokens import encoder, slices

#: Buckets of a document vector; dimensions of its projection and bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 3, 10
#: Chunks that a worker remembers: as many as a dictionary holds before it grows to 2^21 places.
REMEMBERED = 690_000


def projection() -> np.ndarray:
    """Fixed signs: the projection of hashed vectors to few dimensions."""
    x = np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(1)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(x >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Counts of the ids in hashed buckets, damped and of length one."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    counts = np.log1p(np.bincount(hashed, minlength=BUCKETS))
    return counts / max(1e-9, float(np.sqrt((counts**2).sum())))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with ``bits`` bits in each dimension.

    Gray-code form: undo the turns from the highest bit down, then weave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turn = (x[i] & q) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(turn, x[i], x[i] ^ swap) if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """The curve keys of document vectors: project, spread over a grid, find the place."""
    points = vectors @ projection()
    cells = np.clip((np.tanh(points) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS)


def _tokenise(tokenizer_json: str, end_id: int, id_type):
    kind = pa.schema([("id", id_type), ("curve", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        trimmed()  # of what other operators' tasks left in this worker
        encode = encoder(tokenizer_json, False, REMEMBERED)
        for batch in batches:
            for rows in slices(batch):
                found = [np.append(x, np.array(end_id, x.dtype)) for x in encode.encode([t or "" for _, t in rows])]
                keys = curve_keys(np.stack([document_vector(x) for x in found]))
                data = [[r[0] for r in rows], keys, [x.astype("<u4" if x.dtype.itemsize == 4 else "<u2").tobytes() for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, kind, strict=True)], schema=kind)
        encode.settle()

    return run, encoder(tokenizer_json, False).dtype.str


def _pack(length: int, dtype: str, id_type):
    """A map of (id, ids), in curve order, to pieces of sequences."""
    names = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    kind = pa.schema([(n, id_type if n == "id" else pa.int64()) for n in names])

    def run(batches):
        base, sequence = TaskContext.get().partitionId() << 40, 0
        pieces: list[tuple] = []  # of the open sequence
        filled = 0
        rows: list[tuple] = []

        def emit(parts):
            at = 0
            for name, start, ids, total in parts:
                rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + sequence, at))
                at += len(ids)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
            rows.clear()
            return out

        for got in batches:
            for name, data in zip(*[c.to_pylist() for c in got.columns], strict=True):
                ids = np.frombuffer(data, dtype)
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - filled]
                    pieces.append((name, start, part, len(ids)))
                    start, filled = start + len(part), filled + len(part)
                    if filled == length:
                        emit(pieces)
                        pieces, filled, sequence = [], 0, sequence + 1
            if rows:
                yield batch()
        # the rest fills sequences whose lengths are powers of two, which need no padding
        for power in [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]:
            parts, room = [], power
            while room:
                name, start, ids, total = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (name, start + room, ids[room:], total))
                    ids = ids[:room]
                parts.append((name, start, ids, total))
                room -= len(ids)
            emit(parts)
            sequence += 1
        if rows:
            yield batch()

    return run


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    A document's ids, with the end id, are hashed to a vector that is projected to three
    dimensions; its place on the Hilbert curve is its key. Range partitions of the key
    (ties, such as copies, spread by a hash of the id) are sorted, and the documents of a
    partition are laid end to end and cut every ``length`` tokens, so that neighbours in
    content share sequences. The last, short part of a partition becomes sequences whose
    lengths are powers of two: nothing is padded.

    Returns pieces ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A null or empty text is its end id alone; repeated rows and ids are separate
    documents; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    id_type, name = to_arrow_type(kind), kind.simpleString()
    tokenise, dtype = _tokenise(tokenizer_json, end_id, id_type)
    found = stored(rows.mapInArrow(tokenise, f"id {name}, curve long, ids binary"), "pack-ids")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("id", "ids")
    ordered = found.withColumn("spread", spread).repartitionByRange(parts, "curve", "spread")
    ordered = ordered.sortWithinPartitions("curve", "spread", "id").select("id", "ids")
    shape = f"id {name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(_pack(length, dtype, id_type), shape).withColumnRenamed("id", id_col)
