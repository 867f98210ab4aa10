"""Token ids in binary files: patched frame-of-reference blocks with an index."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.shared import get_file, new_folder, put_file, stored
from loomgraph.llm.tokens import encoder, slices

#: Fixed values of the file format: magic, values per block, share of values that fit.
MAGIC, BLOCK, PERCENTILE = b"PFR1", 1024, 95
#: A file is closed once it holds so many ids.
FILE_IDS = 8_000_000


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of an id array, and where each starts.

    A block is its minimum (u32), bit width (u8), number of exceptions (u16), the
    exceptions' places (u16 each) and values (u32 each), and bit planes of all values
    less the minimum. The width fits the 95th percentile; what does not fit is an exception.
    """
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    values = padded.reshape(n, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    place = -(-PERCENTILE * (BLOCK - 1) // 100)
    fitting = np.partition(rest, place, axis=1)[:, place] if n else np.zeros(0, np.uint32)
    widths = np.array([int(x).bit_length() for x in fitting], np.uint8)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths):
        for some in np.array_split(at := np.flatnonzero(widths == width), -(-len(at) // 256)):
            block = rest[some]
            over = block >> np.uint32(width) > 0 if width < 32 else np.zeros(block.shape, bool)
            planes = [np.packbits(((block >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(width)]
            body = np.concatenate(planes, axis=1) if planes else np.zeros((len(some), 0), np.uint8)
            for k, i in enumerate(some):
                places = np.flatnonzero(over[k]).astype("<u2")
                head = struct.pack("<IBH", int(low[i]), int(width), len(places))
                out[i] = head + places.tobytes() + block[k][places].astype("<u4").tobytes() + body[k].tobytes()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in out], dtype=np.int64)]).astype("<u8")
    return b"".join(out), starts


def unpack_block(data: memoryview) -> np.ndarray:
    """The values of the block at the start of ``data``."""
    low, width, n = struct.unpack_from("<IBH", data)
    places = np.frombuffer(data, "<u2", n, 7)
    patches = np.frombuffer(data, "<u4", n, 7 + 2 * n)
    planes = np.frombuffer(data, np.uint8, width * BLOCK // 8, 7 + 6 * n).reshape(width, BLOCK // 8)
    size = next(n for n in (1, 2, 4) if width <= 8 * n)  # bytes of a value
    bits = np.zeros((8 * size, BLOCK), np.uint8)
    bits[8 * size - width :] = np.unpackbits(planes[::-1], axis=1)
    values = np.packbits(np.ascontiguousarray(bits.T)).view(f">u{size}").astype(np.uint32)
    values[places] = patches
    return values + np.uint32(low)


def file_bytes(lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: magic, counts, block starts, document lengths, blocks."""
    blocks, starts = pack_blocks(ids)
    head = MAGIC + struct.pack("<QQQ", len(lengths), len(ids), len(starts))
    return head + starts.tobytes() + np.array(lengths, "<u8").tobytes() + blocks


class TokenFile:
    """Reads a file of :func:`file_bytes`; any range of ids is decoded from its blocks alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_starts = struct.unpack_from("<QQQ", data, 4)
        self.block_starts = np.frombuffer(data, "<u8", n_starts, 28)
        self.lengths = np.frombuffer(data, "<u8", n_docs, 28 + 8 * n_starts).astype(np.int64)
        self.blocks = memoryview(data)[28 + 8 * n_starts + 8 * n_docs :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        parts = [unpack_block(self.blocks[int(self.block_starts[i]) :]) for i in range(first, last + 1)]
        return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self):
        """Each document's first id's place and its ids, some thousand blocks at a time."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            start = int(ends[at] - self.lengths[at])
            upto = max(at + 1, int(np.searchsorted(ends, start + 1024 * BLOCK, "right")))
            ids = self.ids(start, int(ends[upto - 1]))
            for k in range(at, upto):
                low = int(ends[k] - self.lengths[k]) - start
                yield start + low, ids[low : low + int(self.lengths[k])]
            at = upto


def _writer(folder: str, tokenizer_json: str, end_id: int, keeps_space: bool, file_ids: int, id_type):
    """A map of sorted (id, text) to one row per file written."""
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("ids", pa.list_(id_type))])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer_json, keeps_space)
        names, arrays, count = [], [], 0

        def close():
            data = file_bytes([len(a) for a in arrays], np.concatenate(arrays).astype(np.uint32))
            file = put_file(folder, f"ids-{part:06d}-{seq:04d}.pfr", data)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [file], "n_ids": [count], "ids": [names]}, schema=kind)

        for batch in batches:
            for rows in slices(batch):
                for (name, _), ids in zip(rows, encode.encode([t or "" for _, t in rows]), strict=True):
                    names.append(name)
                    arrays.append(np.append(ids, np.array(end_id, ids.dtype)))
                    count += len(arrays[-1])
                    if count >= file_ids:
                        yield close()
                        names, arrays, count, seq = [], [], 0, seq + 1
        if names:
            yield close()
        encode.settle()

    return run


def _reader(id_type):
    """A map of (file, base, ids) to one row per document, decoded from the file."""
    kind = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for file, base, names in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = [(s + base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for s, ids in TokenFile(get_file(file)).documents()]
                columns = [names, *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return run


def write_ids(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keeps_space: bool = True,
    file_ids: int = FILE_IDS,
    folder: str | None = None,
) -> DataFrame:
    """Writes the ids of all documents as files in ascending id order; returns the manifest.

    Range partitions of the ids are sorted and written by their tasks into the shared
    ``folder``; a file name depends on the partition alone and appears in one step, so a
    repeated task replaces its file by the same. ``manifest(file, base, ids)`` has a row
    per file: its path, the number of ids in all files before it, its documents in order.
    Null texts are empty, null ids come first, equal ids are ordered by text.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    write = _writer(folder, tokenizer_json, end_id, keeps_space, file_ids, to_arrow_type(kind))
    manifest = stored(
        ordered.mapInArrow(write, f"part int, seq int, file string, n_ids long, ids array<{kind.simpleString()}>"), "token-manifest"
    )
    base = F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    bases = manifest.select("file", F.coalesce(base, F.lit(0)).alias("base"))  # a row per file
    return manifest.join(bases, "file").select("file", "base", "ids")


def read_ids(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files of a manifest back: ``id_col, start, n_tokens, ids_crc32`` per document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = manifest.schema["ids"].dataType.elementType
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = f"id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long"
    found = manifest.select("file", "base", "ids").repartition(parts).mapInArrow(_reader(to_arrow_type(kind)), shape)
    return found.withColumnRenamed("id", id_col)
