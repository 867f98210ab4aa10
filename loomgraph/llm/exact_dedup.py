"""Exact deduplication with a log-structured merge index of text digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.shared import let_go, stored

SPACES = b" \t\n\x0b\x0c\r"
#: Bits per digest of a run's filter, and probes.
FILTER_BITS, FILTER_PROBES = 10, 4
#: The largest filter of hits that is sent to every task; beyond it all texts are shuffled.
HELD_FILTER_BYTES = 16 << 20
#: Rows for each digest range, at most: a task compacts one range.
BUCKET_ROWS = 2_000_000


def normalised(text: bytes) -> bytes:
    """The text without ASCII white space."""
    return text.translate(None, SPACES)


def filter_of(heads: np.ndarray, n_bits: int | None = None) -> np.ndarray:
    """A Bloom filter, as packed bits, of 64-bit digest heads."""
    n_bits = n_bits or max(64, FILTER_BITS * len(heads))
    bits = np.zeros(n_bits, bool)
    for k in range(FILTER_PROBES):
        bits[_probe(heads, k) % np.uint64(n_bits)] = True
    return np.packbits(bits)


def may_hold(packed: np.ndarray, heads: np.ndarray, n_bits: int) -> np.ndarray:
    found = np.ones(len(heads), bool)
    for k in range(FILTER_PROBES):
        at = _probe(heads, k) % np.uint64(n_bits)
        found &= (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return found


def _probe(heads: np.ndarray, k: int) -> np.ndarray:
    mixed = (heads + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(31))


def heads_of(keys: list[bytes]) -> np.ndarray:
    """The first eight bytes of each key as a number."""
    return np.array([int.from_bytes(k[:8].ljust(8, b"\0"), "big") for k in keys], np.uint64)


def _heads(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(heads_of(batch.column(0).to_pylist()).view(np.int64))], ["head"])


def _digests(key_bytes: int, with_text: bool, held: tuple[bytes, int] | None):
    """A map of batches (id, text) to (id, n_cp, sha, key) or, for hits, with the text."""

    def run(batches):
        let_go("encoders")
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows = {"id": [], "n_cp": [], "sha": [], "key": [], "norm": []}
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py() or ""
                norm = normalised(raw.encode())
                sha = hashlib.sha256(norm).digest()
                rows["id"].append(id_.as_py())
                rows["n_cp"].append(len(raw))
                rows["sha"].append(sha.hex())
                rows["key"].append(sha[:key_bytes])
                rows["norm"].append(norm if with_text else None)
            kind = {"id": batch.schema.field(0).type, "n_cp": pa.int64(), "sha": pa.string(), "key": pa.binary(), "norm": pa.binary()}
            made = pa.RecordBatch.from_pydict(rows, schema=pa.schema(list(kind.items())))
            if held is not None and made.num_rows:
                packed, n_bits = np.frombuffer(held[0], np.uint8), held[1]
                made = made.filter(pa.array(may_hold(packed, heads_of(rows["key"]), n_bits)))
            yield made if with_text else made.drop_columns(["norm"])

    return run


def _better(a: tuple, b: tuple) -> tuple:
    """Of two candidates (n_cp, id, rid, count) the one that stays, with both counts."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    first = a if rank(a) <= rank(b) else b
    return (*first[:3], a[3] + b[3])


def _memtables(id_type: pa.DataType, n_buckets: int, memtable_rows: int):
    """A map of (id, n_cp, key, rid) to sorted runs, one per bucket and flush."""
    schema = pa.schema([("key", pa.binary()), ("n_cp", pa.int64()), ("id", id_type), ("rid", pa.int64()), ("n", pa.int64())])

    def flush(table: dict):
        by_bucket: dict[int, list] = {}
        for key in sorted(table):
            by_bucket.setdefault(int.from_bytes(key[:4].ljust(4, b"\0"), "big") % n_buckets, []).append(key)
        out = {"bucket": [], "run": [], "filter": [], "bits": []}
        for bucket, keys in by_bucket.items():
            columns = [keys, *[[table[k][i] for k in keys] for i in range(4)]]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
            heads = heads_of(keys)
            out["bucket"].append(bucket)
            out["run"].append(batch.serialize().to_pybytes())
            out["filter"].append(filter_of(heads).tobytes())
            out["bits"].append(max(64, FILTER_BITS * len(heads)))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("filter", pa.binary()), ("bits", pa.int64())]))

    def run(batches):
        table: dict[bytes, tuple] = {}
        for batch in batches:
            for id_, n_cp, key, rid in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                new = (n_cp, id_, rid, 1)
                old = table.get(key)
                table[key] = _better(old, new) if old else new
            if len(table) >= memtable_rows:
                yield flush(table)
                table = {}
        if table:
            yield flush(table)

    return run, schema


def _compact(schema: pa.Schema):
    """Merges the runs of a bucket. A key that no other run's filter may hold is copied."""

    def run(group: pa.Table) -> pa.Table:
        runs = [pa.ipc.read_record_batch(pa.py_buffer(r), schema) for r in group["run"].to_pylist()]
        filters = [(np.frombuffer(f, np.uint8), b) for f, b in zip(group["filter"].to_pylist(), group["bits"].to_pylist(), strict=True)]
        copied, merged = [], {}
        for i, batch in enumerate(runs):
            heads = heads_of(batch.column(0).to_pylist())
            shared = np.zeros(len(heads), bool)
            for j, (packed, bits) in enumerate(filters):
                if i != j:
                    shared |= may_hold(packed, heads, bits)
            copied.append(batch.filter(pa.array(~shared)))
            for key, *value in zip(*[c.to_pylist() for c in batch.filter(pa.array(shared)).columns], strict=True):
                old = merged.get(key)
                merged[key] = _better(old, tuple(value)) if old else tuple(value)
        keys = sorted(merged)
        columns = [keys, *[[merged[k][i] for k in keys] for i in range(4)]]
        rest = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
        return pa.Table.from_batches([*copied, rest], schema=schema)

    return run


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_bytes: int = 16,
    memtable_rows: int = 200_000,
) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when their bytes without ASCII white space are. Each task collects
    digests in a memtable, which keeps the best row and the count of each digest and is
    flushed as sorted runs with filters; compaction merges the runs of a digest range.
    So a digest of any number of rows is one entry per flush. All rows with the digest of
    another are then compared byte by byte with the row that stays; where a digest
    collision is found, that digest's rows are grouped by their bytes instead.

    Of a group the row with the most code points of the original text stays, then the
    smallest id (null last), then one of fully equal rows. A null text counts as empty
    and equals other texts without a visible character. Returns ``id_col, keep_id,
    group_size, kept, text_sha256``, one row per input row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = base.schema["id"].dataType
    id_type, sql_type = to_arrow_type(id_kind), id_kind.simpleString()
    shape = f"id {sql_type}, n_cp long, sha string, key binary"
    rows = base.mapInArrow(_digests(key_bytes, False, None), shape)
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "dedup-digests")
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS)
    fill, schema = _memtables(id_type, n_buckets, memtable_rows)
    runs = rows.select("id", "n_cp", "key", "rid").mapInArrow(fill, "bucket int, run binary, filter binary, bits long")
    index = stored(
        runs.groupBy("bucket").applyInArrow(_compact(schema), f"key binary, n_cp long, id {sql_type}, rid long, n long"),
        "dedup-index",
    ).select("key", F.col("n_cp").alias("keep_cp"), F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid"), "n")

    hits = index.where("n > 1")
    held = None
    n_hits = hits.count()
    if n_hits * FILTER_BITS <= 8 * HELD_FILTER_BYTES:
        n_bits = max(64, FILTER_BITS * n_hits)
        heads = hits.select("key").mapInArrow(_heads, "head long").toArrow()["head"].to_numpy()  # bounded above
        packed = filter_of(heads.view(np.uint64), n_bits)
        held = (packed.tobytes(), n_bits)
    texts = base.mapInArrow(_digests(key_bytes, True, held), shape + ", norm binary")
    texts = stored(texts.join(hits.select("key", "keep_id", "keep_cp"), "key"), "dedup-hits")
    keeper = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    keepers = texts.where(keeper).groupBy("key").agg(F.min("norm").alias("keep_norm"))
    keepers = stored(keepers, "dedup-keepers")
    # without distinct(), so that a join with a very large group may be split
    differing = stored(texts.join(keepers, "key").where(F.col("norm") != F.col("keep_norm")).select("key"), "dedup-collisions")
    out = [
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"),
    ]
    if differing.isEmpty():
        return rows.join(index, "key").select(*out)
    plain = rows.join(differing, "key", "left_anti").join(index, "key").select(*out)
    # the full digests of colliding keys differ, or else their bytes decide
    names = texts.join(differing, "key", "left_semi").select("key", "id", "n_cp", "sha", F.sha2("norm", 512).alias("bytes"))
    names = names.distinct()
    exact = rows.join(differing, "key", "left_semi").join(
        names, (rows["key"] == names["key"]) & rows["id"].eqNullSafe(names["id"])
        & (rows["n_cp"] == names["n_cp"]) & (rows["sha"] == names["sha"]),
    ).select(rows["*"], names["bytes"])
    best = exact.groupBy("key", "bytes").agg(
        F.min(F.struct(-F.col("n_cp"), F.col("id").isNull(), "id", "rid")).alias("b"), F.count("*").alias("n")
    )
    best = best.select("key", "bytes", F.col("b.id").alias("keep_id"), F.col("b.rid").alias("keep_rid"), "n")
    return plain.unionByName(exact.join(best, ["key", "bytes"]).select(*out))
