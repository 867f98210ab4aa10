"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.shared import shared_dir, stored, text_crc


def ring(spark, n_shards: int, vnodes: int, cells: int) -> DataFrame:
    """The virtual nodes: ``(cell, shard)``, a place on the circle of cells each."""
    nodes = spark.range(n_shards * vnodes, numPartitions=1)
    shard = (F.col("id") % n_shards).cast("int")
    place = F.pmod(F.xxhash64(F.lit("node"), shard, F.floor(F.col("id") / n_shards)), F.lit(cells))
    return nodes.select(place.cast("int").alias("cell"), shard.alias("shard"))


def _walk(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sends each unit clockwise to the first node; beyond the last cell, to the first node."""
    both = units.withColumn("node", F.lit(None).cast("int")).unionByName(
        nodes.select("cell", F.col("shard").alias("node")), allowMissingColumns=True
    )
    at = W.orderBy("cell", F.col("node").isNotNull(), "node")
    ahead = F.first("node", ignorenulls=True).over(at.rowsBetween(0, W.unboundedFollowing))
    start = F.first("node", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumn("to", F.coalesce(ahead, start)).where(F.col("sub").isNotNull()).drop("node")


def assign_units(units: DataFrame, nodes: DataFrame, n_shards: int, capacity: int) -> DataFrame:
    """``units(cell, sub, bytes, n)`` with their ``shard``.

    In each round every unplaced unit walks clockwise to the first node of an open shard.
    A shard takes its arrivals, largest first, up to the one that would bring it more
    than half that unit beyond ``capacity``; with a unit left over it is full and closes,
    so there are at most ``n_shards`` such rounds. What is left when all are closed, a
    few units at most, walks to shards below ``capacity``.
    """
    shared_dir(units.sparkSession)
    placed = units.withColumn("shard", F.lit(None).cast("int")).checkpoint()
    closed: set[int] = set()
    for _ in range(2 * n_shards):
        loads = placed.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("load"))
        load = F.coalesce("load", F.lit(0))
        strict = len(closed) < n_shards
        open_nodes = nodes.join(F.broadcast(loads), "shard", "left")
        open_nodes = open_nodes.where(~F.col("shard").isin(sorted(closed)) if strict else load < capacity)
        waiting = _walk(placed.where("shard is null").drop("shard"), open_nodes)
        order = W.partitionBy("to").orderBy(F.desc("bytes"), "cell", "sub")
        before = F.sum("bytes").over(order) - F.col("bytes")
        fits = load + before + (F.col("bytes") / 2 if strict else F.lit(1)) <= capacity
        taken = waiting.join(F.broadcast(loads.withColumnRenamed("shard", "to")), "to", "left").withColumn(
            "shard", F.when(fits, F.col("to"))
        )
        done = placed.where("shard is not null").withColumn("to", F.col("shard"))
        placed = done.unionByName(taken.select(done.columns)).checkpoint()
        over = [r[0] for r in placed.where("shard is null").select("to").distinct().collect()]  # shards
        if not over:
            break
        closed.update(over)
        placed = placed.drop("to")
    return placed.drop("to")


def shard(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = 128,
    cells: int = 2**14,
) -> DataFrame:
    """Places every row in one of ``n_shards`` shards of nearly equal bytes.

    Rows hash by id to a cell of the circle (by text where the id is null). The rows of
    a cell are cut into units; a cell of ordinary size is one unit, a cell that holds a
    large part of all rows many. Units, at most ``cells + 2**13`` whatever the input
    size, are then placed by the ring with bounded loads: the capacity is the mean load,
    and a unit that meets a full shard continues clockwise.

    Returns ``id_col, size, text_crc32, shard, slot``: size is UTF-8 bytes plus 8 (a null
    text has 0 bytes), slots are gapless from 0 in each shard. Repeated rows and ids are
    separate rows, and rows that tie in all columns are told apart by their place in the
    table; an empty table gives no rows; a very long text is a large unit; other columns are
    not read, so their names may be any.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
            text_crc(F.col(text_col)).alias("crc"),
            key.alias("key"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",  # row numbers have to stay
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
        )
    per_unit = max(64, -(-count // 2**13))
    cell = F.pmod(F.col("key"), F.lit(cells)).cast("int")
    rows = rows.withColumn("cell", cell)
    # a row per cell; a cell with more than one unit deals its rows out by number
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / per_unit).alias("units"))
    rows = rows.join(F.broadcast(counts), "cell")
    rows = rows.withColumn("sub", F.when(F.col("units") > 1, F.pmod(F.xxhash64("row"), F.col("units"))).otherwise(0).cast("int"))
    order = W.partitionBy("cell", "sub").orderBy("key", "id", "size", "crc", "row")
    rows = rows.withColumn("rank", F.row_number().over(order) - 1).drop("units")
    units = rows.groupBy("cell", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = assign_units(units, ring(spark, n_shards, vnodes, cells), n_shards, -(-total // n_shards))
    along = W.partitionBy("shard").orderBy("cell", "sub")
    placed = placed.withColumn("base", F.sum("n").over(along) - F.col("n"))
    # at most cells + 2**13 rows of five numbers
    found = rows.join(F.broadcast(placed.select("cell", "sub", "shard", "base")), ["cell", "sub"])
    slot = F.col("base") + F.col("rank")
    return found.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("long").alias("slot")
    )
