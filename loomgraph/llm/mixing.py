"""Mixing sources to target weights by a low-discrepancy schedule of token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.shared import WORD, stored

#: The fractional part of the golden ratio times 2**32, as an odd whole number.
GOLDEN = 2654435769
POINTS = 2**32


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes(source, words)`` with ``target``, one row per source.

    Sources in code-point order, null last, take the weights in turn and share ``share``
    of all words. A target stops at ``most`` times its source's words and the excess goes
    to the others by weight. In order of words per weight the stopped sources come first,
    so running sums show where stopping ends. This sorts one row per source.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weighed = sizes.withColumn("weight", F.element_at(cycle, place % len(weights) + 1))
    cap = F.col("words") * F.lit(float(most))
    filling = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    total = F.sum("words").over(W.partitionBy()) * F.lit(float(share))
    earlier = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, W.unboundedFollowing)
    level = (total - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    stopped = cap <= F.col("weight") * level
    levelled = weighed.withColumn("level", F.when(~stopped, level))
    common = F.max("level").over(W.partitionBy())  # that of the first source that is not stopped
    return levelled.select(
        "source", "words", F.coalesce(F.least(cap, F.col("weight") * common), cap).alias("target")
    )


def layout(docs: DataFrame, sizes: DataFrame, seed: int, cell_words: int) -> DataFrame:
    """Places the documents of a source end to end in shuffled order.

    The order is that of hash cells, then of hashes. Each source has a cell for every
    ``cell_words`` of its words; sums per cell give a cell's start, a running sum inside
    the cell the document's, so no source's rows meet in one task.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col("words") / cell_words))
    mixed = F.xxhash64("id", "crc", F.lit(seed))
    celled = docs.join(sizes, docs["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
    celled = celled.withColumn("mixed", mixed).withColumn("cell", F.pmod("mixed", cells))
    sums = celled.groupBy("source_no", "cell").agg(F.sum("size").alias("cell_size"))
    # few cells per source: their number follows the total over cell_words
    start = F.sum("cell_size").over(W.partitionBy("source_no").orderBy("cell")) - F.col("cell_size")
    sums = sums.select("source_no", "cell", start.alias("cell_start"))
    inside = W.partitionBy("source_no", "cell").orderBy(F.col("size") == 0, "mixed", "id", "size", "crc")
    placed = celled.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    placed = placed.withColumn("place", F.row_number().over(inside))
    return placed.join(sums, ["source_no", "cell"]).withColumn("start", F.col("cell_start") + F.col("before"))


def point_of(slot: Column) -> Column:
    """``slot`` times the golden ratio, modulo 1, in units of 1 / POINTS.

    The factor is multiplied by halves, so no product leaves 64 bits however large the slot.
    """
    low = F.pmod(slot, F.lit(POINTS))
    high = F.pmod(low * F.lit(GOLDEN >> 16), F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(high + low * F.lit(GOLDEN & 0xFFFF) + F.lit(POINTS // 2), F.lit(POINTS))


def schedule(sizes: DataFrame, slots: int) -> DataFrame:
    """Slots of the mix with source and rank: ``(source_no, block)``.

    Slot i has the point i * golden ratio mod 1; the source whose interval of cumulative
    target shares holds the point owns the slot, and the slots of a source are ranked in
    order of i. Ranks come from counts per stretch of slots and a running number inside.
    """
    spark = sizes.sparkSession
    stretch = 4096
    total = F.sum("target").over(W.partitionBy())
    upto = F.sum("target").over(W.orderBy("source_no"))
    edges = sizes.select(
        "source_no",
        F.floor(F.try_divide(upto - F.col("target"), total) * POINTS).alias("low"),
        F.floor(F.try_divide(upto, total) * POINTS).alias("high"),
    ).where("high > low")
    points = spark.range(slots).select(F.col("id").alias("slot"), point_of(F.col("id")).alias("point"))
    # met by stretches of the point range, so that neither side is sent to every task
    part = POINTS // 1024
    edges = edges.withColumn("part", F.explode(F.expr(f"sequence(low div {part}, (high - 1) div {part})")))
    owned = points.withColumn("part", F.expr(f"point div {part}")).join(edges, "part")
    owned = owned.where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    owned = owned.withColumn("stretch", F.expr(f"slot div {stretch}"))
    counts = owned.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source_no").orderBy("stretch")) - F.col("n")
    counts = counts.select("source_no", "stretch", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("source_no", "stretch").orderBy("slot")) - 1
    ranked = owned.withColumn("inside", inside).join(counts, ["source_no", "stretch"])
    return ranked.select("source_no", (F.col("before") + F.col("inside")).alias("block"), "slot")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 4096,
    least_slots: int = 2**16,
    seed: int = 7,
) -> DataFrame:
    """How many words the mix takes of every document.

    A source's documents lie end to end in shuffled order and form blocks of equal
    words; ``most`` passes over them are possible. The schedule has a slot for each block
    of the mix (at most ``block_words`` words, and so short that there are about
    ``least_slots``); the slots ranked 0, 1, ... of a source take its blocks in order.
    A document gets the words in which it overlaps taken blocks.

    Returns ``id_col, size, source_size, target, taken, text_crc32``, one row per input row;
    size counts words, a null text has none. A null source is a source of its own,
    last in order; sources without words have target 0; repeated rows are separate;
    reruns agree, since hashes of id and text fix every order. Very long texts count whole
    and may lie in many blocks; other columns are not read, so their names may be any.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"))
    sizes = stored(targets(sizes, weights, share, most).withColumn(
        "source_no", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    ), "mix-sources")
    wanted, words = sizes.agg(F.sum("target"), F.sum("words")).first()
    wanted = wanted or 0.0
    block = max(1, min(block_words, int(wanted // least_slots)))
    slots = int(-(-wanted // block)) if wanted else 0
    placed = layout(rows, sizes, seed, cell_words=max(2**18, (words or 0) // 2**14))
    passes = F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1)))
    spans = placed.where("size > 0").select("source_no", "cell", "place", "words", "start", "size", passes.alias("pass"))
    spans = spans.withColumn("from", F.col("start") + F.col("pass") * F.col("words"))
    spans = spans.withColumn("to", F.col("from") + F.col("size"))
    parts = spans.withColumn("block", F.explode(F.expr(f"sequence(`from` div {block}, (`to` - 1) div {block})")))
    taken = parts.join(schedule(sizes, slots), ["source_no", "block"])
    overlap = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    taken = taken.groupBy("source_no", "cell", "place").agg(F.sum(overlap).alias("taken"))
    found = placed.join(taken, ["source_no", "cell", "place"], "left")
    return found.select(
        F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("crc").cast("long").alias("text_crc32"),
    )
