"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a multiple of all
   words; a target stops at ``cap`` times its source's words and the excess is shared again by weight.
2. Schedule: slot i gets the golden-ratio point frac(i * phi), held in 32 bits; cumulative weights map the
   point to a source, and the slots of a source are ranked in order. The sequence's discrepancy is
   logarithmic, so any stretch of the schedule holds the sources close to their weights. Ranks that a source
   still lacks at the end follow as a short tail; surplus ranks are left out.
3. Blocks: each source's documents, shuffled by hash and laid end to end once per pass, are cut into blocks
   of equal words. Rank r takes block r, and so a document's place in the mix, once per pass, is the slot of
   the block that it begins in. The last block ends at the target, so a source's words come out at the whole
   number below its target, and no document is taken more often than ``cap`` times.

Ranks and word offsets are prefix sums over two levels (within a chunk or hash range, then over those), so
no task sees a whole source. Only per-source totals reach the driver.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

WEIGHTS = (5, 2, 1)
GOLDEN = 2654435769  # 2**32 over the golden ratio
POINTS = 1 << 32
CHUNK = 1 << 12
RANGE_ROWS = 2_000
MOST_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> dict[str | None, Fraction]:
    """Target words of each source; exact."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left = dict(order), Fraction(share) * sum(n for _, n in order)
    out: dict[str | None, Fraction] = {}
    while rest := [s for s in size if s not in out]:
        unit = left / sum(weight[s] for s in rest)
        over = [s for s in rest if unit * weight[s] > cap * size[s]]
        if not over:
            out |= {s: unit * weight[s] for s in rest}
        for s in over:
            out[s] = Fraction(cap * size[s])
            left -= out[s]
    return out


def _sources(rows: DataFrame, weights: tuple[int, ...], share: float, cap: int, block_words: int) -> list[tuple]:
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    found = totals.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: their totals are held on the driver")
    goal = targets([(r["_source"], r["size"]) for r in found], weights, share, cap)
    order = sorted(found, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    out = []
    for no, r in enumerate(order):
        take = int(goal[r["_source"]])
        blocks, ranges = -(-take // block_words), max(1, -(-r["n"] // RANGE_ROWS))
        out.append((no, r["_source"], r["size"], float(goal[r["_source"]]), take, blocks, ranges))
    return out


def schedule(spark, blocks: list[int]) -> DataFrame:
    """slot, source_no, rank: every rank below ``blocks[source_no]`` once, in low-discrepancy order."""
    total, edges, at = sum(blocks), [], 0
    for n in blocks:
        at += n
        edges.append(at * POINTS // max(total, 1))
    last = max((i for i, n in enumerate(blocks) if n), default=0)

    @F.pandas_udf("int")
    def source_at(points: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(edges, points.to_numpy(), side="right"), last).astype("int32"))

    point = F.expr(f"pmod(pmod(id, {POINTS >> 1}) * {GOLDEN}, {POINTS})")
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk"), source_at(point).alias("source_no"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
    offsets = counts.select("chunk", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("chunk", "source_no").orderBy("slot")
    ranked = slots.join(offsets, ["chunk", "source_no"]).select("slot", "source_no", (F.col("offset") + F.row_number().over(within) - 1).alias("rank"))
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(blocks)] or [(0, 0)], "source_no int, wanted long")
    had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    tail = wanted.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < wanted")
    tail = tail.select((F.lit(total) + F.col("source_no")).alias("slot"), "source_no", F.explode(F.expr("sequence(had, wanted - 1)")).alias("rank"))
    return ranked.join(F.broadcast(wanted), "source_no").filter("rank < wanted").select("slot", "source_no", "rank").unionByName(tail)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, block_words: int = 1024, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, slots.

    ``size`` counts runs of anything but space and \\t to \\r; null texts count 0 and are taken 0 times. ``slots``
    has, for each pass that takes the document, the first slot of the schedule that it fills: sorting by it
    gives the mixed order; it is empty if the mix does not take the document. A null source is a source of its
    own. Equal identifiers are separate rows, ordered by size where their hashes tie; rows alike in everything
    are interchangeable. Very long texts fill several blocks. An empty table gives an empty one. Other columns
    are not read, so none can clash. The result depends on the rows alone, not on how they are partitioned.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size")), "sizes")
    found = _sources(rows, weights, share, cap, block_words)
    columns = "source_no int, _name string, source_size long, target double, take long, blocks long, ranges long"
    info = spark.createDataFrame(found or [(0, None, 0, 0.0, 0, 0, 1)], columns)
    known = rows.join(F.broadcast(info), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    known = known.withColumn("_order", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 31)))
    known = known.withColumn("_range", F.shiftright(F.col("_order") * F.col("ranges"), 31))
    total = Window.partitionBy("source_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("source_no", "_range").agg(F.sum("_size").alias("n"))
    sums = sums.select("source_no", "_range", F.coalesce(F.sum("n").over(total), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source_no", "_range").orderBy("_order", "_id", "_size")
    so_far = F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = known.join(sums, ["source_no", "_range"]).withColumn("_row", F.row_number().over(within))
    placed = placed.withColumn("_start", F.col("_before") + so_far)
    start, end = "(_start + pass * source_size)", "least(_start + pass * source_size + _size, take)"
    pieces = F.expr(f"""
        flatten(transform(sequence(0, {cap - 1}), pass -> if(_size > 0 and {start} < take,
            transform(sequence({start} div {block_words}, ({end} - 1) div {block_words}),
                block -> named_struct('pass', pass, 'rank', block, 'words',
                    least({end}, (block + 1) * {block_words}) - greatest({start}, block * {block_words}))),
            array())))""")
    key = ["source_no", "_range", "_row", "_id", "_source", "_size", "source_size", "target"]
    cut = placed.select(*key, pieces.alias("_pieces"))
    # what no pass takes has no rank, and stays out of the join with the slots
    alone = cut.filter(F.size("_pieces") == 0).select(*key, F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<long>)").alias("slots"))
    cut = cut.filter(F.size("_pieces") > 0).select(*key, F.explode("_pieces").alias("_piece")).select(*key, "_piece.*")
    taken = cut.join(schedule(spark, [x[5] for x in found]), ["source_no", "rank"])
    first = [F.min(F.when(F.col("pass") == p, F.struct("rank", "slot"))) for p in range(cap)]
    slots = F.array_compact(F.array(*[x["slot"] for x in first])).alias("slots")
    out = taken.groupBy(*key).agg(F.sum("words").alias("taken"), slots).unionByName(alone)
    names = [F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size")]
    return out.select(*names, "source_size", "target", "taken", "slots")
