"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input makes a run: its digests in sorted order, each with the identifier to keep, a
count and an independent check. Runs are numbered by partition. In round r, run i meets the runs whose numbers
differ from it in the r-th digit (base ``radix``; with 2 the rounds are those of a binomial tree): they are
dealt to one task by their common number and sorted, and a multiway merge passes over the neighbours of equal
digest, verifies that their checks agree, and retains one entry with the best identifier. After as many rounds
as the number of runs has digits one run is left. A run is cut in lanes by the leading bits of its digests, as
many lanes as there are runs, so that the last rounds are as parallel as the first.

A digest that a third of all rows share is one entry of each run after the first merge, and at most ``radix``
entries of any later one. The result goes back down: one entry per (digest, run), joined to that run's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import Hot, Workspace, tidy

RADIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 of each whole text after lower-casing A-Z only; null counts as empty."""
    return F.sha2(_normal(text), 256)


def check(text: Column) -> Column:
    """A second hash of what :func:`digest` reads, independent of it, and its length."""
    return F.concat_ws("/", F.md5(_normal(text)), F.octet_length(_normal(text)).cast("string"))


def _normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary")


def merge(runs: DataFrame, keep: str = "max") -> DataFrame:
    """One round: the entries (node, lane, digest, keep_id, group_size, check) of equal node and digest, merged.

    The rows of a node are sorted by lane and digest first, so its runs meet as one sorted stream, and a task
    holds one entry at a time. Null identifiers lose to all others.
    """
    columns = ["node", "lane", "digest", "keep_id", "group_size", "check"]
    better = (lambda a, b: a > b) if keep == "max" else (lambda a, b: a < b)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kinds = None, None, None
        for batch in batches:
            out, kinds = [], batch.schema
            for node, lane, name, best, size, proof in zip(*(c.to_pylist() for c in batch.columns)):
                if (node, name) != at:
                    if held is not None:
                        out.append(held)
                    at, held = (node, name), [node, lane, name, best, size, proof]
                    continue
                if proof != held[5]:
                    raise ValueError(f"texts of digest {name} differ")
                held[4] += size
                if best is not None and (held[3] is None or better(best, held[3])):
                    held[3] = best
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], names=columns)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, kinds)], names=columns)

    rows = runs.select(*columns)
    kind = rows.schema["keep_id"].dataType.simpleString()
    schema = f"node int, lane int, digest string, keep_id {kind}, group_size long, check string"
    return rows.repartition("node", "lane").sortWithinPartitions("node", "lane", "digest").mapInArrow(run, schema)


def tree(rows: DataFrame, n_runs: int, keep: str, radix: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The runs of ``rows`` (_id, digest, check, run), and the one run that they merge to."""
    lane = F.shiftright(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long") * n_runs, 28).cast("int")
    entries = rows.select(
        F.col("run").alias("node"), lane.alias("lane"), "digest", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "check"
    )
    first = level = work.write(merge(entries, keep), "runs")
    left = n_runs
    while left > 1:
        left = -(-left // radix)
        level = merge(level.withColumn("node", F.expr(f"node div {radix}").cast("int")), keep)
    return first, level


def annotate(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z. ``keep`` says whether the largest or the
    smallest identifier stays. Null texts equal empty ones, very long ones are digested whole. Null identifiers
    lose to all others; a group of only null ones keeps null. Rows that repeat an identifier within a group are
    all marked as kept, and count each. An empty table gives an empty one. Other columns are not read, so none
    can clash.
    """
    work = Workspace(docs.sparkSession, "digests")
    text = F.col(text_col)
    run = F.spark_partition_id().alias("run")  # written, so that every later read sees the same
    rows = work.write(docs.select(F.col(id_col).alias("_id"), digest(text).alias("digest"), check(text).alias("check"), run), "digests")
    n_runs, n_rows = rows.agg(F.coalesce(F.max("run"), F.lit(0)) + 1, F.count("*")).first()
    first, last = tree(rows, n_runs, keep, radix, work.sized(n_rows))
    last = last.select("digest", "keep_id", "group_size")
    down = first.select(F.col("node").alias("run"), "digest").join(last, "digest")
    counts = first.select(F.col("node").alias("run"), "digest", F.col("group_size").alias("n"))
    out = Hot(counts, ["run", "digest"]).join(rows.select("run", "digest", "_id"), down, ["_id"])
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts, with the columns of ``docs``.

    Same rules as :func:`annotate`; of rows that repeat the identifier to keep, one stays.
    """
    marked = annotate(docs, keep, id_col, text_col)

    def one(name: Column) -> Column:
        return F.concat_ws(":", name, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))

    winners = marked.filter("kept").select(one(F.col("text_sha256")).alias("_winner")).distinct()
    rows = docs.withColumn("_row", one(digest(F.col(text_col))))
    first = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))  # the join has dealt and sorted by it
    joined = rows.join(winners, F.col("_row") == F.col("_winner"), "left_semi").withColumn("_nth", first)
    return joined.filter("_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
