"""Running sums, ranks and earlier values over a whole table, however large a group is.

Rows are range-partitioned by group and order and written to the shared folder. Each range is scanned alone;
what the ranges before it add to its first group is one row a range, taken from the ranges' totals. No window
holds a whole group in one task, and a third of all rows in one group is spread over its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.staging import staging


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, computed once and kept in the shared folder: for what several readers or a range partitioning, which
    samples before it deals, would compute again."""
    path = staging(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan(
    rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), sums: Sequence[str] = (), earlier: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """``rows`` with rank (from 1), before_<c> for c in ``sums`` (the sum of c over the group's rows before this
    one, 0 at first) and prev_<c> for c in ``earlier`` (the last c before this row that is not null).

    ``order`` must tell the rows of a group apart; rows that it leaves equal are ordered arbitrarily. Null keys
    are a group. An empty table gives an empty one. The ranges stay in the shared folder while the result is read.
    """
    spark, keys = rows.sparkSession, [*by, *order]
    path = staging(spark, "scan")
    dealt = rows
    if keys:
        dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    dealt = dealt.withColumn("_scan_range", F.spark_partition_id())
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)

    inside = Window.partitionBy("_scan_range", *by).orderBy(*order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumn("_scan_n", F.row_number().over(inside).cast("long"))
    out = out.withColumns({f"_s_{c}": F.coalesce(F.sum(c).over(past), F.lit(0)) for c in sums} | {f"_e_{c}": F.last(c, ignorenulls=True).over(past) for c in earlier})
    totals = out.groupBy("_scan_range", *by).agg(
        F.max("_scan_n").alias("_scan_m"), *[F.sum(c).alias(f"_ts_{c}") for c in sums],
        *[F.max_by(F.coalesce(c, f"_e_{c}"), "_scan_n").alias(f"_te_{c}") for c in earlier],
    )
    ahead = Window.partitionBy(*by).orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1)
    added = totals.select(
        F.col("_scan_range").alias("_scan_r"), *[F.col(c).alias(f"_by_{c}") for c in by], F.sum("_scan_m").over(ahead).alias("_scan_am"),
        *[F.sum(f"_ts_{c}").over(ahead).alias(f"_as_{c}") for c in sums], *[F.last(f"_te_{c}", ignorenulls=True).over(ahead).alias(f"_ae_{c}") for c in earlier],
    ).filter("_scan_am IS NOT NULL")  # only a range's first group can begin in another range: at most one row a range
    same = F.col("_scan_range") == F.col("_scan_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = out.join(F.broadcast(added), same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        *rows.columns, (F.col("_scan_n") + zero("_scan_am")).alias("rank"), *[(F.col(f"_s_{c}") + zero(f"_as_{c}")).alias(f"before_{c}") for c in sums],
        *[F.coalesce(f"_e_{c}", f"_ae_{c}").alias(f"prev_{c}") for c in earlier],
    )
