"""Segmentation of sources into clusters, cluster statistics and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.scan import scan

# Fixed values of a manifest row.
KINDS = ("monologue", "dialogue", "decision_record")
ATTRIBUTIONS = ("firsthand", "secondhand", "mixed", "unknown")
CLUSTER_ID = r"^c[0-9]{2,}$"
REQUIRED = ("id", "label", "file", "kind", "attribution")
LEAST_WORDS = 400
TOKENS_PER_WORD = 1.33
BLOCK = 4096  # lines of a cluster that one row stands for while they are numbered


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0), line; split at \\n only."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def resolve_bounds(all_lines: DataFrame, spec: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """spec columns, first, last (exclusive), problem.

    A spec row names its document and a start (line number from 1, pattern or none) and an end likewise; an
    end pattern is looked for after the line that follows the start. Every pattern is tried once on a document's
    lines, however many rows name it; an end is the next of its hits, found by one sorted sweep over hits and
    starts. Specs are joined like any other table: they may have as many rows as there are documents.
    """
    keys = spec.select("id", id_col, "start", "end", "start_line", "end_line")
    sized = all_lines.groupBy(id_col).agg(F.count("*").alias("n_lines"))
    by_start, by_end = F.expr("start IS NOT NULL AND start_line IS NULL"), F.expr("`end` IS NOT NULL AND end_line IS NULL")
    wanted = keys.filter(by_start).select(id_col, F.col("start").alias("pattern")).unionByName(keys.filter(by_end).select(id_col, F.col("end").alias("pattern"))).distinct()
    # patterns are columns, so they go through regexp_like
    hits = all_lines.join(wanted, id_col).filter(F.regexp_like("line", "pattern")).select(id_col, "pattern", F.col("line_no").cast("long").alias("at"))
    begins = hits.groupBy(id_col, F.col("pattern").alias("start")).agg(F.min("at").alias("hit"))
    rows = keys.join(sized, id_col, "left").join(begins, [id_col, "start"], "left")
    rows = rows.withColumn("first", F.when(F.col("start_line").isNotNull(), F.col("start_line") - 1).when(F.col("start").isNotNull(), F.col("hit")).otherwise(0))
    asked = rows.filter(by_end & F.col("first").isNotNull()).select(id_col, F.col("end").alias("pattern"), (F.col("first") + 1).cast("long").alias("at"), "id", F.lit(0).alias("found"), F.lit(None).cast("long").alias("line"))
    swept = asked.unionByName(hits.select(id_col, "pattern", "at", F.lit(None).cast("string").alias("id"), F.lit(1).alias("found"), F.col("at").alias("line")))
    swept = scan(swept, [F.desc("at"), F.desc("found"), "id"], [id_col, "pattern"], earlier=["line"])
    rows = rows.join(swept.filter("found = 0").select("id", F.col("prev_line").alias("stop")), "id", "left")
    rows = rows.withColumn("last", F.when(F.col("end_line").isNotNull(), F.col("end_line")).when(F.col("end").isNotNull(), F.col("stop")).otherwise(F.col("n_lines")).cast("long"))
    problem = F.when(F.col("n_lines").isNull(), "missing file").when(F.col("first").isNull(), "start marker not found").when(F.col("last").isNull(), "end marker not found after start").when(F.col("last") <= F.col("first"), "end is not after start")
    return rows.select("id", id_col, F.col("first").cast("long").alias("first"), "last", problem.alias("problem"))


def cut(all_lines: DataFrame, bounds: DataFrame, headers: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """id, line_no, line of every cluster, running headers (patterns that match at a line's start) left out.

    Clusters may overlap. Bounds become the line numbers that they hold, in blocks, and meet the lines by
    document and number: as many rows as the result has.
    """
    kept = bounds.filter("problem IS NULL").select("id", id_col, "first", "last")
    sized = all_lines.groupBy(id_col).agg(F.count("*").alias("_n"))
    kept = kept.join(sized, id_col).withColumn("last", F.least("last", "_n")).filter("last > first")
    block = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("last") - 1) / BLOCK)))
    kept = kept.withColumn("_block", block)
    number = F.sequence(F.greatest("first", F.col("_block") * BLOCK), F.least("last", (F.col("_block") + 1) * BLOCK) - 1)
    kept = kept.select("id", id_col, F.explode(number).alias("line_no"))
    rows = all_lines.withColumn("line_no", F.col("line_no").cast("long")).join(kept, [id_col, "line_no"])
    for pattern in headers:
        rows = rows.filter(~F.col("line").rlike(f"^(?:{pattern})"))
    return rows.select("id", "line_no", "line")


def cluster_stats(cut_lines: DataFrame) -> DataFrame:
    """id, n_words, tokens, too_small."""
    counted = cut_lines.groupBy("id").agg(F.sum(T.space_words(F.col("line"))).alias("n_words"))
    return counted.select("id", "n_words", F.floor(F.col("n_words") * TOKENS_PER_WORD).alias("tokens"), (F.col("n_words") < LEAST_WORDS).alias("too_small"))


def firsthand_ratio(manifest: DataFrame) -> DataFrame:
    """One row: firsthand words, all words and their ratio; null without words."""
    first = F.sum(F.when(F.col("attribution") == "firsthand", F.col("n_words")).otherwise(0))
    return manifest.agg(first.alias("firsthand_words"), F.sum("n_words").alias("n_words"), F.try_divide(first.cast("double"), F.sum("n_words")).alias("ratio"))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(id, problem): one row for each rule that a manifest row breaks."""
    checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"missing {c}") for c in REQUIRED]
    checks += [F.when(~F.col("id").rlike(CLUSTER_ID), "bad id"), F.when(~F.col("kind").isin(*KINDS), "bad kind"), F.when(~F.col("attribution").isin(*ATTRIBUTIONS), "bad attribution")]
    return manifest.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def slug(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def coverage(manifest: DataFrame) -> DataFrame:
    """One row about the clusters of a manifest (id, domain, kind, attribution, period, tokens).

    A gap is a span of more than one between neighbouring distinct numeric periods. Thin domains have one cluster.
    """
    totals = manifest.agg(
        F.sum("tokens").alias("total_tokens"), F.count("*").alias("n_clusters"),
        F.try_divide(F.sum(F.when(F.col("attribution") == "firsthand", F.col("tokens")).otherwise(0)).cast("double"), F.sum("tokens")).alias("firsthand_ratio"),
        F.try_divide(F.sum(F.when(F.col("kind").isin("dialogue", "decision_record"), F.col("tokens")).otherwise(0)).cast("double"), F.sum("tokens")).alias("dialogue_ratio"),
        F.try_divide(F.sum(F.when(F.col("kind") == "decision_record", F.col("tokens")).otherwise(0)).cast("double"), F.sum("tokens")).alias("decision_density"),
        F.min("period").alias("earliest"), F.max("period").alias("latest"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy("period")  # as many rows as distinct periods
    gaps = manifest.select("period").filter("period IS NOT NULL").distinct().withColumn("before", F.lag("period").over(order))
    gaps = gaps.agg(F.count_if(F.col("period") - F.col("before") > 1).alias("gaps"))
    thin = manifest.groupBy("domain").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("domain")))), ",").alias("thin_domains"))
    return totals.crossJoin(gaps).crossJoin(thin)  # three single rows


def independent_support(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, n_clusters, n_origins): clusters of one origin count once."""
    return claims.join(clusters, "id").groupBy("claim").agg(F.countDistinct("id").alias("n_clusters"), F.countDistinct("origin").alias("n_origins"))


def attribution_status(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """(claim, kind, status): a regularity needs a firsthand cluster; cost and interactional claims of only
    secondhand clusters are unverified; expression is measured on firsthand clusters only."""
    rows = claims.join(clusters.select("id", "attribution"), "id").groupBy("claim", "kind").agg(
        F.bool_or(F.col("attribution") == "firsthand").alias("first"), F.bool_and(F.col("attribution") == "secondhand").alias("second"))
    status = (F.when((F.col("kind") == "regularity") & ~F.col("first"), "rejected")
              .when(F.col("kind").isin("cost", "interactional") & F.col("second"), "unverified")
              .when((F.col("kind") == "expression") & ~F.col("first"), "not measured").otherwise("usable"))
    return rows.select("claim", "kind", status.alias("status"))


def batch_boundary(clusters: DataFrame) -> DataFrame:
    """Per domain: pairs of its clusters, and the share of them in one delivery, from counts; no pair is made."""
    by = clusters.groupBy("domain", "delivery").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    out = by.groupBy("domain").agg(F.sum("n").alias("m"), F.sum(pairs(F.col("n"))).alias("same"))
    return out.select("domain", pairs(F.col("m")).cast("long").alias("pairs"), F.try_divide(F.col("same"), pairs(F.col("m"))).alias("same_delivery"))
