"""Sinks: JSON artifacts, write-once results, and the text of clusters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_artifact(df: DataFrame, path: str) -> None:
    """A small result as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes if nothing is there; True if it wrote. Writing the same rows again is allowed, other rows are not."""
    spark = df.sparkSession
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
    old = spark.read.schema(df.schema).parquet(path)
    if not (old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty()):
        raise ValueError(f"{path} holds other rows")
    return False


def cluster_texts(lines: DataFrame, path: str, least_words: int = 400) -> DataFrame:
    """Lines (id, line_no, line) as one folder a cluster, in order within its file, and a manifest beside them.

    The manifest, one JSON row a cluster, has id, source (the folder), n_lines, words and small (fewer words
    than corroborate anything); it is returned as read back.
    """
    order = lines.repartition("id").sortWithinPartitions("id", "line_no").select("id", "line")
    order.write.mode("overwrite").partitionBy("id").text(f"{path}/clusters")
    words = F.sum(F.regexp_count("line", F.lit(r"\S+"))).cast("long").alias("words")
    source = F.concat(F.lit("clusters/id="), F.col("id").cast("string")).alias("source")
    found = lines.groupBy("id").agg(F.count("*").alias("n_lines"), words)
    found = found.select("id", source, "n_lines", "words", (F.col("words") < least_words).alias("small"))
    json_artifact(found, f"{path}/manifest")
    return lines.sparkSession.read.schema(found.schema).json(f"{path}/manifest")
