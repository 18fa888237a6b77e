"""The flagship query: size and shape of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return (
        docs.select("source", F.length("text").alias("n"), F.regexp_count("text", F.lit(WORDS)).alias("w"), F.regexp_count("text", F.lit("[.!?]")).alias("e"))
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("chars"), F.sum("w").cast("long").alias("words"), F.sum("e").cast("long").alias("stops"))
    )


QUERIES = {"corpus_profile": profile_query}

ORACLES = {
    "corpus_profile": r"""
        SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS chars,
               sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words,
               sum(len(regexp_extract_all(text, '[.!?]')))::BIGINT AS stops
        FROM documents GROUP BY source""",
}
