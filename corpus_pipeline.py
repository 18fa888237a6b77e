"""From raw documents to a mixed, tokenised corpus, in five stages.

Each stage is written as Parquet and read again before the next one. All but the last return the columns of
``documents``. Rows that repeat an identifier or have null columns follow the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, exactdedup, mixing, neardup, quality
from loomtext.llm.common import Workspace, table
from loomtext.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labels and keeps the documents that are more likely good than not."""
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")), grades=3)
    return quality.accept_rows(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier stays."""
    return exactdedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates by five-word shingles at 0.8, the document with the smallest identifier stays."""
    dropped = neardup.group(docs, words=5).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix's slots.

    The mix takes whole documents, so the number of times is rounded, and one that it takes a word of stays. One
    without words, which no mix can weigh, stays once, at the end.
    """
    whole = F.round(F.col("taken") / F.col("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.greatest(F.signum("taken"), whole)).cast("int")
    mix = mixing.mix(docs).select("doc_id", times.alias("_times"), "slots")
    mix = mix.groupBy("doc_id").agg(F.max(F.struct("_times", "slots")).alias("_mix")).filter("_mix._times > 0")
    slot = F.expr("transform(sequence(1, _mix._times), k -> coalesce(get(_mix.slots, k - 1), element_at(_mix.slots, -1)))")
    slot = F.when(F.size("_mix.slots") > 0, slot).otherwise(F.expr("array(cast(null as long))"))
    copies = mix.select(F.col("doc_id").alias("_id"), F.explode(slot).alias("_slot"))
    mixed = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("_id")))
    return mixed.orderBy(F.col("_slot").asc_nulls_last(), "_id").select(*[docs[c] for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; decoding them gives the text back, or the job fails."""
    out = bpe.encode(docs, vocabulary_path(), keep=("doc_id", "source", "text"), decoded="decoded")
    differs = F.raise_error(F.lit("decoding does not give the text back"))
    same = F.when(F.col("decoded") == F.coalesce("text", F.lit("")), F.col("token_ids")).otherwise(differs)
    return out.select("doc_id", "source", "n_tokens", same.cast("binary").alias("token_ids"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

# No SQL can express the fitted classifier or the tokeniser; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work, before = table(spark, sf_dir, "documents").select(*COLUMNS), Workspace(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(docs, name)
            if before is not None:
                work.drop(before)
            before = docs
    return docs
