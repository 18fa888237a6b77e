"""English style measures. Per-document ones are array expressions in one projection; vocabulary ones explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import counted

CHUNK = 500
TOP_WORDS, TOP_BIGRAMS = 25, 15


def token_estimate(text: Column, han: float = 1 / 0.6, latin: float = 1.3) -> Column:
    """Heuristic model tokens, not rounded."""
    cjk = T.count(text, "[一-鿿]") + T.count(text, r"[぀-ヿ]")
    return (cjk * F.lit(han) + T.count(text, L.WORD) * F.lit(latin) + T.count(text, r"\d+") * F.lit(1.2) + T.count(text, r"\d") / F.lit(3.0)
            + T.count(text, r"[^\sA-Za-z0-9一-鿿぀-ヿ]+") + T.count(text, r"\s+"))


def mean_segment_ttr(words: Column) -> Column:
    """Mean share of distinct words in consecutive chunks of 500, the rest dropped; of all words if fewer."""
    n = F.size(words)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(n / CHUNK).cast("int") - 1), lambda i: F.size(F.array_distinct(F.slice(words, i * CHUNK + 1, CHUNK))) / F.lit(float(CHUNK)))
    mean = F.aggregate(chunks, F.lit(0.0), lambda a, x: a + x) / F.floor(n / CHUNK)
    return F.when(n >= CHUNK, mean).when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(0.0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the per-document measures, none rounded; nothing is shuffled."""
    rows = docs.withColumn("_w", T.words(F.col(text_col))).withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_h", T.in_list(F.col("_w"), L.HEDGES)).withColumn("_b", T.in_list(F.col("_w"), L.BOOSTERS))
    people = [T.in_list(F.col("_w"), x) for x in (L.FIRST_PERSON, L.SECOND_PERSON, L.THIRD_PERSON)]
    rows = rows.withColumns({f"_p{k}": c for k, c in enumerate(people, 1)}).withColumn("_p", F.greatest(F.lit(1), F.col("_p1") + F.col("_p2") + F.col("_p3")))
    text, n = F.col(text_col), F.col("_n")
    marks = {"em_dash": T.literal_count(text, "—") + T.literal_count(text, "--")} | {k: T.literal_count(text, v) for k, v in {"semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "parenthetical": "("}.items()}
    return rows.select(
        id_col, n.alias("n_words"), mean_segment_ttr(F.col("_w")).alias("mean_segment_ttr_500"),
        T.per(F.col("_h"), n, 1000).alias("hedges_per_1k"), T.per(F.col("_b"), n, 1000).alias("boosters_per_1k"), F.try_divide(F.col("_h").cast("double"), F.col("_b")).alias("hedge_booster_ratio"),
        *[T.per(v, n, 1000).alias(f"{k}_per_1k") for k, v in marks.items()],
        *[(F.col(f"_p{k}") * 100.0 / F.col("_p")).alias(f"{name}_person_pct") for k, name in enumerate(("first", "second", "third"), 1)],
    )


def lengths(docs: DataFrame, parts: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the distribution of words per part: sentences, merged_sentences or paragraphs; n is 0 without words."""
    cut = {"sentences": T.sentences, "merged_sentences": T.merged_sentences, "paragraphs": T.paragraphs}[parts]
    rows = docs.withColumn("_parts", cut(F.col(text_col))).withColumn("_lengths", T.word_lengths(F.col("_parts")))
    rows = rows.select(id_col, F.when(F.col("_lengths").isNotNull(), F.lit(0)).cast("long").alias("_none"), T.distribution(F.col("_lengths")).alias("d")).select(id_col, "_none", "d.*")
    return rows.withColumn("n", F.coalesce("n", "_none")).drop("_none")


def content_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, position in the filtered sequence, word, next (null at the end)."""
    kept = F.filter(T.words(F.col(text_col)), lambda w: ~w.isin(*L.STOPWORDS) & (F.length(w) > 2))
    rows = docs.select(id_col, kept.alias("_k")).select(id_col, "_k", F.posexplode("_k").alias("position", "word"))
    return rows.select(id_col, "position", "word", F.get("_k", F.col("position") + 1).alias("next"))


def _first_k(counted: DataFrame, key: str, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy(id_col).orderBy(F.desc("hits"), "first_at")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(id_col, key, "hits", "place")


def top_words(content: DataFrame, k: int = TOP_WORDS, id_col: str = "doc_id") -> DataFrame:
    """Most frequent content words, ties by first occurrence."""
    return _first_k(content.groupBy(id_col, "word").agg(F.count("*").alias("hits"), F.min("position").alias("first_at")), "word", k, id_col)


def top_bigrams(content: DataFrame, k: int = TOP_BIGRAMS, id_col: str = "doc_id") -> DataFrame:
    """Most frequent neighbours in the filtered sequence, which may span stop words and sentences."""
    pairs = content.filter("next IS NOT NULL").groupBy(id_col, F.concat_ws(" ", "word", "next").alias("bigram"))
    return _first_k(pairs.agg(F.count("*").alias("hits"), F.min("position").alias("first_at")), "bigram", k, id_col)


def document_top_words(docs: DataFrame, k: int = TOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`top_words` gives, counted within each document's row: a row is a document, nothing is shuffled."""
    return counted.ranked(docs, id_col, text_col, "word", lambda text: counted.top(counted.content(text), k))


def document_top_bigrams(docs: DataFrame, k: int = TOP_BIGRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`top_bigrams` gives, likewise: the pairs of a document never leave its row."""
    return counted.ranked(docs, id_col, text_col, "bigram", lambda text: counted.top(counted.bigrams(text), k))


def absent_common(docs: DataFrame, below: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): common content words with fewer than ``below`` a thousand words."""
    rows = docs.withColumn("_w", T.words(F.col(text_col)))
    rate = lambda w: T.per(F.size(F.filter("_w", lambda x: x == w)), F.size("_w"), 1000)
    return rows.select(id_col, F.explode(F.filter(F.array(*map(F.lit, L.COMMON_CONTENT)), lambda w: rate(w) < below)).alias("word"))


def joined_by(docs: DataFrame, key: str, order: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """key and the texts of its documents in order of id, a blank line between: measures of a whole corpus are
    taken over this text, as sentences and neighbours may span documents. Meant for keys of bounded size."""
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text_col))).alias("_t"))
    return rows.select(key, F.array_join(F.transform("_t", lambda t: t[text_col]), "\n\n").alias(text_col))
