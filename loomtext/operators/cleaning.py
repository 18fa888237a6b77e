"""Corpus cleaning: damage measures, verdicts and repair. One scan, no shuffle except for top suspects."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.functions import text as T


def f_rate(text: Column) -> Column:
    """Per cent of a-z that is f, lower-cased; null without letters."""
    low = F.lower(text)
    return F.try_divide(100.0 * F.regexp_count(low, F.lit("f")), F.regexp_count(low, F.lit("[a-z]")))


def lexicon_table(spark: SparkSession, lexicon: dict[str, str] = L.LIGATURES) -> DataFrame:
    """bad, good, position, ambiguous: small by construction, to be broadcast."""
    return spark.createDataFrame([(k, v, i, k in L.AMBIGUOUS) for i, (k, v) in enumerate(lexicon.items())], "bad string, good string, position int, ambiguous boolean")


def ligature_census(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bad, position, ambiguous, hits: whole-word occurrences of damaged forms.

    Texts are cut into words once and joined to the broadcast lexicon; a pass per form would read them
    132 times. Counting within a document first keeps the shuffle to distinct hits.
    """
    tokens = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\w+"), F.lit(0))).alias("bad"))
    return tokens.join(F.broadcast(lexicon), "bad").groupBy(id_col, "bad", "position", "ambiguous").agg(F.count("*").alias("hits"))


def markup_hits(text: Column) -> Column:
    total = F.lit(0).cast("long")
    for pattern in L.MARKUP:
        total = total + T.count(text, pattern)
    return total


def strip_markup(text: Column) -> Column:
    for pattern in L.MARKUP:
        text = F.regexp_replace(text, T.unicode(pattern), "")
    return text


def soft_hyphens(text: Column) -> Column:
    """Broken words, without suspended compounds such as pre- and post-war."""
    after = F.regexp_extract_all(text, F.lit(T.unicode(L.SOFT_HYPHEN)), F.lit(2))
    return F.size(F.filter(after, lambda w: ~w.isin(*L.NOT_A_CONTINUATION))).cast("long")


def join_hyphens(text: Column) -> Column:
    def join(m: Column) -> Column:
        second = F.regexp_extract(m, T.unicode(L.SOFT_HYPHEN), 2)
        return F.when(second.isin(*L.NOT_A_CONTINUATION), m).otherwise(F.concat(F.regexp_extract(m, T.unicode(L.SOFT_HYPHEN), 1), second))

    return T.replace_matches(text, L.SOFT_HYPHEN, join)


def _any_of(forms: Iterable[str]) -> str:
    """A pattern of these forms that shares their beginnings: a word is left at its first letter that none has.

    Longer forms are tried first, as in a list of them by length.
    """
    tails: dict[str, list[str]] = {}
    for form in forms:
        tails.setdefault(form[:1], []).append(form[1:])
    ends = tails.pop("", None)
    if not tails:
        return ""
    open_ = "|".join(re.escape(first) + _any_of(rest) for first, rest in sorted(tails.items()))
    return f"(?:{open_})" + ("?" if ends else "")


def repair_ligatures(text: Column, lexicon: dict[str, str] = L.LIGATURES, aggressive: bool = False) -> Column:
    """One pass, longest form first, case-sensitive; what a replacement made is not looked at again."""
    use = {k: v for k, v in lexicon.items() if aggressive or k not in L.AMBIGUOUS}
    if not use:
        return text
    pattern = r"\b" + _any_of(use) + r"\b"
    table = F.create_map(*[F.lit(x) for pair in use.items() for x in pair])
    return T.replace_matches(text, pattern, lambda m: F.element_at(table, m))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def repair(docs: DataFrame, aggressive: bool = False, text_col: str = "text") -> DataFrame:
    """Adds ``repaired``. Each step is its own projection, so that none is evaluated twice."""
    out = docs.withColumn("_a", strip_markup(F.col(text_col))).withColumn("_b", join_hyphens(F.col("_a")))
    return out.withColumn("repaired", collapse_blanks(repair_ligatures(F.col("_b"), aggressive=aggressive))).drop("_a", "_b")


def damage(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, f_rate, n_words, unambiguous, ligature_rate, markup, hyphens, verdict, damaged."""
    hits = ligature_census(docs, lexicon, id_col, text_col).filter("NOT ambiguous").groupBy(id_col).agg(F.sum("hits").alias("unambiguous"))
    text = F.col(text_col)
    base = docs.select(id_col, f_rate(text).alias("f_rate"), F.greatest(F.lit(1), T.space_words(text)).cast("long").alias("n_words"), markup_hits(text).alias("markup"), soft_hyphens(text).alias("hyphens"))
    rows = base.join(hits, id_col, "left").withColumn("unambiguous", F.coalesce("unambiguous", F.lit(0)))
    rows = rows.withColumn("ligature_rate", 10000.0 * F.col("unambiguous") / F.col("n_words"))
    ligature = F.col("ligature_rate") >= L.LIGATURE_RATE
    flags = [
        F.when(ligature, "LIGATURE").when(F.col("f_rate") < L.F_RATE_FLOOR, "f-low(screen only)"),
        F.when(F.col("markup") > 0, "MARKUP"),
        F.when(10000.0 * F.col("hyphens") / F.col("n_words") >= L.HYPHEN_RATE, "HYPHEN"),
    ]
    verdict = F.concat_ws(", ", *flags)
    return rows.withColumn("verdict", F.when(verdict == "", "clean").otherwise(verdict)).withColumn("damaged", F.col("verdict").rlike("LIGATURE|MARKUP|HYPHEN"))


def top_suspects(census: DataFrame, k: int = L.TOP_SUSPECTS, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` most frequent damaged forms of a document, ties in lexicon order."""
    order = Window.partitionBy(id_col).orderBy(F.desc("hits"), "position")
    return census.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(id_col, "bad", "hits", "place")
