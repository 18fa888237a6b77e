"""Chinese style measures; texts without Han characters are left out."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import counted

# Markup of a note, in order of removal.
MARKUP = ((r"(?s)^---\n.*?\n---\n", ""), (r"(?s)```.*?```", ""), (r"(?m)^\s*#{1,6}\s.*$", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\|", " "))
# Of each, literals without any of which it does not occur: looking for them is far cheaper than the expression.
MARKUP_NEEDS = (("---\n",), ("```",), ("#",), (">",), ("-", "*", "+"), ("](",), ("|",))
MARKS = {"question": ("？", "?"), "exclamation": ("！", "!"), "dash": ("——",), "semicolon": ("；", ";"), "parenthetical": ("（", "("), "quote": ("“", "「"), "book_title": ("《",), "interpunct": ("·",)}
TOP, TOP_4 = 25, 15


def without_markup(at: int, text: Column) -> Column:
    """``text`` without the markup of one place of MARKUP."""
    may = functools.reduce(operator.or_, [F.contains(text, F.lit(part)) for part in MARKUP_NEEDS[at]])
    return F.when(may, F.regexp_replace(text, T.unicode(MARKUP[at][0]), MARKUP[at][1])).otherwise(text)


def strip_markup(text: Column, first: int = 0) -> Column:
    """``text`` without markup, that of MARKUP before place ``first`` left."""
    for at in range(first, len(MARKUP)):  # bound to a variable: the text before would be made for each of its uses
        text = F.transform(F.array(text), functools.partial(without_markup, at))[0]
    return text


def han(text: Column) -> Column:
    return F.regexp_count(text, F.lit(L.HAN)).cast("long")


def phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of each phrase, summed; a phrase within another counts for both."""
    total = F.lit(0).cast("long")
    for p in phrases:
        total = total + T.literal_count(text, p)
    return total


def han_lengths(text: Column, ends: str) -> Column:
    return F.filter(F.transform(F.split(text, ends, -1), lambda s: F.regexp_count(s, F.lit(L.HAN))), lambda n: n > 0)


def _stripped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, strip_markup(F.col(text_col)).alias("_t")).withColumn("_n", han(F.col("_t"))).filter("_n > 0")


def _counted(docs: DataFrame, parts: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """id, _n (Han characters), _c: the stripped texts' counts of each part, from one visit to each text."""
    rows = docs.select(id_col, counted.literal_counts(strip_markup(F.col(text_col)), parts).alias("_c"))
    return rows.withColumn("_n", F.get("_c", F.lit(0))).filter("_n > 0")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    groups = {"_h": L.HEDGES_ZH, "_b": L.BOOSTERS_ZH, "_p1": L.FIRST_ZH, "_p2": L.SECOND_ZH, "_p3": L.THIRD_ZH} | MARKS
    rows = _counted(docs, counted.literals_of(groups), id_col, text_col)
    rows = rows.select(id_col, "_n", *[v.alias(k) for k, v in counted.totals(F.col("_c"), groups).items()])
    n, people = F.col("_n"), F.greatest(F.lit(1), F.col("_p1") + F.col("_p2") + F.col("_p3"))
    return rows.select(
        id_col, n.alias("han"), T.per(F.col("_h"), n, 10000).alias("hedges_per_10k"), T.per(F.col("_b"), n, 10000).alias("boosters_per_10k"), F.try_divide(F.col("_h").cast("double"), F.col("_b")).alias("hedge_booster_ratio"),
        *[T.per(F.col(k), n, 10000).alias(f"{k}_per_10k") for k in MARKS],
        *[(100.0 * F.col(f"_p{k}") / people).alias(f"{name}_person_pct") for k, name in enumerate(("first", "second", "third"), 1)])


def lengths(docs: DataFrame, ends: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, distribution of Han characters per sentence or clause, share over 40 and under 12 (per cent)."""
    rows = _stripped(docs, id_col, text_col).withColumn("_l", han_lengths(F.col("_t"), ends))
    share = lambda cond: F.coalesce(F.try_divide(100.0 * F.size(F.filter("_l", cond)), F.size("_l")), F.lit(0.0))
    return rows.select(id_col, T.distribution(F.col("_l")).alias("d"), share(lambda n: n > 40).alias("pct_over_40"), share(lambda n: n < 12).alias("pct_under_12")).select(id_col, "d.*", "pct_over_40", "pct_under_12")


def phrase_rates(docs: DataFrame, terms: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, per_10k) of every term; rates below .05 mark conspicuous absence."""
    rows = _counted(docs, terms, id_col, text_col)
    each = F.array(*[F.struct(F.lit(w).alias("term"), T.per(F.get("_c", F.lit(k)), F.col("_n"), 10000).alias("per_10k")) for k, w in enumerate(terms, 1)])
    return rows.select(id_col, F.explode(each).alias("e")).select(id_col, "e.*")


def ngrams(docs: DataFrame, sizes: tuple[int, ...], top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The most frequent Han n-grams without a stop character for each n of ``sizes`` (up to four), ties by first
    occurrence. A text is stripped once and its grams are counted as integers where it is: nothing is shuffled."""
    if not all(1 <= n <= 4 for n in sizes):
        raise ValueError("four characters at most fit one integer")
    text = strip_markup(F.col(text_col))

    def of(stripped: str | None):
        han = counted.han(stripped)
        for n in sizes:
            for gram, hits in counted.han_ngrams(han, n, min(top, TOP_4) if n == 4 else top):
                yield gram, hits, n

    return counted.ranked(docs.select(id_col, text.alias(text_col)), id_col, text_col, "gram", of, "n int")
