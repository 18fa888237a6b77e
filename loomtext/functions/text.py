"""Column builders for text: tokens, sentences, counts and distributions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L


def unicode(pattern: str) -> str:
    """Java reads \\s, \\d, \\w and \\b as ASCII unless told otherwise."""
    return "(?U)" + pattern


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(unicode(pattern))).cast("long")


def literal_count(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def words(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(L.WORD), F.lit(0)), F.lower)


def space_words(text: Column) -> Column:
    """How many runs of other than white space."""
    return count(text, r"\S+")


def in_list(tokens: Column, members) -> Column:
    """How many tokens are in a fixed list."""
    return F.size(F.filter(tokens, lambda w: w.isin(*members))).cast("long")


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, unicode(pattern), -1)


def replace_matches(text: Column, pattern: str, change) -> Column:
    """``text`` with each match m of ``pattern`` replaced by change(m), left to right, nothing matched twice.

    Pieces between matches and the matches alternate; a regular expression with groups would not do where
    the replacement depends on what was matched.
    """
    found = F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(0))
    between = pieces(text, pattern)
    whole = F.transform(F.array(F.struct(found.alias("m"), between.alias("p"))), lambda s: F.array_join(F.transform(s["p"], lambda p, i: F.concat(p, F.when(i < F.size(s["m"]), change(F.get(s["m"], i))).otherwise(F.lit("")))), ""))
    return whole[0]


def sentences(text: Column) -> Column:
    """Pieces at stops before a capital, quote, bracket or digit; blank ones dropped, the rest trimmed."""
    return F.filter(F.transform(pieces(F.regexp_replace(text, unicode(r"^\s+|\s+$"), ""), L.SENTENCE_BREAK), lambda s: F.regexp_replace(s, unicode(r"^\s+|\s+$"), "")), lambda s: s != "")


def merged_sentences(text: Column) -> Column:
    """Sentences where a piece whose own last word is an abbreviation joins the piece before it."""

    def step(acc: Column, piece: Column) -> Column:
        last = F.regexp_replace(F.lower(F.element_at(F.split(piece, unicode(r"\s+"), -1), -1)), r"\.+$", "")
        joins = (F.size(acc) > 0) & last.isin(*L.ABBREVIATIONS)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), piece)))
        return F.when(joins, joined).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(sentences(text), F.expr("cast(array() as array<string>)"), step)


def paragraphs(text: Column) -> Column:
    return F.filter(pieces(text, L.PARAGRAPH_BREAK), lambda p: F.regexp_replace(p, unicode(r"\s+"), "") != "")


def word_lengths(parts: Column) -> Column:
    """Words of each part; parts without words are left out."""
    return F.filter(F.transform(parts, lambda p: F.regexp_count(p, F.lit(L.WORD))), lambda n: n > 0)


def distribution(values: Column) -> Column:
    """Struct n, mean, median, stdev (population), p10, p90, low, high of an array of integers; null if empty.

    p10 is the sorted value at max(0, floor(n / 10) - 1), p90 that at min(n - 1, floor(9 n / 10)).
    """

    def of(s: Column) -> Column:
        n = F.size(s)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        mean = F.try_divide(total, n)
        # bound to a variable: as an expression the mean would be taken again for every element
        squares = F.transform(F.array(mean), lambda m: F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))[0]
        at = lambda i: F.get(s, i).cast("double")
        return F.when(n > 0, F.struct(
            n.cast("long").alias("n"), mean.alias("mean"), ((at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2).alias("median"),
            F.sqrt(F.try_divide(squares, n)).alias("stdev"), at(F.greatest(F.lit(0), F.expr("0") + F.floor(n / 10).cast("int") - 1)).alias("p10"),
            at(F.least(n - 1, F.floor(n * 9 / 10).cast("int"))).alias("p90"), at(F.lit(0)).alias("low"), at(n - 1).alias("high")))

    return F.transform(F.array(F.sort_array(values)), of)[0]


def per(hits: Column, of: Column, scale: float) -> Column:
    """hits per ``scale`` of ``of``; 0 if there is nothing to count in."""
    return F.coalesce(F.try_divide(hits * F.lit(float(scale)), of), F.lit(0.0))
