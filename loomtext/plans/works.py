"""Measures of whole works (B14): the documents of a source are one work. The SQL joins their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.operators import style_zh, works
from loomtext.plans import sql
from loomtext.plans.style import HAN_FOR, LATIN, MARKUP_FOR, TERMS, _people, _stripped, _sum, as_chinese

ORDER = ["doc_id"]


def _english(spark, d):
    return works.english(spark.read.parquet(f"{d}/documents.parquet"), "source", ORDER)


def _chinese(spark, d):
    """The documents as Chinese texts, as the per-document queries have them."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    docs = as_chinese(docs, "source").withColumn("text", F.coalesce("text", F.lit("")))  # never null, so no filter makes it once more
    return works.chinese(docs, "source", ORDER)


def sentences(spark, d):
    held = works.summaries(_english(spark, d), "source", ORDER, False)
    found = works.figures(works.sentence_histogram(held, "source", ORDER, False), "source", "s")
    return found.select(F.col("source").alias("doc_id"), F.col("s_n").alias("n"), F.col("s_mean").alias("mean"), F.col("s_low").alias("low"), F.col("s_high").alias("high"))


def measures(spark, d):
    return works.measures_en(_english(spark, d), "source", ORDER)


def top_words(spark, d):
    return works.top_words(_english(spark, d), "source", ORDER)


def top_bigrams(spark, d):
    return works.top_bigrams(_english(spark, d), "source", ORDER)


def absent(spark, d):
    return works.absent_common(_english(spark, d), "source")


def zh_measures(spark, d):
    return works.measures_zh(_chinese(spark, d), "source", ORDER)


def zh_ngrams(spark, d):
    return works.ngrams_zh(_chinese(spark, d), "source", ORDER, (2, 3, 4))


def zh_terms(spark, d):
    return works.phrase_rates_zh(_chinese(spark, d), "source", (*TERMS, *L.SCAFFOLDING_ZH))


QUERIES = {
    "B14_corpus_sentences": sentences, "B14_corpus_measures": measures, "B14_corpus_top_words": top_words, "B14_corpus_top_bigrams": top_bigrams,
    "B14_corpus_absent": absent, "B14_corpus_zh_measures": zh_measures, "B14_corpus_zh_ngrams": zh_ngrams, "B14_corpus_zh_terms": zh_terms,
}

WORK = r"(SELECT source, source AS doc_id, string_agg(text, E'\n\n' ORDER BY doc_id) AS text FROM documents GROUP BY 1)"
_markup = "[" + ", ".join("E'" + m.replace("\n", "\\n") + "'" for m in MARKUP_FOR) + "][doc_id % 7 + 1]"
WORK_ZH = rf"(SELECT source, string_agg({_markup} || translate(text, '{LATIN}', '{HAN_FOR}'), E'\n\n' ORDER BY doc_id) || E'\n\n' AS text FROM documents GROUP BY 1)"
PLAIN_ZH = f"(SELECT source, {_stripped('text')} AS t FROM {WORK_ZH})"
N_HAN = f"len(regexp_extract_all(t, '{L.HAN}'))"


def _figures(prefix: str) -> str:
    return f"""len(s) AS {prefix}_n, list_avg(s) AS {prefix}_mean, list_median(s)::DOUBLE AS {prefix}_median, list_stddev_pop(s) AS {prefix}_stdev,
        s[greatest(0, len(s) // 10 - 1) + 1]::DOUBLE AS {prefix}_p10, s[least(len(s) - 1, len(s) * 9 // 10) + 1]::DOUBLE AS {prefix}_p90, s[1]::DOUBLE AS {prefix}_low, s[len(s)]::DOUBLE AS {prefix}_high"""


#: Sentences of the joined text: a piece whose own last word is an abbreviation joins the piece before it.
MERGED = f"""
    p AS (SELECT source, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT source, {sql.SENTENCES} AS p FROM w)),
    q AS (SELECT source, i, len(regexp_extract_all(piece, '{sql.WORD}')) AS n, (i = 1 OR rtrim(lower(regexp_extract(piece, '\\S+$')), '.') NOT IN ({sql.quoted(L.ABBREVIATIONS)}))::INT AS st FROM p),
    g AS (SELECT source, sum(n)::BIGINT AS n FROM (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY i) AS sid FROM q) GROUP BY source, sid),
    sl AS (SELECT source, list(n ORDER BY n) AS s FROM g WHERE n > 0 GROUP BY 1),
    pl AS (SELECT source, list_sort([n for n in [len(regexp_extract_all(x, '{sql.WORD}')) for x in {sql.PARAGRAPHS}] if n > 0]) AS s FROM w),
    ws AS (SELECT source, text, [lower(x) for x in regexp_extract_all(text, '{sql.WORD}')] AS w FROM w)"""
_en = lambda part: f"coalesce(1000.0::DOUBLE * {part} / nullif(len(w), 0), 0)"
_n = lambda words: f"len([x for x in w if x in ({sql.quoted(words)})])"
_all = f"greatest(1, {_n(L.FIRST_PERSON)} + {_n(L.SECOND_PERSON)} + {_n(L.THIRD_PERSON)})"
_marks = ", ".join(_en("(" + " + ".join(sql.n_literal("text", p) for p in v) + ")") + f" AS {k}_per_1k" for k, v in works.MARKS_EN.items())
CONTENT = f"(SELECT source, unnest(c) AS word, generate_subscripts(c, 1) AS i FROM (SELECT source, [x for x in {sql.WORDS} if x not in ({sql.quoted(L.STOPWORDS)}) and length(x) > 2] AS c FROM {WORK}))"
_top = "SELECT source, {0}, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, f) AS place FROM (SELECT source, {0}, count(*) AS hits, min(i) AS f FROM {1} GROUP BY 1, 2)) WHERE place <= {2}"
_rate = lambda part: f"10000.0 * {part} / {N_HAN}"


def _zh_lengths(ends: str) -> str:
    return f"(SELECT source, list_sort([n for n in [len(regexp_extract_all(x, '{L.HAN}')) for x in regexp_split_to_array(t, '{ends}')] if n > 0]) AS s FROM {PLAIN_ZH})"


def _grams(n: int) -> str:
    gram = " || ".join(f"c[i + {k}]" for k in range(n))
    rows = f"""(SELECT source, i, gram FROM (SELECT source, i, {gram} AS gram FROM (SELECT source, regexp_extract_all(t, '{L.HAN}') AS c FROM {PLAIN_ZH}) p,
        LATERAL (SELECT unnest(range(1, len(c) - {n} + 2)) AS i)) WHERE NOT regexp_matches(gram, '[{L.STOP_CHARS_ZH}]'))"""
    return "SELECT *, {} AS n FROM ({})".format(n, _top.format("gram", rows, 15 if n == 4 else 25))


ORACLES = {
    "B14_corpus_sentences": "SELECT doc_id, n, mean, low, high FROM (" + sql.distribution(sql.SENTENCES).replace("FROM documents", f"FROM {WORK}") + ")",
    "B14_corpus_measures": f"""WITH w AS {WORK}, {MERGED},
        a AS (SELECT source, {_figures('sentence')} FROM sl), b AS (SELECT source, {_figures('paragraph')} FROM pl WHERE len(s) > 0)
        SELECT ws.source, len(w) AS words, a.* EXCLUDE source, b.* EXCLUDE source,
               CASE WHEN len(w) >= 500 THEN list_avg([len(list_distinct(w[i * 500 + 1 : i * 500 + 500])) / 500.0::DOUBLE for i in range(len(w) // 500)]) WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS mean_segment_ttr_500,
               {_en(_n(L.HEDGES))} AS hedges_per_1k, {_en(_n(L.BOOSTERS))} AS boosters_per_1k, {_n(L.HEDGES)} / nullif({_n(L.BOOSTERS)}, 0)::DOUBLE AS hedge_booster_ratio, {_marks},
               {', '.join(f'100.0::DOUBLE * {_n(v)} / {_all} AS {k}_person_pct' for k, v in works.PEOPLE_EN.items())}
        FROM ws LEFT JOIN a USING (source) LEFT JOIN b USING (source)""",
    "B14_corpus_top_words": _top.format("word", CONTENT, 25),
    "B14_corpus_top_bigrams": _top.format("bigram", f"(SELECT source, i, word || ' ' || nxt AS bigram FROM (SELECT *, lead(word) OVER (PARTITION BY source ORDER BY i) AS nxt FROM {CONTENT}) WHERE nxt IS NOT NULL)", 15),
    "B14_corpus_absent": f"SELECT source, word FROM (SELECT source, {sql.WORDS} AS w FROM {WORK}), (SELECT unnest([{sql.quoted(L.COMMON_CONTENT)}]) AS word) WHERE coalesce(1000.0::DOUBLE * len([x for x in w if x = word]) / nullif(len(w), 0), 0) < 0.2",
    "B14_corpus_zh_measures": f"""WITH a AS (SELECT source, {_figures('sentence')}, 100.0 * len([x for x in s if x > 40]) / len(s) AS pct_over_40, 100.0 * len([x for x in s if x < 12]) / len(s) AS pct_under_12 FROM {_zh_lengths(L.SENTENCE_END_ZH)}),
        b AS (SELECT source, {_figures('clause')} FROM {_zh_lengths(L.CLAUSE_END_ZH)}), t AS (SELECT * FROM {PLAIN_ZH} WHERE {N_HAN} > 0)
        SELECT t.source, {N_HAN} AS han, a.* EXCLUDE source, b.* EXCLUDE source, {_rate(_sum(L.HEDGES_ZH))} AS hedges_per_10k, {_rate(_sum(L.BOOSTERS_ZH))} AS boosters_per_10k,
               {_sum(L.HEDGES_ZH)} / nullif({_sum(L.BOOSTERS_ZH)}, 0)::DOUBLE AS hedge_booster_ratio, {', '.join(f'{_rate(_sum(v))} AS {k}_per_10k' for k, v in style_zh.MARKS.items())},
               {', '.join(f'100.0 * {_sum(v)} / {_people} AS {k}_person_pct' for k, v in works.PEOPLE_ZH.items())} FROM t LEFT JOIN a USING (source) LEFT JOIN b USING (source)""",
    "B14_corpus_zh_ngrams": " UNION ALL ".join(_grams(n) for n in (2, 3, 4)),
    "B14_corpus_zh_terms": f"SELECT source, term, {_rate('((length(t) - length(replace(t, term, repeat(term, 0)))) // length(term))')} AS per_10k FROM {PLAIN_ZH}, (SELECT unnest([{sql.quoted((*TERMS, *L.SCAFFOLDING_ZH))}]) AS term)",
}
