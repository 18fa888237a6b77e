"""Style queries (B1 to B21) and the page reader (S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import counted, style, style_zh
from loomtext.plans import sql
from loomtext.sources import html


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# Literal texts beside the tables, which have no Han characters, no markup and no blank lines.
CHINESE = (
    (1, "---\ntitle: x\n---\n# 标题一\n也许我们可能要去北京大学。你们觉得呢？首先，他们一定来；其次，北京大学很大！——《红楼梦》\n\n北京大学的图书馆（新）很好，图书馆“老”也好。"),
    (2, "no han here at all"),
    (3, "> 引文：我认为人工智能改变世界。\n- 人工智能改变世界，人工智能必然发展。\n```\n代码不算\n```\n[链接文字](http://x) | 表格 | 实际上也就是说换句话说。"),
    (4, "我" * 45 + "。短句。" + "北京天气晴朗" * 9 + "；" + "上海天气晴朗" * 3 + "！"),
)
ENGLISH = (
    (1, "I met Dr. Smith. He said hello.\n\nThe second paragraph -- with a dash — goes on. \"Quoted.\" (And this.) 3 cats sat.\n \n\nLast etc. One more."),
    (2, ""), (3, "   \n\n  "), (4, "Mr. Who? Yes! no. Vs. Them. E.g. This."), (5, "word " * 1203), (6, "obviously perhaps the time of course\n\nPerhaps never."),
)


#: Documents as Chinese texts: letters and marks become characters of the lists, and one in seven gets each markup.
LATIN, HAN_FOR = "eatioEnurs.,?;l", "我你不是的他北京大学。，？；—"
MARKUP_FOR = ("# 标题一\n", "> 引文", "- 一项\n* 二项\n", "---\ntitle: 天气\n---\n", "```\n代码\n```\n", "[链接文字](http://x) | 表格 ", "")


def as_chinese(docs, *keep):
    """keep, doc_id, text of the documents as Chinese texts."""
    markup = F.array(*map(F.lit, MARKUP_FOR))[(F.col("doc_id") % 7).cast("int")]
    return docs.select(*keep, "doc_id", F.concat(markup, counted.translated(F.col("text"), LATIN, HAN_FOR)).alias("text"))


def chinese(spark, d):
    """(doc_id, text): the documents as Chinese texts, and the literal ones under negative identifiers."""
    docs = as_chinese(_docs(spark, d))
    return docs.unionByName(spark.createDataFrame([(-i, t) for i, t in CHINESE], "doc_id long, text string"))


def _english(spark):
    return spark.createDataFrame(list(ENGLISH), "doc_id long, text string")


def _values(rows) -> str:
    return "(VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in rows) + ") documents(doc_id, text)"


def b1(spark, d):
    return _docs(spark, d).select("doc_id", style.token_estimate(F.col("text")).alias("tokens"))


def b2(spark, d):
    return b1(spark, d).agg(F.count("*").alias("n"), F.sum(F.round("tokens", 2).cast("decimal(20,2)")).cast("double").alias("tokens"))


def b3(spark, d):
    return _docs(spark, d).withColumn("w", T.words(F.col("text"))).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join("w", " "), 256).alias("words"))


def b4(spark, d):
    both = _docs(spark, d).select("doc_id", "text").unionByName(_english(spark).withColumn("doc_id", -F.col("doc_id")))
    return both.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("pieces"), F.size(T.merged_sentences(F.col("text"))).cast("long").alias("sentences"))


def b5(spark, d):
    both = _docs(spark, d).select("doc_id", "text").unionByName(_english(spark).withColumn("doc_id", -F.col("doc_id")))
    return both.select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


def b6(spark, d):
    return style.lengths(_docs(spark, d), "sentences")


def b6_paragraphs(spark, d):
    return style.lengths(_docs(spark, d), "paragraphs")


def b7(spark, d):
    return style.measured(_docs(spark, d)).select("doc_id", "n_words", "mean_segment_ttr_500")


def b8(spark, d):
    return style.measured(_docs(spark, d)).select("doc_id", "hedges_per_1k", "boosters_per_1k", "hedge_booster_ratio")


def b9(spark, d):
    return style.measured(_docs(spark, d)).select("doc_id", *[f"{k}_per_1k" for k in ("em_dash", "semicolon", "colon", "question", "exclamation", "parenthetical")])


def b10(spark, d):
    return style.measured(_docs(spark, d)).select("doc_id", "first_person_pct", "second_person_pct", "third_person_pct")


def b11(spark, d):
    return style.document_top_words(_docs(spark, d))


def b12(spark, d):
    return style.document_top_bigrams(_docs(spark, d))


def b13(spark, d):
    return style.absent_common(_docs(spark, d))


def b15(spark, d):
    return chinese(spark, d).select("doc_id", style_zh.strip_markup(F.col("text")).alias("stripped"))


def b16(spark, d):
    return chinese(spark, d).select("doc_id", style_zh.han(F.col("text")).alias("han")).filter("han > 0")


def b17(spark, d):
    return style_zh.lengths(chinese(spark, d), L.SENTENCE_END_ZH)


def b17_clauses(spark, d):
    return style_zh.lengths(chinese(spark, d), L.CLAUSE_END_ZH)


def b18(spark, d):
    return style_zh.measured(chinese(spark, d))


def b19(spark, d):
    return style_zh.phrase_rates(chinese(spark, d), L.SCAFFOLDING_ZH).filter("per_10k < 0.05").select("doc_id", "term")


def b20(spark, d):
    return style_zh.ngrams(chinese(spark, d), (2, 3, 4))


TERMS = ("北京大学", "人工智能", "图书馆", "天气")


def b21(spark, d):
    return style_zh.phrase_rates(chinese(spark, d), TERMS)


def s12(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html.text_of(F.col("html")).alias("text"))


_markup = "[" + ", ".join("E'" + m.replace("\n", "\\n") + "'" for m in MARKUP_FOR) + "][doc_id % 7 + 1]"
_literal = ", ".join("({}, '{}')".format(-i, t.replace("'", "''")) for i, t in CHINESE)
ZH = f"(SELECT doc_id, {_markup} || translate(text, '{LATIN}', '{HAN_FOR}') AS text FROM documents UNION ALL SELECT * FROM (VALUES {_literal}))"
EN = _values(ENGLISH)
W = sql.WORDS
NW = f"len({W})"


def _zh_lengths(ends: str) -> str:
    return f"""
        SELECT doc_id, len(s) AS n, list_avg(s) AS mean, list_median(s)::DOUBLE AS median, list_stddev_pop(s) AS stdev, s[greatest(0, len(s) // 10 - 1) + 1]::DOUBLE AS p10, s[least(len(s) - 1, len(s) * 9 // 10) + 1]::DOUBLE AS p90,
               s[1]::DOUBLE AS low, s[len(s)]::DOUBLE AS high, 100.0 * len([x for x in s if x > 40]) / len(s) AS pct_over_40, 100.0 * len([x for x in s if x < 12]) / len(s) AS pct_under_12
        FROM (SELECT doc_id, list_sort([n for n in [len(regexp_extract_all(x, '{L.HAN}')) for x in regexp_split_to_array(t, '{ends}')] if n > 0]) AS s FROM {PLAIN_ZH})"""


def _stripped(text: str) -> str:
    for pattern, new in style_zh.MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return text


PLAIN_ZH = f"(SELECT * FROM (SELECT doc_id, {_stripped('text')} AS t FROM {ZH}) WHERE len(regexp_extract_all(t, '{L.HAN}')) > 0)"
N_HAN = f"len(regexp_extract_all(t, '{L.HAN}'))"
_sum = lambda words: "(" + " + ".join(sql.n_literal("t", w) for w in words) + ")"
_people = f"greatest(1, {_sum(L.FIRST_ZH)} + {_sum(L.SECOND_ZH)} + {_sum(L.THIRD_ZH)})"
_rate = lambda part: f"10000.0 * {part} / {N_HAN}"


def _terms(terms) -> str:
    return f"SELECT doc_id, term, 10000.0 * ((length(t) - length(replace(t, term, ''))) // length(term)) / {N_HAN} AS per_10k FROM {PLAIN_ZH}, (SELECT unnest([{sql.quoted(terms)}]) AS term)"


def _grams(n: int) -> str:
    return f"""SELECT doc_id, gram, hits, place, {n} AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, f) AS place FROM (
        SELECT doc_id, gram, count(*) AS hits, min(i) AS f FROM (SELECT doc_id, i, substr(s, i::BIGINT, {n}) AS gram FROM (SELECT doc_id, list_aggregate(regexp_extract_all(t, '{L.HAN}'), 'string_agg', '') AS s FROM {PLAIN_ZH}) p, LATERAL (SELECT unnest(range(1, length(s) - {n} + 2)) AS i))
        WHERE NOT regexp_matches(gram, '[{L.STOP_CHARS_ZH}]') GROUP BY 1, 2)) WHERE place <= {15 if n == 4 else 25}"""


CONTENT = f"(SELECT doc_id, unnest(c) AS word, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, [w for w in {W} if w not in ({sql.quoted(L.STOPWORDS)}) and length(w) > 2] AS c FROM documents))"

QUERIES = {
    "B1_token_count": b1, "B2_token_total": b2, "B3_words": b3, "B4_sentences": b4, "B5_paragraphs": b5, "B6_sentence_lengths": b6, "B6_paragraph_lengths": b6_paragraphs, "B7_segment_ttr": b7, "B8_hedges": b8, "B9_punctuation": b9,
    "B10_person": b10, "B11_top_words": b11, "B12_top_bigrams": b12, "B13_absent_common": b13, "B15_strip_markup": b15, "B16_han": b16, "B17_sentence_han": b17, "B17_clause_han": b17_clauses, "B18_phrase_rates": b18,
    "B19_absent_scaffolding": b19, "B20_han_ngrams": b20, "B21_tracked_terms": b21, "S12_html_text": s12,
}

MERGE_ALL = f"SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {EN}"
ESTIMATE = f"""(({sql.n_matches('text', '[一-鿿]')} + {sql.n_matches('text', '[぀-ヿ]')}) / 0.6::DOUBLE + {NW} * 1.3::DOUBLE + {sql.n_matches('text', '[0-9]+')} * 1.2::DOUBLE + {sql.n_matches('text', '[0-9]')} / 3.0::DOUBLE
    + {sql.n_matches('text', '[^ \\t\\n\\x0B\\f\\rA-Za-z0-9一-鿿぀-ヿ]+')} + {sql.n_matches('text', '[ \\t\\n\\x0B\\f\\r]+')})"""
TTR = f"CASE WHEN len(w) >= 500 THEN list_avg([len(list_distinct(w[i * 500 + 1 : i * 500 + 500])) / 500.0::DOUBLE for i in range(len(w) // 500)]) WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END"
_en = lambda part: f"coalesce(1000.0::DOUBLE * {part} / nullif({NW}, 0), 0)"
_p = [sql.share_of(W, x) for x in (L.FIRST_PERSON, L.SECOND_PERSON, L.THIRD_PERSON)]

ORACLES = {
    "B1_token_count": f"SELECT doc_id, {ESTIMATE} AS tokens FROM documents",
    "B2_token_total": f"SELECT count(*) AS n, sum(round({ESTIMATE}, 2)::DECIMAL(20, 2))::DOUBLE AS tokens FROM documents",
    "B3_words": f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, sha256(coalesce(list_aggregate(w, 'string_agg', ' '), '')) AS words FROM (SELECT doc_id, {W} AS w FROM documents)",
    "B4_sentences": f"""SELECT doc_id, len(p) AS pieces, len(p) - len([i for i in range(2, len(p) + 1) if rtrim(lower(regexp_extract(p[i], '\\S+$')), '.') in ({sql.quoted(L.ABBREVIATIONS)})]) AS sentences
        FROM (SELECT doc_id, {sql.SENTENCES} AS p FROM ({MERGE_ALL}))""",
    "B5_paragraphs": f"SELECT doc_id, len({sql.PARAGRAPHS}) AS paragraphs FROM ({MERGE_ALL})",
    "B6_sentence_lengths": sql.distribution(sql.SENTENCES),
    "B6_paragraph_lengths": sql.distribution(sql.PARAGRAPHS),
    "B7_segment_ttr": f"SELECT doc_id, len(w) AS n_words, {TTR} AS mean_segment_ttr_500 FROM (SELECT doc_id, {W} AS w FROM documents)",
    "B8_hedges": f"SELECT doc_id, {_en(sql.share_of(W, L.HEDGES))} AS hedges_per_1k, {_en(sql.share_of(W, L.BOOSTERS))} AS boosters_per_1k, {sql.share_of(W, L.HEDGES)} / nullif({sql.share_of(W, L.BOOSTERS)}, 0)::DOUBLE AS hedge_booster_ratio FROM documents",
    "B9_punctuation": "SELECT doc_id, " + _en(f"({sql.n_literal('text', '—')} + {sql.n_literal('text', '--')})") + " AS em_dash_per_1k, " + ", ".join(f"{_en(sql.n_literal('text', v))} AS {k}_per_1k" for k, v in {"semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "parenthetical": "("}.items()) + " FROM documents",
    "B10_person": "SELECT doc_id, " + ", ".join(f"100.0::DOUBLE * {p} / greatest(1, {' + '.join(_p)}) AS {k}_person_pct" for k, p in zip(("first", "second", "third"), _p)) + " FROM documents",
    "B11_top_words": f"SELECT doc_id, word, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, f) AS place FROM (SELECT doc_id, word, count(*) AS hits, min(i) AS f FROM {CONTENT} GROUP BY 1, 2)) WHERE place <= 25",
    "B12_top_bigrams": f"""SELECT doc_id, bigram, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, f) AS place FROM (
        SELECT doc_id, word || ' ' || nxt AS bigram, count(*) AS hits, min(i) AS f FROM (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM {CONTENT}) WHERE nxt IS NOT NULL GROUP BY 1, 2)) WHERE place <= 15""",
    "B13_absent_common": f"SELECT doc_id, word FROM (SELECT doc_id, {W} AS w FROM documents), (SELECT unnest([{sql.quoted(L.COMMON_CONTENT)}]) AS word) WHERE coalesce(1000.0::DOUBLE * len([x for x in w if x = word]) / nullif(len(w), 0), 0) < 0.2",
    "B15_strip_markup": f"SELECT doc_id, {_stripped('text')} AS stripped FROM {ZH}",
    "B16_han": f"SELECT doc_id, len(regexp_extract_all(text, '{L.HAN}')) AS han FROM {ZH} WHERE han > 0",
    "B17_sentence_han": _zh_lengths(L.SENTENCE_END_ZH),
    "B17_clause_han": _zh_lengths(L.CLAUSE_END_ZH),
    "B18_phrase_rates": f"SELECT doc_id, {N_HAN} AS han, {_rate(_sum(L.HEDGES_ZH))} AS hedges_per_10k, {_rate(_sum(L.BOOSTERS_ZH))} AS boosters_per_10k, {_sum(L.HEDGES_ZH)} / nullif({_sum(L.BOOSTERS_ZH)}, 0)::DOUBLE AS hedge_booster_ratio, "
    + ", ".join(f"{_rate(_sum(v))} AS {k}_per_10k" for k, v in style_zh.MARKS.items()) + ", " + ", ".join(f"100.0 * {_sum(v)} / {_people} AS {k}_person_pct" for k, v in {"first": L.FIRST_ZH, "second": L.SECOND_ZH, "third": L.THIRD_ZH}.items()) + f" FROM {PLAIN_ZH}",
    "B19_absent_scaffolding": f"SELECT doc_id, term FROM ({_terms(L.SCAFFOLDING_ZH)}) WHERE per_10k < 0.05",
    "B20_han_ngrams": " UNION ALL ".join(_grams(n) for n in (2, 3, 4)),
    "B21_tracked_terms": _terms(TERMS),
    "S12_html_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'),
        '<h[1-6]\b[^>]*>', E'\n# ', 'gi'), '<blockquote\b[^>]*>', E'\n> ', 'gi'), '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'), E' \n') AS text FROM pages""",
}
