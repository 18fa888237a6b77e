"""Cleaning and segmentation queries (A1 to A20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.operators import cleaning, segmentation
from loomtext.plans import sql


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every eighth one damaged, as the test texts have little damage of their own."""
    return _docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("The rst Dierence is signicant, transporta- tion of self-love, pre- and post-war filepos123 tries  nd. "), "text")).otherwise(F.col("text")))


DAMAGED = """(SELECT doc_id, source, lang, CASE WHEN doc_id % 8 = 0 THEN 'The rst Dierence is signicant, transporta- tion of self-love, pre- and post-war filepos123 tries  nd. ' || text ELSE text END AS text FROM documents)"""
RUNS = r"[\p{L}\p{N}_]+"
MARKUP_SQL = " + ".join(sql.n_matches("text", p) for p in L.MARKUP)
HYPHEN_SQL = f"len([w for w in regexp_extract_all(text, '{L.SOFT_HYPHEN}', 2) if w not in ({sql.quoted(L.NOT_A_CONTINUATION)})])"
CENSUS_SQL = f"""SELECT doc_id, bad, position, ambiguous, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{RUNS}')) AS bad FROM {DAMAGED})
    JOIN {sql.lexicon()} USING (bad) GROUP BY ALL"""


def a1(spark, d):
    return _damaged(spark, d).select("doc_id", cleaning.f_rate(F.col("text")).alias("f_rate"))


def a2(spark, d):
    return cleaning.ligature_census(_damaged(spark, d), cleaning.lexicon_table(spark))


def a3(spark, d):
    text = F.col("text")
    return _damaged(spark, d).select("doc_id", cleaning.markup_hits(text).alias("markup"), F.length(cleaning.strip_markup(text)).cast("long").alias("left"))


def a4(spark, d):
    text = F.col("text")
    return _damaged(spark, d).select("doc_id", cleaning.soft_hyphens(text).alias("hyphens"), F.sha2(cleaning.join_hyphens(text), 256).alias("joined"))


def a5(spark, d):
    return _damaged(spark, d).select("doc_id", F.sha2(cleaning.repair_ligatures(F.col("text")), 256).alias("plain"), F.sha2(cleaning.repair_ligatures(F.col("text"), aggressive=True), 256).alias("aggressive"))


def a6(spark, d):
    return _damaged(spark, d).select("doc_id", F.sha2(cleaning.collapse_blanks(F.col("text")), 256).alias("collapsed"))


def a7(spark, d):
    return cleaning.damage(_damaged(spark, d), cleaning.lexicon_table(spark))


def a8(spark, d):
    return cleaning.top_suspects(a2(spark, d))


def a9(spark, d):
    return segmentation.lines(_docs(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"))


def _spec(spark, d):
    """Every fourth document from its first line with 'the ' to the next with 'and ' after that; others by number."""
    docs = _docs(spark, d).select("doc_id")
    pick = F.col("doc_id") % 4
    return docs.select(F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), "doc_id",
                       F.when(pick == 0, "[Tt]he ").alias("start"), F.when(pick <= 1, "and ").alias("end"),
                       F.when(pick == 2, 2).alias("start_line"), F.when(pick == 3, 1).alias("end_line"))


def a10(spark, d):
    hits = segmentation.lines(_docs(spark, d)).filter(F.col("line").rlike("[Tt]he "))
    return hits.groupBy("doc_id").agg(F.min("line_no").cast("long").alias("first"))


def a11(spark, d):
    return segmentation.resolve_bounds(segmentation.lines(_docs(spark, d)), _spec(spark, d))


def a12(spark, d):
    rows = segmentation.lines(_docs(spark, d))
    return segmentation.cut(rows, segmentation.resolve_bounds(rows, _spec(spark, d)), headers=(r"The\b",)).groupBy("id").agg(F.count("*").alias("n_lines"))


def a13(spark, d):
    rows = segmentation.lines(_docs(spark, d))
    return segmentation.cluster_stats(segmentation.cut(rows, segmentation.resolve_bounds(rows, _spec(spark, d))))


def _manifest(spark, d):
    """A cluster per source and language."""
    from loomtext.functions import text as T

    by = _docs(spark, d).groupBy("source", "lang").agg(F.sum(T.space_words(F.col("text"))).alias("n_words"), F.min("doc_id").alias("first"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return by.select(
        F.concat(F.lit("c"), F.lpad(number.cast("string"), 2, "0"), "lang").alias("id"), F.concat_ws(": ", "source", "lang").alias("label"), F.col("source").alias("file"), F.col("lang").alias("domain"), F.col("source").alias("origin"),
        F.when(number % 3 == 0, "dialogue").when(number % 7 == 1, "decision_record").otherwise("monologue").alias("kind"),
        F.when(F.col("lang") == "en", "firsthand").when(F.col("lang") == "fr", "mixed").when(F.col("lang") == "de", "secondhand").otherwise("hearsay").alias("attribution"),
        (F.lit(1900) + number * 2 - F.when(number > 10, 1).otherwise(0)).alias("period"), F.floor(F.col("n_words") * 1.33).alias("tokens"), "n_words", (number % 5).alias("delivery"))


MANIFEST = r"""(SELECT 'c' || lpad(k::VARCHAR, 2, '0') || lang AS id, source || ': ' || lang AS label, source AS file, lang AS domain, source AS origin,
    CASE WHEN k % 3 = 0 THEN 'dialogue' WHEN k % 7 = 1 THEN 'decision_record' ELSE 'monologue' END AS kind,
    CASE lang WHEN 'en' THEN 'firsthand' WHEN 'fr' THEN 'mixed' WHEN 'de' THEN 'secondhand' ELSE 'hearsay' END AS attribution,
    1900 + k * 2 - CASE WHEN k > 10 THEN 1 ELSE 0 END AS period, floor(n_words * 1.33)::BIGINT AS tokens, n_words, k % 5 AS delivery
    FROM (SELECT source, lang, regexp_extract(source, '(\d+)$', 1)::INT AS k, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS n_words FROM documents GROUP BY source, lang))"""


def a14(spark, d):
    return segmentation.firsthand_ratio(_manifest(spark, d))


def a15(spark, d):
    return segmentation.manifest_violations(_manifest(spark, d))


def a16(spark, d):
    return _manifest(spark, d).select("id", segmentation.slug(F.concat_ws(" -- ", F.lit("Book"), "label", F.repeat("label", 3))).alias("slug"))


def a17(spark, d):
    return segmentation.coverage(_manifest(spark, d))


def a18(spark, d):
    rows = _manifest(spark, d)
    return segmentation.independent_support(rows.select("id", "origin"), rows.select("id", F.col("kind").alias("claim")))


def a19(spark, d):
    rows = _manifest(spark, d)
    kinds = F.explode(F.array(*map(F.lit, ("regularity", "cost", "expression"))))
    claims = rows.select("id", F.col("domain").alias("claim"), kinds.alias("kind")).withColumn("claim", F.concat_ws("-", "claim", "kind"))
    return segmentation.attribution_status(claims, rows)


def a20(spark, d):
    return segmentation.batch_boundary(_manifest(spark, d))


LINES = r"(SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS line_no FROM documents)"
BOUNDS = f"""(
    WITH spec AS (SELECT 'c' || lpad(doc_id::VARCHAR, 8, '0') AS id, doc_id, doc_id % 4 AS pick FROM documents),
    n AS (SELECT doc_id, count(*) AS n_lines FROM {LINES} GROUP BY 1),
    s AS (SELECT doc_id, min(line_no) AS hit FROM {LINES} WHERE regexp_matches(line, '[Tt]he ') GROUP BY 1),
    f AS (SELECT spec.*, n_lines, CASE WHEN pick = 0 THEN hit WHEN pick = 2 THEN 1 ELSE 0 END AS first FROM spec JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)),
    e AS (SELECT f.doc_id, min(line_no) AS stop FROM f JOIN {LINES} l USING (doc_id) WHERE line_no >= first + 1 AND contains(line, 'and ') GROUP BY 1),
    r AS (SELECT id, doc_id, first, CASE WHEN pick <= 1 THEN stop WHEN pick = 3 THEN 1 ELSE n_lines END AS last FROM f LEFT JOIN e USING (doc_id))
    SELECT *, CASE WHEN first IS NULL THEN 'start marker not found' WHEN last IS NULL THEN 'end marker not found after start' WHEN last <= first THEN 'end is not after start' END AS problem FROM r)"""
CUT = f"(SELECT id, l.line_no, line FROM {LINES} l JOIN {BOUNDS} b USING (doc_id) WHERE problem IS NULL AND line_no >= first AND line_no < last)"

QUERIES = {
    "A1_f_rate": a1, "A2_ligature_census": a2, "A3_markup": a3, "A4_soft_hyphens": a4, "A5_ligature_repair": a5, "A6_collapse_blanks": a6, "A7_damage_verdict": a7, "A8_top_suspects": a8,
    "A9_lines": a9, "A10_find_marker": a10, "A11_resolve_bounds": a11, "A12_header_strip": a12, "A13_cluster_stats": a13, "A14_firsthand_ratio": a14, "A15_manifest_violations": a15, "A16_slug": a16,
    "A17_coverage": a17, "A18_independence": a18, "A19_attribution": a19, "A20_batch_boundary": a20,
}

MANIFEST_CHECKS = ", ".join([f"CASE WHEN trim({c}) = '' THEN 'missing {c}' END" for c in segmentation.REQUIRED] + [
    "CASE WHEN NOT regexp_matches(id, '^c[0-9]{2,}$') THEN 'bad id' END", f"CASE WHEN kind NOT IN ({sql.quoted(segmentation.KINDS)}) THEN 'bad kind' END",
    f"CASE WHEN attribution NOT IN ({sql.quoted(segmentation.ATTRIBUTIONS)}) THEN 'bad attribution' END"])
LIGATURE_MAP = lambda all_: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.LIGATURES.items() if all_ or k not in L.AMBIGUOUS) + "}"
REPAIRED = lambda all_: f"sha256(list_aggregate([coalesce(m[x], x) for x in regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')], 'string_agg', ''))".replace("m[", f"{LIGATURE_MAP(all_)}[")

ORACLES = {
    "A1_f_rate": f"SELECT doc_id, 100.0 * len(regexp_extract_all(lower(text), 'f')) / nullif(len(regexp_extract_all(lower(text), '[a-z]')), 0) AS f_rate FROM {DAMAGED}",
    "A2_ligature_census": CENSUS_SQL,
    "A3_markup": f"SELECT doc_id, {MARKUP_SQL} AS markup, length(" + "regexp_replace(" * len(L.MARKUP) + "text" + "".join(f", '{p}', '', 'g')" for p in L.MARKUP) + f") AS \"left\" FROM {DAMAGED}",
    "A4_soft_hyphens": f"""SELECT doc_id, {HYPHEN_SQL} AS hyphens, sha256(list_aggregate(list_transform(list_zip(regexp_split_to_array(text, '{L.SOFT_HYPHEN}'), list_concat(regexp_extract_all(text, '{L.SOFT_HYPHEN}', 0), [''])),
        lambda z: z[1] || CASE WHEN z[2] = '' OR regexp_extract(z[2], '{L.SOFT_HYPHEN}', 2) IN ({sql.quoted(L.NOT_A_CONTINUATION)}) THEN z[2] ELSE regexp_extract(z[2], '{L.SOFT_HYPHEN}', 1) || regexp_extract(z[2], '{L.SOFT_HYPHEN}', 2) END), 'string_agg', '')) AS joined FROM {DAMAGED}""",
    "A5_ligature_repair": f"SELECT doc_id, {REPAIRED(False)} AS plain, {REPAIRED(True)} AS aggressive FROM {DAMAGED}",
    "A6_collapse_blanks": f"SELECT doc_id, sha256(regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g')) AS collapsed FROM {DAMAGED}",
    "A7_damage_verdict": f"""
        WITH c AS ({CENSUS_SQL}), u AS (SELECT doc_id, sum(hits)::BIGINT AS hits FROM c WHERE NOT ambiguous GROUP BY 1),
        b AS (SELECT doc_id, 100.0 * len(regexp_extract_all(lower(text), 'f')) / nullif(len(regexp_extract_all(lower(text), '[a-z]')), 0) AS f_rate, greatest(1, len(regexp_extract_all(text, '\\S+'))) AS n_words,
              {MARKUP_SQL} AS markup, {HYPHEN_SQL} AS hyphens FROM {DAMAGED}),
        r AS (SELECT b.*, coalesce(hits, 0) AS unambiguous, 10000.0 * coalesce(hits, 0) / n_words AS ligature_rate FROM b LEFT JOIN u USING (doc_id)),
        v AS (SELECT *, concat_ws(', ', CASE WHEN ligature_rate >= 10 THEN 'LIGATURE' WHEN f_rate < 2 THEN 'f-low(screen only)' END, CASE WHEN markup > 0 THEN 'MARKUP' END, CASE WHEN 10000.0 * hyphens / n_words >= 20 THEN 'HYPHEN' END) AS x FROM r)
        SELECT doc_id, f_rate, n_words, unambiguous, ligature_rate, markup, hyphens, CASE x WHEN '' THEN 'clean' ELSE x END AS verdict, regexp_matches(x, 'LIGATURE|MARKUP|HYPHEN') AS damaged FROM v""",
    "A8_top_suspects": f"SELECT doc_id, bad, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, position) AS place FROM ({CENSUS_SQL})) WHERE place <= 12",
    "A9_lines": f"SELECT doc_id, line_no, length(line) AS n FROM {LINES}",
    "A10_find_marker": f"SELECT doc_id, min(line_no) AS first FROM {LINES} WHERE regexp_matches(line, '[Tt]he ') GROUP BY 1",
    "A11_resolve_bounds": f"SELECT * FROM {BOUNDS}",
    "A12_header_strip": f"SELECT id, count(*) AS n_lines FROM {CUT} WHERE NOT regexp_matches(line, '^The($|[^\\p{{L}}\\p{{N}}_])') GROUP BY 1",
    "A13_cluster_stats": f"SELECT id, n_words, floor(n_words * 1.33)::BIGINT AS tokens, n_words < 400 AS too_small FROM (SELECT id, sum(len(regexp_extract_all(line, '\\S+')))::BIGINT AS n_words FROM {CUT} GROUP BY 1)",
    "A14_firsthand_ratio": f"SELECT sum(n_words) FILTER (attribution = 'firsthand')::BIGINT AS firsthand_words, sum(n_words)::BIGINT AS n_words, sum(n_words) FILTER (attribution = 'firsthand') / sum(n_words) AS ratio FROM {MANIFEST}",
    "A15_manifest_violations": f"SELECT id, problem FROM (SELECT id, unnest([{MANIFEST_CHECKS}]) AS problem FROM {MANIFEST}) WHERE problem IS NOT NULL",
    "A16_slug": f"SELECT id, substr(trim(regexp_replace(lower('Book -- ' || label || ' -- ' || repeat(label, 3)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug FROM {MANIFEST}",
    "A17_coverage": f"""
        WITH m AS (SELECT * FROM {MANIFEST}), p AS (SELECT DISTINCT period FROM m), g AS (SELECT count(*) FILTER (period - b > 1) AS gaps FROM (SELECT period, lag(period) OVER (ORDER BY period) AS b FROM p)),
        t AS (SELECT coalesce(string_agg(domain, ',' ORDER BY domain), '') AS thin_domains FROM (SELECT domain FROM m GROUP BY 1 HAVING count(*) = 1))
        SELECT sum(tokens)::BIGINT AS total_tokens, count(*) AS n_clusters, sum(tokens) FILTER (attribution = 'firsthand') / sum(tokens) AS firsthand_ratio, sum(tokens) FILTER (kind <> 'monologue') / sum(tokens) AS dialogue_ratio,
               sum(tokens) FILTER (kind = 'decision_record') / sum(tokens) AS decision_density, min(period) AS earliest, max(period) AS latest, any_value(gaps) AS gaps, any_value(thin_domains) AS thin_domains FROM m, g, t""",
    "A18_independence": f"SELECT kind AS claim, count(DISTINCT id) AS n_clusters, count(DISTINCT origin) AS n_origins FROM {MANIFEST} GROUP BY 1",
    "A19_attribution": f"""
        SELECT domain || '-' || kind AS claim, kind, CASE WHEN kind = 'regularity' AND NOT f THEN 'rejected' WHEN kind = 'cost' AND s THEN 'unverified' WHEN kind = 'expression' AND NOT f THEN 'not measured' ELSE 'usable' END AS status
        FROM (SELECT domain, bool_or(attribution = 'firsthand') AS f, bool_and(attribution = 'secondhand') AS s FROM {MANIFEST} GROUP BY 1), (VALUES ('regularity'), ('cost'), ('expression')) k(kind)""",
    "A20_batch_boundary": f"SELECT a.domain, count(*) AS pairs, avg((a.delivery = b.delivery)::INT) AS same_delivery FROM {MANIFEST} a JOIN {MANIFEST} b ON a.domain = b.domain AND a.id < b.id GROUP BY 1",
}
