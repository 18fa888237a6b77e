"""Register queries (D1 to D27); a unit is the English text of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.operators import registers as R
from loomtext.operators import style, works
from loomtext.operators.scan import staged
from loomtext.plans import sql
from loomtext.plans.style import CHINESE, ZH, chinese

TERMS, FLAGSHIP = ("the of", "And "), ("tion",)


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _units(spark, d):
    return style.joined_by(_docs(spark, d).filter("lang = 'en'"), "source").withColumnRenamed("source", "unit_id")


def _english(spark, d):
    return _docs(spark, d).filter("lang = 'en'")


def _table(spark, d):
    """What the texts of the units are read for, once: a row a unit."""
    return works.unit_table(_english(spark, d), "source", ["doc_id"], TERMS, FLAGSHIP)


def _features(spark, d):
    return works.features_of(_table(spark, d))


#: Families for queries that need some: units in two groups by the last digit of their name.
def _members(spark, d):
    units = _english(spark, d).select(F.col("source").alias("unit_id")).distinct()
    return units.select("unit_id", F.when(F.col("unit_id").rlike("[0-4]$"), "R1").otherwise("R2").alias("family_id"))


def d1(spark, d):
    return _docs(spark, d).select("doc_id", R.language(F.col("text")).alias("lang")).unionByName(spark.createDataFrame([(-i, t) for i, t in CHINESE], "doc_id long, text string").select("doc_id", R.language(F.col("text")).alias("lang")))


def d2(spark, d):
    return _features(spark, d)


ZH_TERMS, ZH_FLAGSHIP = ("北京", "不是"), ("大学",)


def d3(spark, d):
    units = chinese(spark, d).withColumn("unit_id", F.concat(F.lit("u"), "doc_id"))
    return R.features_zh(units.select("unit_id", "text"), ZH_TERMS, ZH_FLAGSHIP)


def d4(spark, d):
    """The 90th percentile of each document's sentence lengths."""
    units = _docs(spark, d).select(F.col("doc_id").alias("unit_id"), "text")
    return R.features_en(units).filter("dim = 'p90_sentence_len'").select(F.col("unit_id").alias("doc_id"), F.col("value").alias("p90"))


def d5(spark, d):
    units = staged(R.unit_sizes(_english(spark, d), "source"), "sizes")
    more = R.text_sizes(spark.createDataFrame([("zz", "他们都是大学的人")], "unit_id string, text string"))
    return R.size_problems(units.unionByName(units.filter("unit_id = 'src1'")).unionByName(more), least_chars=20)


def d6(spark, d):
    return R.ratios(R.pairs(_features(spark, d)))


def d7(spark, d):
    return R.z_scores(_features(spark, d)).select("unit_id", "dim", F.round("z", 6).alias("z"))


def d8(spark, d):
    return R.z_distances(R.z_scores(_features(spark, d))).select("a", "b", F.round("distance", 6).alias("distance"))


def d9(spark, d):
    return _supported(_table(spark, d))


def _supported(table):
    return R.supported(works.features_of(table), table.select("unit_id", "tokens"), ratio=1.5, least_events=2)


def d10(spark, d):
    table = _table(spark, d)
    return R.events(works.features_of(table), table.select("unit_id", "tokens")).select("unit_id", "dim", F.col("events").cast("double").alias("events"))


def d11(spark, d):
    return R.adequacy(_table(spark, d).select("unit_id", "tokens", "sentences"))


def d12(spark, d):
    cut = R.windows(works.beginnings(_english(spark, d), "source", ["doc_id"], 200 * R.WINDOWS), 200)
    return R.observations(cut.withColumn("unit_id", F.concat_ws("/", "unit_id", "k")))


def d13(spark, d):
    return R.forced_splits(d9(spark, d), dims=2)


def d14(spark, d):
    """Windows need the beginnings of units only; what is asked of whole units comes from their table."""
    table = works.unit_table(_english(spark, d), "source", ["doc_id"])
    cut = staged(R.windows(works.beginnings(_english(spark, d), "source", ["doc_id"], 100 * R.WINDOWS), 100), "windows")
    per = R.supported(R.features_en(cut, extra=("k",)), cut.select("unit_id", "k", F.lit(100).alias("tokens")), by=("k",))
    return R.pair_stability(table, R.forced_splits(R.supported(works.features_of(table), table.select("unit_id", "tokens"))), R.forced_splits(per, by=("k",)))


def d15(spark, d):
    table = _table(spark, d)
    z = R.z_distances(R.z_scores(works.features_of(table)))
    return R.families(spark, table.select("unit_id"), z, R.forced_splits(_supported(table), dims=2))


def d17(spark, d):
    return R.centroids(_features(spark, d), _members(spark, d))


def d18(spark, d):
    return R.spearman(_features(spark, d)).select("p", "q", F.round("rho", 6).alias("rho"))


def d19(spark, d):
    """Few real features move together, so three follow one here."""
    features = _features(spark, d)
    base = features.filter("dim = 'mean_sentence_len'")
    follow = [base.withColumn("dim", F.lit(k)).withColumn("value", F.col("value") * m + 1) for k, m in (("hedge_rate", 2), ("booster_rate", -3), ("connective_rate", 5))]
    rest = features.filter("dim NOT IN ('hedge_rate', 'booster_rate', 'connective_rate')")
    return R.gradients(rest.unionByName(follow[0]).unionByName(follow[1]).unionByName(follow[2]), _members(spark, d))


def d20(spark, d):
    return R.gaps(d17(spark, d)).select("dim", "low", "high", "max_ratio")


def d21(spark, d):
    """Of every source: its languages as families, adequate by size, stable by the share of its documents that are long."""
    rows = _docs(spark, d).groupBy("source").agg(F.countDistinct("lang").alias("n"), F.sum("n_chars").alias("chars"), F.avg((F.col("n_chars") > 500).cast("int")).alias("long"))
    return rows.select("source", R.verdicts(F.col("n"), F.col("chars") > 100_000, F.col("long") > 0.6).alias("verdict"))


def _clustered(spark, d):
    return _docs(spark, d).filter("lang = 'en'").groupBy("source").agg(F.array_sort(F.collect_set(F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string")))).alias("clusters")).withColumnRenamed("source", "unit_id")


def d22(spark, d):
    return R.family_mapping(_clustered(spark, d), _members(spark, d)).select("source", F.array_join("families", ",").alias("families"), (F.size("families") > 1).alias("mixed"))


def d23(spark, d):
    return _docs(spark, d).filter("lang = 'en'").select("doc_id", F.sha2(R.denoise(F.col("text")), 256).alias("clean"))


def d23_mask(spark, d):
    return _docs(spark, d).filter("lang = 'en'").select("doc_id", F.length(R.mask_names(R.denoise(F.col("text")))).alias("n"))


def d24(spark, d):
    return R.blind_sample(_units(spark, d).withColumnRenamed("unit_id", "cluster_id"))


def _key(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("passage_id"), F.col("lang").alias("family_id"))


def _answers(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("passage_id"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("family_id"))


def d25(spark, d):
    return R.discrimination(_key(spark, d), _answers(spark, d))


def d25_confusions(spark, d):
    return R.confusions(_key(spark, d), _answers(spark, d))


def d26(spark, d):
    def half(third: bool):
        return works.features_en(_english(spark, d).filter((F.col("doc_id") % 3 == 0) == F.lit(third)), "source", ["doc_id"])

    return R.divergence(half(True), half(False))


def d27(spark, d):
    return R.family_mapping(_clustered(spark, d), _members(spark, d)).filter(F.size("families") > 1).select("source", F.array_join("families", ",").alias("families"))


QUERIES = {
    "D1_language": d1, "D2_features_en": d2, "D3_features_zh": d3, "D4_p90": d4, "D5_unit_problems": d5, "D6_pair_ratios": d6, "D7_z_scores": d7, "D8_z_distances": d8, "D9_supported_dimensions": d9, "D10_event_counts": d10, "D11_adequacy": d11, "D12_windows": d12,
    "D13_forced_splits": d13, "D14_pair_stability": d14, "D15_families": d15, "D17_centroids": d17, "D18_spearman": d18, "D19_gradients": d19, "D20_gap_table": d20, "D21_verdict": d21, "D22_family_mapping": d22, "D23_denoise": d23, "D23_mask_names": d23_mask,
    "D24_blind_sample": d24, "D25_discrimination": d25, "D25_confusions": d25_confusions, "D26_divergence": d26, "D27_conflicts": d27,
}


def units(where: str = "lang = 'en'") -> str:
    return rf"(SELECT source AS unit_id, string_agg(text, E'\n\n' ORDER BY doc_id) AS text FROM documents WHERE {where} GROUP BY 1)"


def features(rows: str, terms=(), flagship=()) -> str:
    """Long features of ``rows`` (unit_id, text)."""
    share = lambda members: f"10000.0::DOUBLE * {sql.share_of('w', members)} / nn"
    phrase = lambda ts: "10000.0::DOUBLE * (" + (" + ".join(sql.n_literal("lower(text)", t.lower()) for t in ts) or "0") + ") / nn"
    dims = {
        "mean_sentence_len": "coalesce(list_avg(s), 0)", "median_sentence_len": "coalesce(list_median(s), 0)", "p90_sentence_len": "coalesce(s[least(len(s) - 1, len(s) * 9 // 10) + 1], 0)",
        "long_sentence_share": "coalesce(len([x for x in s if x > 30]) / nullif(len(s), 0)::DOUBLE, 0)", "question_rate": f"10000.0::DOUBLE * {sql.n_literal('text', '?')} / nn", "connective_rate": share(L.CONNECTIVES), "hedge_rate": share(L.HEDGES), "booster_rate": share(L.BOOSTERS),
        "second_person_rate": share(L.SECOND_PERSON), "first_person_rate": share(L.FIRST_PERSON), "title_mark_rate": "0", "core_term_density": phrase(terms), "flagship_term_density": phrase(flagship),
    }
    word = L.WORD.replace("'", "''")
    base = f"(SELECT *, nullif(len(w), 0) AS nn FROM (SELECT unit_id, text, {sql.WORDS} AS w, list_sort([n for n in [len(regexp_extract_all(x, '{word}')) for x in {sql.SENTENCES}] if n > 0]) AS s FROM {rows}))"
    return "(" + " UNION ALL ".join(f"SELECT unit_id, '{k}' AS dim, coalesce({v}, 0)::DOUBLE AS value FROM {base}" for k, v in dims.items()) + ")"


def features_zh() -> str:
    """Long features of the Chinese texts, one unit each."""
    han = f"len(regexp_extract_all(text, '{L.HAN}'))"
    rate = lambda words: "10000.0::DOUBLE * (" + " + ".join(sql.n_literal("text", w) for w in words) + ") / nn"
    dims = {
        "mean_sentence_len": "list_avg(s)", "median_sentence_len": "list_median(s)", "p90_sentence_len": "s[least(len(s) - 1, len(s) * 9 // 10) + 1]",
        "long_sentence_share": "len([x for x in s if x > 40]) / nullif(len(s), 0)::DOUBLE", "question_rate": rate(("？", "?")), "connective_rate": rate(L.SCAFFOLDING_ZH),
        "hedge_rate": rate(L.HEDGES_ZH), "booster_rate": rate(L.BOOSTERS_ZH), "second_person_rate": rate(L.SECOND_ZH), "first_person_rate": rate(L.FIRST_ZH),
        "title_mark_rate": rate(("《",)), "core_term_density": rate(ZH_TERMS), "flagship_term_density": rate(ZH_FLAGSHIP),
    }
    lengths = f"list_sort([n for n in [len(regexp_extract_all(x, '{L.HAN}')) for x in regexp_split_to_array(text, '{L.SENTENCE_END_ZH}')] if n > 0])"
    base = f"(SELECT 'u' || doc_id AS unit_id, text, nullif({han}, 0) AS nn, {lengths} AS s FROM {ZH})"
    return " UNION ALL ".join(f"SELECT unit_id, '{k}' AS dim, coalesce({v}, 0)::DOUBLE AS value FROM {base}" for k, v in dims.items())


FEATURES = features(units(), TERMS, FLAGSHIP)
WITH = f"WITH f AS MATERIALIZED (SELECT * FROM {FEATURES}) "
Z = "(SELECT unit_id, dim, CASE WHEN sd > 1e-12 THEN (v - m) / sd ELSE 0 END AS z FROM (SELECT unit_id, dim, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM (SELECT unit_id, dim, round(value, 6) AS v FROM f) WINDOW w AS (PARTITION BY dim)))"
DIST = f"(SELECT a.unit_id AS a, b.unit_id AS b, avg(abs(a.z - b.z)) AS distance FROM {Z} a JOIN {Z} b ON a.dim = b.dim AND a.unit_id < b.unit_id GROUP BY 1, 2)"
TOKENS = f"(SELECT unit_id, len({sql.WORDS}) AS tokens FROM {units()})"
LEAST = "CASE dim " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.ABSOLUTE_MINIMA.items()) + " ELSE 10 END"
SUPPORTED = f"""(SELECT a, b, dim FROM (SELECT p.unit_id AS a, q.unit_id AS b, dim, p.value AS x, q.value AS y, p.e AS ex, q.e AS ey FROM e p JOIN e q USING (dim) WHERE p.unit_id < q.unit_id)
    WHERE x <> y AND (dim IN ({sql.quoted(L.ABSOLUTE_MINIMA)}) OR greatest(ex, ey) >= 2) AND greatest(x, y) - least(x, y) >= {LEAST} AND (least(x, y) = 0 OR greatest(x, y) / nullif(least(x, y), 0) > 1.5))"""


def _windowed(size: int) -> str:
    """Windows of so many words; a window is its words with what follows each: matches and the gaps between them alternate."""
    return f"""(SELECT unit_id || '/' || k AS unit_id, list_aggregate([w[i] || g[i + 1] for i in range({size} * k + 1, least({size} * (k + 1), len(w)) + 1)], 'string_agg', '') AS text
        FROM (SELECT *, unnest(range(3)) AS k FROM (SELECT unit_id, regexp_extract_all(text, '{sql.WORD}') AS w, regexp_split_to_array(text, '{sql.WORD}') AS g FROM {units()})) WHERE {size} * k < len(w))"""


def _splits(e: str, by: str = "") -> str:
    """Pairs split by the defaults: three dimensions that differ by three times, on five events."""
    return f"""(SELECT a, b{by} FROM (SELECT p.unit_id AS a, q.unit_id AS b, dim{by}, p.value AS x, q.value AS y, p.e AS ex, q.e AS ey FROM {e} p JOIN {e} q USING (dim{by}) WHERE p.unit_id < q.unit_id)
        WHERE x <> y AND (dim IN ({sql.quoted(L.ABSOLUTE_MINIMA)}) OR greatest(ex, ey) >= 5) AND greatest(x, y) - least(x, y) >= {LEAST} AND (least(x, y) = 0 OR greatest(x, y) / nullif(least(x, y), 0) > 3) GROUP BY a, b{by} HAVING count(*) >= 3)"""


_counted = f"CASE WHEN dim IN ({sql.quoted(L.ABSOLUTE_MINIMA)}) THEN 0 ELSE round_even(value * tokens / 10000, 0) END AS e"
EVENTS = WITH + f", e AS MATERIALIZED (SELECT f.*, CASE WHEN dim IN ({sql.quoted(L.ABSOLUTE_MINIMA)}) THEN 0 ELSE round_even(value * tokens / 10000, 0) END AS e FROM f JOIN {TOKENS} USING (unit_id)) "
FAMILY = "CASE WHEN regexp_matches(unit_id, '[0-4]$') THEN 'R1' ELSE 'R2' END"
CENTRES = f"(SELECT {FAMILY} AS family_id, dim, round(avg(round(value, 6)), 6) AS mean FROM f GROUP BY 1, 2)"
CLUSTERED = "(SELECT DISTINCT source AS unit_id, s FROM (SELECT source, unnest([source, 'c' || (doc_id % 7)]) AS s FROM documents WHERE lang = 'en'))"

ORACLES = {
    "D12_windows": f"SELECT unit_id, len(regexp_extract_all(text, '{sql.WORD}')) AS tokens, len([x for x in {sql.SENTENCES} if len(regexp_extract_all(x, '{sql.WORD}')) > 0]) AS sentences FROM {_windowed(200)}",
    "D14_pair_stability": f"""WITH e0 AS MATERIALIZED (SELECT f.*, {_counted} FROM {features(units())} f JOIN {TOKENS} USING (unit_id)),
        e1 AS MATERIALIZED (SELECT split_part(unit_id, '/', 1) AS unit_id, split_part(unit_id, '/', 2) AS k, dim, value, {_counted} FROM (SELECT *, 100 AS tokens FROM {features(_windowed(100))})),
        s AS (SELECT a, b, true AS split FROM {_splits('e0')}), v AS (SELECT a, b, count(*) AS votes FROM {_splits('e1', ', k')} GROUP BY 1, 2), u AS (SELECT unit_id FROM {units()})
        SELECT p.unit_id AS a, q.unit_id AS b, coalesce(split, false) AS split, CASE WHEN split THEN coalesce(votes, 0) ELSE 3 - coalesce(votes, 0) END / 3.0::DOUBLE AS agreement
        FROM u p JOIN u q ON p.unit_id < q.unit_id LEFT JOIN s ON s.a = p.unit_id AND s.b = q.unit_id LEFT JOIN v ON v.a = p.unit_id AND v.b = q.unit_id""",
    "D1_language": "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) / nullif(len(regexp_extract_all(text, '\\S')), 0)::DOUBLE > 0.3 THEN 'zh' ELSE 'en' END AS lang FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(-i, t.replace("'", "''")) for i, t in CHINESE) + "))",
    "D2_features_en": f"SELECT * FROM {FEATURES}",
    "D3_features_zh": features_zh(),
    "D4_p90": f"SELECT unit_id AS doc_id, value AS p90 FROM {features('(SELECT doc_id AS unit_id, text FROM documents)')} WHERE dim = 'p90_sentence_len'",
    "D10_event_counts": EVENTS + "SELECT unit_id, dim, e::DOUBLE AS events FROM e",
    "D5_unit_problems": f"SELECT 'src1' AS unit_id, 'repeated unit' AS problem UNION ALL SELECT 'zz', 'too short' UNION ALL SELECT 'zz', 'mixed languages' UNION ALL SELECT unit_id, 'too short' FROM {units()} WHERE length(text) < 20",
    "D6_pair_ratios": WITH + "SELECT a.unit_id AS a, b.unit_id AS b, dim, a.value AS x, b.value AS y, CASE WHEN a.value = 0 AND b.value = 0 THEN 1 WHEN least(a.value, b.value) > 0 THEN greatest(a.value, b.value) / least(a.value, b.value) END AS ratio FROM f a JOIN f b USING (dim) WHERE a.unit_id < b.unit_id",
    "D7_z_scores": WITH + f"SELECT unit_id, dim, round(z, 6) AS z FROM {Z}",
    "D8_z_distances": WITH + f"SELECT a, b, round(distance, 6) AS distance FROM {DIST}",
    "D9_supported_dimensions": EVENTS + f"SELECT * FROM {SUPPORTED}",
    "D11_adequacy": f"""SELECT n_units, "window", n_units >= 2 AND ok AND "window" >= 100 AS adequate FROM (SELECT count(*) AS n_units, min(tokens // 3) AS "window", bool_and(tokens >= 600 AND sentences >= 20) AS ok
        FROM (SELECT len({sql.WORDS}) AS tokens, len([x for x in {sql.SENTENCES} if len(regexp_extract_all(x, '{sql.WORD}')) > 0]) AS sentences FROM {units()}))""",
    "D13_forced_splits": EVENTS + f"SELECT a, b, count(*) AS n_dims FROM {SUPPORTED} GROUP BY 1, 2 HAVING count(*) >= 2",
    "D17_centroids": WITH + f"SELECT * FROM {CENTRES}",
    "D18_spearman": WITH + """, r AS (SELECT unit_id, dim, rank() OVER (PARTITION BY dim ORDER BY value) + (count(*) OVER (PARTITION BY dim, value) - 1) / 2.0 AS r FROM f)
        SELECT a.dim AS p, b.dim AS q, round(CASE WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) ELSE 0 END, 6) AS rho FROM r a JOIN r b USING (unit_id) WHERE a.dim <> b.dim GROUP BY 1, 2""",
    "D20_gap_table": WITH + f"SELECT dim, min(mean) AS low, max(mean) AS high, CASE WHEN max(mean) = 0 THEN 1 WHEN min(mean) > 0 THEN max(mean) / min(mean) END AS max_ratio FROM {CENTRES} GROUP BY 1",
    "D21_verdict": "SELECT source, CASE WHEN coalesce(NOT (sum(n_chars) > 100000 AND avg((n_chars > 500)::INT) > 0.6::DOUBLE), true) THEN 'INSUFFICIENT_EVIDENCE' WHEN count(DISTINCT lang) > 1 THEN 'MULTI_REGISTER' ELSE 'SINGLE_REGISTER' END AS verdict FROM documents GROUP BY 1",
    "D22_family_mapping": f"SELECT s AS source, string_agg(DISTINCT {FAMILY}, ',' ORDER BY {FAMILY}) AS families, count(DISTINCT {FAMILY}) > 1 AS mixed FROM {CLUSTERED} GROUP BY 1",
    "D23_denoise": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\[[^\]]{0,80}\]|\*+|#+|<!--.*?-->|\(#\)|_+', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents WHERE lang = 'en'",
    "D25_discrimination": "SELECT count(*) AS n, count(*) FILTER (hit) AS hits, avg(hit::INT) AS accuracy, CASE WHEN avg(hit::INT) >= 0.9 THEN 'strong' WHEN avg(hit::INT) >= 0.7 THEN 'adequate' ELSE 'weak' END AS band FROM (SELECT doc_id % 5 <> 0 OR lang = 'en' AS hit FROM documents)",
    "D25_confusions": "SELECT lang AS actual, 'en' AS predicted, count(*) AS n FROM documents WHERE doc_id % 5 = 0 AND lang <> 'en' GROUP BY 1",
    "D26_divergence": f"SELECT unit_id, dim, a.value - b.value AS delta FROM {features(units('lang = ' + chr(39) + 'en' + chr(39) + ' AND doc_id % 3 = 0'))} a JOIN {features(units('lang = ' + chr(39) + 'en' + chr(39) + ' AND doc_id % 3 <> 0'))} b USING (unit_id, dim)",
    "D27_conflicts": f"SELECT s AS source, string_agg(DISTINCT {FAMILY}, ',' ORDER BY {FAMILY}) AS families FROM {CLUSTERED} GROUP BY 1 HAVING count(DISTINCT {FAMILY}) > 1",
}
