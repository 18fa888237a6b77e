"""Split, admission and budget queries (E1 to E15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import admission as A
from loomtext.plans import sql


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _passages(spark, d):
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return _docs(spark, d).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("group"), F.concat(F.lit("d"), (number % 3).cast("string")).alias("domain"), "lang")


CLASSES = tuple(A.REQUIRED)


def _elements(spark, d):
    """An element per document, its parts computed from the number of the document."""
    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, CLASSES)), (i % 8).cast("int"))
    text = lambda k: F.when(i % k == 0, "").otherwise("text")
    fields = sorted({f for fs in A.REQUIRED.values() for f in fs if f != "steps"})
    prefix = F.create_map(*[F.lit(x) for p in A.PREFIX.items() for x in p])
    share = lambda k: ((i * k) % 101) / F.lit(100.0)
    return _docs(spark, d).select(
        F.concat(F.coalesce(F.try_element_at(prefix, kind), F.lit("ST")), F.when(i % 29 == 0, "_").otherwise("-"), i.cast("string")).alias("id"), kind.alias("class"),
        *[text(11 + j).alias(f) for j, f in enumerate(fields)], F.when(i % 13 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("one"), F.lit("two"))).alias("steps"),
        F.transform(F.sequence(F.lit(0), (i % 7).cast("int")), lambda k: F.concat(F.lit("c"), F.lpad(((i + k) % 5).cast("string"), F.when(i % 31 == 0, 1).otherwise(2), F.lit("0")))).alias("clusters"),
        F.array_repeat(F.lit("locator"), (i % 5).cast("int")).alias("locators"), F.when(i % 17 == 0, F.array(F.lit("thin"))).otherwise(F.expr("cast(array() as array<string>)")).alias("flags"),
        F.array_repeat(F.concat(F.lit("d"), (i % 3).cast("string")), 1 + (i % 2).cast("int")).alias("_d"),
        F.array(F.lit("x"), F.concat(F.lit("d"), (i % 3).cast("string"))).alias("domains"),
        F.struct(share(37).alias("transfer"), share(53).alias("reasoning"), share(71).alias("pressure"), F.when(i % 97 == 3, None).otherwise(share(29)).alias("discrimination"), (i % 6).alias("transfer_cases"), (i % 9).alias("pressure_cases"), (i % 15).alias("corpus_hits"), (i % 60).alias("observations")).alias("metrics"),
    ).drop("_d").withColumn("_n", F.regexp_extract("id", r"(\d+)$", 1).cast("long")).withColumn("conflicts_with", F.expr("cast(array() as array<string>)"))


def _conflicting(spark, d):
    rows = _elements(spark, d)
    ids = rows.select((F.col("_n") - 8).alias("_n"), F.col("id").alias("_other"))
    both = rows.join(ids, "_n", "left")
    return both.withColumn("conflicts_with", F.when((F.col("_n") % 5 == 0) & F.col("_other").isNotNull(), F.array("_other")).otherwise(F.expr("cast(array() as array<string>)"))).drop("_n", "_other")


def e1(spark, d):
    return A.grouped_split(_passages(spark, d))


def e1_stratified(spark, d):
    return A.grouped_split(_passages(spark, d), stratify="domain")


def e1_passages(spark, d):
    return _passages(spark, d).join(e1(spark, d), "group").groupBy("partition").agg(F.count("*").alias("n"))


def e2(spark, d):
    rows = _passages(spark, d)
    return A.split_problems(rows.unionByName(rows.filter("id = 'p3'")).unionByName(spark.createDataFrame([("", "g", "d0", "en")], rows.schema)), stratify="lang")


def e3(spark, d):
    return A.admit(_elements(spark, d)).select("id", "class", "eligible", "score", "error")


def e4(spark, d):
    return A.decide(_conflicting(spark, d)).select("id", "decision", "conflicts")


def e5(spark, d):
    return A.decide(_conflicting(spark, d)).filter("decision = 'retain'").select("id", "class", "score", "rank")


def _counts(spark, d):
    n = lambda k, m: F.count_if(F.col("doc_id") % k == 0) % m
    names = ["n_cost_refusal", "n_projectible", "n_procedure", "n_verdict", "n_interactional", "n_variation", "n_constructs", "n_epistemic", "n_moves", "n_personal", "n_registers", "any_gradient", "n_rules", "n_avoid", "n_pairs", "n_nopool_pairs"]
    mods = [9, 10, 8, 30, 7, 6, 45, 9, 13, 9, 6, 2, 25, 30, 11, 9]
    return _docs(spark, d).groupBy("source").agg(*[n(j % 5 + 1, m).alias(k) for j, (k, m) in enumerate(zip(names, mods))], F.sum("n_chars").alias("total_tokens"), F.countDistinct("lang").alias("n_clusters"), F.avg((F.col("lang") == "en").cast("int")).alias("firsthand_ratio"))


def e6(spark, d):
    return A.core_budget(_counts(spark, d)).select("source", "supply", "ceiling", "core_budget")


def _modules(spark, d):
    i = F.col("doc_id")
    return _docs(spark, d).select(i.alias("cluster_id"), (F.length("text")).alias("words"), (i % 16).alias("apparatus"), (i % 15).alias("moves"), (i % 11).alias("applications"), (i % 30).alias("fragments"),
                                  F.when(i % 4 == 0, i % 12).alias("siblings"), (i % 5).alias("registers"), (i % 2 == 0).alias("shared_domain"), F.lit(None).cast("long").alias("words_firsthand"))


def e7(spark, d):
    return A.cluster_budgets(_modules(spark, d)).select("cluster_id", "siblings", "mass", "supply", "budget")


def e8(spark, d):
    return A.cluster_budgets(_modules(spark, d)).select("cluster_id", "verdict")


def e10(spark, d):
    return A.cluster_budgets(_modules(spark, d), {"moves": (40, 5)}).select("cluster_id", "budget", "verdict")


SCALARS = {"frame": 500, "prohibitions": 60, "sibling": 10, "siblings": 5, "mass": 900, "register": 150, "registers": 2, "floor": 1500, "ceiling": 3000}


def e10_scalars(spark, d):
    return A.cluster_budgets(_modules(spark, d), scalars=SCALARS).select("cluster_id", "mass", "budget", "verdict")


def e9(spark, d):
    return A.with_defaults(_modules(spark, d)).select("cluster_id", "siblings", "words_firsthand")


def e11(spark, d):
    return A.standing_budgets(_counts(spark, d)).select("source", "frameworks_budget", "voice_budget")


def e12(spark, d):
    return A.worst_case_load(A.cluster_budgets(_modules(spark, d)), 5510, 3000, 4000)


def e13(spark, d):
    return A.style_cap(e5(spark, d))


def e14(spark, d):
    i = F.col("doc_id")
    parts = _docs(spark, d).select(i.alias("id"), F.get(F.array(*map(F.lit, (*A.RELOCATION, "axis"))), (i % 6).cast("int")).alias("kind"), (i % 100).alias("place"), "n_chars", (i % 9 == 0).alias("protected"))
    return A.relocations(parts.withColumnRenamed("n_chars", "size"), 100_000)


def e15(spark, d):
    return A.element_problems(_elements(spark, d))


QUERIES = {"E1_grouped_split": e1, "E1_stratified_split": e1_stratified, "E1_passages": e1_passages, "E2_split_problems": e2, "E3_admission": e3, "E4_conflicts": e4, "E5_ranking": e5, "E6_core_budget": e6, "E7_cluster_budget": e7, "E8_budget_verdict": e8, "E9_defaults": e9, "E10_coefficients": e10, "E10_scalars": e10_scalars, "E11_standing_budgets": e11, "E12_worst_case_load": e12, "E13_style_cap": e13, "E14_relocation": e14, "E15_element_problems": e15}


def _split(stratum: str) -> str:
    return f"""SELECT "group", stratum, CASE WHEN n < 3 THEN 'train' WHEN place <= t THEN 'test' WHEN place <= t + least(ceil(n * 0.15::DOUBLE), n - t - 1) THEN 'development' ELSE 'train' END AS partition FROM (SELECT *, least(ceil(n * 0.12::DOUBLE), n - 2) AS t FROM (
        SELECT "group", stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || "group"), "group") AS place, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT DISTINCT source AS "group", {stratum} AS stratum FROM documents)))"""


FIELDS = sorted({f for fs in A.REQUIRED.values() for f in fs if f != "steps"})
_share = lambda k: f"((i * {k}) % 101) / 100.0::DOUBLE"
ELEMENTS = f"""(SELECT *, CASE class {' '.join(f"WHEN '{c}' THEN '{p}'" for c, p in A.PREFIX.items())} ELSE 'ST' END || CASE WHEN i % 29 = 0 THEN '_' ELSE '-' END || i AS id,
    {', '.join(f"i % {11 + j} <> 0 AS {f}" for j, f in enumerate(FIELDS))}, i % 13 <> 0 AS steps, least(i % 7 + 1, 5) AS n_clusters, i % 7 + 1 >= 2 AND i % 5 >= 2 AS sourced, i % 17 = 0 AS flagged, i % 31 = 0 AS short,
    {_share(37)} AS transfer, {_share(53)} AS reasoning, {_share(71)} AS pressure, CASE WHEN i % 97 = 3 THEN NULL ELSE {_share(29)} END AS discrimination, i % 6 AS transfer_cases, i % 9 AS pressure_cases, i % 15 AS corpus_hits, i % 60 AS observations
    FROM (SELECT doc_id AS i, [{sql.quoted(CLASSES)}][doc_id % 8 + 1] AS class FROM documents))"""
_has = "CASE class " + " ".join(f"WHEN '{c}' THEN {' AND '.join(fs)}" for c, fs in A.REQUIRED.items()) + " END AND sourced"
_proc = ("transfer >= 0.7 AND reasoning >= 0.5 AND transfer_cases >= 2", "0.7::DOUBLE * transfer + 0.3::DOUBLE * reasoning")
_style = ("discrimination >= 0.7 AND observations >= 20", "discrimination")
_rules = {"procedure": _proc, "projectible_regularity": _proc, "verdict": ("corpus_hits >= 2", "0.6::DOUBLE * least(n_clusters / 5.0::DOUBLE, 1) + 0.4::DOUBLE * least(corpus_hits / 10.0::DOUBLE, 1)"), "stable_style": _style, "variation": _style,
          "cost_refusal": ("pressure >= 0.7 AND pressure_cases >= 2", "pressure"), "interactional": ("transfer >= 0.7 AND transfer_cases >= 2", "transfer"), "preoccupation": ("n_clusters >= 3", "least(n_clusters / 6.0::DOUBLE, 1)")}
ADMITTED = f"""(SELECT id, i, class, counts AND error IS NULL AND coalesce(CASE class {' '.join(f"WHEN '{c}' THEN {t}" for c, (t, _) in _rules.items())} END, false) AS eligible,
    CASE WHEN counts AND error IS NULL THEN round(CASE class {' '.join(f"WHEN '{c}' THEN {v}" for c, (_, v) in _rules.items())} END, 6) ELSE 0 END AS score, error
    FROM (SELECT *, NOT flagged AND {_has} AS counts, CASE WHEN NOT flagged AND {_has} AND class IN ('stable_style', 'variation') AND discrimination IS NULL THEN 'invalid: discrimination' END AS error FROM {ELEMENTS}))"""
PAIRS = f"(SELECT a.id AS id, b.id AS other FROM {ELEMENTS} a JOIN {ELEMENTS} b ON b.i = a.i + 8 WHERE a.i % 5 = 0)"
DECIDED = f"""(SELECT a.*, conflicts, CASE WHEN NOT eligible THEN 'cut' WHEN conflicts IS NOT NULL THEN 'pending' ELSE 'retain' END AS decision FROM {ADMITTED} a
    LEFT JOIN (SELECT id, string_agg(DISTINCT other, ',' ORDER BY other) AS conflicts FROM (SELECT id, other FROM {PAIRS} UNION SELECT other, id FROM {PAIRS}) GROUP BY 1) USING (id))"""
RANKED = f"(SELECT id, class, score, row_number() OVER (ORDER BY list_position([{sql.quoted(CLASSES)}], class), score DESC, id) AS rank FROM {DECIDED} WHERE decision = 'retain')"
_names = ["n_cost_refusal", "n_projectible", "n_procedure", "n_verdict", "n_interactional", "n_variation", "n_constructs", "n_epistemic", "n_moves", "n_personal", "n_registers", "any_gradient", "n_rules", "n_avoid", "n_pairs", "n_nopool_pairs"]
COUNTS = "(SELECT source, " + ", ".join(f"count(*) FILTER (doc_id % {j % 5 + 1} = 0) % {m} AS {k}" for j, (k, m) in enumerate(zip(_names, [9, 10, 8, 30, 7, 6, 45, 9, 13, 9, 6, 2, 25, 30, 11, 9]))) + ", sum(n_chars)::BIGINT AS total_tokens, count(DISTINCT lang) AS n_clusters, avg((lang = 'en')::INT) AS firsthand_ratio FROM documents GROUP BY 1)"
_sum = lambda base, terms: str(base) + "".join(f" + {p} * least({n}, {c})" for n, p, c in terms)


def _modules_sql(moves=(90, 12), scalars=None) -> str:
    c = A.COEFFICIENTS | (scalars or {})
    recut = f"(apparatus > 12 OR moves > {moves[1]})"
    return f"""(SELECT *, greatest({c['floor']}, least(supply, {c['ceiling']})) AS budget,
            CASE WHEN {recut} AND r > 1 AND shared THEN 'SPLIT_IN_MODULE' WHEN {recut} THEN 'RECUT' WHEN supply < {c['floor']} THEN 'FLOOR' ELSE 'OK' END AS verdict FROM (
        SELECT *, {c['frame']} + 90 * least(apparatus, 12) + {moves[0]} * least(moves, {moves[1]}) + 85 * least(applications, 8) + 30 * least(fragments, 24)
            + {c['prohibitions']} + {c['sibling']} * least(siblings, {c['siblings']}) + {c['register']} * (r - 1) + mass AS supply FROM (
        SELECT doc_id AS cluster_id, doc_id % 16 AS apparatus, doc_id % 15 AS moves, doc_id % 11 AS applications, doc_id % 30 AS fragments,
            CASE WHEN doc_id % 4 = 0 THEN doc_id % 12 ELSE count(*) OVER () - 1 END AS siblings, greatest(1, least(doc_id % 5, {c['registers']})) AS r,
            doc_id % 2 = 0 AS shared, round_even({c['mass']} * sqrt(length(text) / sum(length(text)) OVER ()), 0)::BIGINT AS mass FROM documents)))"""


ORACLES = {
    "E1_grouped_split": _split("'all'"),
    "E1_stratified_split": _split(r"'d' || (regexp_extract(source, '(\d+)$', 1)::INT % 3)"),
    "E1_passages": f"SELECT partition, count(*) AS n FROM documents JOIN ({_split(chr(39) + 'all' + chr(39))}) s ON source = s.\"group\" GROUP BY 1",
    "E2_split_problems": "SELECT 'missing id or group' AS problem, '' AS key UNION ALL SELECT 'repeated id', 'p3' UNION ALL SELECT 'group of several strata', source FROM documents GROUP BY source HAVING count(DISTINCT lang) <> 1",
    "E3_admission": f"SELECT id, class, eligible, score, error FROM {ADMITTED}",
    "E4_conflicts": f"SELECT id, decision, conflicts FROM {DECIDED}",
    "E5_ranking": f"SELECT * FROM {RANKED}",
    "E6_core_budget": f"""SELECT source, supply, ceiling, greatest(3000, least(supply, ceiling)) AS core_budget FROM (SELECT source, {_sum(2200, [(k, *v) for k, v in A.CORE.items()])} AS supply,
        CASE WHEN firsthand_ratio < 0.5 OR total_tokens < 50000 OR n_clusters < 4 THEN 4000 WHEN total_tokens < 250000 OR n_clusters < 9 THEN 6000 ELSE 7500 END AS ceiling FROM {COUNTS})""",
    "E7_cluster_budget": f"SELECT cluster_id, siblings, mass, supply, budget FROM {_modules_sql()}",
    "E8_budget_verdict": f"SELECT cluster_id, verdict FROM {_modules_sql()}",
    "E10_coefficients": f"SELECT cluster_id, budget, verdict FROM {_modules_sql((40, 5))}",
    "E9_defaults": "SELECT doc_id AS cluster_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 12 ELSE count(*) OVER () - 1 END AS siblings, sum(length(text)) OVER ()::BIGINT AS words_firsthand FROM documents",
    "E10_scalars": f"SELECT cluster_id, mass, budget, verdict FROM {_modules_sql(scalars=SCALARS)}",
    "E11_standing_budgets": f"SELECT source, greatest(2000, least({_sum(700, A.FRAMEWORKS)}, 7000)) AS frameworks_budget, greatest(2000, least({_sum(600, A.VOICE)}, 7000)) AS voice_budget FROM {COUNTS}",
    "E12_worst_case_load": f"SELECT 12510 + 2 * max(budget) AS loaded_worst_case FROM {_modules_sql()}",
    "E13_style_cap": f"SELECT id, place, place <= floor(n * 0.2) AS in_core FROM (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY score DESC, id) AS place, count(*) OVER () AS n FROM {RANKED}) WHERE class = 'stable_style'",
    "E14_relocation": f"""SELECT id, step, moved_so_far FROM (SELECT *, sum(n_chars) OVER (ORDER BY step, place DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS moved_so_far FROM (SELECT doc_id AS id, doc_id % 6 + 1 AS step, doc_id % 100 AS place, n_chars FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 6 < 5)) WHERE moved_so_far - n_chars < 100000""",
    "E15_element_problems": f"SELECT id, unnest(list_filter([CASE WHEN i % 29 = 0 AND class <> 'stable_style' THEN 'id is not ' || CASE class {' '.join(f'''WHEN '{c}' THEN '{p}' ''' for c, p in A.PREFIX.items())} END END, CASE WHEN short THEN 'bad cluster id' END], lambda x: x IS NOT NULL)) AS problem FROM {ELEMENTS}",
}
