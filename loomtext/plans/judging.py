"""Judgment and gate queries (F1 to F19); judgments are computed from documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import admission, judging as J
from loomtext.operators import registers
from loomtext.plans import registers as register_plans
from loomtext.plans import sql
from loomtext.plans.admission import ORACLES as SPLITS
from loomtext.plans.admission import _passages


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _grid(spark, d):
    """A run per document: two judges, three cases, two slots, five dimensions."""
    each = lambda n, name: F.explode(F.array(*map(F.lit, range(n)))).alias(name)
    rows = _docs(spark, d).select(F.col("doc_id").alias("run"))
    for n, name in ((2, "j"), (3, "c"), (2, "s"), (5, "dim_no")):
        rows = rows.select("*", each(n, name))
    return rows


def _scores(spark, d):
    r, j, c, s, k = (F.col(x) for x in ("run", "j", "c", "s", "dim_no"))
    mix = (r * 31 + j * 17 + c * 13 + s * 7 + k * 5) % 40
    score = F.when((r * 3 + j + c * 5 + k) % 211 == 0, None).when(mix == 0, 1).when(mix <= 2, 2).when(mix % 2 == 0, 3).otherwise(4)
    dims = F.get(F.array(*map(F.lit, J.DIMENSIONS)), k)
    return _grid(spark, d).select("run", (j + 1).alias("judge"), (c + 1).alias("case_id"), F.when(s == 0, "A").otherwise("B").alias("slot"), dims.alias("dim"), score.alias("score"))


def _comparisons(spark, d):
    rows = _grid(spark, d).filter("s = 0 AND dim_no = 0")
    r, j, c = (F.col(x) for x in ("run", "j", "c"))
    reported = F.when((r + j * 2 + c) % 5 == 0, "tie").when((r * 7 + c + j) % 3 == 0, "B").otherwise("A")
    same = F.when((r + c) % 11 == 0, "same").otherwise("a")
    return rows.select("run", (j + 1).alias("judge"), (c + 1).alias("case_id"), J.preference(F.when((j == 1) & (reported != "tie"), F.when(reported == "A", "B").otherwise("A")).otherwise(reported), same, F.when(same == "same", "same").otherwise("b")).alias("effective"))


def _issues(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("run"), F.explode(F.array(F.lit(1), F.lit(2))).alias("judge")).withColumn("n_issues", ((F.col("run") + F.col("judge")) % 13 == 0).cast("int"))


def f1(spark, d):
    return J.recognition(_scores(spark, d), _comparisons(spark, d), _issues(spark, d))


def f2(spark, d):
    return _comparisons(spark, d)


def f3(spark, d):
    return J.outcome(f1(spark, d))


def f4(spark, d):
    docs = _docs(spark, d)
    cites = docs.select(F.col("doc_id").alias("citation_id"), F.col("doc_id").alias("answer_id"), ((F.col("doc_id") * 7) % 60).alias("evidence_id"), F.when(F.col("doc_id") % 6 == 0, "zz not there").otherwise(F.expr("substring(text, 3, 12)")).alias("passage"))
    known = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("evidence_id"))
    return J.citation_problems(cites, known, docs.select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer")))


def f5(spark, d):
    i = F.col("doc_id")
    gate = lambda k: F.when(i % k == 0, "failed").otherwise("passed")
    return J.delivery(_docs(spark, d).select(i.alias("run"), gate(5).alias("package"), gate(7).alias("source"), gate(3).alias("recognition"), F.when(i % 11 == 0, None).otherwise(i % 4 != 0).alias("current"))).select("run", "status")


def _behavior(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kind = F.get(F.array(F.lit("reasoning"), F.lit("commitment"), F.lit("scope")), (F.col("doc_id") % 3).cast("int"))
    return labels.select(kind.alias("kind"), F.col("doc_id").alias("case_id"), F.get(F.array(F.lit("attested_period"), F.lit("earlier_period"), F.lit("changed_conditions")), (F.floor(F.col("doc_id") / 3) % 3).cast("int")).alias("scope_case"),
                         F.create_map(F.lit("method"), F.col("quality") == 1, F.lit("conditions"), F.col("toxic") == 0).alias("criteria"), F.lit(False).alias("disputed"))


def f6(spark, d):
    return J.behavioral(_behavior(spark, d))


def _judgments(spark, d):
    langs = ("en", "fr", "de", "es")
    rows = _docs(spark, d).select("doc_id", F.col("lang").alias("truth"), F.explode(F.array(F.lit(1), F.lit(2))).alias("reviewer"))
    wrong = F.get(F.array(*map(F.lit, langs)), ((F.col("doc_id") + F.col("reviewer")) % 4).cast("int"))
    return rows.select((F.col("doc_id") % 50).alias("task"), "truth", (F.col("reviewer") + F.col("doc_id") * 2).alias("reviewer"), F.when((F.col("doc_id") + F.col("reviewer")) % 3 == 0, wrong).otherwise(F.col("truth")).alias("choice"))


def f7(spark, d):
    return J.identity_accuracy(_judgments(spark, d))


def f7_gate(spark, d):
    return J.identity_gate(_judgments(spark, d))


def f7_problems(spark, d):
    return J.identity_problems(_judgments(spark, d), spark.createDataFrame([("en",), ("fr",), ("de",)], "candidate string"))


def f8(spark, d):
    i = F.col("doc_id")
    return J.projection(_docs(spark, d).select("source", (i % 3).alias("score"), (F.floor(i / 3) % 3).alias("baseline_score")), "source")


def f9(spark, d):
    rows = _passages(spark, d)
    parts = admission.grouped_split(rows)
    split = rows.join(parts, "group").select("id", F.when(F.col("id").endswith("7"), "test").otherwise(F.col("partition")).alias("partition")).filter("id <> 'p9'")
    return J.leakage(split.unionByName(spark.createDataFrame([("stranger", "train")], "id string, partition string")), rows.select("id", "group"))


def f10(spark, d):
    i = F.col("doc_id")
    return J.cost_problems(_docs(spark, d).select(i.alias("id"), (i % 10).alias("total_divergences"), (i % 7).alias("slated_for_core"), (i % 4).alias("in_core_final"), (i % 10 - i % 4).alias("logged_out"), (i % 37 == 0).cast("int").alias("missing_unlogged")))


def f11(spark, d):
    dist = registers.z_distances(registers.z_scores(register_plans._features(spark, d))).select(F.col("a").alias("i"), F.col("b").alias("j"), F.round("distance", 6).alias("value"))
    other = dist.select(F.col("j").alias("i"), F.col("i").alias("j"), F.when(F.col("i") == "src1", F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    units = register_plans._units(spark, d).select("unit_id")
    diagonal = units.select(F.col("unit_id").alias("i"), F.col("unit_id").alias("j"), F.when(F.col("unit_id") == "src3", 0.5).otherwise(0.0).alias("value"))
    strange = spark.createDataFrame([("zz", "src1", 0.0)], "i string, j string, value double")
    return J.matrix_problems(dist.unionByName(other).unionByName(diagonal).unionByName(strange), units).filter("i <> 'zz' OR problem = 'unknown unit'")


def f12(spark, d):
    i = F.col("doc_id")
    pick = lambda x: F.concat(F.lit("R"), (x % 3).cast("string"))
    cases = _docs(spark, d).select(pick(i).alias("expected"), pick(i + (i % 9 == 0).cast("int")).alias("selected"), pick(i + (i % 11 == 0).cast("int")).alias("observed"))
    return J.selection_gate(cases, spark.createDataFrame([("R0",), ("R1",), ("R2",)], "family_id string"))


def f13(spark, d):
    i = F.col("doc_id")
    gates = _docs(spark, d).select(i.alias("gate"), (i % 5).alias("target"), F.concat(F.lit("h"), (i % 7).cast("string")).alias("hash"), F.when(i % 11 == 0, None).otherwise(i % 3 != 0).alias("masked"), (i % 4).alias("n"), (i % 101 / F.lit(100.0)).alias("score"))
    return J.register_gates(gates, spark.range(4).select(F.col("id").alias("target"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash")))


def f14(spark, d):
    text, labels = F.col("text"), ["the", "the on", "ing"]
    return _docs(spark, d).select("doc_id", F.sha2(J.conceal(text, labels), 256).alias("concealed"), F.array_join(F.transform(J.conceal_counts(text, labels), lambda x: F.concat_ws("=", x["literal"], x["count"])), ",").alias("counts"))


def f15(spark, d):
    return _docs(spark, d).select("doc_id", J.mixed_words(F.col("text")).alias("n_words"))


def _grades(spark, d):
    i = F.col("doc_id")
    rows = _docs(spark, d).select(i.alias("task"), F.get(F.array(F.lit("none"), F.lit("whole"), F.lit("targeted")), (i % 3).cast("int")).alias("condition"), F.explode(F.array(F.lit(1), F.lit(2))).alias("grader"))
    return rows.select("task", "condition", F.concat(F.lit("g"), F.col("grader").cast("string")).alias("reviewer"), ((F.col("task") + (F.col("task") % 7 == 0).cast("int") * F.col("grader")) % 3).alias("score"), F.concat(F.lit("k"), (F.col("task") % 2).cast("string")).alias("criteria"), (F.col("task") % 5 == 0).alias("disputed"),
                       F.array(F.concat(F.lit("p"), (F.col("task") % 4).cast("string")), F.concat(F.lit("p"), (F.col("task") % 6).cast("string"))).alias("paths"))


def f16(spark, d):
    return J.agreement(_grades(spark, d))


def _corrections(spark, d):
    i = F.col("doc_id")
    return _docs(spark, d).filter(i % 10 == 0).select(i.alias("task"), F.when(i % 20 == 0, "elsewhere").otherwise(F.get(F.array(F.lit("none"), F.lit("whole"), F.lit("targeted")), (i % 3).cast("int"))).alias("condition"), F.lit(2).cast("long").alias("score"), F.lit("human").alias("reviewer"))


def f17(spark, d):
    return J.apply_corrections(_grades(spark, d), _corrections(spark, d)).select("task", "condition", "score", "reviewer", "disputed")


def f17_unknown(spark, d):
    return J.unknown_corrections(_grades(spark, d), _corrections(spark, d)).select("task", "condition")


def f18(spark, d):
    return J.regroup(_grades(spark, d)).select("condition", "n", F.array_join("loaded", ",").alias("loaded"))


def f19(spark, d):
    i = F.col("doc_id")
    results = _docs(spark, d).select(i.alias("target"), F.concat(F.lit("h"), (i % 9).cast("string")).alias("hash"), F.when(i % 2 == 0, "style").otherwise("projection").alias("kind"), (i % 13 == 0).alias("listed"), F.when(i % 4 == 0, "known").alias("note"))
    now = _docs(spark, d).filter(i % 17 != 0).select(i.alias("target"), F.concat(F.lit("h"), (i % 9 + (i % 6 == 0).cast("int")).cast("string")).alias("hash"))
    return J.stale(results, now).select("target", "stale", "blocking")


QUERIES = {"F1_recognition": f1, "F2_preference": f2, "F3_outcome": f3, "F4_citations": f4, "F5_delivery": f5, "F6_behavioral": f6, "F7_identity": f7, "F7_identity_gate": f7_gate, "F7_identity_problems": f7_problems, "F8_projection": f8, "F9_leakage": f9,
           "F10_cost_problems": f10, "F11_matrix_problems": f11, "F12_selection": f12, "F13_register_gates": f13, "F14_concealment": f14, "F15_mixed_words": f15, "F16_agreement": f16, "F17_corrections": f17, "F17_unknown_corrections": f17_unknown, "F18_regroup": f18, "F19_staleness": f19}

GRID = "(SELECT doc_id AS run, j, c, s, k FROM documents, (SELECT unnest(range(2)) AS j), (SELECT unnest(range(3)) AS c), (SELECT unnest(range(2)) AS s), (SELECT unnest(range(5)) AS k))"
SCORES = f"""(SELECT run, j + 1 AS judge, c + 1 AS case_id, j = s AS own, k, CASE WHEN (run * 3 + j + c * 5 + k) % 211 = 0 THEN NULL WHEN m = 0 THEN 1 WHEN m <= 2 THEN 2 WHEN m % 2 = 0 THEN 3 ELSE 4 END AS score
    FROM (SELECT *, (run * 31 + j * 17 + c * 13 + s * 7 + k * 5) % 40 AS m FROM {GRID}))"""
EFFECTIVE = f"""(SELECT run, j + 1 AS judge, c + 1 AS case_id, CASE WHEN (run + c) % 11 = 0 OR (run + j * 2 + c) % 5 = 0 THEN 'tie' WHEN ((run * 7 + c + j) % 3 = 0) = (j = 0) THEN 'B' ELSE 'A' END AS effective FROM {GRID} WHERE s = 0 AND k = 0)"""
JUDGED = f"""(SELECT run, judge, CASE WHEN o = 0 THEN 100.0::DOUBLE * t / 60 END AS score, CASE WHEN o = 0 THEN least_total END AS least_total, wins, o = 0 AS complete,
        CASE WHEN o = 0 THEN t >= 48 AND least_total >= 15 AND floors AND wins >= 2 AND (run + judge) % 13 <> 0 END AS accepted
    FROM (SELECT run, judge, sum(t)::BIGINT AS t, min(t)::BIGINT AS least_total, sum(o) AS o, bool_and(floors) AS floors FROM (SELECT run, judge, case_id, sum(score) AS t, count(*) FILTER (score IS NULL) AS o, bool_and(score >= CASE WHEN k = 3 THEN 2 ELSE 3 END) AS floors FROM {SCORES} WHERE own GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT run, judge, count(*) FILTER (effective = CASE judge WHEN 1 THEN 'A' ELSE 'B' END) AS wins FROM {EFFECTIVE} GROUP BY ALL) USING (run, judge))"""
CONDITION = "['none', 'whole', 'targeted'][doc_id % 3 + 1]"
GRADES = f"(SELECT doc_id AS task, {CONDITION} AS condition, 'g' || g AS reviewer, (doc_id + CASE WHEN doc_id % 7 = 0 THEN g ELSE 0 END) % 3 AS score, doc_id % 2 AS criteria, doc_id % 5 = 0 AS disputed FROM documents, (SELECT unnest([1, 2]) AS g))"
JUDGMENTS = "(SELECT doc_id % 50 AS task, lang AS truth, doc_id, r, CASE WHEN (doc_id + r) % 3 = 0 THEN ['en', 'fr', 'de', 'es'][(doc_id + r) % 4 + 1] ELSE lang END AS choice FROM documents, (SELECT unnest([1, 2]) AS r))"
_fixed = "(SELECT doc_id, text AS t0, replace(text, 'the on', '[identity concealed]') AS t1 FROM documents)"

ORACLES = {
    "F1_recognition": f"SELECT * FROM {JUDGED}",
    "F2_preference": f"SELECT * FROM {EFFECTIVE}",
    "F3_outcome": f"SELECT run, CASE WHEN count(*) FILTER (accepted) = 2 THEN 'passed' WHEN count(*) FILTER (NOT accepted) = 2 THEN 'failed' ELSE 'inconclusive' END AS outcome FROM {JUDGED} GROUP BY 1",
    "F4_citations": "SELECT doc_id AS citation_id, 'unknown evidence' AS problem FROM documents WHERE (doc_id * 7) % 60 NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT doc_id, 'passage not in answer' FROM documents WHERE doc_id % 6 = 0 OR trim(substr(text, 3, 12)) = ''",
    "F5_delivery": "SELECT doc_id AS run, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 0 AND doc_id % 4 <> 0 THEN 'standard_accepted' ELSE 'candidate' END AS status FROM documents",
    "F6_behavioral": """SELECT kind, hits, n, hits / n AS score, hits / n >= CASE kind WHEN 'reasoning' THEN 0.7 WHEN 'commitment' THEN 0.8 ELSE 1 END AND CASE kind WHEN 'scope' THEN n >= 3 AND k = 3 ELSE n >= 2 END AS passed FROM (
        SELECT ['reasoning', 'commitment', 'scope'][doc_id % 3 + 1] AS kind, count(*) FILTER (quality = 1 AND toxic = 0) AS hits, count(*) AS n, count(DISTINCT (doc_id // 3) % 3) AS k FROM labels GROUP BY 1)""",
    "F7_identity": f"SELECT truth AS candidate, count(*) FILTER (choice = truth) AS hits, count(*) AS n, avg((choice = truth)::INT) AS accuracy FROM {JUDGMENTS} GROUP BY 1",
    "F7_identity_gate": f"SELECT avg(a) AS macro, min(a) AS least, avg(a) >= 0.7 AND min(a) >= 0.5 AS passed FROM (SELECT avg((choice = truth)::INT) AS a FROM {JUDGMENTS} GROUP BY truth)",
    "F7_identity_problems": f"SELECT task, 'not every candidate' AS problem FROM {JUDGMENTS} GROUP BY task HAVING count(DISTINCT truth) <> 3 UNION ALL SELECT DISTINCT task, 'unknown choice' FROM {JUDGMENTS} WHERE choice = 'es'",
    "F8_projection": """SELECT *, CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.5 THEN 'usable' ELSE 'weak' END AS band, score >= 0.5 AND score >= baseline AS passed FROM (
        SELECT source, sum(doc_id % 3) / (2.0::DOUBLE * count(*)) AS score, sum(doc_id // 3 % 3) / (2.0::DOUBLE * count(*)) AS baseline, avg((doc_id % 3 = 1)::INT) AS hit_1, avg((doc_id % 3 = 2)::INT) AS hit_2 FROM documents GROUP BY 1)""",
    "F9_leakage": f"""WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 7 THEN 'test' ELSE partition END AS p FROM documents JOIN ({SPLITS['E1_grouped_split']}) x ON x."group" = source WHERE doc_id <> 9)
        SELECT 'not assigned' AS problem, 'p9' AS key UNION ALL SELECT 'not in inventory', 'stranger' UNION ALL SELECT 'group in several partitions', source FROM s GROUP BY source HAVING count(DISTINCT p) > 1""",
    "F10_cost_problems": """SELECT id, problem FROM (SELECT doc_id AS id, unnest([CASE WHEN doc_id % 37 = 0 THEN 'missing' END, CASE WHEN doc_id % 4 > doc_id % 7 OR doc_id % 7 > doc_id % 10 THEN 'inconsistent' END, CASE WHEN doc_id % 10 > 0 AND doc_id % 4 = 0 THEN 'no core refusal' END]) AS problem FROM documents) WHERE problem IS NOT NULL""",
    "F11_matrix_problems": f"SELECT 'unknown unit' AS problem, 'zz' AS i, 'src1' AS j UNION ALL SELECT 'diagonal', 'src3', 'src3' UNION ALL SELECT 'not symmetric', 'src1', unit_id FROM {register_plans.units()} WHERE unit_id > 'src1'",
    "F12_selection": "SELECT avg((doc_id % 9 <> 0 AND doc_id % 11 <> 0)::INT) AS score, true AS covers, avg((doc_id % 9 <> 0 AND doc_id % 11 <> 0)::INT) >= 0.7 AS passed FROM documents",
    "F13_register_gates": "SELECT doc_id AS gate, doc_id % 5 < 4 AND doc_id % 5 = doc_id % 7 AND doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 4 >= 2 AND doc_id % 101 >= 70 AS passed FROM documents",
    "F14_concealment": f"""SELECT doc_id, sha256(replace(replace(t1, 'ing', '[identity concealed]'), 'the', '[identity concealed]')) AS concealed, concat_ws(',', CASE WHEN a > 0 THEN 'the on=' || a END, CASE WHEN b > 0 THEN 'ing=' || b END, CASE WHEN c > 0 THEN 'the=' || c END) AS counts
        FROM (SELECT *, {sql.n_literal('t0', 'the on')} AS a, {sql.n_literal('t1', 'ing')} AS b, {sql.n_literal("replace(t1, 'ing', '[identity concealed]')", 'the')} AS c FROM {_fixed})""",
    "F15_mixed_words": "SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]|[\\p{L}\\p{N}]+([’''-][\\p{L}\\p{N}]+)*')) AS n_words FROM documents",
    "F16_agreement": f"SELECT task, condition, count(DISTINCT score) = 1 AS agree FROM {GRADES} GROUP BY 1, 2",
    "F17_corrections": f"SELECT task, condition, CASE WHEN c THEN 2 ELSE score END AS score, CASE WHEN c THEN 'human' ELSE reviewer END AS reviewer, disputed AND NOT c AS disputed FROM (SELECT *, task % 10 = 0 AND task % 20 <> 0 AS c FROM {GRADES})",
    "F17_unknown_corrections": "SELECT doc_id AS task, 'elsewhere' AS condition FROM documents WHERE doc_id % 20 = 0",
    "F18_regroup": f"SELECT condition, count(*) AS n, (SELECT string_agg(DISTINCT p, ',' ORDER BY p) FROM (SELECT {CONDITION} AS c, unnest(['p' || (doc_id % 4), 'p' || (doc_id % 6)]) AS p FROM documents) WHERE c = condition) AS loaded FROM {GRADES} GROUP BY 1",
    "F19_staleness": "SELECT doc_id AS target, stale, stale AND NOT (doc_id % 2 = 0 AND doc_id % 4 = 0) AS blocking FROM (SELECT doc_id, doc_id % 17 = 0 OR doc_id % 6 = 0 OR doc_id % 13 = 0 AS stale FROM documents)",
}
