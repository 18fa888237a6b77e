"""Ledger queries (G1 to G19); events of a user are calls of a workflow, conversations are messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import ledger as L
from loomtext.plans import sql

ROLE = {"click": "candidate", "view": "judge", "purchase": "control", "signup": "grader", "error": "baseline"}


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _calls(spark, d):
    i = F.col("event_id")
    return _events(spark, d).select(i.alias("call_id"), F.col("user_id").alias("workflow"), (F.col("user_id") % 50).cast("string").alias("item"), F.col("event_type").alias("role"), (i % 40).cast("string").alias("fingerprint"),
                                    F.when(i % 5 == 0, "failed").otherwise("completed").alias("state"), F.when(i % 7 == 0, i % 2 == 0).alias("usable"), F.concat(F.lit("r"), i.cast("string")).alias("response"))


def g1(spark, d):
    calls = _calls(spark, d)
    return L.budget(calls, calls.select("workflow").distinct().withColumn("budget", F.lit(8) + F.col("workflow") % 20))


def _ledger_events(spark, d):
    kind = F.when(F.col("event_id") % 37 == 0, "repair").when(F.col("event_id") % 41 == 0, "stop").when(F.col("event_id") % 43 == 0, "authorize").otherwise("reserve")
    role = F.create_map(*[F.lit(x) for p in ROLE.items() for x in p])[F.col("event_type")]
    i = F.col("event_id")
    return _events(spark, d).select(F.col("user_id").alias("workflow"), i.alias("seq"), kind.alias("kind"), F.concat(F.lit("i"), (i % 3).cast("string")).alias("item"), role.alias("role"), (i % 4).cast("string").alias("fingerprint"),
                                    F.concat(F.lit("c"), (i % 5).cast("string")).alias("candidate"), (i % 6 == 0).alias("retry"), F.when(i % 3 == 0, "failed").otherwise("completed").alias("result"), (i % 3).alias("amount"))


def g2(spark, d):
    return L.replay(_ledger_events(spark, d))


def g3(spark, d):
    calls = _calls(spark, d)
    requests = calls.filter("call_id % 9 = 0").select("item", "role", "fingerprint").distinct()
    imported = calls.filter("call_id % 11 = 0").select("item", "role", F.col("fingerprint"), F.col("call_id").cast("string").alias("lineage"), "response")
    return L.reusable(requests, calls.filter("call_id % 2 = 1"), imported)


def g4(spark, d):
    return _events(spark, d).select("event_id", L.fingerprint(F.col("props")).alias("fingerprint"))


def g5(spark, d):
    calls = _calls(spark, d)
    existing = calls.filter("call_id < 500").groupBy("item", "fingerprint").agg(F.min("role").alias("role"), F.min("response").alias("response"), F.lit("before").alias("lineage"))
    return L.import_calls(existing, calls.filter("call_id >= 500")).select("item", "fingerprint", "role", "response", "lineage")


def g5_conflicts(spark, d):
    calls = _calls(spark, d)
    existing = calls.filter("call_id < 500").groupBy("item", "fingerprint").agg(F.min("response").alias("response"))
    return L.import_conflicts(existing, calls.filter("call_id >= 500"))


def _checks(spark, d):
    i = F.col("event_id")
    return _events(spark, d).select(F.col("user_id").alias("call_id"), i.alias("seq"), (F.floor(i / 3) % 2 == 0).alias("usable"), F.when(i % 4 == 0, "why").alias("reason"))


def g6(spark, d):
    return L.latest_checks(_checks(spark, d))


def g6_events(spark, d):
    return L.check_events(_checks(spark, d))


def g7(spark, d):
    rows = _calls(spark, d).select("call_id", "item", "fingerprint", F.coalesce("usable", F.lit(True)).alias("usable"), (F.col("call_id") % 2 == 0).alias("retry"))
    return L.replacements(rows)


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def g8(spark, d):
    i = F.col("doc_id")
    path = lambda k: F.concat(F.lit("f"), ((i + k) % 30).cast("string"))
    records = _docs(spark, d).select(i.alias("record"), F.when(i % 10 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.map_from_arrays(F.array(path(0), path(7)), F.array(F.lit("h0"), F.lit("h0")))).alias("dependencies"))
    hashes = spark.range(30).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 4 == 0, "h1").otherwise("h0").alias("hash")).filter("path <> 'f5'")
    return L.current_evidence(records, hashes)


def g9(spark, d):
    i = F.col("doc_id")
    rows = _docs(spark, d).select(F.concat(F.lit("f"), i.cast("string")).alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    found = rows.filter("doc_id % 13 <> 0").select("path", F.when(i % 7 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return L.manifest_differences(rows.filter("doc_id % 11 <> 0").select("path", "hash"), found)


BOOKS = (
    ("references/a.md", "# Title\nintro\n## Decision rules\nx\n### Deep\ny\n```\n## not a heading\n```\n## Second\nz\n"),
    ("references/b.md", "## Mental models\na\n\n### Sub one\n~~~\n### no\n~~~\n### Sub two\nend"),
)


def g10(spark, d):
    """Sections of the cases, and of a file per document with the document between its headings."""
    number = F.col("doc_id").cast("string")
    text = F.concat(F.lit("## Part "), number, F.lit("\n### Sub\n"), F.coalesce("text", F.lit("")), F.lit("\n## Decision rules "), number, F.lit("\n"))
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), number).alias("path"), text.alias("text"))
    return L.sections(spark.createDataFrame(list(BOOKS), "path string, text string").unionByName(files))


def g10_guards(spark, d):
    return L.section_guards(g10(spark, d))


def g11(spark, d):
    return L.exposures(_docs(spark, d).select((F.col("doc_id") % 7).alias("experiment"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string")).alias("group")))


def g12(spark, d):
    return L.torn_groups(_docs(spark, d).select(F.concat_ws("/", "source", F.col("doc_id") % 9).alias("group"), F.when(F.col("lang") == "en", "train").otherwise("test").alias("partition")))


def g13(spark, d):
    cases = spark.createDataFrame([(1, "c 1", "characteristic"), (2, "c2", "interpersonal"), (3, "c3", "changed_condition")], "place int, case_id string, kind string")
    patterns = spark.createDataFrame([("p1", 1), ("p2", 999)], "pattern string, evidence_id long")
    return L.plan_problems(cases, patterns, spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("evidence_id")))


def g14(spark, d):
    i = F.col("doc_id")
    requests = _docs(spark, d).select(i.alias("request"), F.when(i % 2 == 0, "persona").otherwise("control").alias("condition"), F.array(F.concat(F.lit("m"), (i % 5).cast("string")), F.lit("gone")).alias("references"))
    modules = spark.createDataFrame([("SKILL.md", "s")] + [(f"m{k}", f"h{k}") for k in range(5)], "path string, hash string")
    deps = L.dependency_hashes(requests, modules)
    return deps.select("request", F.array_join(F.transform(F.array_sort(F.map_entries("dependencies")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("dependencies"))


def g15(spark, d):
    return L.blinded(_docs(spark, d).select(F.col("doc_id").alias("case_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("answer_a"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("answer_b")))


def g16(spark, d):
    from loomtext.operators import judging

    rows = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'").withColumn("n", judging.mixed_words(F.col("text")))
    return rows.select("conv_id", "turn", "n", (F.col("n") <= judging.MOST_WORDS).alias("usable"))


def g17(spark, d):
    i = F.col("doc_id")
    requests = _docs(spark, d).select(i.alias("request"), F.get(F.array(F.lit("none"), F.lit("whole"), F.lit("targeted")), (i % 3).cast("int")).alias("condition"), F.concat(F.lit("f"), (i % 4).cast("string")).alias("path"), F.array(F.concat(F.lit("f"), (i % 4).cast("string"), F.lit("#2"))).alias("sections"))
    catalog = spark.range(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.explode(F.array(F.lit("#1"), F.lit("#2"))).alias("s")).select("path", F.concat("path", "s").alias("key"))
    return L.allowed_references(requests, catalog)


def g18(spark, d):
    rows = _ledger_events(spark, d).withColumn("kind", F.when(F.col("seq") % 47 == 0, "checkpoint").otherwise(F.col("kind")))
    return L.checkpoints(rows)


def g19(spark, d):
    return L.over_cap(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("request"), "text"), 400)


QUERIES = {"G1_budget": g1, "G2_replay": g2, "G3_reuse": g3, "G4_fingerprint": g4, "G5_import": g5, "G5_import_conflicts": g5_conflicts, "G6_latest_checks": g6, "G6_check_events": g6_events, "G7_replacements": g7, "G8_current_evidence": g8, "G9_manifest": g9,
           "G10_sections": g10, "G10_guards": g10_guards, "G11_exposures": g11, "G12_torn_groups": g12, "G13_plan_problems": g13, "G14_dependencies": g14, "G15_blinding": g15, "G16_usable_answers": g16, "G17_allowed_references": g17, "G18_checkpoints": g18, "G19_input_cap": g19}

CALLS = "(SELECT event_id AS call_id, user_id AS workflow, (user_id % 50)::VARCHAR AS item, event_type AS role, (event_id % 40)::VARCHAR AS fingerprint, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 END AS usable, 'r' || event_id AS response FROM events)"
GOOD = "state = 'completed' AND coalesce(usable, true)"
CHECKS = "(SELECT user_id AS call_id, event_id AS seq, (event_id // 3) % 2 = 0 AS usable, CASE WHEN event_id % 4 = 0 THEN 'why' END AS reason FROM events)"
EXISTING = f"(SELECT item, fingerprint, min(role) AS role, min(response) AS response, 'before' AS lineage FROM {CALLS} WHERE call_id < 500 GROUP BY 1, 2)"
KIND = "CASE WHEN event_id % 47 = 0 THEN 'checkpoint' WHEN event_id % 37 = 0 THEN 'repair' WHEN event_id % 41 = 0 THEN 'stop' WHEN event_id % 43 = 0 THEN 'authorize' ELSE 'reserve' END"

ORACLES = {
    "G1_budget": f"SELECT workflow, 8 + workflow % 20 AS budget, count(*) AS consumed, greatest(0, 8 + workflow % 20 - count(*)) AS remaining FROM {CALLS} GROUP BY 1",
    "G3_reuse": f"""SELECT q.item, q.role, q.fingerprint, coalesce(own.call_id::VARCHAR, 'import:' || other.lineage) AS call_id, coalesce(own.response, other.response) AS response
        FROM (SELECT DISTINCT item, role, fingerprint FROM {CALLS} WHERE call_id % 9 = 0) q
        LEFT JOIN (SELECT item, role, fingerprint, max(call_id) AS call_id, arg_max(response, call_id) AS response FROM {CALLS} WHERE call_id % 2 = 1 AND {GOOD} GROUP BY ALL) own USING (item, role, fingerprint)
        LEFT JOIN (SELECT item, role, fingerprint, min(call_id::VARCHAR) AS lineage, arg_min(response, call_id::VARCHAR) AS response FROM {CALLS} WHERE call_id % 11 = 0 GROUP BY ALL) other USING (item, role, fingerprint)""",
    "G4_fingerprint": "SELECT event_id, 'sha256:' || sha256(props) AS fingerprint FROM events",
    "G5_import": f"""SELECT item, fingerprint, role, response, lineage FROM {EXISTING} UNION ALL SELECT item, fingerprint, arg_min(role, call_id), arg_min(response, call_id), min(call_id)::VARCHAR FROM {CALLS} WHERE call_id >= 500 AND {GOOD} AND (item, fingerprint) NOT IN (SELECT (item, fingerprint) FROM {EXISTING}) GROUP BY 1, 2""",
    "G5_import_conflicts": f"SELECT DISTINCT item, fingerprint FROM {EXISTING} JOIN (SELECT item, fingerprint, response AS r FROM {CALLS} WHERE call_id >= 500 AND {GOOD}) USING (item, fingerprint) WHERE response <> r",
    "G6_latest_checks": f"SELECT call_id, arg_max(usable, seq) AS usable, list_last(list(reason ORDER BY seq)) AS reason FROM {CHECKS} GROUP BY 1",
    "G6_check_events": f"SELECT call_id, seq, usable, reason FROM (SELECT *, lag(usable) OVER w AS u, lag(reason) OVER w AS r, row_number() OVER w AS n FROM {CHECKS} WINDOW w AS (PARTITION BY call_id ORDER BY seq)) WHERE n = 1 OR usable IS DISTINCT FROM u OR reason IS DISTINCT FROM r",
    "G7_replacements": f"""SELECT item, fingerprint, count(*) AS attempts, count(*) > 1 AS replaced, bool_and(n = 1 OR (n = 2 AND NOT coalesce(b, true) AND call_id % 2 = 0)) AS allowed
        FROM (SELECT *, lag(coalesce(usable, true)) OVER w AS b, row_number() OVER w AS n FROM {CALLS} WINDOW w AS (PARTITION BY item, fingerprint ORDER BY call_id)) GROUP BY 1, 2""",
    "G8_current_evidence": "SELECT doc_id AS record, doc_id % 10 = 0 OR list_bool_and([k <> 5 AND k % 4 <> 0 FOR k IN [doc_id % 30, (doc_id + 7) % 30]]) AS current FROM documents",
    "G9_manifest": "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'added' ELSE 'changed' END AS problem FROM documents WHERE NOT (doc_id % 13 = 0 AND doc_id % 11 = 0) AND (doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0)",
    "G10_sections": """SELECT * FROM (VALUES ('references/a.md', 3, 9, 2, 'Decision rules'), ('references/a.md', 5, 9, 3, 'Deep'), ('references/a.md', 10, 11, 2, 'Second'), ('references/b.md', 1, 9, 2, 'Mental models'), ('references/b.md', 4, 7, 3, 'Sub one'),
        ('references/b.md', 8, 9, 3, 'Sub two')) v(path, start, "end", depth, title)
        UNION ALL SELECT 'd' || doc_id, unnest([1, 2, 3 + n]), unnest([2 + n, 2 + n, 3 + n]), unnest([2, 3, 2]), unnest(['Part ' || doc_id, 'Sub', 'Decision rules ' || doc_id]) FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)""",
    "G10_guards": "SELECT * FROM (VALUES ('references/a.md', 5, 3), ('references/a.md', 10, 3), ('references/b.md', 4, 1), ('references/b.md', 8, 1)) v(path, start, guard) UNION ALL SELECT 'd' || doc_id, unnest([1, 2]), 3 + len(string_split(coalesce(text, ''), chr(10))) FROM documents",
    "G11_exposures": "SELECT doc_id % 7 AS experiment, CASE WHEN doc_id % 3 = 0 THEN source ELSE doc_id::VARCHAR END AS \"group\" FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "G12_torn_groups": "SELECT source || '/' || (doc_id % 9) AS \"group\" FROM documents GROUP BY 1 HAVING count(DISTINCT lang = 'en') > 1",
    "G13_plan_problems": "SELECT * FROM (VALUES ('case kinds', 'characteristic,interpersonal,changed_condition'), ('unsafe case id', 'c 1'), ('pattern count', '2'), ('unknown evidence', '999')) v(problem, key)",
    "G14_dependencies": "SELECT doc_id AS request, CASE WHEN doc_id % 2 = 0 THEN 'SKILL.md=s,m' || (doc_id % 5) || '=h' || (doc_id % 5) ELSE '' END AS dependencies FROM documents",
    "G15_blinding": "SELECT doc_id AS case_id, j AS judge, CASE j WHEN 1 THEN 'p' ELSE 'c' END || doc_id AS slot_a, CASE j WHEN 1 THEN 'c' ELSE 'p' END || doc_id AS slot_b FROM documents, (SELECT unnest([1, 2]) AS j)",
    "G16_usable_answers": "SELECT conv_id, turn, n, n <= 250 AS usable FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[㐀-鿿]|[\\p{L}\\p{N}]+([’''-][\\p{L}\\p{N}]+)*')) AS n FROM conversations WHERE role = 'assistant')",
    "G17_allowed_references": "SELECT doc_id AS request, 'f' || (doc_id % 4) AS path, 'f' || (doc_id % 4) || s AS key, CASE doc_id % 3 WHEN 1 THEN 'whole' ELSE 'section' END AS access FROM documents, (SELECT unnest(['#1', '#2']) AS s) WHERE doc_id % 3 = 1 OR (doc_id % 3 = 2 AND s = '#2')",
    "G18_checkpoints": f"""SELECT workflow, least(1, count(*) FILTER (kind = 'repair')) AS repairs, coalesce(sum(amount) FILTER (kind = 'authorize'), 0)::BIGINT AS allowance, coalesce(arg_max(kind, seq) FILTER (kind IN ('stop', 'authorize')) = 'stop', false) AS stopped, count(*) FILTER (kind = 'checkpoint') AS checkpoints
        FROM (SELECT user_id AS workflow, event_id AS seq, event_id % 3 AS amount, {KIND} AS kind FROM events) GROUP BY 1""",
    "G19_input_cap": "SELECT conv_id AS request, sum(strlen(text))::BIGINT AS n_bytes FROM conversations GROUP BY 1 HAVING sum(strlen(text)) > 400",
}
ORACLES["G8_current_evidence"] = "SELECT doc_id AS record, doc_id % 10 = 0 OR (doc_id % 30 <> 5 AND (doc_id % 30) % 4 <> 0 AND (doc_id + 7) % 30 <> 5 AND ((doc_id + 7) % 30) % 4 <> 0) AS current FROM documents"
