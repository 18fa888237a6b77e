"""Retrieval and attestation queries (C1 to C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import retrieval, segmentation
from loomtext.plans import sql

PATTERN = "the"
PROBE = "of the"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


PACKAGE = ("# The River\nHe said \"over there\" and **bold move** twice, **bold move**.\n\n「引用」 and 《书名》; escaped \\\"not this\" x\n## Second heading ##\n**x** **1234** \"a very long quotation that is over the limit\"",)
CORPUS = (
    (1, "Intro line.\n\nThe River\n\nThe prose goes on about bold move here.\nbold move"),
    (2, "\nBold\n\nover there\n\nnothing else"),
    (3, "a bold move; 引用。\n\nover there\n\nThe River runs. The River"),
)


def _corpus(spark, d):
    """The cases, and every document under a heading of its own, from identifier 1000."""
    number = F.col("doc_id").cast("string")
    docs = _docs(spark, d).select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("x\n\nHeading "), number, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return spark.createDataFrame(list(CORPUS), "doc_id long, text string").unionByName(docs)


def _package(spark, d):
    """The cases, and a file per document that names it in bold and in a heading."""
    number = F.col("doc_id").cast("string")
    files = _docs(spark, d).select(F.concat(F.lit("# Topic "), number, F.lit("\n**Name "), number, F.lit("** and **"), number, F.lit("**")).alias("text"))
    return spark.createDataFrame([(t,) for t in PACKAGE], "text string").unionByName(files)


def _names(spark, d):
    """Two-word phrases: the first two words of every benchmark text, and two that no text has."""
    words = F.split("text", " ")
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat_ws(" ", F.get(words, 0), F.get(words, 1)).alias("name"))
    return rows.unionByName(spark.createDataFrame([("Zzyzx Qqq",), ("of the",)], "name string")).distinct()


def _hits(spark, d):
    return retrieval.occurrences(_docs(spark, d), [r[0] for r in _names(spark, d).collect()])


def c1(spark, d):
    return retrieval.kwic(_docs(spark, d), PATTERN).select("doc_id", "offset", F.lower("match").alias("match"), F.length("window").cast("long").alias("n"), F.sha2("window", 256).alias("window"))


def c2(spark, d):
    return retrieval.hit_counts(_docs(spark, d), PATTERN)


def c2_corroboration(spark, d):
    return retrieval.corroboration(retrieval.hit_counts(_docs(spark, d), "idiot"))


def c4(spark, d):
    return retrieval.harvest_names(_package(spark, d))


def c5(spark, d):
    return _hits(spark, d).groupBy("doc_id", "name").agg(F.count("*").alias("hits"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def c6(spark, d):
    return retrieval.headings(segmentation.lines(_corpus(spark, d))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def c7(spark, d):
    return retrieval.attestation(_names(spark, d), _hits(spark, d))


def c7_fixture(spark, d):
    names = retrieval.harvest_names(spark.createDataFrame([(t,) for t in PACKAGE], "text string"))
    return retrieval.attestation(names, retrieval.occurrences(_corpus(spark, d), [r[0] for r in names.collect()]))


def c7_verdict(spark, d):
    return retrieval.audit_verdict(c7(spark, d))


def c8(spark, d):
    return retrieval.first_contexts(_docs(spark, d), _hits(spark, d)).select("name", "doc_id", "position", F.sha2("context", 256).alias("context"))


def c3(spark, d):
    pipe = F.when(F.col("doc_id") % 3 == 0, "\\|").otherwise("|")
    patterns = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("source", pipe, F.left("text", F.lit(40))).alias("pattern"))
    return retrieval.bad_patterns(patterns, "pattern").select("doc_id")


QUERIES = {"C3_bad_patterns": c3, "C1_kwic": c1, "C2_hit_counts": c2, "C2_corroboration": c2_corroboration, "C4_harvest_names": c4, "C5_occurrences": c5, "C6_headings": c6, "C7_attestation": c7, "C7_attestation_fixture": c7_fixture, "C7_audit_verdict": c7_verdict, "C8_first_context": c8}

FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"
NAMES = "(SELECT DISTINCT name FROM (SELECT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS name FROM benchmark UNION ALL VALUES ('Zzyzx Qqq'), ('of the')))"
#: Offsets of non-overlapping hits: lengths of what stands between them.
_starts = lambda text, part, size: f"[list_sum([length(x) for x in string_split({text}, {part})[1:i]])::BIGINT + (i - 1) * {size} for i in range(1, len(string_split({text}, {part})))]"
HITS = f"(SELECT doc_id, name, text, unnest({_starts('text', 'name', 'length(name)')}) AS p FROM documents, {NAMES} WHERE contains(text, name))"
_verdict = "CASE WHEN hits = 0 THEN 'UNATTESTED' WHEN hits = heading_hits THEN 'EDITORIAL' WHEN hits - heading_hits >= 2 AND prose_files >= 2 THEN 'ATTESTED' ELSE 'THIN' END"
ATTESTED = f"SELECT *, {_verdict} AS verdict FROM (SELECT name, count(p) AS hits, 0::BIGINT AS heading_hits, count(DISTINCT doc_id) AS files, count(DISTINCT doc_id) AS prose_files FROM {NAMES} LEFT JOIN {HITS} h USING (name) GROUP BY 1)"

ORACLES = {
    "C3_bad_patterns": r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND (doc_id % 3 = 0 OR contains(left(text, 40), '\|'))",
    "C1_kwic": f"""SELECT doc_id, p AS "offset", 'the' AS match, length(w) AS n, sha256(w) AS "window" FROM (SELECT doc_id, p, substr(t, greatest(0, p - 250) + 1, p + 3 + 900 - greatest(0, p - 250)) AS w
        FROM (SELECT doc_id, t, unnest({_starts('lower(t)', "'the'", 3)}[1:2]) AS p FROM (SELECT doc_id, {FLAT} AS t FROM documents)))""",
    "C2_hit_counts": f"SELECT doc_id, {sql.n_matches(FLAT, '(?i)the')} AS hits FROM documents WHERE hits > 0",
    "C2_corroboration": "SELECT coalesce(sum(h), 0)::BIGINT AS hits, count(*) AS files, count(*) < 2 AS single FROM (SELECT len(regexp_extract_all(text, '(?i)idiot')) AS h FROM documents WHERE h > 0)",
    "C4_harvest_names": "SELECT unnest(['The River', 'over there', 'bold move', '引用', '书名', 'Second heading']) AS name UNION ALL SELECT unnest(['Name ' || doc_id, 'Topic ' || doc_id]) FROM documents",
    "C5_occurrences": f"SELECT doc_id, name, count(*) AS hits, min(p) AS first, max(p) AS last FROM {HITS} GROUP BY 1, 2",
    "C6_headings": "SELECT * FROM (VALUES (1, 2, 'The River'), (2, 1, 'Bold'), (2, 3, 'over there'), (3, 2, 'over there')) v(doc_id, line_no, line) UNION ALL SELECT doc_id + 1000, 2, 'Heading ' || doc_id FROM documents",
    "C7_attestation": ATTESTED,
    "C7_attestation_fixture": """SELECT * FROM (VALUES ('The River', 3, 1, 2, 1, 'THIN'), ('over there', 2, 2, 2, 0, 'EDITORIAL'), ('bold move', 3, 0, 2, 2, 'ATTESTED'), ('引用', 1, 0, 1, 1, 'THIN'), ('书名', 0, 0, 0, 0, 'UNATTESTED'),
        ('Second heading', 0, 0, 0, 0, 'UNATTESTED')) v(name, hits, heading_hits, files, prose_files, verdict)""",
    "C7_audit_verdict": f"SELECT CASE WHEN count(*) FILTER (verdict IN ('UNATTESTED', 'EDITORIAL')) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({ATTESTED})",
    "C8_first_context": rf"""
        WITH f AS (SELECT name, min({{'d': doc_id, 'p': p}}) AS f FROM {HITS} GROUP BY 1), r AS (SELECT name, doc_id, length(regexp_replace(substr(text, 1, f.p), '\s+', ' ', 'g')) AS position, {FLAT} AS t FROM f JOIN documents ON doc_id = f.d)
        SELECT name, doc_id, position, sha256(substr(t, greatest(0, position - 250) + 1, position + length(name) + 900 - greatest(0, position - 250))) AS context FROM r""",
}
