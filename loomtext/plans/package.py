"""Package integrity queries (H1 to H14), on files made of the documents, a small package of cases, and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import package as P

FILES = (
    ("SKILL.md", "---\nname: demo\ndescription: \"a demo: of links\"\n---\n# Title\n## Use `voice.md` and [topic](references/clusters/c01_topic.md#part 'x')\nSee c01 and C02, [site](https://x.org/a.md) or [gone](references/no%20file.md).\n[ref]: references/voice.md\nAvoid this.\n"),
    ("references/voice.md", "# Voice\nBack to [core](../SKILL.md); plain references/frameworks.md here. transworld-identity/scope.md\ncomposite score: 0.9\n"),
    ("references/frameworks.md", "No heading\n### Deep ###\nc03 is cited, [up](../../outside.md) /home/me/x\n"),
    ("references/clusters/c01_topic.md", "uid: c02\ntext with provenance\n\n`references/frameworks.md`\n"),
    ("references/clusters/c09_lost.md", "nobody links here\n"),
    ("raw/book.PDF", "binary"),
    ("AGENTS.md", "[skill](SKILL.md)\n"),
)


def _written(spark, d):
    """A file per document: front matter, headings, links to the files of twice its number, citations, and its text."""
    i = F.col("doc_id")
    n = i.cast("string")
    at = lambda k, r, *parts: F.when(i % k == r, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    cited = F.lpad((i % 50).cast("string"), 2, "0")
    twice = (2 * i).cast("string")
    text = F.concat(
        at(3, 0, "---\nname: old\ntitle: 't", n, "'\nname: d", n, "\n---\n"), F.lit("# Title "), n, F.lit("\n"), at(4, 0, "## Part ", n, " ##\n"), F.when(i % 50 >= 5, F.concat(F.lit("uid: c"), cited, F.lit("\n"))).otherwise(""),
        F.lit("See [even](d"), twice, F.lit(".md#x 'y') and c"), cited, F.lit(".\n"), F.when(i % 6 != 5, F.concat(F.lit("[odd]: d"), (2 * i + 1).cast("string"), F.lit(".md\n"))).otherwise(""),
        at(9, 0, "[out](../../x", n, ".md)\n"), at(13, 0, "transworld-identity/scope.md\n"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("docs/d"), n, F.lit(".md")).alias("path"), text.alias("text"))


def _files(spark, d):
    """The files of the documents, and a small package of cases beside them."""
    return spark.createDataFrame(list(FILES), "path string, text string").unionByName(_written(spark, d))


def h1(spark, d):
    return P.links(_files(spark, d))


def h1_structure(spark, d):
    return P.links(_files(spark, d), "structure")


def h1_pages(spark, d):
    """Links of web pages, read as files of a package with their targets as paths from its root."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), "html")
    raw = F.regexp_extract_all("html", F.lit('href="/[^"]*"'), F.lit(0))
    files = pages.select("path", F.array_join(F.transform(raw, lambda x: F.concat(F.lit("[x](<"), F.regexp_extract(x, r'"/(.*)"', 1), F.lit(">)"))), "\n").alias("text"))
    found = P.links(files).select("path", P.resolve(F.lit("root"), F.col("target")).alias("target"))
    return found.join(pages.select("path", "page_id"), "path").select("page_id", F.concat(F.lit("/"), "target").alias("target"))


def h2(spark, d):
    return P.missing_targets(h1(spark, d), _files(spark, d))


def h2_unreferenced(spark, d):
    links, files = h1(spark, d), _files(spark, d)
    return P.unreferenced(links, files, "references/").unionByName(P.unreferenced(links, files, "docs/"))


def h3(spark, d):
    files = _files(spark, d)
    return P.hidden_routes(files.filter("path LIKE 'references/%' OR path LIKE 'docs/%' OR path = 'SKILL.md'"), h1(spark, d))


def h3_reachable(spark, d):
    return P.reachable(h1(spark, d), ["AGENTS.md", "docs/d0.md"]).join(_files(spark, d).select("path"), "path", "left_semi")


def h4(spark, d):
    files = _files(spark, d)
    return P.dead_citations(files.filter("path LIKE '%.md'"), files.filter("path LIKE 'references/clusters/%' OR path LIKE 'docs/%'"))


def h5(spark, d):
    return P.frontmatter(_files(spark, d))


def h5_heading(spark, d):
    return P.first_heading(_files(spark, d)).filter("heading IS NOT NULL")


def _worded(spark, d):
    i = F.col("doc_id")
    first = F.when(i % 5 == 0, "Keep the token budget\nin /home/me. ").otherwise("Zz ")
    return spark.read.parquet(f"{d}/documents.parquet").select(i.cast("string").alias("path"), F.concat(first, "text").alias("text"))


def h6(spark, d):
    """The cases, and the documents in reverse of their lines' order."""
    turned = _worded(spark, d).withColumn("text", F.array_join(F.reverse(F.split("text", "\n", -1)), "\n")).withColumn("path", F.concat(F.lit("r/"), "path"))
    return P.text_issues(spark.createDataFrame(list(FILES), "path string, text string").unionByName(turned))


def h6_documents(spark, d):
    return P.text_issues(_worded(spark, d))


def h7(spark, d):
    i = F.col("doc_id")
    checks = spark.read.parquet(f"{d}/documents.parquet").select(F.when(i % 3 == 0, "warn").otherwise("error").alias("level"), (i % 7 != 0).alias("ok"))
    both = [P.roll_up(checks, strict).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return both[0].unionByName(both[1]).unionByName(P.roll_up(checks.filter("level = 'warn'")).withColumn("strict", F.lit(None).cast("boolean")))


def _tree(spark, d, k):
    i = F.col("doc_id")
    folder = F.when(i % 29 == k, "/").otherwise("")
    return spark.read.parquet(f"{d}/documents.parquet").filter(i % (11 + k) != 0).select(F.concat(F.lit("t/"), i.cast("string"), folder).alias("path"), F.when(i % (5 + k) == 0, "x").otherwise(F.sha2("text", 256)).alias("hash"))


def h8(spark, d):
    return P.tree_conflicts(_tree(spark, d, 0), _tree(spark, d, 2))


def h9(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(P.relocate(F.concat(F.lit("old/a \"old\" 'old' `old` older "), "text"), "old", "new"), 256).alias("moved"))


def h10(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    return P.uncovered_lines(docs.select("path", "text"), docs.select("path", F.lit(1).alias("first"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(4).alias("last"))).groupBy("path").agg(F.count("*").alias("n"))


def h11(spark, d):
    """One package: the cases, and a file per benchmark item. A package's files are what one reader loads."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return P.runtime_hash(spark.createDataFrame(list(FILES), "path string, text string").unionByName(items))


def h12(spark, d):
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda k, h: docs.filter(i % k != 0).select(i.alias("name"), F.concat(F.lit("h"), (i % h).cast("string")).alias("hash"))
    return P.resolved_records(rows(5, 6), rows(7, 4))


def h13(spark, d):
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda k, h: docs.filter(i % k != 0).select(i.alias("name"), F.concat(F.lit("h"), (i % h).cast("string")).alias("hash"))
    return P.applicability(rows(5, 6), rows(7, 4))


def h14(spark, d):
    """What conversations would need: the file of three times their number."""
    needed = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("docs/d"), (3 * F.col("conv_id")).cast("string"), F.lit(".md")).alias("path")).distinct()
    cases = spark.createDataFrame([("SKILL.md",), ("references/voice.md",), ("references/scope.md",)], "path string")
    return P.missing_paths(cases.unionByName(needed), _files(spark, d))


QUERIES = {"H1_links": h1, "H1_structure_links": h1_structure, "H1_page_links": h1_pages, "H2_missing_targets": h2, "H2_unreferenced": h2_unreferenced, "H3_hidden_routes": h3, "H3_reachable": h3_reachable, "H4_dead_citations": h4, "H5_frontmatter": h5, "H5_first_heading": h5_heading,
           "H6_text_issues": h6, "H6_document_issues": h6_documents, "H7_roll_up": h7, "H8_tree_conflicts": h8, "H9_relocation": h9, "H10_uncovered_lines": h10, "H11_runtime_hash": h11, "H12_records": h12, "H13_applicability": h13, "H14_missing_paths": h14}


def _rows(columns: str, *rows: tuple) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") v({columns})"


def _hash() -> str:
    cases = ", ".join("('{}', '{}')".format(p, t.replace("'", "''")) for p, t in FILES)
    return f"""SELECT 'sha256:' || sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path <> 'SKILL.md', path)) AS hash
        FROM (SELECT * FROM (VALUES {cases}) f(path, text) UNION ALL SELECT 'items/' || item_id || '.md', text FROM benchmark)"""


def _document_issues(shape: str = "{}") -> str:
    """Every rule over every document; RE2 has no Unicode word boundary, so the character after a word is named."""
    edge = r"[^\p{L}\p{N}\p{M}_]"
    banned = [f"CASE WHEN contains(lower(t), '{b.lower()}') THEN 'banned {b.strip()}' END" for b in P.BANNED]
    first = rf"lower(regexp_extract(trim(x), '^([A-Za-z]+)(?:{edge}|$)', 1))"
    verbs = ", ".join(f"'{v}'" for v in P.IMPERATIVES)
    rules = [
        *banned,
        f"CASE WHEN regexp_matches(t, '{P.LOCAL_PATH}') THEN 'local path' END",
        f"CASE WHEN regexp_matches(t, '{P.SCORE}') THEN 'score' END",
        f"CASE WHEN len([x FOR x IN string_split(t, E'\\n') IF {first} IN ({verbs})]) > 0 THEN 'imperative line' END",
        f"CASE WHEN regexp_matches(t, '(?i)(?:^|{edge})you(?:$|{edge})|你') THEN 'second person line' END",
    ]
    text = "(CASE WHEN doc_id % 5 = 0 THEN E'Keep the token budget\\nin /home/me. ' ELSE 'Zz ' END || text)"
    return f"""SELECT path, issue FROM (SELECT doc_id::VARCHAR AS path, unnest([{', '.join(rules)}]) AS issue
        FROM (SELECT doc_id, {shape.format(text)} AS t FROM documents)) WHERE issue IS NOT NULL"""


#: Links of the documents' files; k is the number that a target names.
LINKED = """(SELECT doc_id, 'docs/d' || doc_id || '.md' AS path, 'd' || k || '.md' AS target, k FROM (SELECT doc_id, 2 * doc_id AS k FROM documents UNION ALL SELECT doc_id, 2 * doc_id + 1 FROM documents WHERE doc_id % 6 <> 5)
    UNION ALL SELECT doc_id, 'docs/d' || doc_id || '.md', '../../x' || doc_id || '.md', NULL FROM documents WHERE doc_id % 9 = 0)"""

ORACLES = {
    "H1_links": _rows("path, target", ("SKILL.md", "references/clusters/c01_topic.md"), ("SKILL.md", "references/no file.md"), ("SKILL.md", "references/voice.md"), ("SKILL.md", "voice.md"), ("references/voice.md", "../SKILL.md"), ("references/voice.md", "references/frameworks.md"),
                      ("references/frameworks.md", "../../outside.md"), ("references/clusters/c01_topic.md", "references/frameworks.md"), ("AGENTS.md", "SKILL.md")) + f" UNION ALL SELECT path, target FROM {LINKED}",
    "H1_page_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages",
    "H2_missing_targets": _rows("path, target", ("SKILL.md", "references/no file.md"), ("SKILL.md", "voice.md"), ("references/voice.md", "references/frameworks.md"), ("references/frameworks.md", "../../outside.md"), ("references/clusters/c01_topic.md", "references/frameworks.md")) + f" UNION ALL SELECT path, target FROM {LINKED} WHERE target LIKE '../%' OR k NOT IN (SELECT doc_id FROM documents)",
    "H2_unreferenced": _rows("path", ("references/frameworks.md",), ("references/clusters/c09_lost.md",)) + f" UNION ALL SELECT 'docs/d' || doc_id || '.md' FROM documents WHERE doc_id NOT IN (SELECT k FROM {LINKED} WHERE k IS NOT NULL)",
    "H3_hidden_routes": _rows("path, reason", ("references/voice.md", "names assessment"), ("references/frameworks.md", "link leaves runtime")) + " UNION ALL SELECT 'docs/d' || doc_id || '.md', 'names assessment' FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'docs/d' || doc_id || '.md', 'link leaves runtime' FROM documents WHERE doc_id % 9 = 0",
    "H3_reachable": f"""WITH RECURSIVE l AS (SELECT doc_id, k FROM {LINKED} WHERE k IN (SELECT doc_id FROM documents)), r AS (SELECT 0::BIGINT AS k UNION SELECT l.k FROM r JOIN l ON l.doc_id = r.k)
        SELECT 'docs/d' || k || '.md' AS path FROM r UNION ALL """ + _rows("path", ("AGENTS.md",), ("SKILL.md",), ("references/voice.md",), ("references/clusters/c01_topic.md",)),
    "H4_dead_citations": r"""SELECT DISTINCT citation FROM (SELECT unnest(['c01', 'c02', 'c03']) AS citation UNION ALL SELECT 'c' || lpad((doc_id % 50)::VARCHAR, 2, '0') FROM documents
        UNION ALL SELECT lower(unnest(regexp_extract_all(text, '(?i)\bc\d{2}\b'))) FROM documents) WHERE citation NOT IN ('c02', 'c09') AND citation NOT IN (SELECT 'c' || lpad((doc_id % 50)::VARCHAR, 2, '0') FROM documents WHERE doc_id % 50 >= 5)""",
    "H5_frontmatter": _rows("path, key, value", ("SKILL.md", "name", "demo"), ("SKILL.md", "description", "a demo: of links")) + " UNION ALL SELECT 'docs/d' || doc_id || '.md', unnest(['name', 'title']), unnest(['d' || doc_id, 't' || doc_id]) FROM documents WHERE doc_id % 3 = 0",
    "H5_first_heading": _rows("path, heading", ("SKILL.md", "Use `voice.md` and [topic](references/clusters/c01_topic.md#part 'x')"), ("references/voice.md", "Voice"), ("references/frameworks.md", "Deep")) + " UNION ALL SELECT 'docs/d' || doc_id || '.md', CASE WHEN doc_id % 4 = 0 THEN 'Part ' ELSE 'Title ' END || doc_id FROM documents",
    "H6_text_issues": _rows("path, issue", ("SKILL.md", "imperative line"), ("references/voice.md", "banned composite score"), ("references/voice.md", "score"), ("references/frameworks.md", "local path"), ("references/clusters/c01_topic.md", "banned provenance"), ("raw/book.PDF", "raw file")) + " UNION ALL SELECT 'r/' || path, issue FROM (" + _document_issues("list_aggregate(list_reverse(string_split({}, E'\\n')), 'string_agg', E'\\n')") + ")",
    "H6_document_issues": _document_issues(),
    "H7_roll_up": """WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'warn' ELSE 'error' END AS level FROM documents WHERE doc_id % 7 = 0), n AS (SELECT count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warn') AS w FROM c)
        SELECT e AS errors, w AS warnings, CASE WHEN e > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, false AS strict FROM n UNION ALL SELECT e + w, 0, CASE WHEN e + w > 0 THEN 'FAIL' ELSE 'PASS' END, true FROM n UNION ALL SELECT 0, w, 'PASS', NULL FROM n""",
    "H8_tree_conflicts": """SELECT 't/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 29 IN (0, 2) THEN 'file and folder' ELSE 'changed' END AS problem FROM documents
        WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 29 IN (0, 2) OR (doc_id % 5 = 0) <> (doc_id % 7 = 0))""",
    "H9_relocation": "SELECT doc_id, sha256('new/a \"new\" ''new'' `new` older ' || replace(replace(replace(replace(text, 'old/', 'new/'), '\"old\"', '\"new\"'), '''old''', '''new'''), '`old`', '`new`')) AS moved FROM documents",
    "H10_uncovered_lines": r"SELECT doc_id::VARCHAR AS path, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents) WHERE trim(line, ' ') <> '' AND i > CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 4 END GROUP BY 1",
    "H11_runtime_hash": _hash(),
    "H12_records": "SELECT doc_id AS name, CASE WHEN doc_id % 5 <> 0 THEN 'h' || (doc_id % 6) ELSE 'h' || (doc_id % 4) END AS hash, CASE WHEN doc_id % 5 <> 0 THEN 'canonical' ELSE 'legacy' END AS origin, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 6 <> doc_id % 4 AS conflict FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0",
    "H13_applicability": "SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'superseded' WHEN doc_id % 6 = doc_id % 4 THEN 'reusable' ELSE 'requires comparison' END AS status FROM documents WHERE doc_id % 5 <> 0",
    "H14_missing_paths": _rows("path", ("references/scope.md",)) + " UNION ALL SELECT DISTINCT 'docs/d' || 3 * conv_id || '.md' FROM conversations WHERE 3 * conv_id NOT IN (SELECT doc_id FROM documents)",
}
