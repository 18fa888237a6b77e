"""Package integrity: links, citations, front matter, tree differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.staging import staging

# Link grammars (any markdown file, and the narrower one for runtime routes), word lists and patterns.
INLINE = r"\[[^\]]*\]\(\s*(<[^>]+>|[^\s)]+)(?:\s+[^)]*)?\)"
DEFINED = r"(?m)^\s*\[[^\]]+\]:\s*(<[^>]+>|\S+)"
GRAMMARS = {
    "package": (r"`([^`\n]+\.md(?:#[^`\n]*)?)`", r"(?<![\w/])(references/[\w./%-]+\.md)"),
    "structure": (r"`([^`\s]+)`", r"(?<![\w/])((?:references|transworld-identity|fidelity-ledger)/[\w./%-]+)"),
}
ASSESSMENT = ("transworld-identity", "fidelity-ledger")
CITATION = r"(?i)\bc\d{2}\b"
BANNED = ("provenance", "episodic.md", "extraction", "holdout", "Stage ", "token budget", "composite score", "probe")
AUDIT_WORDS = ("token", "budget", "cluster", "probe", "corpus", "distill", "score")
IMPERATIVES = ("add", "avoid", "choose", "consider", "do", "ensure", "keep", "make", "note", "prefer", "remove", "remember", "use", "write")
SECOND_PERSON = r"(?iU)\byou\b|你"
LOCAL_PATH = r"(?:/Users/|/home/|/private/tmp/|[A-Z]:\\Users\\)"
RAW_FILE = r"(?i)\.(pdf|epub|docx)$"
SCORE = r"(?i)(?:composite|projectibility|cost_refusal|expressive_match|interactional|preoccupation)\s*(?:score)?\s*[:=]?\s*[-+]?\d+(?:\.\d+)?"


def _decode(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def links(files: DataFrame, grammar: str = "package") -> DataFrame:
    """(path, target) of local links: no scheme, no host, fragment and query dropped, percent-decoded."""
    patterns = (INLINE, DEFINED, *GRAMMARS[grammar])
    raw = F.concat(*[F.regexp_extract_all("text", F.lit("(?U)" + p), F.lit(1)) for p in patterns])
    rows = files.select("path", F.explode(F.array_distinct(raw)).alias("raw")).withColumn("raw", F.regexp_replace("raw", "^[<>]+|[<>]+$", ""))
    rows = rows.filter(~F.col("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("raw").startswith("//"))
    target = F.regexp_replace("raw", r"[?#].*$", "")
    rows = rows.select("path", target.alias("target")).filter("target <> ''")
    if grammar == "structure":
        rows = rows.filter(F.contains(F.col("target"), F.lit("/")) | F.endswith(F.col("target"), F.lit(".md")))
    target = _decode(F.col("target"))
    return rows.select("path", (F.regexp_replace(target, r"\.+$", "") if grammar == "structure" else target).alias("target")).distinct()


def resolve(source: Column, target: Column) -> Column:
    """The target as a path from the root: relative to the source's folder, . and .. taken out; null above the root."""
    parts = F.split(F.concat(F.regexp_replace(source, r"[^/]*$", ""), target), "/")

    def fold(acc: Column, p: Column) -> Column:
        return F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    out = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), fold), "/")
    return F.when(target.startswith("/") | out.startswith(".."), None).otherwise(out)


def missing_targets(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of links to files that are not there or lie outside."""
    rows = found.withColumn("_to", resolve(F.col("path"), F.col("target")))
    return rows.join(files.select(F.col("path").alias("_to")), "_to", "left_anti").select("path", "target")


def unreferenced(found: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(path) of files in a folder that no link reaches."""
    reached = found.select(resolve(F.col("path"), F.col("target")).alias("path")).distinct()
    return files.filter(F.col("path").startswith(folder)).select("path").join(reached, "path", "left_anti")


def hidden_routes(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, reason): runtime files that name an assessment folder, or link into one or out of the root."""
    named = files.filter(F.col("text").rlike("|".join(a + "/" for a in ASSESSMENT))).select("path", F.lit("names assessment").alias("reason"))
    to = resolve(F.col("path"), F.col("target"))
    led = found.withColumn("_to", to).filter(F.col("_to").isNull() | F.col("_to").rlike("(^|/)(" + "|".join(ASSESSMENT) + ")(/|$)")).select("path", F.lit("link leaves runtime").alias("reason"))
    return named.unionByName(led).distinct()


def reachable(found: DataFrame, roots: list[str]) -> DataFrame:
    """(path) reached over links from the roots, these included; one join a round, until a round adds nothing.

    Links and each round's new paths are tables in the shared folder, so plans stay short, nothing is collected,
    and neither the number of files nor the depth of the links is limited: every round but the last adds a path.
    """
    spark, base = found.sparkSession, staging(found.sparkSession, "reachable")
    links = found.select("path", resolve(F.col("path"), F.col("target")).alias("to"))
    links.filter("path IS NOT NULL AND to IS NOT NULL").distinct().write.parquet(f"{base}/links")
    edges = spark.read.schema("path string, to string").parquet(f"{base}/links")
    rounds = [f"{base}/round-0"]
    spark.createDataFrame([(r,) for r in sorted(set(roots))], "path string").write.parquet(rounds[0])
    while True:
        front, seen = (spark.read.schema("path string").parquet(*p) for p in (rounds[-1:], rounds))
        if front.isEmpty():
            return seen
        new = edges.join(front, "path").select(F.col("to").alias("path")).distinct().join(seen, "path", "left_anti")
        rounds.append(f"{base}/round-{len(rounds)}")
        new.write.parquet(rounds[-1])


def dead_citations(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(citation) of cNN that no module bears, by file name or uid line."""
    cited = files.select(F.explode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))).alias("c")).select(F.lower("c").alias("citation")).distinct()
    named = modules.select(F.lower(F.regexp_extract("path", r"(?i)([^/]*)$", 1)).alias("name")).select(F.regexp_extract("name", r"^(c\d{2})\b", 1).alias("citation"))
    stated = modules.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*(?:uid|cluster_id)\s*:\s*(c\d{2})\b"), F.lit(1))).alias("citation")).select(F.lower("citation").alias("citation"))
    return cited.join(named.unionByName(stated).distinct(), "citation", "left_anti")


FRONT, FRONT_BODY = r"(?s)\A---[ \t]*\r?\n.*?^?---", r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^?---[ \t]*(?:\r?\n|\z)"
FRONT_LINE = r"^[^:#][^:]*:"


def frontmatter(files: DataFrame) -> DataFrame:
    """(path, key, value) of key: value lines between a leading --- and the next; the last of a key counts."""
    lines = files.filter(F.col("text").rlike(FRONT)).select("path", F.posexplode(F.split(F.regexp_extract("text", FRONT_BODY, 1), r"\r?\n", -1)).alias("i", "line")).filter(F.col("line").rlike(FRONT_LINE))
    pair = lines.select("path", "i", F.trim(F.regexp_extract("line", r"^([^:#][^:]*):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^:#][^:]*:(.*)$", 1)), r"^['\"]+|['\"]+$", "").alias("value"))
    return pair.groupBy("path", "key").agg(F.max(F.struct("i", "value")).alias("m")).select("path", "key", F.col("m.value").alias("value"))


def first_heading(files: DataFrame) -> DataFrame:
    """(path, heading): the first H2 or deeper, or else the first heading."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("i", "line")).filter(F.col("line").rlike(r"^\s{0,3}#{1,6}\s+.+"))
    rows = lines.select("path", "i", F.length(F.regexp_extract("line", r"(#{1,6})\s", 1)).alias("depth"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s{0,3}#{1,6}\s+(.+)$", 1), r"\s*#*\s*$", "")).alias("title"))
    return rows.groupBy("path").agg(F.coalesce(F.min_by(F.when(F.col("depth") >= 2, F.col("title")), F.when(F.col("depth") >= 2, F.col("i"))), F.min_by("title", "i")).alias("heading"))


def _description(text: Column) -> Column:
    """The description of the front matter, empty if there is none; as in :func:`frontmatter`, the last counts."""
    lines = F.filter(F.split(F.regexp_extract(text, FRONT_BODY, 1), r"\r?\n", -1), lambda x: x.rlike(FRONT_LINE) & (F.trim(F.regexp_extract(x, r"^([^:#][^:]*):", 1)) == "description"))
    return F.coalesce(F.regexp_extract(F.get(F.reverse(lines), F.lit(0)), r"^[^:]*:(.*)$", 1), F.lit(""))


def text_issues(files: DataFrame) -> DataFrame:
    """(path, issue): banned strings, audit words in a description, local paths, scores, imperative and
    second-person lines, raw files."""
    low = F.lower("text")
    checks = [F.when(F.contains(low, F.lit(b.lower())), f"banned {b.strip()}") for b in BANNED] + [F.when(F.col("text").rlike(LOCAL_PATH), "local path"), F.when(F.col("text").rlike(SCORE), "score"), F.when(F.col("path").rlike(RAW_FILE), "raw file")]
    audit = F.transform(F.array(_description(F.col("text"))), lambda d: F.array(*[F.when(d.rlike(rf"(?iU)\b{w}\b"), f"audit word {w}") for w in AUDIT_WORDS]))[0]
    imperative = F.exists(F.split("text", "\n"), lambda line: F.lower(F.regexp_extract(F.trim(line), r"^([A-Za-z]+)\b", 1)).isin(*IMPERATIVES))
    lines = [F.when(imperative, "imperative line"), F.when(F.col("text").rlike(SECOND_PERSON), "second person line")]
    return files.select("path", F.explode(F.array_compact(F.concat(F.array(*checks, *lines), F.when(F.col("text").rlike(FRONT), audit).otherwise(F.expr("cast(array() as array<string>)"))))).alias("issue"))


def roll_up(checks: DataFrame, strict: bool = False) -> DataFrame:
    """One row: failed errors, failed warnings, verdict; strict turns warnings into errors."""
    failed = checks.filter("NOT ok")
    rows = failed.agg(F.count_if((F.col("level") == "error") | F.lit(strict)).alias("errors"), F.count_if((F.col("level") == "warn") & ~F.lit(strict)).alias("warnings"))
    return rows.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").otherwise("PASS"))


def tree_conflicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, problem): changed content, or a file where the other has a folder (folders end in /)."""
    bare = lambda c: F.regexp_replace(c, "/$", "")
    rows = before.select(bare(F.col("path")).alias("key"), F.col("path").alias("a"), F.col("hash").alias("ha")).join(after.select(bare(F.col("path")).alias("key"), F.col("path").alias("b"), F.col("hash").alias("hb")), "key", "full")
    said = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "file and folder").when(F.col("ha") != F.col("hb"), "changed")
    return rows.select(F.col("key").alias("path"), said.alias("problem")).filter("problem IS NOT NULL")


def relocate(text: Column, old: str, new: str) -> Column:
    """A folder's name replaced where a path or a quoted word begins with it."""
    out = F.replace(text, F.lit(old + "/"), F.lit(new + "/"))
    for q in ("\"", "'", "`"):
        out = F.replace(out, F.lit(q + old + q), F.lit(q + new + q))
    return out


def uncovered_lines(files: DataFrame, passages: DataFrame) -> DataFrame:
    """(path, line_no): non-blank lines, from 1, in none of the passages (path, first, last) of their file.

    A passage counts in either direction and is cut to its file's lines; one with a null end covers nothing.
    Overlapping passages are merged before they are listed, so no file lists more lines than it has.
    """
    split = F.split("text", "\n", -1)
    lines = files.select("path", F.posexplode(split).alias("i", "line")).filter(F.trim("line") != "")
    lines = lines.select("path", (F.col("i") + 1).alias("line_no"))
    counts = files.groupBy("path").agg(F.max(F.size(split)).alias("_n"))
    cut = passages.filter("first IS NOT NULL AND last IS NOT NULL").join(counts, "path")
    low, high = F.greatest(F.least("first", "last"), F.lit(1)), F.least(F.greatest("first", "last"), "_n")
    cut = cut.select("path", low.alias("_low"), high.alias("_high")).filter("_low <= _high").distinct()
    order = Window.partitionBy("path").orderBy("_low", "_high")  # one file's passages
    reach = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("_low") > reach), 1).otherwise(0)
    runs = cut.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    merged = runs.groupBy("path", "_run").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    covered = merged.select("path", F.explode(F.sequence("_low", "_high")).alias("line_no"))
    return lines.join(covered, ["path", "line_no"], "left_anti")


def resolved_records(canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """(name, hash, origin, conflict): the canonical record, or else the legacy one; both must agree."""
    rows = canonical.select("name", F.col("hash").alias("a")).join(legacy.select("name", F.col("hash").alias("b")), "name", "full")
    return rows.select("name", F.coalesce("a", "b").alias("hash"), F.when(F.col("a").isNotNull(), "canonical").otherwise("legacy").alias("origin"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


def applicability(assessments: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, status): reusable on the same request hash, superseded where the case is gone, else to be compared."""
    rows = assessments.join(requests.select("name", F.col("hash").alias("_now")), "name", "left")
    return rows.select("name", F.when(F.col("_now").isNull(), "superseded").when(F.col("_now") == F.col("hash"), "reusable").otherwise("requires comparison").alias("status"))


def runtime_hash(files: DataFrame, first: str = "SKILL.md") -> DataFrame:
    """One row: SHA-256 over path and content hash of every file, ``first`` first, then by path."""
    each = F.struct((F.col("path") != first).alias("k"), F.col("path").alias("p"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return files.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat(x["p"], F.lit(":"), x["h"])), "\n"), 256)).alias("hash"))


def missing_paths(required: DataFrame, files: DataFrame) -> DataFrame:
    return required.join(files.select("path"), "path", "left_anti")
