"""Source and sink queries (S1 to S10): the test tables are written as files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.sources import readers, sinks
from loomtext.sources.staging import staging


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _lines(spark, d):
    docs = _docs(spark, d).filter("text IS NOT NULL").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return docs.select(F.col("source").alias("id"), F.struct("doc_id", "i").alias("line_no"), "line")


def _clusters(spark, d):
    path = staging(spark, "clusters")
    return path, sinks.cluster_texts(_lines(spark, d), path)


def _per_cluster(files):
    cluster = F.regexp_extract("path", "id=([^/]+)/", 1).alias("source")
    return files.groupBy(cluster).agg(F.sum(F.length("text")).alias("n_chars"))


def s1(spark, d):
    return _per_cluster(readers.text_files(spark, _clusters(spark, d)[0] + "/clusters"))


def s2(spark, d):
    return _per_cluster(readers.notes(spark, _clusters(spark, d)[0] + "/clusters"))


def s3(spark, d):
    """Units of which some have an identifier or a label and others get theirs."""
    name = F.col("source")
    unit_id, label = F.when(name.rlike("[5-9]$"), name), F.when(F.length(name) > 4, F.concat(F.lit("label of "), name))
    unit = F.struct(name.alias("_order"), unit_id.alias("unit_id"), label.alias("label"), F.concat(name, F.lit(".txt")).alias("path"))
    units = _docs(spark, d).select(name).distinct().agg(F.to_json(F.struct(F.array_sort(F.collect_list(unit)).alias("units"))))
    path = staging(spark, "units")
    units.coalesce(1).write.text(path)
    return readers.units(spark, path).select("unit_id", "label", "path")


def s4(spark, d):
    kind = F.col("event_id") % 10
    text = F.when(kind == 0, "not json").when(kind == 1, '{"k": NaN}').when(kind == 2, '{"k": 1e999}').otherwise(F.col("props"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("text"))
    return readers.strict_json(rows, "text", "k double", ("k",)).select("event_id", "error", F.col("value.k").alias("k"))


def s5(spark, d):
    """The sources as a term list, with a comment and a blank line before each."""
    entry = F.concat(F.lit("# next\n\n  "), "source")
    path = staging(spark, "terms")
    _docs(spark, d).select(entry.alias("line")).distinct().agg(F.array_join(F.array_sort(F.collect_list("line")), "\n")).coalesce(1).write.text(path)
    return readers.terms(spark, path, comments=True)


def s6(spark, d):
    """One file a source, which lists its documents."""
    path = staging(spark, "tree")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), " ")
    rows = _docs(spark, d).groupBy("source").agg(ids.alias("text"))
    rows.repartition("source").write.partitionBy("source").text(path)
    found = readers.package_tree(spark, path)
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length", "hash")


def _languages(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))


def s8(spark, d):
    path = staging(spark, "artifact")
    sinks.json_artifact(_languages(spark, d), path)
    return spark.read.schema("lang string, n long").json(path)


def s9(spark, d):
    """What is stored after a first write, an equal second one, and a third one that must fail."""
    path, rows = staging(spark, "once"), _languages(spark, d)
    wrote = [sinks.write_once(rows, path), sinks.write_once(rows, path)]
    try:
        sinks.write_once(rows.withColumn("n", F.col("n") + 1), path)
        refused = False
    except ValueError:
        refused = True
    told = [F.lit(x).alias(name) for x, name in zip((*wrote, refused), ("first", "second", "refused"))]
    return spark.read.parquet(path).select("lang", "n", *told)


def s10(spark, d):
    return _clusters(spark, d)[1]


QUERIES = {
    "S1_text_files": s1, "S2_notes": s2, "S3_units": s3, "S4_strict_json": s4, "S5_terms": s5, "S6_package_tree": s6, "S8_json_artifact": s8,
    "S9_write_once": s9, "S10_cluster_texts": s10,
}

_chars = "SELECT source, sum(length(text) + 1)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1"
_id = "coalesce(CASE WHEN regexp_matches(source, '[5-9]$') THEN source END, printf('u%02d', row_number() OVER (ORDER BY source)))"

ORACLES = {
    "S1_text_files": _chars,
    "S2_notes": _chars,
    "S3_units": f"""SELECT unit_id, coalesce(CASE WHEN length(source) > 4 THEN 'label of ' || source END, unit_id) AS label, source || '.txt' AS path
        FROM (SELECT source, {_id} AS unit_id FROM (SELECT DISTINCT source FROM documents))""",
    "S4_strict_json": """SELECT event_id, CASE WHEN event_id % 10 < 2 THEN 'not JSON of this form' WHEN event_id % 10 = 2 THEN 'number is not finite' END AS error,
        CASE WHEN event_id % 10 > 2 THEN json_extract_string(props, '$.k')::DOUBLE END AS k FROM events""",
    "S5_terms": "SELECT (row_number() OVER (ORDER BY source) - 1)::INT AS position, source AS term FROM (SELECT DISTINCT source FROM documents)",
    "S6_package_tree": """SELECT source, strlen(t)::BIGINT AS length, 'sha256:' || sha256(t) AS hash
        FROM (SELECT source, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY 1)""",
    "S8_json_artifact": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "S9_write_once": "SELECT lang, count(*) AS n, true AS first, false AS second, true AS refused FROM documents GROUP BY 1",
    "S10_cluster_texts": r"""SELECT source AS id, 'clusters/id=' || source AS source, sum(len(string_split(text, E'\n')))::BIGINT AS n_lines,
        sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words, sum(len(regexp_extract_all(text, '\S+'))) < 400 AS small FROM documents WHERE text IS NOT NULL GROUP BY source""",
}
