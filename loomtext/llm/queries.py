"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import alignment, bpe, exactdedup, fingerprint, langid, licenses, maintext, mixing, neardup, quality, secrets, trie, warc
from loomtext.llm.common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded="decoded")
    digests = [F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return out.select("doc_id", "n_tokens", *digests)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")), grades=3)
    return quality.grade(docs, model)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join("slots", ",").alias("slots"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.col("all").alias("spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.compare(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.annotate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(trie.shared_openings(trie.threads(table(spark, sf_dir, "conversations"))))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.compare(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_language": op3_language, "op4_warc": op4_warc, "op5_mixing": op5_mixing, "op6_secrets": op6_secrets, "op7_near_dedup": op7_near_dedup, "op8_fingerprints": op8_fingerprints, "op9_exact_dedup": op9_exact_dedup, "op10_licenses": op10_licenses, "op11_trie": op11_trie, "op12_main_text": op12_main_text, "op13_alignment": op13_alignment}

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words as op7's contract cuts them, and a text's distinct shingles (or its whole sequence, if it is shorter).
NEAR_WORDS = r"[w FOR w IN regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')]"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: CRC-32 of an identifier's decimal digits, modulo 4, bit by bit (4294967295 and 3988292384 are the checksum's fixed values).
CRC_4 = """(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ord(z)::BIGINT),
             lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR k IN range(8)], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
             4294967295) % 4)::INT"""

ORACLES = {
    # SQL can't parse markup; the tables' pages declare one article of h1 and p blocks, with two character references
    "op12_main_text": """
        WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
                   '<br>', ' '), '</?(h1|p)>'), lambda x: trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'),
                   '[\x20\x09-\x0D]+', ' ', 'g'))) AS b FROM pages),
             t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op11_trie": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             o AS (SELECT conv_id, list({{'k': md5(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}}
                   ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY 1),
             h AS (SELECT *, {CRC_4} AS h FROM o),
             r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS own FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
             p AS (SELECT conv_id, d, len(own) = d AS ends, md5(array_to_string(list_transform(own[1:d], lambda x: x.k), '')) AS node,
                   CASE WHEN d > 0 THEN md5(array_to_string(list_transform(own[1:d - 1], lambda x: x.k), '')) END AS up, CASE WHEN d > 0 THEN own[d].w ELSE 0 END AS w
                   FROM (SELECT *, unnest(range(0, len(own) + 1)) AS d FROM r)),
             n AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node),
             k AS (SELECT up AS node, count(*) AS kids FROM n GROUP BY 1),
             s AS (SELECT p.node, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (n.node NOT IN (SELECT node FROM k WHERE node IS NOT NULL)) AS leaves
                   FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY 1)
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
               saved::BIGINT AS saved_tokens, n.ends_sha256 FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node""",
    # SHA-1 in base32: five hex digits are 20 bits, and those are four letters
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS best, sha1(payload) AS hex FROM p),
             d AS (SELECT *, array_to_string([substr('{BASE32}', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))) & 31), 1)
                   FOR k IN range(32)], '') AS payload_digest FROM r)
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to FROM d""",
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {NEAR_WORDS} AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
             m AS (SELECT a, min(b) AS component_id FROM c GROUP BY 1)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN m ON a = doc_id""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER_AZ}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
