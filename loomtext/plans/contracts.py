"""Contracts over records made of the tables, canonical fingerprints (G4) and judge outputs (G16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import contracts, judges
from loomtext.operators.judging import DIMENSIONS


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


EVENT = {
    "type": "object", "required": ["type", "props"], "additionalProperties": False,
    "properties": {"type": {"enum": ["click", "view"]}, "value": {"type": "number", "exclusiveMinimum": 1, "maximum": 50}, "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}},
}
DOCUMENT = {
    "required": ["lang", "source"], "properties": {"lang": {"enum": ["en", "de"]}, "source": {"type": "string", "pattern": "^src1"}, "n_chars": {"type": "integer", "maximum": 5000}, "words": {"minItems": 3, "uniqueItems": True}},
}
THREAD = {"properties": {"turns": {"type": "array", "maxItems": 3, "items": {"$ref": "#/$defs/turn"}}}, "$defs": {"turn": {"required": ["role", "text"], "properties": {"role": {"const": "user"}, "text": {"minLength": 60}}}}}
LABEL = {"allOf": [{"required": ["quality"]}, {"if": {"properties": {"toxic": {"const": 1}}}, "then": {"properties": {"quality": {"const": 0}}}, "else": {"not": {"properties": {"quality": {"const": 0}}}}}]}
ORDER = {
    "additionalProperties": {"type": "string"}, "minProperties": 4,
    "properties": {"status": {"oneOf": [{"enum": ["F", "P"]}, {"enum": ["P", "O"]}]}, "total": {"anyOf": [{"exclusiveMaximum": 100000}, {"minimum": 300000}]}, "priority": {"pattern": "^[1-4]-", "maxLength": 10}},
}


def events(spark, d):
    """The properties are JSON within the record."""
    props = F.parse_json("props")
    rows = _table(spark, d, "events").select("event_id", F.concat(F.lit('{"type": "'), "event_type", F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "props": '), F.to_json(props), F.when(F.col("event_id") % 6 == 0, ', "late": true').otherwise(""), F.lit("}")).alias("j"))
    return contracts.contract_violations(rows, EVENT, "event_id", "j")


def documents(spark, d):
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " ", -1), 1, 4)
    rows = _table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", "source", "n_chars", words.alias("words"))).alias("j"))
    return contracts.contract_violations(rows, DOCUMENT, "doc_id", "j")


def conversations(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("j"))
    return contracts.contract_violations(rows, THREAD, "conv_id", "j")


def labels(spark, d):
    rows = _table(spark, d, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("j"))
    return contracts.contract_violations(rows, LABEL, "doc_id", "j")


def orders(spark, d):
    more = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("customer")
    rows = _table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), more)).alias("j"))
    return contracts.contract_violations(rows, ORDER, "o_orderkey", "j")


def fingerprints(spark, d):
    """Two texts of each event, of other key order, spacing and number forms, have one fingerprint."""
    k, v = F.lit('"'), F.col("value").cast("string")
    first = F.concat(F.lit('{"value":'), v, F.lit(',"type":"'), "event_type", k, F.lit(',"props":'), "props", F.lit(',"é":["x",null]}'))
    second = F.concat(F.lit('{ "props" : '), "props", F.lit(',\n "\\u00e9" : [ "x" , null ], "type": "'), "event_type", k, F.lit(', "value": '), v, F.lit("0}"))
    rows = _table(spark, d, "events").select("event_id", contracts.fingerprint(first, 2).alias("fingerprint"), contracts.fingerprint(second, 2).alias("again"))
    return rows.select("event_id", "fingerprint", (F.col("fingerprint") == F.col("again")).alias("same"))


FAULTS = 14


def _outputs(spark, d):
    """A judge's output per document, and one fault in it by the document's number: see EXPECTED."""
    fault = F.col("doc_id") % FAULTS
    judge = (F.lit(1) + F.col("doc_id") % 2).cast("int")
    answer = lambda side: F.concat(F.lit(f"answer {side} of "), F.col("doc_id").cast("string"))

    def element(case: int, slot: str, dim: str):
        here = F.lit((case, slot, dim) == (1, "A", "conditional_coherence"))
        shown = F.when((judge == 1) == F.lit(slot == "A"), answer("a")).otherwise(answer("b"))
        gone = (fault == 9) & F.lit((case, slot, dim) == (0, "A", "interaction"))
        return F.when(~gone, F.struct(
            F.when(here & (fault == 10), 5).otherwise(3).alias("score"), F.lit("because").alias("reason"), F.when(here & (fault == 11), "never said").otherwise(shown).alias("passage"),
            F.array(F.when(here & (fault == 8), "e9").otherwise("e1")).alias("evidence_ids"), F.when(F.lit(dim == "conditional_coherence") & ~(here & (fault == 12)), "both").alias("pair_reason")))

    def case(k: int):
        slots = [F.struct(*[element(k, s, dim).alias(dim) for dim in DIMENSIONS]).alias(s) for s in ("A", "B")]
        here = F.lit(k == 2)
        cited = F.when(here & (fault == 7), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("e0")))
        return F.struct(F.when(here & (fault == 4), "c7").otherwise(f"c{k}").alias("id"), *slots, F.when(here & (fault == 5), "C").otherwise("A").alias("preference"), F.when(here & (fault == 6), " ").otherwise("why").alias("reason"), cited.alias("evidence_ids"))

    issues = F.when(fault == 1, None).when(fault == 2, F.array(F.lit(" "))).otherwise(F.expr("cast(array() as array<string>)"))
    cases = F.slice(F.array(*[case(k) for k in range(3)]), 1, F.when(fault == 3, 2).otherwise(3))
    text = F.to_json(F.struct(issues.alias("material_issues"), cases.alias("cases")))
    docs = _table(spark, d, "documents")
    outputs = docs.select(F.col("doc_id").alias("run"), judge.alias("judge"), F.when(fault == 13, F.substr(text, F.lit(1), F.lit(40))).otherwise(text).alias("text"))
    answers = docs.select(F.col("doc_id").alias("run"), F.explode(F.array(*[F.lit(f"c{k}") for k in range(3)])).alias("case_id"), answer("a").alias("a"), answer("b").alias("b"))
    return outputs, answers, docs.select(F.col("doc_id").alias("run"), F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("evidence_id"))


def judge_problems(spark, d):
    return judges.problems(*_outputs(spark, d))


def judge_usable(spark, d):
    outputs, answers, evidence = _outputs(spark, d)
    return judges.usable(outputs, judges.problems(outputs, answers, evidence))


def judge_scores(spark, d):
    """Score and passages of every judge's candidate, flattened."""
    rows = judges.scores(_outputs(spark, d)[0])
    return rows.groupBy("run", "judge", "slot").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.countDistinct("passage").alias("passages"))


QUERIES = {
    "contract_events": events, "contract_documents": documents, "contract_conversations": conversations, "contract_labels": labels, "contract_orders": orders,
    "G4_canonical_fingerprint": fingerprints, "G16_judge_problems": judge_problems, "G16_judge_usable": judge_usable, "G16_judge_scores": judge_scores,
}

K = "(props::JSON->>'k')::BIGINT"
_case = "/cases/1/A/conditional_coherence"
#: What each fault breaks: (path, rule).
EXPECTED = {
    1: ("", "required material_issues"), 2: ("/material_issues/0", "pattern"), 3: ("/cases", "minItems"), 4: ("", "case of another run"), 5: ("/cases/2/preference", "enum"), 6: ("/cases/2/reason", "pattern"), 7: ("/cases/2/evidence_ids", "minItems"),
    8: ("", "unknown evidence e9"), 9: ("/cases/0/A", "required interaction"), 10: (f"{_case}/score", "oneOf"), 11: ("/c1/A/conditional_coherence", "passage not in answer"), 12: (_case, "required pair_reason"), 13: ("", "json"),
}
_values = ", ".join(f"({k}, '{p}', '{r}')" for k, (p, r) in EXPECTED.items())
PROBLEMS = f"(SELECT doc_id AS run, (1 + doc_id % 2)::INT AS judge, path, rule FROM documents JOIN (VALUES {_values}) f(fault, path, rule) ON doc_id % {FAULTS} = fault)"
_first = "list_slice(string_split(coalesce(text, ''), ' '), 1, 4)"
_turns = "(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)"

ORACLES = {
    "contract_events": f"""SELECT event_id, '/type' AS path, 'enum' AS rule FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, '/value', 'exclusiveMinimum' FROM events WHERE value <= 1
        UNION ALL SELECT event_id, '/value', 'maximum' FROM events WHERE value > 50 UNION ALL SELECT event_id, '/props/k', 'minimum' FROM events WHERE {K} < 10 UNION ALL SELECT event_id, '/late', 'additionalProperties' FROM events WHERE event_id % 6 = 0""",
    "contract_documents": f"""SELECT doc_id, '' AS path, 'required lang' AS rule FROM documents WHERE lang IS NULL UNION ALL SELECT doc_id, '', 'required source' FROM documents WHERE source IS NULL UNION ALL SELECT doc_id, '/lang', 'enum' FROM documents WHERE lang NOT IN ('en', 'de')
        UNION ALL SELECT doc_id, '/source', 'pattern' FROM documents WHERE NOT starts_with(source, 'src1') UNION ALL SELECT doc_id, '/n_chars', 'maximum' FROM documents WHERE n_chars > 5000
        UNION ALL SELECT doc_id, '/words', 'minItems' FROM documents WHERE len({_first}) < 3 UNION ALL SELECT doc_id, '/words', 'uniqueItems' FROM documents WHERE len(list_distinct({_first})) < len({_first})""",
    "contract_conversations": f"""SELECT conv_id, '/turns' AS path, 'maxItems' AS rule FROM conversations GROUP BY 1 HAVING count(*) > 3 UNION ALL SELECT conv_id, '/turns/' || i || '/role', 'const' FROM {_turns} WHERE role <> 'user'
        UNION ALL SELECT conv_id, '/turns/' || i || '/text', 'minLength' FROM {_turns} WHERE length(text) < 60 UNION ALL SELECT conv_id, '/turns/' || i, 'required role' FROM {_turns} WHERE role IS NULL UNION ALL SELECT conv_id, '/turns/' || i, 'required text' FROM {_turns} WHERE text IS NULL""",
    "contract_labels": "SELECT doc_id, '' AS path, 'required quality' AS rule FROM labels WHERE quality IS NULL UNION ALL SELECT doc_id, '/quality', 'const' FROM labels WHERE coalesce(toxic, 1) = 1 AND quality <> 0 UNION ALL SELECT doc_id, '', 'not' FROM labels WHERE toxic <> 1 AND coalesce(quality, 0) = 0",
    "contract_orders": """SELECT o_orderkey, '' AS path, 'minProperties' AS rule FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, '/customer', 'type' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, '/status', 'oneOf' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT o_orderkey, '/total', 'anyOf' FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000 UNION ALL SELECT o_orderkey, '/priority', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-') UNION ALL SELECT o_orderkey, '/priority', 'maxLength' FROM orders WHERE length(o_orderpriority) > 10""",
    "G4_canonical_fingerprint": """SELECT event_id, 'sha256:' || sha256('{"props": {"k": ' || (props::JSON->>'k') || '}, "type": "' || event_type || '", "value": ' || value::VARCHAR || ', "é": ["x", null]}') AS fingerprint, true AS same FROM events""",
    "G16_judge_problems": f"SELECT * FROM {PROBLEMS}",
    "G16_judge_usable": f"SELECT doc_id AS run, (1 + doc_id % 2)::INT AS judge, doc_id % {FAULTS} = 0 AS usable, (doc_id % {FAULTS} <> 0)::BIGINT AS n_problems FROM documents",
    "G16_judge_scores": f"""SELECT doc_id AS run, (1 + doc_id % 2)::INT AS judge, slot, (CASE f WHEN 3 THEN 10 ELSE 15 END - (f = 9 AND slot = 'A')::INT)::BIGINT AS n, (3 * (CASE f WHEN 3 THEN 10 ELSE 15 END - (f = 9 AND slot = 'A')::INT) + 2 * (f = 10 AND slot = 'A')::INT)::BIGINT AS total,
        1 + (f = 11 AND slot = 'A')::BIGINT AS passages FROM (SELECT doc_id, doc_id % {FAULTS} AS f, unnest(['A', 'B']) AS slot FROM documents) WHERE f <> 13""",
}
