import hashlib
import json
import math
import random
import re

import pytest
from loomtext.operators import contracts as C
from pyspark.sql import functions as F

SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]"},
        "kind": {"enum": ["a", "b", 3]},
        "n": {"type": ["integer", "null"], "minimum": 0, "exclusiveMaximum": 10},
        "list": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/item"}},
        "more": {"type": "object", "additionalProperties": {"type": "number"}, "minProperties": 1},
        "any": {"anyOf": [{"type": "string"}, {"const": 1}]}, "one": {"oneOf": [{"minimum": 3}, {"maximum": 5}]}, "no": {"not": {"type": "boolean"}},
        "c": {"if": {"properties": {"x": {"const": 1}}, "required": ["x"]}, "then": {"required": ["y"]}, "else": {"required": ["z"]}},
        "all": {"allOf": [{"type": "string"}, {"minLength": 1}]},
    },
    "$defs": {"item": {"type": "object", "properties": {"v": {"type": "number", "exclusiveMinimum": 0, "maximum": 5}}, "required": ["v"]}},
}


def kind_of(v):
    if v is None or isinstance(v, bool):
        return "null" if v is None else "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def same(a, b):
    return kind_of(a) == kind_of(b) and a == b


def plain(v, s, path=""):
    """The rules read one by one, in the schema's order."""
    out, k = [], kind_of(v)
    is_a = lambda t: k in ("integer", "number") if t == "number" else k == t
    no = lambda rule, bad: out.append((path, rule)) if bad else None
    num, text = is_a("number"), k == "string"
    for rule, x in s.items():
        if rule == "type":
            no(rule, not any(is_a(t) for t in ([x] if isinstance(x, str) else x)))
        elif rule in ("enum", "const"):
            no(rule, not any(same(v, y) for y in (x if rule == "enum" else [x])))
        elif rule in ("minLength", "maxLength"):
            no(rule, text and (len(v) < x if rule == "minLength" else len(v) > x))
        elif rule == "pattern":
            no(rule, text and not re.search(x, v))
        elif rule in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            no(rule, num and {"minimum": lambda: v < x, "maximum": lambda: v > x, "exclusiveMinimum": lambda: v <= x, "exclusiveMaximum": lambda: v >= x}[rule]())
        elif rule in ("minItems", "maxItems", "uniqueItems"):
            no(rule, k == "array" and {"minItems": lambda: len(v) < x, "maxItems": lambda: len(v) > x, "uniqueItems": lambda: any(same(a, b) for i, a in enumerate(v) for b in v[:i])}[rule]())
        elif rule == "minProperties":
            no(rule, k == "object" and len(v) < x)
        elif rule == "required":
            for key in x:
                no(f"required {key}", k == "object" and key not in v)
        elif rule == "properties" and k == "object":
            for key, sub in x.items():
                out += plain(v[key], sub, f"{path}/{key}") if key in v else []
        elif rule == "additionalProperties" and k == "object":
            for key in sorted(v):
                if key not in s.get("properties", {}):
                    out += [(f"{path}/{key}", rule)] if x is False else plain(v[key], x, f"{path}/{key}")
        elif rule == "items" and k == "array":
            for i, y in enumerate(v):
                out += plain(y, x, f"{path}/{i}")
        elif rule == "allOf":
            for sub in x:
                out += plain(v, sub, path)
        elif rule in ("anyOf", "oneOf"):
            n = sum(not plain(v, sub) for sub in x)
            no(rule, n < 1 if rule == "anyOf" else n != 1)
        elif rule == "not":
            no(rule, not plain(v, x))
        elif rule == "if":
            branch = "then" if not plain(v, x) else "else"
            out += plain(v, s[branch], path) if branch in s else []
        elif rule == "$ref":
            out += plain(v, SCHEMA["$defs"]["item"], path)
    return out


def value(rng, depth=2):
    pick = rng.randrange(9 if depth else 6)
    return [lambda: None, lambda: rng.choice([True, False]), lambda: rng.randint(-3, 12), lambda: rng.choice([0.5, 1.0, 2.5, 7.25]), lambda: rng.choice(["", "a", "abc", "Abc", "a" * 6, "b"]), lambda: rng.choice([1, 3, "a"]),
            lambda: [value(rng, depth - 1) for _ in range(rng.randint(0, 4))], lambda: {rng.choice("vxyz"): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}, lambda: [{"v": rng.choice([0, 1, 5.0, 6, "x"])} for _ in range(rng.randint(0, 4))]][pick]()


def test_violations_equal_a_plain_reading_of_the_rules(spark):
    rng = random.Random(5)
    keys = [*SCHEMA["properties"], "other"]
    docs = [{k: value(rng) for k in rng.sample(keys, rng.randint(0, 7))} for _ in range(250)]
    docs += [{"id": "abc", "kind": "a"}, {"id": "abc", "kind": 3.0, "n": 2.0, "list": [{"v": 1}], "more": {"é": 1}, "c": {"x": 1, "y": 0}}, [], "x", 3, None, {"one": 4, "id": "ab", "kind": "b"}]
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(999, "{"), (998, '{"a":1,"a":2}'), (997, None)], "id long, j string")
    got = {}
    for r in C.contract_violations(rows, SCHEMA, "id", "j").collect():
        got.setdefault(r.id, []).append((r.path, r.rule))
    for i, d in enumerate(docs):
        assert got.get(i, []) == plain(d, SCHEMA), d
    assert got[999] == got[998] == got[997] == [("", "json")]


@pytest.mark.parametrize("schema,match", [({"contains": {}}, "not known"), ({"$ref": "http://x"}, "within the schema"), ({"properties": {"a": {"$ref": "#"}}}, "nested more than")])
def test_what_the_compiler_does_not_know_is_an_error(spark, schema, match):
    with pytest.raises(ValueError, match=match):
        C.violations(C.record(F.lit("{}")), schema)


def test_canonical_text_equals_sorted_json(spark):
    rng = random.Random(6)

    def made(depth=3):
        if depth == 0 or rng.random() < 0.5:
            return rng.choice([None, True, 0, -7, 10**17, 12345678901234567890, 1.0, 0.5, -2.25, 1e15, 1.5e16, 1e22, 1e-4, 1.5e-5, 3.5e-7, 1e7, 123456789.125, 0.1, "", "é😀", 'q"\\/', "\n\t\x01\x1f\x0b", " "])
        if rng.random() < 0.5:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["b", "a", "é", "", "😀", "A", 'k"']): made(depth - 1) for _ in range(rng.randint(0, 4))}

    docs = [made() for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=bool(i % 2), indent=i % 3 or None), json.dumps(d, sort_keys=True, separators=(",", ":"))) for i, d in enumerate(docs)], "id long, j string, k string")
    out = rows.select("id", C.canonical(C.record(F.col("j"))).alias("c"), C.fingerprint(F.col("j")).alias("f"), (C.fingerprint(F.col("j")) == C.fingerprint(F.col("k"))).alias("same"))
    for r in out.collect():
        want = json.dumps(docs[r.id], ensure_ascii=False, sort_keys=True)
        assert r.c == want and r.same
        assert r.f == "sha256:" + hashlib.sha256(want.encode()).hexdigest()


def test_numbers_that_are_not_finite_and_deep_values(spark):
    rows = spark.createDataFrame([("1e400",), ("[1,{\"a\":1e400}]",), ("{",), (None,)], "j string")
    assert [r.f for r in rows.select(C.fingerprint(F.col("j")).alias("f")).collect()] == [None] * 4
    deep = spark.createDataFrame([("[" * 12 + "]" * 12,)], "j string")
    with pytest.raises(Exception, match="nested more than"):
        deep.select(C.fingerprint(F.col("j"))).collect()
    assert math.isinf(float("1e400"))
