"""Contracts of JSON records: a compiler from JSON Schema to column expressions over VARIANT, and canonical text.

Nothing runs per row in Python: a schema becomes one expression, which gives every violation of a record with
its path. Keywords that the compiler does not know are an error, never ignored.
"""

from __future__ import annotations

import json
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that look into a value, and those whose schemas apply to the value itself.
INSIDE = frozenset("minItems maxItems uniqueItems minProperties required properties additionalProperties items".split())
ITSELF = frozenset("allOf anyOf oneOf not if then else $ref".split())
ANNOTATIONS = frozenset("$schema $id $defs $comment title description default examples format definitions".split())
MOST_REFS, DEEPEST = 8, 8
_NONE = "cast(array() as array<struct<path:string,rule:string>>)"


def record(text: Column) -> Column:
    """The VARIANT of a JSON text; null if it is not JSON, repeats a key, or holds a number that is no JSON number."""
    return F.try_parse_json(text)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def bound(value: Column, of) -> Column:
    """``of(value)``, the value computed once: a lambda's variable is not an expression to repeat.

    The value is what an aggregate over no elements begins with. The item of an array would do the same, but asks for
    the type and nullability of all that stands below it, for every row and twice as often with every level.
    """
    return F.aggregate(F.expr("cast(array() as array<int>)"), value, lambda held, _: held, of)


def _kind(v: Column, told: Column) -> Column:
    """The kind of a value whose SQL schema is ``told``."""
    number = F.when(F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")), "integer").otherwise("number")
    kind = F.when(told == "STRING", "string").when(told == "BIGINT", "integer").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null")
    return kind.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").otherwise(number)


def _kinded(t: Column) -> Column:
    """The struct of v, its members m and its elements a with its kind."""
    v, m, a = t["v"], t["m"], t["a"]
    kind = F.when(m.isNotNull(), "object").when(a.isNotNull(), "array").otherwise(bound(F.schema_of_variant(v), lambda told: _kind(v, told)))
    return F.struct(v.alias("v"), m.alias("m"), a.alias("a"), kind.alias("kind"))


def _shut(v: Column) -> Column:
    """The struct of v and its kind, for rules that look into neither members nor elements."""
    return F.struct(v.alias("v"), bound(F.schema_of_variant(v), lambda told: _kind(v, told)).alias("kind"))


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds. In and array_contains leave their loops by an exception, for every hit."""
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:]) if half else tests[0] if tests else F.lit(False)


def _all(tests: list[Column]) -> Column:
    """Whether all tests hold."""
    half = len(tests) // 2
    return _all(tests[:half]) & _all(tests[half:]) if half else tests[0] if tests else F.lit(True)


def _of_type(kind: Column, name: str) -> Column:
    return (kind == "integer") | (kind == "number") if name == "number" else kind == name


def _has(m: Column, key: str) -> Column:
    """Whether the members hold the key; a JSON null is a value."""
    return F.try_element_at(m, F.lit(key)).isNotNull()


class _Compiler:
    def __init__(self, root: dict):
        self.root, self.none = root, F.expr(_NONE)

    def ref(self, name: str) -> Any:
        if not name.startswith("#"):
            raise ValueError(f"only references within the schema are known, not {name}")
        found = self.root
        for part in filter(None, name[1:].split("/")):
            found = found[part.replace("~1", "/").replace("~0", "~")]
        return found

    def opens(self, schema: Any, refs: int) -> bool:
        """Whether a schema's rules need a value's members or elements; references too deep do, and fail later."""
        if isinstance(schema, bool):
            return False
        within = [y for rule in ITSELF & schema.keys() - {"$ref"} for y in (schema[rule] if isinstance(schema[rule], list) else [schema[rule]])]
        if "$ref" in schema:
            within.append({"items": True} if refs >= MOST_REFS else self.ref(schema["$ref"]))
            refs += 1
        return bool(INSIDE & schema.keys()) or any(self.opens(y, refs) for y in within)

    def check(self, v: Column, schema: Any, path: Column | None, refs: int = 0) -> Column:
        """array<struct<path, rule>> of what is wrong with v; without a path only whether nothing is."""
        if schema is True or schema == {}:
            return F.lit(True) if path is None else self.none
        if schema is False:
            return F.lit(False) if path is None else F.array(F.struct(path.alias("path"), F.lit("false").alias("rule")))
        # each step is bound, or what stands before would be computed again wherever it is named
        if not self.opens(schema, refs):
            return bound(v, lambda x: bound(_shut(x), lambda s: self.rules(s, schema, path, refs)))
        return bound(v, lambda x: bound(_parted(x), lambda t: bound(_kinded(t), lambda s: self.rules(s, schema, path, refs))))

    def again(self, s: Column, schema: Any, path: Column | None, refs: int) -> Column:
        """:meth:`check` of a value that is open already."""
        if isinstance(schema, bool) or not schema:
            return self.check(s["v"], schema, path, refs)
        return self.rules(s, schema, path, refs)

    def each(self, values: Column, schema: Any, path: Column | None, refs: int, value, at) -> Column:
        """:meth:`check` of every element: ``value`` and ``at`` give an element's value and its path."""
        if path is None:
            return F.forall(values, lambda e: self.check(value(e), schema, None, refs))
        return F.flatten(F.transform(values, lambda e, i: self.check(value(e), schema, F.concat(path, F.lit("/"), at(e, i)), refs)))

    def rules(self, s: Column, schema: dict, path: Column | None, refs: int) -> Column:
        v, m, a, kind = s["v"], s["m"], s["a"], s["kind"]
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        found: list[Column] = []

        def broken(rule: str, when: Column) -> None:
            found.append(F.coalesce(~when, F.lit(True)) if path is None else F.when(when, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(self.none))

        def only(name: str, when: Column) -> Column:
            return _of_type(kind, name) & when

        def under(when: Column, of: Column) -> None:
            found.append(F.coalesce(F.when(when, of), F.lit(True) if path is None else self.none))

        same = lambda x: F.to_json(F.parse_json(F.lit(json.dumps(x))))
        named = list(schema.get("properties", {}))
        for rule, x in schema.items():
            if rule in ANNOTATIONS or rule in ("then", "else"):
                continue
            if rule == "type":
                kinds = [_of_type(kind, t) for t in ([x] if isinstance(x, str) else x)]
                broken(rule, ~_any(kinds))
            elif rule in ("enum", "const"):
                broken(rule, bound(F.to_json(v), lambda j: ~_any([j == same(y) for y in (x if rule == "enum" else [x])])))
            elif rule == "minLength":
                broken(rule, only("string", F.char_length(text) < x))
            elif rule == "maxLength":
                broken(rule, only("string", F.char_length(text) > x))
            elif rule == "pattern":
                broken(rule, only("string", ~text.rlike(x)))
            elif rule == "minimum":
                broken(rule, only("number", number < x))
            elif rule == "maximum":
                broken(rule, only("number", number > x))
            elif rule == "exclusiveMinimum":
                broken(rule, only("number", number <= x))
            elif rule == "exclusiveMaximum":
                broken(rule, only("number", number >= x))
            elif rule == "minItems":
                broken(rule, only("array", F.size(a) < x))
            elif rule == "maxItems":
                broken(rule, only("array", F.size(a) > x))
            elif rule == "uniqueItems":
                broken(rule, F.lit(bool(x)) & only("array", F.size(F.array_distinct(F.transform(a, lambda e: F.to_json(e)))) < F.size(a)))
            elif rule == "minProperties":
                broken(rule, only("object", F.size(m) < x))
            elif rule == "required":
                for key in x:
                    broken(f"required {key}", only("object", ~_has(m, key)))
            elif rule == "properties":
                # neighbours under one schema share its expression
                for sub, keys in [(json.loads(sub), [*keys]) for sub, keys in groupby(x, lambda key: json.dumps(x[key]))]:
                    if len(keys) == 1:
                        under(only("object", _has(m, keys[0])), self.check(F.try_element_at(m, F.lit(keys[0])), sub, None if path is None else F.concat(path, F.lit(f"/{keys[0]}")), refs))
                    else:
                        given = F.filter(F.array(*[F.struct(F.lit(key).alias("key"), F.try_element_at(m, F.lit(key)).alias("value")) for key in keys]), lambda e: e["value"].isNotNull())
                        under(kind == "object", self.each(given, sub, path, refs, lambda e: e["value"], lambda e, _: e["key"]))
            elif rule == "additionalProperties":
                others = F.filter(F.map_entries(m), lambda e: ~_any([e["key"] == key for key in named])) if named else F.map_entries(m)
                if x is not False:
                    under(kind == "object", self.each(others, x, path, refs, lambda e: e["value"], lambda e, _: e["key"]))
                elif path is None:
                    broken(rule, only("object", F.size(others) > 0))
                else:
                    under(kind == "object", F.transform(others, lambda e: F.struct(F.concat(path, F.lit("/"), e["key"]).alias("path"), F.lit("additionalProperties").alias("rule"))))
            elif rule == "items":
                under(kind == "array", self.each(a, x, path, refs, lambda e: e, lambda _, i: i.cast("string")))
            elif rule == "allOf":
                found.extend(self.again(s, sub, path, refs) for sub in x)
            elif rule in ("anyOf", "oneOf"):
                n = sum((self.again(s, sub, None, refs).cast("int") for sub in x), F.lit(0))
                broken(rule, n < 1 if rule == "anyOf" else n != 1)
            elif rule == "not":
                broken(rule, self.again(s, x, None, refs))
            elif rule == "if":
                holds = self.again(s, x, None, refs)
                for branch, when in (("then", holds), ("else", ~holds)):
                    if branch in schema:
                        under(when, self.again(s, schema[branch], path, refs))
            elif rule == "$ref":
                if refs >= MOST_REFS:
                    raise ValueError(f"references are nested more than {MOST_REFS} deep at {x}")
                found.append(self.again(s, self.ref(x), path, refs + 1))
            else:
                raise ValueError(f"the keyword {rule} is not known")
        if path is None:
            return _all(found)
        return F.flatten(F.array(*found)) if found else self.none


def violations(value: Column, schema: dict) -> Column:
    """array<struct<path, rule>> of everything in a VARIANT that breaks a schema, in the schema's order.

    Paths are keys and positions behind slashes, "" is the whole record. A null (no JSON) breaks "json". Known
    keywords: type, enum, const, bounds of numbers, lengths and sizes, pattern (found anywhere), uniqueItems,
    required, properties, additionalProperties, items, allOf, anyOf, oneOf, not, if, then, else, and $ref within
    the schema, nested at most eight deep; formats are annotations.
    """
    absent = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule")))
    return bound(value, lambda v: F.when(v.isNull(), absent).otherwise(_Compiler(schema).check(v, schema, F.lit(""))))


def contract_violations(records: DataFrame, schema: dict, id_col: str, json_col: str) -> DataFrame:
    """(id, path, rule), a row per violation; records that keep the contract have none."""
    rows = records.select(id_col, F.explode(violations(record(F.col(json_col)), schema)).alias("_v"))
    return rows.select(id_col, "_v.path", "_v.rule")


def _quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else kept."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    escaped = text
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(text), F.lit('"'))


def _number(v: Column, kind: Column) -> Column:
    """Whole numbers as they are; others in shortest form, with an exponent from 1e16 and below 1e-4."""
    d = F.try_variant_get(v, "$", "double")
    text = F.when(d == 0, F.when(d.cast("string").startswith("-"), "-0.0").otherwise("0.0"))
    plain = F.regexp_replace(d.cast("string").cast("decimal(38,21)").cast("string"), "(\\.[0-9]*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    parts = F.split(d.cast("string"), "E")
    power = F.get(parts, F.lit(1)).cast("int")
    mantissa = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", "")
    digits = F.when(F.abs(power) < 10, F.lpad(F.abs(power).cast("string"), 2, "0")).otherwise(F.abs(power).cast("string"))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), digits)
    text = F.coalesce(text, F.when((F.abs(d) < 1e16) & (F.abs(d) >= 1e-4), plain).otherwise(scientific))
    finite = ~d.isin(float("inf"), float("-inf")) & ~F.isnan(d)
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return F.when(whole, F.try_variant_get(v, "$", "string")).when(finite, text)


def canonical(v: Column, deepest: int = DEEPEST) -> Column:
    """One text per JSON value, whatever the order of keys and the spacing: keys by code point, ", " and ": "
    between, non-ASCII kept. Null where a number is not finite. Values nested deeper than ``deepest`` are an error.
    """

    def of(s: Column, depth: int) -> Column:
        v, m, a = s["v"], s["m"], s["a"]
        kind = F.schema_of_variant(v)
        scalar = F.when(F.is_variant_null(v), "null").when(kind == "STRING", _quoted(F.try_variant_get(v, "$", "string"))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).otherwise(_number(v, kind))
        if depth == 0:
            return F.when(m.isNotNull() | a.isNotNull(), F.raise_error(F.lit(f"nested more than {deepest} deep"))).otherwise(scalar)
        keys = F.array_sort(F.map_keys(m))
        entries = F.coalesce(F.transform(keys, lambda k: F.struct(F.concat(_quoted(k), F.lit(": ")).alias("k"), F.try_element_at(m, k).alias("v"))), F.transform(a, lambda x: F.struct(F.lit("").alias("k"), x.alias("v"))))
        parts = F.transform(entries, lambda e: F.concat(e["k"], bound(_parted(e["v"]), lambda t: of(t, depth - 1))))
        joined = bound(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ", ")))
        # the nested part stands once in the expression, or it would double with every level
        around = [F.when(m.isNotNull(), left).otherwise(right) for left, right in (("{", "["), ("}", "]"))]
        return F.when(m.isNotNull() | a.isNotNull(), F.concat(around[0], joined, around[1])).otherwise(scalar)

    return bound(_parted(v), lambda s: of(s, deepest))


def _parted(v: Column) -> Column:
    return F.struct(v.alias("v"), _object(v).alias("m"), _array(v).alias("a"))


def fingerprint(text: Column, deepest: int = DEEPEST) -> Column:
    """Hash of a JSON text's canonical form; null if it is not JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical(record(text), deepest).cast("binary"), 256))
