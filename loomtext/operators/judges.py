"""Judge outputs as JSON: structural faults, flattened scores and citations, and whether each output is usable.

A judge's text is parsed once; its nested arrays become the score and citation tables that scoring and citation
checks read. Passages and evidence are checked by joins, so answers and evidence stay tables of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import contracts
from loomtext.operators.judging import DIMENSIONS
from loomtext.operators.scan import staged

CASES = 3
_SAID = {"type": "string", "pattern": r"\S"}
_CITED = {"type": "array", "minItems": 1, "items": {"type": "string"}}
ELEMENT = "struct<score:variant,reason:string,passage:string,evidence_ids:array<string>,pair_reason:string>"
SLOT = f"struct<{','.join(f'{d}:{ELEMENT}' for d in DIMENSIONS)}>"
CASE = f"struct<id:string,A:{SLOT},B:{SLOT},preference:string,reason:string,evidence_ids:array<string>>"


def schema(cases: int = CASES) -> dict:
    """What a judge's output must look like on its own, before its references are followed."""

    assessed = {"properties": {"score": {"type": "number"}}}
    dimension = {
        "type": "object", "required": ["score", "reason"],
        "properties": {"reason": _SAID, "score": {"oneOf": [{"type": "integer", "minimum": 0, "maximum": 4}, {"const": "unassessed"}]}},
        "if": assessed, "then": {"required": ["passage", "evidence_ids"], "properties": {"passage": _SAID, "evidence_ids": _CITED}},
    }
    paired = {"if": assessed, "then": {"required": ["pair_reason"], "properties": {"pair_reason": _SAID}}}
    slot = {"type": "object", "required": [*DIMENSIONS], "additionalProperties": False, "properties": {d: dimension for d in DIMENSIONS}, "allOf": [{"properties": {"conditional_coherence": paired}}]}
    case = {
        "type": "object", "required": ["id", "A", "B", "preference", "reason", "evidence_ids"],
        "properties": {"id": {"type": "string"}, "A": slot, "B": slot, "preference": {"enum": ["A", "B", "tie"]}, "reason": _SAID, "evidence_ids": _CITED},
    }
    return {
        "type": "object", "required": ["material_issues", "cases"],
        "properties": {"material_issues": {"type": "array", "items": _SAID}, "cases": {"type": "array", "minItems": cases, "maxItems": cases, "items": case}},
    }


def _cases(outputs: DataFrame, text_col: str) -> DataFrame:
    """run, judge, c: a row per case that an output reports."""
    found = F.try_variant_get(contracts.record(F.col(text_col)), "$.cases", "array<variant>")
    rows = outputs.select("run", "judge", F.explode(found).alias("_c"))
    return rows.select("run", "judge", F.try_variant_get("_c", "$", CASE).alias("c"))


def scores(outputs: DataFrame, text_col: str = "text") -> DataFrame:
    """run, judge, case_id, slot, dim, score (null: unassessed), passage, evidence_ids: one row per assessed dimension."""

    def flat(case: Column) -> Column:
        return F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(d).alias("dim"), case[s][d].alias("e")) for s in ("A", "B") for d in DIMENSIONS])

    rows = _cases(outputs, text_col).select("run", "judge", F.col("c.id").alias("case_id"), F.explode(flat(F.col("c"))).alias("_f")).select("run", "judge", "case_id", "_f.*")
    score = F.when(F.schema_of_variant("e.score") == "BIGINT", F.try_variant_get("e.score", "$", "int"))
    return rows.filter("e IS NOT NULL").select("run", "judge", "case_id", "slot", "dim", score.alias("score"), "e.passage", "e.evidence_ids")


def comparisons(outputs: DataFrame, text_col: str = "text") -> DataFrame:
    """run, judge, case_id, reported, evidence_ids."""
    return _cases(outputs, text_col).select("run", "judge", F.col("c.id").alias("case_id"), F.col("c.preference").alias("reported"), F.col("c.evidence_ids").alias("evidence_ids"))


def _opened_once(outputs: DataFrame, text_col: str) -> DataFrame:
    """run, judge, violations, cases: each text parsed once. A case has case_id, the passages of its scored
    dimensions and the distinct evidence that it cites, so that joins see a row a case and not one a dimension."""
    none = F.expr("cast(array() as array<string>)")

    def case(c: Column) -> Column:
        every = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(d).alias("dim"), c[s][d].alias("e")) for s in ("A", "B") for d in DIMENSIONS])
        number = lambda x: (F.schema_of_variant(x["e"]["score"]) == "BIGINT") & F.try_variant_get(x["e"]["score"], "$", "int").isNotNull()
        scored = F.filter(every, lambda x: F.coalesce(number(x), F.lit(False)))
        return contracts.bound(scored, lambda found: F.struct(
            c["id"].alias("case_id"),
            F.transform(F.filter(found, lambda x: x["e"]["passage"].isNotNull()), lambda x: F.struct(x["slot"].alias("slot"), x["dim"].alias("dim"), x["e"]["passage"].alias("passage"))).alias("passages"),
            F.array_distinct(F.concat(F.flatten(F.transform(found, lambda x: F.coalesce(x["e"]["evidence_ids"], none))), F.coalesce(c["evidence_ids"], none))).alias("cited")))

    def opened(v: Column) -> Column:
        cases = F.transform(F.try_variant_get(v, "$.cases", "array<variant>"), lambda x: F.try_variant_get(x, "$", CASE))
        return F.struct(contracts.violations(v, schema()).alias("violations"), F.transform(cases, case).alias("cases"))

    rows = outputs.select("run", "judge", contracts.bound(contracts.record(F.col(text_col)), opened).alias("_o"))
    return rows.select("run", "judge", "_o.*")


def problems(outputs: DataFrame, answers: DataFrame, evidence: DataFrame, text_col: str = "text") -> DataFrame:
    """(run, judge, path, rule), distinct; an output without a row is usable.

    ``outputs`` has run, judge (1 or 2) and the text; ``answers`` run, case_id, a, b; ``evidence`` run and
    evidence_id. Beside the structure: cases must be the run's, a scored passage must occur in the answer that
    its slot presented (the second judge sees them reversed), cited evidence must be known. A null text breaks
    "json"; repeated outputs report the same rows.
    """
    held = staged(_opened_once(outputs, text_col), "judged")
    shape = held.select("run", "judge", F.explode("violations").alias("v")).select("run", "judge", "v.path", "v.rule")
    cases = held.select("run", "judge", F.explode("cases").alias("c")).select("run", "judge", "c.*")
    whole = F.lit("").alias("path")
    asked = answers.select("run", "case_id").distinct()
    strange = cases.select("run", "judge", "case_id").join(asked, ["run", "case_id"], "left_anti").select("run", "judge", whole, F.lit("case of another run").alias("rule"))
    shown = lambda e: F.when((F.col("judge") == 1) == (e["slot"] == "A"), F.col("a")).otherwise(F.col("b"))
    met = cases.select("run", "judge", "case_id", "passages").join(answers, ["run", "case_id"])
    gone = F.filter("passages", lambda e: ~F.coalesce(F.contains(shown(e), e["passage"]), F.lit(False)))
    absent = met.select("run", "judge", "case_id", F.explode(gone).alias("e"))
    absent = absent.select("run", "judge", F.concat_ws("/", F.lit(""), "case_id", "e.slot", "e.dim").alias("path"), F.lit("passage not in answer").alias("rule"))
    cited = cases.select("run", "judge", F.explode("cited").alias("evidence_id")).distinct()
    unknown = cited.join(evidence.select("run", "evidence_id").distinct(), ["run", "evidence_id"], "left_anti").select("run", "judge", whole, F.concat(F.lit("unknown evidence "), "evidence_id").alias("rule"))
    return shape.unionByName(strange).unionByName(absent).unionByName(unknown).distinct()


def usable(outputs: DataFrame, found: DataFrame) -> DataFrame:
    """run, judge, usable, n_problems: the verdict that a cache of outputs needs, one row an output."""
    n = found.groupBy("run", "judge").agg(F.count("*").alias("n_problems"))
    rows = outputs.select("run", "judge").distinct().join(n, ["run", "judge"], "left").fillna(0, ["n_problems"])
    return rows.select("run", "judge", (F.col("n_problems") == 0).alias("usable"), "n_problems")
