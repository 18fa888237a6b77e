"""Judge outputs: the compiled contract against the rules of each dimension read one by one, and the cost of a row."""

import copy
import json
import random
import time

from loomtext.operators import contracts, judges
from loomtext.operators.judging import DIMENSIONS
from pyspark.sql import functions as F
from test_contracts import plain

COHERENCE = "conditional_coherence"


def by_dimension():
    """The contract with a schema of its own for every slot and dimension."""
    rules = judges.schema()
    said, cited = rules["properties"]["material_issues"]["items"], rules["properties"]["cases"]["items"]["properties"]["evidence_ids"]

    def dimension(name):
        more = {"pair_reason": said} if name == COHERENCE else {}
        return {
            "type": "object", "required": ["score", "reason"],
            "properties": {"reason": said, "score": {"oneOf": [{"type": "integer", "minimum": 0, "maximum": 4}, {"const": "unassessed"}]}},
            "if": {"properties": {"score": {"type": "number"}}}, "then": {"allOf": [{"required": ["passage", "evidence_ids", *more]}, {"properties": {"passage": said, "evidence_ids": cited} | more}]},
        }

    for s in "AB":
        rules["properties"]["cases"]["items"]["properties"][s] = {"type": "object", "required": [*DIMENSIONS], "additionalProperties": False, "properties": {d: dimension(d) for d in DIMENSIONS}}
    return rules


def output():
    element = lambda d: {"score": 3, "reason": "r", "passage": "p", "evidence_ids": ["e"]} | ({"pair_reason": "b"} if d == COHERENCE else {})
    slot = lambda: {d: element(d) for d in DIMENSIONS}
    return {"material_issues": [], "cases": [{"id": f"c{k}", "A": slot(), "B": slot(), "preference": "A", "reason": "r", "evidence_ids": ["e"]} for k in range(3)]}


def spoilt(rng):
    """An output with a few parts dropped, renamed or replaced, mostly within dimensions."""
    made = output()
    for _ in range(rng.randint(0, 3)):
        case = rng.choice(made["cases"])
        holder = rng.choice([made, case] + [case["A"], case["B"]] * 2 + [s[d] for s in (case["A"], case["B"]) if isinstance(s, dict) for d in [*DIMENSIONS, COHERENCE, COHERENCE] if isinstance(s.get(d), dict)])
        if not isinstance(holder, dict) or not holder:
            continue
        key = rng.choice([*holder])
        what = rng.randrange(4)
        if what == 0:
            del holder[key]
        elif what == 1:
            holder[f"{key}x"] = copy.deepcopy(holder[key])
        else:
            holder[key] = rng.choice([None, True, "", " ", "unassessed", 0, 4, 5, -1, 2.0, 2.5, [], ["e", 1], [None], {}, {"score": 1}])
        if not isinstance(made.get("cases"), list) or not all(isinstance(c, dict) and {"A", "B"} <= c.keys() for c in made["cases"]) or not made["cases"]:
            break
    return made


def test_outputs_break_the_same_rules_as_with_a_schema_for_every_dimension(spark):
    rng = random.Random(16)
    made = [output()] + [spoilt(rng) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(made)], "id long, j string")
    got = {}
    for r in contracts.contract_violations(rows, judges.schema(), "id", "j").collect():
        got.setdefault(r.id, []).append((r.path, r.rule))
    rules = by_dimension()
    for i, m in enumerate(made):
        assert sorted(got.get(i, [])) == sorted(plain(m, rules)), m
    assert 0 not in got and len({rule for found in got.values() for _, rule in found}) > 12


def test_neighbours_under_one_schema_keep_order_and_paths(spark):
    one = {"type": "integer", "minimum": 1}
    schema = {"properties": {"a": one, "b": dict(one), "c": False, "d": False, "e": {"const": 1}, "f": {"const": True}, "g": True, "h": True, "i": {"items": one}, "j": {"items": one}}}
    docs = [{}, {"b": 0, "a": None}, {"a": 1, "b": 1}, {"d": None, "c": 1}, {"e": True, "f": 1}, {"e": 1, "f": True, "g": None}, {"j": [1, 0], "i": ["x", 2]}, {"i": {}, "j": []}, [], None]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, j string")
    got = {r.id: [tuple(v) for v in r.v] for r in rows.select("id", contracts.violations(contracts.record(F.col("j")), schema).alias("v")).collect()}
    want = {1: [("/a", "type"), ("/b", "minimum")], 3: [("/c", "false"), ("/d", "false")], 4: [("/e", "const"), ("/f", "const")], 6: [("/i/0", "type"), ("/j/1", "minimum")]}
    assert got == {i: want.get(i, []) for i in range(len(docs))}


def test_no_step_asks_for_the_types_below_it_for_every_row(spark):
    """An array's item, and a loop that a hit leaves, were most of a row's time: 55 ms, now 2."""
    rows = spark.createDataFrame([("{}",)], "text string").select(F.lit(1).alias("run"), F.lit(1).alias("judge"), "text")
    plan = judges._opened_once(rows, "text")._jdf.queryExecution().analyzed().toString()
    assert ")[0]" not in plan and "array_contains(" not in plan and "map_contains_key(" not in plan and " IN (" not in plan


def test_a_nested_contract_is_planned_in_time_that_grows_with_its_depth(spark):
    schema = {"type": "integer"}
    for _ in range(12):
        schema = {"type": "object", "properties": {"a": schema}, "required": ["a"]}
    began = time.perf_counter()
    rows = spark.range(200).select(F.concat(F.lit('{"a":' * 12), F.when(F.col("id") % 2 == 0, "1").otherwise('"x"'), F.lit("}" * 12)).alias("j"), "id")
    got = contracts.contract_violations(rows, schema, "id", "j").collect()
    assert sorted(tuple(r) for r in got) == [(i, "/a" * 12, "type") for i in range(1, 200, 2)]
    assert time.perf_counter() - began < 90


def test_usable_counts_every_distinct_problem_of_every_output(spark):
    """References followed in plain Python; the second judge sees the answers reversed, repeated outputs count once."""
    rng, outputs, answers, evidence, want = random.Random(17), [], [], [], {}
    for run in range(60):
        answers += [(run, f"c{k}", f"a{run} p", f"b{run} p") for k in range(3)]
        evidence += [(run, "e"), (run, "f"), (run, "f")]
        for judge in (1, 2):
            made, bad = output(), set()
            for _ in range(rng.randint(0, 3)):
                k, s, d = rng.randrange(3), rng.choice("AB"), rng.choice(DIMENSIONS)
                case = made["cases"][k]
                what = rng.randrange(7)
                if what == 0:
                    case[s][d]["passage"] = rng.choice([f"a{run}", f"b{run}"])
                elif what == 1:
                    case[s][d]["evidence_ids"] = rng.choice([["e", "g"], ["f"], ["h", "h"], []])
                elif what == 2:
                    case["evidence_ids"] = rng.choice([["g"], ["f", "e"]])
                elif what == 3:
                    case[s][d] = {"score": "unassessed", "reason": "r", "passage": "none", "evidence_ids": ["z"]}
                elif what == 4:
                    case["id"] = rng.choice(["c9", "c0"])
                elif what == 5:
                    case[s][d]["reason"] = " "
                else:
                    case[s].pop(d)
            bad |= set(plain(made, by_dimension()))
            for case in made["cases"]:
                known = case["id"] in ("c0", "c1", "c2")
                bad |= set() if known else {("", "case of another run")}
                cited = list(case["evidence_ids"])
                for s in "AB":
                    shown = f"{'a' if (judge == 1) == (s == 'A') else 'b'}{run} p"
                    for d, e in case[s].items():
                        if e["score"] == "unassessed":
                            continue
                        cited += e["evidence_ids"]
                        if known and e["passage"] not in shown:
                            bad.add((f"/{case['id']}/{s}/{d}", "passage not in answer"))
                bad |= {("", f"unknown evidence {x}") for x in cited if x not in ("e", "f")}
            text = json.dumps(made)
            if run % 20 == 7:
                text, bad = (None, text[:30])[judge - 1], {("", "json")}
            want[run, judge] = (not bad, len(bad))
            outputs += [(run, judge, text)] * rng.randint(1, 2)
    made = spark.createDataFrame(outputs, "run int, judge int, text string")
    tables = spark.createDataFrame(answers, "run int, case_id string, a string, b string"), spark.createDataFrame(evidence, "run int, evidence_id string")
    got = judges.usable(made, judges.problems(made, *tables)).collect()
    assert {(r.run, r.judge): (r.usable, r.n_problems) for r in got} == want and len(got) == len(want)
    assert 10 < sum(ok for ok, _ in want.values()) < 110
