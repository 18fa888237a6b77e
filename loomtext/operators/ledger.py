"""Call ledgers: budgets, reuse, replay of reservations, freshness by hash."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles, and limits of the standard mode.
ROLES = ("candidate", "control", "judge", "baseline", "neighbor", "grader", "delegated")
CANDIDATES, JUDGES = 3, 2


def encoded(value: Any) -> str:
    """JSON with sorted keys and non-ASCII kept; numbers must be finite."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)


def digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(encoded(value).encode()).hexdigest()


def fingerprint(request: Column) -> Column:
    """Hash of a request that is already canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(request.cast("binary"), 256))


def budget(calls: DataFrame, allowances: DataFrame, key: str = "workflow") -> DataFrame:
    """key, budget, consumed, remaining (never below 0)."""
    used = calls.groupBy(key).agg(F.count("*").alias("consumed"))
    rows = allowances.join(used, key, "left").fillna(0, ["consumed"])
    return rows.select(key, "budget", "consumed", F.greatest(F.lit(0), F.col("budget") - F.col("consumed")).alias("remaining"))


def reusable(requests: DataFrame, calls: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """requests with call_id and response of the latest completed usable call of the same item, role and
    fingerprint, or else of an import; null where there is neither."""
    key = ["item", "role", "fingerprint"]
    good = calls.filter((F.col("state") == "completed") & F.coalesce(F.col("usable"), F.lit(True)))
    last = good.groupBy(*key).agg(F.max(F.struct("call_id", "response")).alias("own"))
    rows = requests.join(last, key, "left")
    if imported is None:
        return rows.select(*requests.columns, F.col("own.call_id").cast("string").alias("call_id"), F.col("own.response").alias("response"))
    more = imported.groupBy(*key).agg(F.min(F.struct("lineage", "response")).alias("other"))
    rows = rows.join(more, key, "left")
    return rows.select(*requests.columns, F.coalesce(F.col("own.call_id").cast("string"), F.concat(F.lit("import:"), F.col("other.lineage"))).alias("call_id"), F.coalesce("own.response", "other.response").alias("response"))


def import_calls(existing: DataFrame, source: DataFrame) -> DataFrame:
    """Adds completed usable calls of a source that are not there yet; (item, fingerprint) is the key."""
    good = source.filter((F.col("state") == "completed") & F.coalesce(F.col("usable"), F.lit(True)))
    new = good.groupBy("item", "fingerprint").agg(F.min(F.struct("call_id", "role", "response")).alias("c")).select("item", "fingerprint", "c.role", "c.response", F.col("c.call_id").cast("string").alias("lineage"))
    return existing.unionByName(new.join(existing, ["item", "fingerprint"], "left_anti").select(*existing.columns))


def import_conflicts(existing: DataFrame, source: DataFrame) -> DataFrame:
    good = source.filter((F.col("state") == "completed") & F.coalesce(F.col("usable"), F.lit(True))).select("item", "fingerprint", F.col("response").alias("_new"))
    return existing.join(good, ["item", "fingerprint"]).filter("response <> _new").select("item", "fingerprint").distinct()


def latest_checks(checks: DataFrame) -> DataFrame:
    """(call_id, usable, reason): the last check of each call."""
    return checks.groupBy("call_id").agg(F.max(F.struct("seq", "usable", "reason")).alias("c")).select("call_id", "c.usable", "c.reason")


def check_events(checks: DataFrame) -> DataFrame:
    """Checks that change a call's state: the first one, and those that differ from the one before."""
    order = Window.partitionBy("call_id").orderBy("seq")
    rows = checks.withColumn("_u", F.lag("usable").over(order)).withColumn("_r", F.lag("reason").over(order)).withColumn("_n", F.row_number().over(order))
    return rows.filter((F.col("_n") == 1) | ~F.col("usable").eqNullSafe(F.col("_u")) | ~F.col("reason").eqNullSafe(F.col("_r"))).select("call_id", "seq", "usable", "reason")


def decide(state: dict, row: dict) -> tuple[str, bool]:
    """One reservation against the state of its workflow: (decision, charged). The state is updated.

    Rules in order: reuse, unfinished attempts need a retry, stop and budget, then those of the standard mode.
    """
    if row["role"] not in ROLES or not row["item"]:
        return "invalid", False
    key = (row["item"], row["fingerprint"])
    old = state["last"].get(key)
    if old == "completed":
        return "reuse", False
    if old is not None and not row["retry"]:
        return "needs retry", False
    if state["stopped"] or state["used"] >= state["budget"]:
        return "stopped", False
    if state["mode"] == "standard":
        if old is None and state["item_pass"].get(row["item"], -1) >= state["pass"]:
            return "needs repair pass", False
        if row["role"] in ("baseline", "neighbor", "delegated"):
            return "role not dispatched", False
        if row["role"] in ("candidate", "control"):
            seen = state["candidates"].setdefault((row["role"], state["pass"]), set())
            if not row["candidate"]:
                return "invalid", False
            if row["candidate"] not in seen and len(seen) >= CANDIDATES:
                return "candidate limit", False
            seen.add(row["candidate"])
        else:
            seen = state["judges"].setdefault((row["role"], state["pass"]), set())
            if row["item"] not in seen and len(seen) >= JUDGES:
                return "judge limit", False
            seen.add(row["item"])
    state["used"] += 1
    state["item_pass"][row["item"]] = state["pass"]
    state["last"][key] = row["result"] or "reserved"
    return "reserved", True


def fresh_state(budget: int, mode: str = "standard") -> dict:
    return {"budget": budget, "mode": mode, "used": 0, "pass": 0, "stopped": False, "last": {}, "item_pass": {}, "candidates": {}, "judges": {}}


def step(state: dict, row: dict) -> tuple[str, bool]:
    """One ledger event: reserve, repair, stop or authorize."""
    if row["kind"] == "stop":
        state["stopped"] = True
        return "stop", False
    if row["kind"] == "authorize":
        state["budget"] += int(row["amount"] or 0)
        state["stopped"] = False
        return "authorize", False
    if row["kind"] == "repair":
        if state["stopped"] or (state["mode"] == "standard" and state["pass"] >= 1):
            return "repair refused", False
        state["pass"] += 1
        return "repair", False
    return decide(state, row)


REPLAY_SCHEMA = "workflow long, seq long, decision string, charged boolean, used long"


def replay(events: DataFrame, budget: int = 8, mode: str = "standard") -> DataFrame:
    """(workflow, seq, decision, charged, used): a ledger's events decided in order.

    Order matters within a workflow, so each is replayed by itself; a workflow's ledger is short by its budget.
    events: workflow, seq, kind, item, role, fingerprint, candidate, retry, result, amount.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = fresh_state(budget, mode), []
        for row in group.sort_values("seq").to_dict("records"):
            row = {k: None if v is None or v != v else v for k, v in row.items()}
            decision, charged = step(state, row)
            out.append((row["workflow"], row["seq"], decision, charged, state["used"]))
        return pd.DataFrame(out, columns=["workflow", "seq", "decision", "charged", "used"])

    return events.groupBy("workflow").applyInPandas(run, REPLAY_SCHEMA)


def replacements(calls: DataFrame) -> DataFrame:
    """(item, fingerprint, attempts, replaced, allowed): an unusable output is replaced once, and only by a retry."""
    order = Window.partitionBy("item", "fingerprint").orderBy("call_id")
    rows = calls.withColumn("_before", F.lag("usable").over(order)).withColumn("_place", F.row_number().over(order))
    fair = (F.col("_place") == 1) | ((F.col("_place") == 2) & ~F.coalesce(F.col("_before"), F.lit(True)) & F.col("retry"))
    return rows.groupBy("item", "fingerprint").agg(F.count("*").alias("attempts"), (F.count("*") > 1).alias("replaced"), F.bool_and(fair).alias("allowed"))


def current_evidence(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """(record, current): every dependency of the record (a map of path to hash) has that hash now."""
    rows = records.select("record", F.explode_outer("dependencies").alias("path", "hash")).join(hashes.select("path", F.col("hash").alias("_now")), "path", "left")
    return rows.groupBy("record").agg(F.bool_and(F.col("path").isNull() | F.coalesce(F.col("hash") == F.col("_now"), F.lit(False))).alias("current"))


def manifest_differences(sealed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, added or changed files."""
    rows = sealed.select("path", F.col("hash").alias("a")).join(found.select("path", F.col("hash").alias("b")), "path", "full")
    said = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return rows.select("path", said.alias("problem")).filter("problem IS NOT NULL")


def sections(files: DataFrame) -> DataFrame:
    """(path, start, end, depth, title) of H2 and H3 sections outside fences, lines from 1; a section ends before
    the next heading of its depth or less. Per file, so in one window each."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("i", "line")).withColumn("i", F.col("i") + 1)
    order = Window.partitionBy("path").orderBy("i")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = rows.withColumn("_open", F.sum(fence.cast("int")).over(order) % 2 == 1)
    heads = rows.filter(~F.col("_open") & F.col("line").rlike(r"^#{2,3}\s+.+")).select("path", F.col("i").alias("start"), F.length(F.regexp_extract("line", r"^(#{2,3})\s", 1)).alias("depth"), F.trim(F.regexp_extract("line", r"^#{2,3}\s+(.+)", 1)).alias("title"))
    later = Window.partitionBy("path").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    n = files.select("path", (F.size(F.split("text", r"\r\n|\n|\r", -1)) - F.when(F.col("text").rlike(r"(\n|\r)\z"), 1).otherwise(0)).alias("n"))
    after = heads.withColumn("_two", F.min(F.when(F.col("depth") == 2, F.col("start"))).over(later)).withColumn("_any", F.min("start").over(later)).join(n, "path")
    return after.select("path", "start", F.coalesce(F.when(F.col("depth") == 2, F.col("_two")).otherwise(F.col("_any")) - 1, F.col("n")).alias("end"), "depth", "title")


def section_guards(found: DataFrame) -> DataFrame:
    """(path, start, guard): sections whose title speaks of decision rules or mental models guard all others of a file."""
    guards = found.filter(F.lower("title").rlike("decision rules|mental model")).select("path", F.col("start").alias("guard"))
    return found.select("path", "start").join(guards, "path").filter("start <> guard")


def exposures(claims: DataFrame) -> DataFrame:
    """(experiment, group) claimed more than once for the final test."""
    return claims.groupBy("experiment", "group").count().filter("count > 1").select("experiment", "group")


def torn_groups(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("group").agg(F.countDistinct("partition").alias("n")).filter("n > 1").select("group")


def plan_problems(cases: DataFrame, patterns: DataFrame, evidence: DataFrame) -> DataFrame:
    """(problem, key): a plan has three distinct cases of fixed kinds in order, three to five patterns, and patterns
    cite known evidence."""
    kinds = cases.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    wrong = kinds.filter("kinds <> 'characteristic,changed_condition,interpersonal'").select(F.lit("case kinds").alias("problem"), F.col("kinds").alias("key"))
    unsafe = cases.filter(~F.col("case_id").rlike("^[a-zA-Z0-9_-]+$")).select(F.lit("unsafe case id").alias("problem"), F.col("case_id").alias("key"))
    many = patterns.agg(F.countDistinct("pattern").alias("n")).filter("n NOT BETWEEN 3 AND 5").select(F.lit("pattern count").alias("problem"), F.col("n").cast("string").alias("key"))
    strange = patterns.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select(F.lit("unknown evidence").alias("problem"), F.col("evidence_id").cast("string").alias("key"))
    return wrong.unionByName(unsafe).unionByName(many).unionByName(strange)


def dependency_hashes(requests: DataFrame, modules: DataFrame) -> DataFrame:
    """(request, dependencies): a persona request depends on the core and its references, a control on nothing."""
    refs = requests.filter("condition = 'persona'").select("request", F.explode(F.concat(F.array(F.lit("SKILL.md")), "references")).alias("path"))
    found = refs.join(modules, "path").groupBy("request").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "hash")))).alias("dependencies"))
    return requests.select("request").join(found, "request", "left").withColumn("dependencies", F.coalesce("dependencies", F.expr("cast(map() as map<string,string>)")))


def blinded(cases: DataFrame, judges: int = 2) -> DataFrame:
    """(case_id, judge, slot_a, slot_b): the second judge sees the answers swapped."""
    rows = cases.withColumn("judge", F.explode(F.sequence(F.lit(1), F.lit(judges))))
    even = F.col("judge") % 2 == 0
    return rows.select("case_id", "judge", F.when(even, F.col("answer_b")).otherwise(F.col("answer_a")).alias("slot_a"), F.when(even, F.col("answer_a")).otherwise(F.col("answer_b")).alias("slot_b"))


def allowed_references(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request, path, access): whole files for a whole condition, listed sections for a targeted one, else none."""
    access = F.when(F.col("condition") == "whole", "whole").when((F.col("condition") == "targeted") & F.array_contains("sections", F.col("key")), "section")
    return requests.join(catalog, "path").withColumn("access", access).filter("access IS NOT NULL").select("request", "path", "key", "access").distinct()


def checkpoints(events: DataFrame) -> DataFrame:
    """(workflow, repairs, allowance, stopped, checkpoints): a fold of control events; a later authorisation reopens."""
    last = F.max(F.when(F.col("kind").isin("stop", "authorize"), F.struct("seq", "kind")))
    rows = events.groupBy("workflow").agg(F.least(F.lit(1), F.count_if(F.col("kind") == "repair")).alias("repairs"), F.coalesce(F.sum(F.when(F.col("kind") == "authorize", F.col("amount"))), F.lit(0)).alias("allowance"), last.alias("_l"), F.count_if(F.col("kind") == "checkpoint").alias("checkpoints"))
    return rows.select("workflow", "repairs", "allowance", F.coalesce(F.col("_l.kind") == "stop", F.lit(False)).alias("stopped"), "checkpoints")


def over_cap(messages: DataFrame, limit: int) -> DataFrame:
    """(request, n_bytes) of requests whose messages exceed the limit in UTF-8."""
    return messages.groupBy("request").agg(F.sum(F.octet_length("text")).alias("n_bytes")).filter(F.col("n_bytes") > limit)


