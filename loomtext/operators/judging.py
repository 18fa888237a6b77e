"""Scoring of blinded judgments, and the gates that decide on them. Plain aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T

# Dimensions, thresholds of recognition and of the behavioral gates.
DIMENSIONS = ("reasoning", "priorities", "conditional_coherence", "interaction", "specificity")
PASS_SCORE, CASE_TOTAL, FLOOR, INTERACTION_FLOOR, WINS = 80, 15, 3, 2, 2
GATES = {"reasoning": 0.7, "commitment": 0.8, "scope": 1.0}
MACRO, LEAST_CANDIDATE, PROJECTION, SELECTION = 0.7, 0.5, 0.5, 0.7
WORDS = r"[㐀-鿿]|[^\W_]+(?:[’'-][^\W_]+)*"
MOST_WORDS = 250
CONCEALED = "[identity concealed]"


def preference(reported: Column, answer_a: Column, answer_b: Column) -> Column:
    """Identical answers tie, whatever was reported."""
    return F.when(answer_a == answer_b, "tie").otherwise(reported)


def recognition(scores: DataFrame, comparisons: DataFrame, issues: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """[by], judge, score, least_total, wins, complete, accepted.

    scores: [by], judge, case_id, slot, dim, score (null: unassessed); comparisons: [by], judge, case_id,
    effective; issues: [by], judge, n_issues. The candidate is slot A for judge 1 and B for judge 2.
    """
    own = F.when(F.col("judge") == 1, "A").otherwise("B")
    mine = scores.filter(F.col("slot") == own)
    floor = F.col("score") >= F.when(F.col("dim") == "interaction", INTERACTION_FLOOR).otherwise(FLOOR)
    cases = mine.groupBy(*by, "judge", "case_id").agg(F.sum("score").alias("total"), F.count_if(F.col("score").isNull()).alias("open"), F.bool_and(floor).alias("floors"))
    wins = comparisons.groupBy(*by, "judge").agg(F.count_if(F.col("effective") == own).alias("wins"))
    rows = cases.groupBy(*by, "judge").agg(F.sum("total").alias("sum"), F.min("total").alias("least_total"), F.sum("open").alias("open"), F.bool_and("floors").alias("floors"))
    rows = rows.join(wins, [*by, "judge"]).join(issues, [*by, "judge"])
    complete = F.col("open") == 0
    score = F.when(complete, 100.0 * F.col("sum") / 60)
    accepted = F.when(complete, (100 * F.col("sum") >= PASS_SCORE * 60) & (F.col("least_total") >= CASE_TOTAL) & F.col("floors") & (F.col("wins") >= WINS) & (F.col("n_issues") == 0))
    return rows.select(*by, "judge", score.alias("score"), F.when(complete, F.col("least_total")).alias("least_total"), "wins", complete.alias("complete"), accepted.alias("accepted"))


def outcome(judged: DataFrame, by: tuple[str, ...] = ("run",), defect: Column | None = None) -> DataFrame:
    """[by], outcome: passed if both judges accept, failed if both reject, else inconclusive."""
    rows = judged.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    said = F.when((F.col("n") == 2) & (F.col("yes") == 2), "passed").when((F.col("n") == 2) & (F.col("no") == 2), "failed").otherwise("inconclusive")
    return rows.select(*by, said.alias("outcome") if defect is None else F.when(defect, "failed").otherwise(said).alias("outcome"))


def citation_problems(citations: DataFrame, known: DataFrame, answers: DataFrame) -> DataFrame:
    """(citation_id, problem): unknown evidence, or a passage that its answer does not hold."""
    unknown = citations.join(known.select("evidence_id").distinct(), "evidence_id", "left_anti").select("citation_id", F.lit("unknown evidence").alias("problem"))
    rows = citations.join(answers, "answer_id", "left")
    absent = rows.filter(~F.coalesce(F.contains("answer", "passage") & (F.trim("passage") != ""), F.lit(False))).select("citation_id", F.lit("passage not in answer").alias("problem"))
    return unknown.unionByName(absent)


def delivery(gates: DataFrame) -> DataFrame:
    """Adds status from package, source, recognition and whether their hashes are current."""
    fresh = F.coalesce(F.col("current"), F.lit(False))
    ok = fresh & (F.col("package") == "passed") & (F.col("source") == "passed") & (F.col("recognition") == "passed")
    return gates.withColumn("status", F.when(ok, "standard_accepted").otherwise("candidate"))


def behavioral(cases: DataFrame) -> DataFrame:
    """kind, hits, n, score, passed: cases (kind, case_id, scope_case, criteria: map of booleans, disputed)."""
    hit = F.forall(F.map_values("criteria"), lambda v: v)
    rows = cases.groupBy("kind").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"), F.countDistinct("scope_case").alias("kinds"), F.bool_or("disputed").alias("disputed"))
    least = F.lit(2.0)
    for k, v in GATES.items():
        least = F.when(F.col("kind") == k, v).otherwise(least)
    score = F.col("hits").cast("double") / F.col("n")
    enough = F.when(F.col("kind") == "scope", (F.col("n") >= 3) & (F.col("kinds") == 3)).otherwise(F.col("n") >= 2)
    return rows.select("kind", "hits", "n", score.alias("score"), ((score >= least) & enough & ~F.col("disputed")).alias("passed"))


def identity_accuracy(judgments: DataFrame) -> DataFrame:
    """candidate, hits, n, accuracy: judgments (task, truth, reviewer, choice)."""
    return judgments.groupBy(F.col("truth").alias("candidate")).agg(F.count_if(F.col("choice") == F.col("truth")).alias("hits"), F.count("*").alias("n"), F.avg((F.col("choice") == F.col("truth")).cast("int")).alias("accuracy"))


def identity_gate(judgments: DataFrame) -> DataFrame:
    """One row: macro accuracy, least accuracy, passed."""
    rows = identity_accuracy(judgments).agg(F.avg("accuracy").alias("macro"), F.min("accuracy").alias("least"))
    return rows.withColumn("passed", (F.col("macro") >= MACRO) & (F.col("least") >= LEAST_CANDIDATE))


def identity_problems(judgments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task, problem): tasks that miss candidates, answers under two reviewers, choices of strangers."""
    n = candidates.select("candidate").distinct().agg(F.count("*").alias("n_candidates"))
    per = judgments.groupBy("task", "truth").agg(F.countDistinct("reviewer").alias("reviewers"), F.count("*").alias("m"))
    missing = per.groupBy("task").agg(F.count("*").alias("k")).join(F.broadcast(n)).filter("k <> n_candidates").select("task", F.lit("not every candidate").alias("problem"))
    few = per.filter("reviewers < 2 OR reviewers <> m").select("task", F.lit("reviewers").alias("problem"))
    strange = judgments.join(candidates.select(F.col("candidate").alias("choice")), "choice", "left_anti").select("task", F.lit("unknown choice").alias("problem"))
    return missing.unionByName(few).unionByName(strange).distinct()


def projection(items: DataFrame, by: str) -> DataFrame:
    """by, score, baseline, hit_1, hit_2, band, passed: items (score, baseline_score of 0 to 2)."""
    rows = items.groupBy(by).agg((F.sum("score") / (2.0 * F.count("*"))).alias("score"), (F.sum("baseline_score") / (2.0 * F.count("*"))).alias("baseline"), F.avg((F.col("score") == 1).cast("int")).alias("hit_1"), F.avg((F.col("score") == 2).cast("int")).alias("hit_2"))
    band = F.when(F.col("score") >= 0.7, "strong").when(F.col("score") >= PROJECTION, "usable").otherwise("weak")
    return rows.withColumn("band", band).withColumn("passed", (F.col("score") >= PROJECTION) & (F.col("score") >= F.col("baseline")))


def leakage(split: DataFrame, inventory: DataFrame) -> DataFrame:
    """(problem, key): split (id, partition) against inventory (id, group)."""
    twice = split.groupBy("id").agg(F.countDistinct("partition").alias("n")).filter("n > 1").select(F.lit("id in several partitions").alias("problem"), F.col("id").alias("key"))
    uncovered = inventory.join(split, "id", "left_anti").select(F.lit("not assigned").alias("problem"), F.col("id").alias("key"))
    strange = split.join(inventory, "id", "left_anti").select(F.lit("not in inventory").alias("problem"), F.col("id").alias("key"))
    torn = split.join(inventory, "id").groupBy("group").agg(F.countDistinct("partition").alias("n")).filter("n > 1").select(F.lit("group in several partitions").alias("problem"), F.col("group").alias("key"))
    return twice.unionByName(uncovered).unionByName(strange).unionByName(torn)


def cost_problems(costs: DataFrame) -> DataFrame:
    """(id, problem) of divergence inventories that do not reconcile."""
    checks = [F.when(F.col("missing_unlogged") != 0, "missing"), F.when(F.col("in_core_final") + F.col("logged_out") != F.col("total_divergences"), "does not add up"),
              F.when((F.col("in_core_final") > F.col("slated_for_core")) | (F.col("slated_for_core") > F.col("total_divergences")), "inconsistent"), F.when((F.col("total_divergences") > 0) & (F.col("in_core_final") == 0), "no core refusal")]
    return costs.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def matrix_problems(cells: DataFrame, units: DataFrame) -> DataFrame:
    """(problem, i, j) of a long matrix (i, j, value) over units (unit_id)."""
    named = units.select(F.col("unit_id"))
    outside = cells.join(named.withColumnRenamed("unit_id", "i"), "i", "left_anti").unionByName(cells.join(named.withColumnRenamed("unit_id", "j"), "j", "left_anti")).select(F.lit("unknown unit").alias("problem"), "i", "j").distinct()
    bad = cells.filter(F.isnan(F.coalesce("value", F.lit(float("nan")))) | (F.col("value") < 0) | (F.col("value") == float("inf"))).select(F.lit("not finite and nonnegative").alias("problem"), "i", "j")
    diagonal = cells.filter("i = j AND value <> 0").select(F.lit("diagonal").alias("problem"), "i", "j")
    other = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("mirror"))
    near = F.abs(F.col("value") - F.col("mirror")) <= F.greatest(1e-9 * F.greatest(F.abs("value"), F.abs("mirror")), F.lit(1e-12))
    odd = cells.join(other, ["i", "j"], "left").filter(~F.coalesce(near, F.lit(False)) & (F.col("i") < F.col("j"))).select(F.lit("not symmetric").alias("problem"), "i", "j")
    return outside.unionByName(bad).unionByName(diagonal).unionByName(odd)


def selection_gate(cases: DataFrame, families: DataFrame) -> DataFrame:
    """One row: score, covers every family, passed: cases (expected, selected, observed)."""
    n = families.select("family_id").distinct().agg(F.count("*").alias("n"))
    rows = cases.agg(F.avg(((F.col("selected") == F.col("expected")) & (F.col("expected") == F.col("observed"))).cast("int")).alias("score"), F.countDistinct("expected").alias("k")).join(F.broadcast(n))
    return rows.select("score", (F.col("k") == F.col("n")).alias("covers"), ((F.col("score") >= SELECTION) & (F.col("k") == F.col("n"))).alias("passed"))


def stale(results: DataFrame, current: DataFrame) -> DataFrame:
    """Adds stale and blocking: a result on another hash, or listed as stale; only style may ship stale, with a note."""
    rows = results.join(current.select("target", F.col("hash").alias("_now")), "target", "left")
    old = ~F.coalesce(F.col("hash") == F.col("_now"), F.lit(False)) | F.coalesce(F.col("listed"), F.lit(False))
    return rows.withColumn("stale", old).withColumn("blocking", old & ~((F.col("kind") == "style") & (F.coalesce(F.trim("note"), F.lit("")) != ""))).drop("_now")


def register_gates(gates: DataFrame, current: DataFrame) -> DataFrame:
    """(gate, passed): discrimination and family gates need a current hash, masked passages, two samples and .7."""
    rows = gates.join(current.select("target", F.col("hash").alias("_now")), "target", "left")
    ok = F.coalesce(F.col("hash") == F.col("_now"), F.lit(False)) & F.coalesce(F.col("masked"), F.lit(False)) & (F.col("n") >= 2) & (F.col("score") >= SELECTION)
    return rows.select("gate", F.coalesce(ok, F.lit(False)).alias("passed"))


def conceal(text: Column, labels: list[str]) -> Column:
    """Literal labels replaced, longest first."""
    for label in sorted(set(labels), key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(label), F.lit(CONCEALED))
    return text


def conceal_counts(text: Column, labels: list[str]) -> Column:
    """Array of (literal, count) in that order, each counted in what the ones before left."""
    out = []
    for label in sorted(set(labels), key=lambda s: (-len(s), s)):
        out.append(F.struct(F.lit(label).alias("literal"), T.literal_count(text, label).alias("count")))
        text = F.replace(text, F.lit(label), F.lit(CONCEALED))
    return F.filter(F.array(*out), lambda x: x["count"] > 0)


def mixed_words(text: Column) -> Column:
    """Words of any script; a CJK character is a word."""
    return T.count(text, WORDS)


def agreement(grades: DataFrame) -> DataFrame:
    """(task, condition, agree): all graders gave the same score and criteria."""
    return grades.groupBy("task", "condition").agg((F.countDistinct(F.struct("score", "criteria")) == 1).alias("agree"))


def apply_corrections(grades: DataFrame, corrections: DataFrame) -> DataFrame:
    """Grades with corrections (task, condition, score, reviewer) laid over them; corrected ones are not disputed."""
    new = corrections.select("task", "condition", F.col("score").alias("_score"), F.col("reviewer").alias("_by"))
    rows = grades.join(new, ["task", "condition"], "left")
    hit = F.col("_score").isNotNull()
    return rows.withColumn("score", F.coalesce("_score", "score")).withColumn("reviewer", F.coalesce("_by", "reviewer")).withColumn("disputed", F.col("disputed") & ~hit).drop("_score", "_by")


def unknown_corrections(grades: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.join(grades.select("task", "condition").distinct(), ["task", "condition"], "left_anti")


def regroup(grades: DataFrame) -> DataFrame:
    """(condition, n, loaded): answers of each condition with the distinct sorted paths they loaded."""
    return grades.groupBy("condition").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("loaded"))
