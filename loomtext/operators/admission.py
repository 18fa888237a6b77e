"""Grouped splits, admission and ranking of candidate elements, and size budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.scan import scan

# Classes in order of priority, and the fields each needs.
REQUIRED = {
    "procedure": ("precondition", "on_fail", "steps"),
    "cost_refusal": ("convenient_move", "characteristic_move", "stakes"),
    "verdict": ("object", "judgment", "period", "conditions"),
    "projectible_regularity": ("method", "conditions"),
    "interactional": ("trigger", "move"),
    "variation": ("trigger", "contrast"),
    "preoccupation": ("theme",),
    "stable_style": ("feature", "contrast"),
}
PREFIX = {"procedure": "PROC", "cost_refusal": "CR", "verdict": "VD", "projectible_regularity": "PR", "interactional": "IM", "variation": "MOD", "preoccupation": "PP"}
METRICS = {"procedure": ("transfer", "reasoning", "transfer_cases"), "projectible_regularity": ("transfer", "reasoning", "transfer_cases"), "verdict": ("corpus_hits",), "stable_style": ("discrimination", "observations"),
           "variation": ("discrimination", "observations"), "cost_refusal": ("pressure", "pressure_cases"), "interactional": ("transfer", "transfer_cases"), "preoccupation": ()}
COUNTS = ("transfer_cases", "pressure_cases", "corpus_hits", "observations")
TEST_SHARE, DEV_SHARE, SEED = 0.12, 0.15, 42
# Price and cap of each kind of survivor, base, floor and ceiling of each budget.
CORE = {"n_cost_refusal": (250, 6), "n_projectible": (180, 7), "n_procedure": (200, 5), "n_verdict": (150, 8), "n_interactional": (140, 5), "n_variation": (120, 4)}
FRAMEWORKS = (("n_constructs", 120, 20), ("n_procedure", 200, 6), ("n_epistemic", 130, 6), ("n_verdict", 90, 24), ("n_moves", 110, 10), ("n_personal", 70, 6), ("n_constructs", 25, 40))
VOICE = (("n_registers", 550, 4), ("any_gradient", 250, 1), ("n_rules", 90, 18), ("n_avoid", 40, 25), ("n_pairs", 120, 8), ("n_nopool_pairs", 60, 6))
CLUSTER = {"apparatus": (90, 12), "moves": (90, 12), "applications": (85, 8), "fragments": (30, 24)}
FRAME, PROHIBITIONS, SIBLING, SIBLINGS, MASS, REGISTER, REGISTERS, CLUSTER_RANGE = 600, 80, 15, 9, 400, 220, 3, (1800, 6000)
RELOCATION = ("stable_style", "preoccupation", "verdict", "routing_row", "prose")


def split_order(seed: int, key: Column) -> Column:
    """A shuffle that any engine repeats: by SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)


def grouped_split(passages: DataFrame, stratify: str | None = None, test: float = TEST_SHARE, dev: float = DEV_SHARE, seed: int = SEED) -> DataFrame:
    """(group, stratum, partition): no group is divided; a stratum of under three groups only trains.

    test = min(ceil(n * test), n - 2), development = min(ceil(n * dev), n - test - 1) groups of each stratum.
    """
    stratum = F.min(stratify) if stratify else F.lit("all")
    groups = passages.groupBy("group").agg(stratum.alias("stratum"))
    order = Window.partitionBy("stratum").orderBy(split_order(seed, F.col("group")), "group")
    rows = groups.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("stratum")))
    n_test = F.least(F.ceil(F.col("n") * test), F.col("n") - 2)
    rows = rows.withColumn("n_test", n_test).withColumn("n_dev", F.least(F.ceil(F.col("n") * dev), F.col("n") - F.col("n_test") - 1))
    part = F.when(F.col("n") < 3, "train").when(F.col("place") <= F.col("n_test"), "test").when(F.col("place") <= F.col("n_test") + F.col("n_dev"), "development").otherwise("train")
    return rows.select("group", "stratum", part.alias("partition"))


def split_problems(passages: DataFrame, stratify: str | None = None) -> DataFrame:
    """(problem, key): empty or repeated ids, missing groups, groups of several strata, under three groups."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    out = passages.filter(blank("id") | blank("group")).select(F.lit("missing id or group").alias("problem"), F.coalesce("id", F.lit("")).alias("key"))
    out = out.unionByName(passages.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), F.col("id").alias("key")))
    if stratify:
        out = out.unionByName(passages.groupBy("group").agg(F.countDistinct(stratify).alias("n")).filter("n <> 1").select(F.lit("group of several strata").alias("problem"), F.col("group").alias("key")))
    few = passages.agg(F.countDistinct("group").alias("n")).filter("n < 3")
    return out.unionByName(few.select(F.lit("under three groups").alias("problem"), F.col("n").cast("string").alias("key")))


def admit(elements: DataFrame) -> DataFrame:
    """Adds eligible, score (6 digits), reason, error.

    A missing field cuts an element; a missing or impossible metric is an error of the input and sets ``error``.
    """
    texts = sorted({f for fields in REQUIRED.values() for f in fields if f != "steps"})
    has = {f: F.coalesce(F.trim(F.col(f)), F.lit("")) != "" for f in texts} | {"steps": (F.size("steps") > 0) & ~F.exists("steps", lambda s: F.coalesce(F.trim(s), F.lit("")) == "")}
    kind, m = F.col("class"), lambda k: F.col(f"metrics.{k}")
    n_clusters = F.size(F.array_distinct(F.coalesce("clusters", F.expr("cast(array() as array<string>)"))))
    lacking = F.array_compact(F.array(*[F.when((kind == c) & ~F.coalesce(has[f], F.lit(False)), F.lit(f)) for c, fields in REQUIRED.items() for f in fields],
                                      F.when((n_clusters < 2) | (F.size(F.coalesce("locators", F.expr("cast(array() as array<string>)"))) < 2), "two clusters and locators")))
    bad = lambda k: m(k).isNull() | F.isnan(m(k).cast("double")) | (m(k) < 0) | (m(k) > (100_000 if k in COUNTS else 1))
    wrong = F.array_compact(F.array(*[F.when((kind == c) & bad(k), F.lit(k)) for c, ks in METRICS.items() for k in ks], F.when(~kind.isin(*REQUIRED), "unknown class")))
    rules = {
        "procedure": ((m("transfer") >= 0.7) & (m("reasoning") >= 0.5) & (m("transfer_cases") >= 2), 0.7 * m("transfer") + 0.3 * m("reasoning")),
        "verdict": (m("corpus_hits") >= 2, 0.6 * F.least(n_clusters / F.lit(5.0), F.lit(1.0)) + 0.4 * F.least(m("corpus_hits") / F.lit(10.0), F.lit(1.0))),
        "variation": ((m("discrimination") >= 0.7) & (m("observations") >= 20), m("discrimination")),
        "cost_refusal": ((m("pressure") >= 0.7) & (m("pressure_cases") >= 2), m("pressure")),
        "interactional": ((m("transfer") >= 0.7) & (m("transfer_cases") >= 2), m("transfer")),
        "preoccupation": ((n_clusters >= 3) & (F.size(F.array_distinct(F.coalesce("domains", F.expr("cast(array() as array<string>)")))) >= 2), F.least(n_clusters / F.lit(6.0), F.lit(1.0))),
    }
    rules |= {"projectible_regularity": rules["procedure"], "stable_style": rules["variation"]}
    ok, score = F.lit(False), F.lit(0.0)
    for c, (test, value) in rules.items():
        ok, score = F.when(kind == c, test).otherwise(ok), F.when(kind == c, value).otherwise(score)
    flagged = F.coalesce(F.size("flags") > 0, F.lit(False))
    rows = elements.withColumn("_lacking", F.when(flagged, F.expr("cast(array() as array<string>)")).otherwise(lacking)).withColumn("_wrong", wrong)
    open_ = ~flagged & (F.size("_lacking") == 0)
    rows = rows.withColumn("error", F.when(open_ & (F.size("_wrong") > 0), F.concat(F.lit("invalid: "), F.array_join("_wrong", ", "))))
    counts = open_ & F.col("error").isNull()
    rows = rows.withColumn("eligible", counts & F.coalesce(ok, F.lit(False))).withColumn("score", F.when(counts, F.round(score, 6)).otherwise(0.0))
    reason = F.when(flagged, F.concat(F.lit("excluded: "), F.array_join("flags", ", "))).when(F.size("_lacking") > 0, F.concat(F.lit("missing: "), F.array_join("_lacking", ", "))).otherwise("class rule")
    return rows.withColumn("reason", reason).drop("_lacking", "_wrong")


def conflicts(elements: DataFrame) -> DataFrame:
    """(id, other) in both directions."""
    one = elements.select("id", F.explode("conflicts_with").alias("other"))
    return one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def conflict_problems(elements: DataFrame) -> DataFrame:
    """(id, other): conflicts with oneself or with unknown elements."""
    one = elements.select("id", F.explode("conflicts_with").alias("other"))
    known = elements.select(F.col("id").alias("other")).distinct()
    return one.filter("id = other").unionByName(one.join(known, "other", "left_anti").select("id", "other"))


def decide(elements: DataFrame) -> DataFrame:
    """id, class, eligible, score, decision (retain, pending, cut), rank among the retained, conflicts."""
    judged = admit(elements).select("id", "class", "eligible", "score", "reason", "error")
    with_ = conflicts(elements).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("conflicts"))
    rows = judged.join(with_, "id", "left")
    decision = F.when(~F.col("eligible"), "cut").when(F.col("conflicts").isNotNull(), "pending").otherwise("retain")
    place = F.lit(len(REQUIRED))
    for i, c in enumerate(REQUIRED):
        place = F.when(F.col("class") == c, i).otherwise(place)
    rows = rows.withColumn("decision", decision).withColumn("_place", place)
    kept = scan(rows.filter("decision = 'retain'"), ["_place", F.desc("score"), "id"])
    rest = rows.filter("decision <> 'retain'").withColumn("rank", F.lit(None).cast("long"))
    return kept.unionByName(rest).select("id", "class", "eligible", "score", "decision", "rank", "conflicts", "reason", "error")


def style_cap(retained: DataFrame, share: float = 0.2) -> DataFrame:
    """(id, place, in_core): pure style elements hold at most a share of the core, best first."""
    n = retained.agg(F.count("*")).scalar()
    rows = scan(retained.filter(F.col("class") == "stable_style").select("id", "score"), [F.desc("score"), "id"])
    return rows.select("id", F.col("rank").alias("place"), (F.col("rank") <= F.floor(n * share)).alias("in_core"))


def element_problems(elements: DataFrame) -> DataFrame:
    """(id, problem): identifier prefix that disagrees with the class, bad cluster ids, missing class fields."""
    checks = [F.when((F.col("class") == c) & ~F.col("id").startswith(p + "-"), f"id is not {p}") for c, p in PREFIX.items()]
    checks += [F.when(F.exists(F.coalesce("clusters", F.expr("cast(array() as array<string>)")), lambda c: ~c.rlike("^c[0-9]{2,}$")), "bad cluster id"), F.when(~F.col("class").isin(*REQUIRED), "unknown class")]
    return elements.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def _supply(base: int, terms) -> Column:
    total = F.lit(base)
    for name, price, cap in terms:
        total = total + price * F.least(F.coalesce(F.col(name), F.lit(0)), F.lit(cap))
    return total


def _clamp(value: Column, low: int | Column, high: int | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(value, lit(high)))


def core_budget(rows: DataFrame) -> DataFrame:
    """Adds supply, ceiling, core_budget to rows of counts and coverage (firsthand_ratio, total_tokens, n_clusters)."""
    ceiling = F.when((F.col("firsthand_ratio") < 0.5) | (F.col("total_tokens") < 50_000) | (F.col("n_clusters") < 4), 4000).when((F.col("total_tokens") < 250_000) | (F.col("n_clusters") < 9), 6000).otherwise(7500)
    out = rows.withColumn("supply", _supply(2200, [(k, *v) for k, v in CORE.items()])).withColumn("ceiling", ceiling)
    return out.withColumn("core_budget", _clamp(F.col("supply"), 3000, F.col("ceiling")))


def standing_budgets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("frameworks_budget", _clamp(_supply(700, FRAMEWORKS), 2000, 7000)).withColumn("voice_budget", _clamp(_supply(600, VOICE), 2000, 7000))


#: The scalar prices and limits of a module's budget, by the name under which they can be overridden.
COEFFICIENTS = {
    "frame": FRAME, "prohibitions": PROHIBITIONS, "sibling": SIBLING, "siblings": SIBLINGS, "mass": MASS, "register": REGISTER,
    "registers": REGISTERS, "floor": CLUSTER_RANGE[0], "ceiling": CLUSTER_RANGE[1],
}


def with_defaults(clusters: DataFrame) -> DataFrame:
    """Siblings default to all other modules, first-hand words to the sum of all words.

    Both totals are scalar subqueries, so no task holds a package's modules.
    """
    others = clusters.agg(F.count("*") - 1).scalar()
    words = clusters.agg(F.sum("words")).scalar()
    return clusters.withColumns({"siblings": F.coalesce("siblings", others), "words_firsthand": F.coalesce("words_firsthand", words)})


def cluster_budgets(
    clusters: DataFrame, terms: dict[str, tuple[int, int]] | None = None, scalars: dict[str, float] | None = None
) -> DataFrame:
    """Adds siblings, mass, supply, budget, verdict, with the defaults of :func:`with_defaults`.

    ``terms`` overrides prices and caps, ``scalars`` those of ``COEFFICIENTS``; unknown names are refused.
    """
    for given, known in ((terms, CLUSTER), (scalars, COEFFICIENTS)):
        if unknown := set(given or ()) - set(known):
            raise ValueError(f"unknown names: {sorted(unknown)}")
    prices, c = CLUSTER | (terms or {}), COEFFICIENTS | (scalars or {})
    rows = with_defaults(clusters)
    registers = F.greatest(F.lit(1), F.least(F.coalesce("registers", F.lit(1)), F.lit(c["registers"])))
    share = F.try_divide(F.greatest(F.lit(0), F.col("words")).cast("double"), F.col("words_firsthand"))
    rows = rows.withColumn("mass", F.bround(c["mass"] * F.sqrt(share), 0).cast("long"))
    fixed = _supply(c["frame"], [(k, *v) for k, v in prices.items()]) + c["prohibitions"]
    fixed = fixed + c["sibling"] * F.least("siblings", F.lit(c["siblings"])) + c["register"] * (registers - 1)
    rows = rows.withColumn("supply", (fixed + F.col("mass")).cast("long"))
    rows = rows.withColumn("budget", _clamp(F.col("supply"), c["floor"], c["ceiling"]))
    recut = (F.col("apparatus") > prices["apparatus"][1]) | (F.col("moves") > prices["moves"][1])
    split = recut & (registers > 1) & F.coalesce("shared_domain", F.lit(False))
    said = F.when(split, "SPLIT_IN_MODULE").when(recut, "RECUT").when(F.col("supply") < c["floor"], "FLOOR").otherwise("OK")
    return rows.withColumn("verdict", said)


def worst_case_load(modules: DataFrame, core: int, voice: int, frameworks: int) -> DataFrame:
    """One row: what the heaviest single exchange loads."""
    return modules.agg((F.lit(core + voice + frameworks) + 2 * F.max("budget")).alias("loaded_worst_case"))


def relocations(parts: DataFrame, deficit: int) -> DataFrame:
    """(id, step, moved_so_far): parts moved out, in the fixed order and then largest place first, until the deficit is met."""
    step = F.lit(None).cast("int")
    for i, k in enumerate(RELOCATION, 1):
        step = F.when(F.col("kind") == k, i).otherwise(step)
    rows = parts.filter("NOT protected").withColumn("step", step).filter("step IS NOT NULL")
    rows = scan(rows.select("id", "step", "place", "size"), ["step", F.desc("place"), "id"], sums=["size"])
    rows = rows.withColumn("moved_so_far", F.col("before_size") + F.col("size"))
    return rows.filter(F.col("moved_so_far") - F.col("size") < deficit).select("id", "step", "moved_so_far")
