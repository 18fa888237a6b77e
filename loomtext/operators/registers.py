"""Registers: groups of text units that write alike, found from 13 features with stability checks.

Units are few (works or clusters), so matrices of units are small; texts are measured where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import counted, style_zh
from loomtext.operators.scan import scan

# Defaults of discovery.
RATIO, DIMS, LEAST_TOKENS, LEAST_SENTENCES, LEAST_EVENTS, LEAST_DELTA, WINDOWS, LEAST_WINDOW, STABILITY = 3.0, 3, 600, 20, 5, 10.0, 3, 100, 0.8
HAN_SHARE, LONG_EN, LONG_ZH, STRONG, LEAST_CONSISTENT = 0.3, 30, 40, 0.9, 3
MOST_UNITS = 2_000
PAIR_BLOCKS = 16


def language(text: Column) -> Column:
    """zh if more than 30 % of what is not white space is Han, else en."""
    return F.when(F.try_divide(style_zh.han(text), T.count(text, r"\S")) > HAN_SHARE, "zh").otherwise("en")


def _long(rows: DataFrame, values: dict[str, Column], extra: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("double").alias("value")) for k, v in values.items()])
    return rows.select("unit_id", *extra, F.explode(each).alias("e")).select("unit_id", *extra, "e.*")


def _lengths(rows: DataFrame, lengths: Column, longest: int) -> tuple[DataFrame, dict[str, Column]]:
    rows = rows.withColumn("_l", lengths).withColumn("_d", T.distribution(F.col("_l")))
    share = F.try_divide(F.size(F.filter("_l", lambda n: n > longest)).cast("double"), F.size("_l"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows, {"mean_sentence_len": zero(F.col("_d.mean")), "median_sentence_len": zero(F.col("_d.median")), "p90_sentence_len": zero(F.col("_d.p90")), "long_sentence_share": zero(share)}


def features_en(units: DataFrame, terms: tuple[str, ...] = (), flagship: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, [extra], dim, value) of English units (unit_id, text)."""
    rows = units.withColumn("_w", T.words(F.col("text"))).withColumn("_low", F.lower("text"))
    rows, out = _lengths(rows, T.word_lengths(T.sentences(F.col("text"))), LONG_EN)
    rate = lambda hits: T.per(hits, F.size("_w"), 10000)
    members = {"connective_rate": L.CONNECTIVES, "hedge_rate": L.HEDGES, "booster_rate": L.BOOSTERS, "second_person_rate": L.SECOND_PERSON, "first_person_rate": L.FIRST_PERSON}
    out |= {"question_rate": rate(T.literal_count(F.col("text"), "?"))} | {k: rate(T.in_list(F.col("_w"), v)) for k, v in members.items()}
    out |= {"title_mark_rate": F.lit(0.0), "core_term_density": rate(style_zh.phrases(F.col("_low"), tuple(map(str.lower, terms)))), "flagship_term_density": rate(style_zh.phrases(F.col("_low"), tuple(map(str.lower, flagship))))}
    return _long(rows, {k: out[k] for k in L.DIMENSIONS}, list(extra))


def features_zh(units: DataFrame, terms: tuple[str, ...] = (), flagship: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    lists = {"question_rate": ("？", "?"), "connective_rate": L.SCAFFOLDING_ZH, "hedge_rate": L.HEDGES_ZH, "booster_rate": L.BOOSTERS_ZH, "second_person_rate": L.SECOND_ZH, "first_person_rate": L.FIRST_ZH, "title_mark_rate": ("《",), "core_term_density": terms, "flagship_term_density": flagship}
    lists = {k: tuple(v) for k, v in lists.items()}
    rows = units.select("unit_id", *extra, style_zh.han_lengths(F.col("text"), L.SENTENCE_END_ZH).alias("_han"), counted.literal_counts(F.col("text"), counted.literals_of(lists)).alias("_c"))
    rows, out = _lengths(rows, F.col("_han"), LONG_ZH)
    out |= {k: T.per(hits, F.get("_c", F.lit(0)), 10000) for k, hits in counted.totals(F.col("_c"), lists).items()}
    return _long(rows, {k: out[k] for k in L.DIMENSIONS}, list(extra))


def observations(units: DataFrame) -> DataFrame:
    """unit_id, tokens, sentences of English units."""
    return units.select("unit_id", F.size(T.words(F.col("text"))).cast("long").alias("tokens"), F.size(T.word_lengths(T.sentences(F.col("text")))).cast("long").alias("sentences"))


def text_sizes(units: DataFrame) -> DataFrame:
    """unit_id, chars, han, visible (characters but white space) of units (unit_id, text)."""
    text = F.col("text")
    return units.select("unit_id", F.length(text).cast("long").alias("chars"), style_zh.han(text).alias("han"), T.count(text, r"\S").alias("visible"))


def unit_sizes(docs: DataFrame, work: str, text_col: str = "text") -> DataFrame:
    """What :func:`text_sizes` gives for the texts of works, a blank line between their documents, from sums over these."""
    rows = text_sizes(docs.select(F.col(work).alias("unit_id"), F.col(text_col).alias("text")))
    between = 2 * F.greatest(F.count("chars") - 1, F.lit(0))
    sums = rows.groupBy("unit_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("han", "visible")], (F.coalesce(F.sum("chars"), F.lit(0)) + between).alias("chars"))
    return sums.select("unit_id", "chars", "han", "visible")


def size_problems(sizes: DataFrame, least_chars: int = 0) -> DataFrame:
    """(unit_id, problem): repeated identifiers, too short texts, and a second language in the set."""
    repeated = sizes.groupBy("unit_id").count().filter("count > 1").select("unit_id", F.lit("repeated unit").alias("problem"))
    short = sizes.filter(F.col("chars") < least_chars).select("unit_id", F.lit("too short").alias("problem"))
    langs = sizes.select("unit_id", F.when(F.try_divide("han", "visible") > HAN_SHARE, "zh").otherwise("en").alias("lang"))
    first = langs.agg(F.min("lang").alias("lo"), F.max("lang").alias("hi"))
    mixed = langs.join(F.broadcast(first.filter("lo <> hi")), langs["lang"] == F.col("hi")).select("unit_id", F.lit("mixed languages").alias("problem"))
    return repeated.unionByName(short).unionByName(mixed)


def unit_problems(units: DataFrame, least_chars: int = 0) -> DataFrame:
    """:func:`size_problems` of units (unit_id, text)."""
    return size_problems(text_sizes(units), least_chars)


def pairs(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, dim, x, y) for a < b: units are few, and dim keeps the join an equi-join."""
    left = features.select(F.col("unit_id").alias("a"), *by, "dim", F.col("value").alias("x"))
    right = features.select(F.col("unit_id").alias("b"), *by, "dim", F.col("value").alias("y"))
    return left.join(right, ["dim", *by]).filter("a < b")


def ratios(paired: DataFrame) -> DataFrame:
    """Adds ratio: 1 if both are 0, null if one is, else larger over smaller."""
    ratio = F.when((F.col("x") == 0) & (F.col("y") == 0), 1.0).otherwise(F.try_divide(F.greatest("x", "y"), F.greatest(F.least("x", "y"), F.when(F.least("x", "y") == 0, 0.0).otherwise(1e-12))))
    return paired.withColumn("ratio", ratio)


def z_scores(features: DataFrame, digits: int = 6) -> DataFrame:
    """(unit_id, dim, z) from features rounded to ``digits``; 0 where all are equal."""
    by = Window.partitionBy("dim")
    rows = features.withColumn("v", F.round("value", digits)).withColumn("m", F.avg("v").over(by)).withColumn("sd", F.stddev_pop("v").over(by))
    return rows.select("unit_id", "dim", F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.when(F.col("sd") > 1e-12, F.col("sd"))), F.lit(0.0)).alias("z"))


def z_distances(z: DataFrame) -> DataFrame:
    """(a, b, distance): mean absolute difference of z over the dimensions."""
    rows = pairs(z.withColumnRenamed("z", "value"))
    return rows.groupBy("a", "b").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def events(features: DataFrame, tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``features`` with the events that each rate stands for: rate * tokens / 10000, halves to even; none for
    lengths and shares."""
    counted = features.join(tokens, ["unit_id", *by])
    rate = F.bround(F.col("value") * F.col("tokens") / 10000, 0)
    return counted.withColumn("events", F.when(F.col("dim").isin(*L.ABSOLUTE_MINIMA), F.lit(0)).otherwise(rate))


def supported(features: DataFrame, tokens: DataFrame, by: tuple[str, ...] = (), ratio: float = RATIO, least_events: int = LEAST_EVENTS, least_delta: float = LEAST_DELTA) -> DataFrame:
    """(a, b, [by], dim) where two units differ by enough, on enough events.

    Event counts are rate * tokens / 10000, halves to even. Dimensions of lengths and shares need no events.
    """
    counted = events(features, tokens, by)
    left = counted.select(F.col("unit_id").alias("a"), *by, "dim", F.col("value").alias("x"), F.col("events").alias("ex"))
    right = counted.select(F.col("unit_id").alias("b"), *by, "dim", F.col("value").alias("y"), F.col("events").alias("ey"))
    rows = left.join(right, ["dim", *by]).filter("a < b")
    least = F.lit(float(least_delta))
    for k, v in L.ABSOLUTE_MINIMA.items():
        least = F.when(F.col("dim") == k, v).otherwise(least)
    low, high = F.least("x", "y"), F.greatest("x", "y")
    enough = F.col("dim").isin(*L.ABSOLUTE_MINIMA) | (F.greatest("ex", "ey") >= least_events)
    far = (low == 0) | (F.try_divide(high, low) > ratio)
    return rows.filter((F.col("x") != F.col("y")) & enough & (high - low >= least) & far).select("a", "b", *by, "dim")


def forced_splits(found: DataFrame, dims: int = DIMS, by: tuple[str, ...] = ()) -> DataFrame:
    return found.groupBy("a", "b", *by).agg(F.count("*").alias("n_dims")).filter(F.col("n_dims") >= dims)


def adequacy(observed: DataFrame, windows: int = WINDOWS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row: n_units, window (tokens of each window) and whether the units suffice."""
    rows = observed.agg(F.count("*").alias("n_units"), F.coalesce(F.min(F.floor(F.col("tokens") / windows)), F.lit(0)).alias("window"), F.coalesce(F.bool_and((F.col("tokens") >= least_tokens) & (F.col("sentences") >= LEAST_SENTENCES)), F.lit(False)).alias("ok"))
    return rows.select("n_units", "window", ((F.col("n_units") >= 2) & F.col("ok") & (F.col("window") >= LEAST_WINDOW)).alias("adequate"))


def windows(units: DataFrame, size: int, n: int = WINDOWS, token: str = L.WORD) -> DataFrame:
    """(unit_id, k, text): ``n`` consecutive windows of ``size`` tokens of each unit, from a token's start to
    the start of the token after the window, or to the end of the text where there is none."""
    kind = units.schema["unit_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(token)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = [m.start() for m in found.finditer(text or "")]
                for k in range(n):
                    if k * size < len(starts):
                        last = starts[(k + 1) * size] if (k + 1) * size < len(starts) else len(text)
                        for column, value in zip(rows, (unit, k, text[starts[k * size] : last])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string())], names=["unit_id", "k", "text"])

    return units.select("unit_id", "text").mapInArrow(run, f"unit_id {kind}, k int, text string")


def unit_pairs(units: DataFrame, blocks: int = PAIR_BLOCKS) -> DataFrame:
    """(a, b) for every two units, a < b: units are dealt to blocks, and each pair of blocks is one key of an equi-join."""
    ids = units.select("unit_id").distinct().withColumn("_block", F.pmod(F.xxhash64("unit_id"), F.lit(blocks)).cast("int"))
    left = ids.select(F.col("unit_id").alias("x"), F.col("_block").alias("_p"), F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1))).alias("_q"))
    right = ids.select(F.col("unit_id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_p"), F.col("_block").alias("_q"))
    met = left.join(right, ["_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pair_stability(units: DataFrame, full_splits: DataFrame, window_splits: DataFrame, n: int = WINDOWS) -> DataFrame:
    """(a, b, split, agreement): the share of windows that agree with the decision on whole units."""
    every = unit_pairs(units)
    rows = every.join(full_splits.select("a", "b", F.lit(True).alias("split")), ["a", "b"], "left").fillna(False, ["split"])
    votes = window_splits.groupBy("a", "b").agg(F.count("*").alias("votes"))
    rows = rows.join(votes, ["a", "b"], "left").fillna(0, ["votes"])
    return rows.select("a", "b", "split", (F.when(F.col("split"), F.col("votes")).otherwise(n - F.col("votes")) / F.lit(float(n))).alias("agreement"))


def agglomerate(ids: list[str], distance: dict[tuple[str, str], float], forced: set[tuple[str, str]]) -> list[list[str]]:
    """Average-link merging of the nearest groups, ties by group order, never across a forced pair.

    Sums of distances between groups are kept and added when two merge, so a merge costs one pass over them.
    """
    groups = {i: [u] for i, u in enumerate(ids)}
    total, barred = {}, set()
    for i, a in enumerate(ids):
        for j in range(i + 1, len(ids)):
            pair = tuple(sorted((a, ids[j])))
            total[i, j] = distance[pair]
            if pair in forced:
                barred.add((i, j))
    order, fresh = list(range(len(ids))), len(ids)
    while True:
        best = None
        for x, i in enumerate(order):
            for y in range(x + 1, len(order)):
                key = (i, order[y])
                if key not in barred and (best is None or (total[key] / (len(groups[i]) * len(groups[order[y]]))) < best[0]):
                    best = (total[key] / (len(groups[i]) * len(groups[order[y]])), i, order[y])
        if best is None:
            return [sorted(groups[i]) for i in order]
        _, i, j = best
        order = [g for g in order if g not in (i, j)]
        for g in order:
            a, b = tuple(sorted((g, i))), tuple(sorted((g, j)))
            total[g, fresh] = total[a] + total[b]
            if a in barred or b in barred:
                barred.add((g, fresh))
        groups[fresh] = groups[i] + groups[j]
        order.append(fresh)
        fresh += 1


def families(spark: SparkSession, units: DataFrame, distances: DataFrame, forced: DataFrame) -> DataFrame:
    """(family_id, unit_id): R1, R2, ... by smallest member. Sequential by nature; at most ``MOST_UNITS`` units."""
    ids = [r[0] for r in units.select("unit_id").distinct().orderBy("unit_id").limit(MOST_UNITS + 1).collect()]
    if len(ids) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units: pool them first")
    found = agglomerate(ids, {(r["a"], r["b"]): r["distance"] for r in distances.collect()}, {(r["a"], r["b"]) for r in forced.collect()})
    rows = [(f"R{k}", u) for k, members in enumerate(sorted(found), 1) for u in members]
    return spark.createDataFrame(rows, "family_id string, unit_id string")


def family_agreement(full: DataFrame, by_window: list[DataFrame]) -> float:
    """The least share, over windows, of pairs that are together or apart as on whole units."""
    base = {r["unit_id"]: r["family_id"] for r in full.collect()}
    ids = sorted(base)
    shares = []
    for window in by_window:
        other = {r["unit_id"]: r["family_id"] for r in window.collect()}
        votes = [(base[a] == base[b]) == (other[a] == other[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]]
        shares.append(sum(votes) / len(votes) if votes else 1.0)
    return min(shares, default=0.0)


def centroids(features: DataFrame, members: DataFrame) -> DataFrame:
    """(family_id, dim, mean), means rounded to 6 digits."""
    return features.join(members, "unit_id").groupBy("family_id", "dim").agg(F.round(F.avg(F.round("value", 6)), 6).alias("mean"))


def spearman(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by], p, q, rho) of every two dimensions over units, average ranks for ties; 0 without variance."""
    order = Window.partitionBy("dim", *by).orderBy("value")
    ties = Window.partitionBy("dim", "value", *by)
    ranked = features.withColumn("r", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)
    left = ranked.select("unit_id", *by, F.col("dim").alias("p"), F.col("r").alias("x"))
    right = ranked.select("unit_id", *by, F.col("dim").alias("q"), F.col("r").alias("y"))
    both = left.join(right, ["unit_id", *by]).filter("p <> q")
    sums = both.groupBy(*by, "p", "q").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return sums.select(*by, "p", "q", F.coalesce(F.try_divide("c", F.col("sx") * F.col("sy")), F.lit(0.0)).alias("rho"))


def gradients(features: DataFrame, members: DataFrame) -> DataFrame:
    """(family_id, axis, place, unit_id): of families of three or more, the dimension that most others follow."""
    rows = features.join(members, "unit_id")
    rho = spearman(rows, ("family_id",))
    strong = rho.groupBy("family_id", F.col("p").alias("dim")).agg(F.count_if(F.abs("rho") >= STRONG - 1e-12).alias("n"))
    sizes = members.groupBy("family_id").agg(F.count("*").alias("size")).filter("size >= 3")
    axis = strong.join(sizes, "family_id").groupBy("family_id").agg(F.max(F.struct("n", "dim")).alias("best")).filter(F.col("best.n") >= LEAST_CONSISTENT)
    order = Window.partitionBy("family_id").orderBy(F.round("value", 6), "unit_id")
    picked = rows.join(axis.select("family_id", F.col("best.dim").alias("dim")), ["family_id", "dim"])
    return picked.select("family_id", F.col("dim").alias("axis"), F.row_number().over(order).alias("place"), "unit_id")


def gaps(centres: DataFrame) -> DataFrame:
    """(dim, low, high, max_ratio, place): 1 if all means are 0, null if one is; nulls first, then largest first."""
    rows = centres.groupBy("dim").agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    rows = rows.withColumn("max_ratio", F.when(F.col("high") == 0, 1.0).otherwise(F.try_divide("high", "low")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("max_ratio").desc_nulls_first(), "dim")  # 13 rows
    return rows.withColumn("place", F.row_number().over(order))


def verdicts(n_families: Column, adequate: Column, stable: Column) -> Column:
    """The verdict of :func:`verdict` for a table of corpora; what is not known is not enough."""
    enough = F.coalesce(adequate & stable, F.lit(False))
    return F.when(~enough, "INSUFFICIENT_EVIDENCE").when(n_families > 1, "MULTI_REGISTER").otherwise("SINGLE_REGISTER")


def verdict(n_families: int, adequate: bool, stable: bool) -> str:
    if not adequate or not stable:
        return "INSUFFICIENT_EVIDENCE"
    return "MULTI_REGISTER" if n_families > 1 else "SINGLE_REGISTER"


def discover(spark: SparkSession, units: DataFrame) -> dict:
    """Whole discovery over English units (unit_id, text), with defaults; the answer is small and comes as a dict."""
    units = units.cache()
    try:
        observed = observations(units)
        enough = adequacy(observed).first()
        full = features_en(units)
        splits = forced_splits(supported(full, observed.select("unit_id", "tokens")))
        members = families(spark, units, z_distances(z_scores(full)), splits)
        rows, agreement = [], 0.0
        if enough["adequate"]:
            cut = windows(units, enough["window"])
            per = features_en(cut, extra=("k",)).cache()
            parts = forced_splits(supported(per, cut.select("unit_id", "k", F.lit(enough["window"]).alias("tokens")), by=("k",)), by=("k",)).cache()
            rows = pair_stability(units, splits, parts).collect()
            again = [families(spark, units, z_distances(z_scores(per.filter(F.col("k") == k).drop("k"), 15)), parts.filter(F.col("k") == k)) for k in range(WINDOWS)]
            agreement = family_agreement(members, again)
            per.unpersist()
            parts.unpersist()
        stable = bool(enough["adequate"]) and all(r["agreement"] >= STABILITY for r in rows) and agreement >= STABILITY
        found = {r["unit_id"]: r["family_id"] for r in members.collect()}
        said = verdict(len(set(found.values())), enough["adequate"], stable)
        return {"verdict": said, "families": {} if said == "INSUFFICIENT_EVIDENCE" else found, "adequate": enough["adequate"], "stable": stable, "splits": splits.count(), "family_agreement": agreement, "pairs": [r.asDict() for r in rows]}
    finally:
        units.unpersist()


def family_mapping(units: DataFrame, members: DataFrame) -> DataFrame:
    """(source, families): families of each unit and of the clusters in it (unit_id, clusters); more than one is a conflict."""
    sources = units.select("unit_id", F.explode(F.concat(F.array("unit_id"), F.coalesce("clusters", F.expr("cast(array() as array<string>)")))).alias("source"))
    return sources.join(members, "unit_id").groupBy("source").agg(F.array_sort(F.collect_set("family_id")).alias("families"))


NOISE = r"\[[^\]]{0,80}\]|\*+|#+|<!--.*?-->|\(#\)|_+"
CAPITALISED = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]{2,})\b"


def denoise(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, NOISE, ""), T.unicode(r"\s+"), " ")


def mask_names(text: Column) -> Column:
    return F.regexp_replace(text, T.unicode(CAPITALISED), "◼")


def blind_sample(clusters: DataFrame, per_cluster: int = 2, length: int = 120, seed: int = 42, mask: bool = False) -> DataFrame:
    """(passage_id, cluster_id, start, passage): windows of words at hashed offsets, in hashed order.

    Offsets lie between lo = min(n // 10, 500, n - length) and hi = max(lo + 1, n - length + 1), hi exclusive.
    """
    rows = clusters.select("cluster_id", F.filter(F.split("text", T.unicode(r"\s+"), -1), lambda w: w != "").alias("_w")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_lo", F.least(F.floor(F.col("_n") / 10), F.lit(500), F.greatest(F.lit(0), F.col("_n") - length))).withColumn("_hi", F.greatest(F.col("_lo") + 1, F.col("_n") - length + 1))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_cluster))))
    start = F.col("_lo") + F.pmod(F.xxhash64(F.lit(seed), "cluster_id", "_k"), F.col("_hi") - F.col("_lo"))
    rows = rows.withColumn("start", start.cast("int")).withColumn("passage", F.array_join(F.slice("_w", F.col("start") + 1, length), " "))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed + 1), "cluster_id", "_k"))
    rows = scan(rows.select("cluster_id", "_k", "_hash", "start", "passage"), ["_hash", "cluster_id", "_k"])
    return rows.select(F.col("rank").alias("passage_id"), "cluster_id", "start", (mask_names(F.col("passage")) if mask else F.col("passage")).alias("passage"))


def discrimination(key: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: n, hits, accuracy, band; identifiers must match exactly, or accuracy is null and band says so."""
    both = key.select("passage_id", F.col("family_id").alias("actual")).join(answers.select("passage_id", F.col("family_id").alias("guess")), "passage_id", "full")
    rows = both.agg(F.count("*").alias("n"), F.count_if(F.col("actual") == F.col("guess")).alias("hits"), F.count_if(F.col("actual").isNull() | F.col("guess").isNull()).alias("odd"))
    score = F.when(F.col("odd") == 0, F.try_divide(F.col("hits").cast("double"), F.col("n")))
    rows = rows.withColumn("accuracy", score)
    band = F.when(F.col("accuracy").isNull(), "mismatched").when(F.col("accuracy") >= 0.9, "strong").when(F.col("accuracy") >= 0.7, "adequate").otherwise("weak")
    return rows.select("n", "hits", "accuracy", band.alias("band"))


def confusions(key: DataFrame, answers: DataFrame) -> DataFrame:
    """(actual, predicted, n) of wrong answers."""
    both = key.select("passage_id", F.col("family_id").alias("actual")).join(answers.select("passage_id", F.col("family_id").alias("predicted")), "passage_id")
    return both.filter("actual <> predicted").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def divergence(sample: DataFrame, baseline: DataFrame) -> DataFrame:
    """(unit_id, dim, delta) of measured features against a held-out baseline."""
    return sample.join(baseline.select("unit_id", "dim", F.col("value").alias("base")), ["unit_id", "dim"]).select("unit_id", "dim", (F.col("value") - F.col("base")).alias("delta"))


