import random
import re
from collections import Counter, defaultdict

import pytest
from loomtext.operators import scan as S
from loomtext.operators import segmentation, style, works
from pyspark.sql import functions as F


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_scan_equals_a_plain_pass(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(-5, 5), rng.choice([None, None, i])) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "g string, i long, v long, e long")
    want, seen = {}, defaultdict(lambda: [0, 0, None])
    for g, i, v, e in sorted(rows, key=lambda r: -r[1]):
        n, total, last = seen[g]
        want[i] = (n + 1, total, last)
        seen[g] = [n + 1, total + v, last if e is None else e]
    out = S.scan(df, [F.desc("i")], ["g"], sums=["v"], earlier=["e"], ranges=ranges)
    assert {r.i: (r["rank"], r.before_v, r.prev_e) for r in out.collect()} == want
    whole = S.scan(df.select("i"), ["i"], ranges=ranges).collect()
    assert {r.i: r["rank"] for r in whole} == {i: k for k, i in enumerate(sorted(r[1] for r in rows), 1)}
    assert S.scan(df.limit(0), ["i"], ["g"], sums=["v"]).count() == 0


def test_works_equal_the_same_measures_of_the_joined_text(spark):
    rng = random.Random(8)
    parts = ["Mr.", "etc.", "word", "Time", "people say.", "Yes!", "no?", "\n\n", "\n", "(A)", '"Q."', "perhaps", "--", "I", "vs.", "", " ", "x" * 3]
    docs = [(f"w{i % 3}", i, " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 40, 700])))) for i in range(60)] + [("w0", 99, None), ("w3", 100, " \n "), ("w4", 101, "one")]
    df = spark.createDataFrame(docs, "work string, i long, text string").repartition(6)
    joined = spark.createDataFrame([(w, "\n\n".join(t for v, _, t in docs if v == w and t is not None)) for w in ("w0", "w1", "w2", "w4")], "doc_id string, text string")
    scanned = works.english(df, "work", ["i"])
    got = {r.work: r for r in works.measures_en(scanned, "work", ["i"]).collect()}
    assert set(got) == {"w0", "w1", "w2", "w4"}
    for r in style.measured(joined).collect():
        g = got[r.doc_id]
        assert g.words == r.n_words and abs(g.mean_segment_ttr_500 - r.mean_segment_ttr_500) < 1e-12
        for c in ("hedges_per_1k", "em_dash_per_1k", "question_per_1k", "first_person_pct"):
            assert abs(g[c] - r[c]) < 1e-9
    for parts_of, prefix in (("merged_sentences", "sentence"), ("paragraphs", "paragraph")):
        for r in style.lengths(joined, parts_of).collect():
            for c in ("n", "mean", "median", "stdev", "p10", "p90", "low", "high"):
                assert abs(got[r.doc_id][f"{prefix}_{c}"] - r[c]) < 1e-9, (r.doc_id, c)
    content = style.content_words(joined)
    for mine, theirs, key in ((works.top_words, style.top_words, "word"), (works.top_bigrams, style.top_bigrams, "bigram")):
        want = {(r.doc_id, r[key], r.hits, r.place) for r in theirs(content).collect()}
        assert {(r.work, r[key], r.hits, r.place) for r in mine(scanned, "work", ["i"]).collect()} == want


def test_bounds_of_many_overlapping_clusters_in_one_file(spark):
    rng = random.Random(9)
    text = "\n".join(rng.choice(["the a", "and b", "c", "Head", "the and"]) for _ in range(6000))
    lines = text.split("\n")
    spec = [(f"c{i}", 1, rng.choice([None, "^the", "nothing"]), rng.choice([None, "and", "Head"]), s if (s := rng.choice([None, rng.randint(1, 6000)])) else None, rng.choice([None, None, rng.randint(1, 9000)])) for i in range(400)]
    spec.append(("gone", 2, None, None, None, None))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = spark.createDataFrame(spec, "id string, doc_id long, start string, end string, start_line int, end_line int")
    all_lines = segmentation.lines(docs)
    bounds = segmentation.resolve_bounds(all_lines, rows)
    hit = lambda p, at: next((k for k in range(at, len(lines)) if re.search(p, lines[k])), None)
    want, held = {}, Counter()
    for i, d, start, end, start_line, end_line in spec:
        first = start_line - 1 if start_line else hit(start, 0) if start and d == 1 else None if start else 0
        last = end_line if end_line else (hit(end, first + 1) if first is not None else None) if end else len(lines) if d == 1 else None
        problem = "missing file" if d == 2 else "start marker not found" if first is None else "end marker not found after start" if last is None else "end is not after start" if last <= first else None
        want[i] = (first, last, problem)
        if not problem:
            held[i] = sum(not x.startswith("Head") for x in lines[first:last])
    assert {r.id: (r["first"], r["last"], r.problem) for r in bounds.collect()} == want
    got = segmentation.cut(all_lines, bounds, headers=("Head",)).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {k: v for k, v in held.items() if v}


def test_a_file_with_a_hundred_thousand_clusters(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "\n".join(["begin", "x"] * n))], "doc_id long, text string")
    spec = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.lit(1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("start"), F.lit("begin").alias("end"), (2 * F.col("id") + 1).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    all_lines = segmentation.lines(docs)
    bounds = segmentation.resolve_bounds(all_lines, spec)
    out = segmentation.cut(all_lines, bounds).groupBy("id").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert tuple(out) == (n - 1, 2, 2)
    assert bounds.filter("problem IS NOT NULL").count() == 1


def test_every_two_units_are_a_pair_once(spark):
    from loomtext.operators import registers

    units = spark.createDataFrame([(f"u{i}",) for i in range(70)] + [("u3",)], "unit_id string")
    got = [(r.a, r.b) for r in registers.unit_pairs(units).collect()]
    names = sorted(f"u{i}" for i in range(70))
    assert sorted(got) == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :])
    assert "NestedLoop" not in registers.unit_pairs(units)._jdf.queryExecution().executedPlan().toString()
