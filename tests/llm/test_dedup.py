import hashlib
import random
from collections import Counter, defaultdict

import pytest
from loomtext.llm import common, exactdedup, neardup
from pyspark.sql import functions as F


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    return sorted((i, max(v), len(v), i == max(v), hashlib.sha256(k).hexdigest()) for k, v in groups.items() for i in v)


def test_exact_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Same", "sAME", "É", "é", "", None, f"own {i}", "x" * 50_000])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exactdedup.annotate(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == exact_brute(rows)
    assert exactdedup.deduplicate(docs).count() == len({(t or "").encode().lower() for _, t in rows})


def test_exact_smallest_null_ids_repeats_and_clashing_columns(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (2, "A", "k"), (None, "a", "k"), (None, "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = exactdedup.annotate(docs, keep="min").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == Counter({(1, 1, 4, True): 2, (2, 1, 4, False): 1, (None, 1, 4, False): 1, (None, None, 1, True): 1})
    left = exactdedup.deduplicate(docs, keep="min").collect()
    assert sorted((r.doc_id is None, r.text) for r in left) == [(False, "a"), (True, "b")] and left[0].digest == "k"
    assert exactdedup.annotate(docs.limit(0)).count() == 0 and exactdedup.deduplicate(docs.limit(0)).count() == 0


def test_a_round_merges_sorted_runs_and_verifies_them(spark):
    columns = "node int, lane int, digest string, keep_id long, group_size long, check string"
    entries = [(k % 4 // 2, 0, f"d{k % 3}", k, 1, f"c{k % 3}") for k in range(60)]
    out = exactdedup.merge(spark.createDataFrame(entries, columns)).collect()
    want = {(node, d): (max(k for n, _, e, k, _, _ in entries if (n, e) == (node, d)), 10) for node in (0, 1) for d in ("d0", "d1", "d2")}
    assert {(r.node, r.digest): (r.keep_id, r.group_size) for r in out} == want and len(out) == 6
    for node in (0, 1):
        assert [r.digest for r in out if r.node == node] == ["d0", "d1", "d2"]
    with pytest.raises(Exception, match="differ"):
        exactdedup.merge(spark.createDataFrame([*entries, (0, 0, "d1", 3, 1, "other")], columns)).collect()


def test_runs_are_the_input_s_partitions_and_any_radix_gives_the_same(spark):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    work = common.Workspace(spark, "test")
    for radix in (2, 3, 8):
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.annotate(docs, radix=radix).collect()) == exact_brute(rows)
    found = docs.select(F.col("doc_id").alias("_id"), exactdedup.digest(F.col("text")).alias("digest"), exactdedup.check(F.col("text")).alias("check"), F.spark_partition_id().alias("run"))
    found = work.write(found, "rows")
    first, last = exactdedup.tree(found, 11, "min", 2, work)
    runs = {r.run for r in found.select("run").distinct().collect()}
    assert {r.node for r in first.collect()} == runs and len(runs) > 5
    assert first.count() == found.select("run", "digest").distinct().count()
    assert {r.digest: r.keep_id for r in last.collect()} == {r.digest: r.best for r in found.groupBy("digest").agg(F.min("_id").alias("best")).collect()}
    assert {r.node for r in last.collect()} == {0}


def near_brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    parent, where = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        seen = Counter(j for x in s for j in where[x])
        for j, k in seen.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups_equal_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)  # several blocks a leader
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(common, "HOT_ROWS", 20)  # several parts of a leader, a star's centre and a component
    rng, rows = random.Random(4), []
    shared = " ".join(f"p{k}" for k in range(60))
    for g in range(12):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 300]))]
        rows += [edited(rng, base, rng.choice([0, 1, 2, 3, 6, 12])) for _ in range(rng.choice([2, 9, 90]))]
    rows += [shared + " " + " ".join(f"q{rng.random()}" for _ in range(30)) for _ in range(150)]
    rows += ["", None, " \t\n", "two words", "two words", "Two WORDS", "one"]
    rng.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.group(docs, words=words).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_brute(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (5, "a b c d e", 1), (5, "a b c d e", 1), (2, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.group(docs).collect())
    assert out == Counter({(None, 1, None, True): 1, (5, 1, 5, True): 2, (2, 0, 2, True): 1})
    assert neardup.group(docs.limit(0)).count() == 0


def test_near_a_leader_outside_a_large_group_and_very_long_texts(spark, monkeypatch):
    """The smallest id shares keys with a group whose members are alike, but is not alike enough itself."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base[:290] + [f"own{k}" for k in range(60)]))]
    rows += [(k, " ".join(base + [f"m{k}"])) for k in range(1, 90)]
    rows += [(200 + k, " ".join(base[:300] + [f"far{k}_{j}" for j in range(40)])) for k in range(40)]
    long = [f"l{rng.randrange(50_000)}" for _ in range(100_000)]
    rows += [(1000, " ".join(long)), (1001, edited(rng, long, 1000)), (1002, edited(rng, long, 40_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.group(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_brute(rows, 5)


def test_near_rows_of_one_identifier_with_different_texts_are_one_vertex(spark):
    one, two = ([f"{x}{k}" for k in range(100)] for x in "ab")
    rows = [(7, " ".join(one)), (7, " ".join(two)), (9, " ".join(one[:99])), (3, " ".join(two[:99])), (4, " ".join(two)), (8, "else")]
    out = neardup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(7, 3), (9, 3), (3, 3), (4, 3), (8, 8)}


def test_linked_components_come_back_as_a_forest():
    import numpy as np

    alike = [(k, 100, np.array([k]), np.array([1000 + k])) for k in range(40)]
    apart = [(50, 100, np.arange(60), np.empty(0, np.int64))]
    assert sorted(zip(*neardup._forest(alike + apart, 80))) == [(k, 0) for k in range(1, 40)]


def test_hot_keys_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)], "key long, v long")
    right = spark.createDataFrame([(k, str(k)) for k in range(6)], "key long, w string")
    hot = common.Hot(left.groupBy("key").count().withColumnRenamed("count", "n"), ["key"])
    parts = hot.deal(left, ["v"]).filter("key = 0").groupBy("_part").count().collect()
    assert len(parts) == 12 and max(r["count"] for r in parts) < 30
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "key", how).collect()))
        assert sorted(map(str, hot.join(left, right, ["v"], how).select("key", "v", "w").collect())) == want


def test_the_sessions_settings_return(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    neardup.group(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert spark.conf.get(key) == before


def test_chunk_keys_tolerate_one_error_per_chunk():
    import numpy as np

    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (1, neardup.VALUES)).astype("<u2")
    far = sig.copy()
    for c in range(neardup.CHUNKS):  # as many errors as the guarantee allows: two in all chunks but one
        far[0, c * neardup.CHUNK] ^= 1
        if c:
            far[0, c * neardup.CHUNK + 1] ^= 1
    assert set(neardup.chunk_keys(sig)[0]) & set(neardup.chunk_keys(far)[0])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "a long, b long")
    assert {(r.id, r.component) for r in neardup.components(links).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}
