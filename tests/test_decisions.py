import itertools
import random

import pytest
from loomtext.operators import admission, judging, ledger, registers
from loomtext.streaming import ledger as stream

NEUTRAL, MARKED = "The account describes causes and outcomes in a careful sequence. ", "Perhaps you must check this result and explain it? "


@pytest.mark.parametrize("first, second, verdict", [
    (NEUTRAL * 100, NEUTRAL * 100 + "Perhaps you must check?", "SINGLE_REGISTER"),
    (NEUTRAL * 150, MARKED * 150, "MULTI_REGISTER"),
    (NEUTRAL, MARKED, "INSUFFICIENT_EVIDENCE"),
    (NEUTRAL * 150, MARKED * 50 + NEUTRAL * 100, "INSUFFICIENT_EVIDENCE"),
])
def test_register_discovery(spark, first, second, verdict):
    found = registers.discover(spark, spark.createDataFrame([("u0", first), ("u1", second)], "unit_id string, text string"))
    assert found["verdict"] == verdict
    assert found["splits"] == 0 or verdict != "SINGLE_REGISTER"


def test_agglomeration_equals_recomputing_every_mean():
    rng = random.Random(1)
    for _ in range(20):
        ids = [f"u{k}" for k in range(8)]
        dist = {p: rng.random() for p in itertools.combinations(ids, 2)}
        forced = {p for p in dist if rng.random() < 0.2}
        groups = [{u} for u in ids]
        while True:
            options = []
            for a, b in itertools.combinations(range(len(groups)), 2):
                pairs = [tuple(sorted((x, y))) for x in groups[a] for y in groups[b]]
                if not any(p in forced for p in pairs):
                    options.append((sum(dist[p] for p in pairs) / len(pairs), a, b))
            if not options:
                break
            _, a, b = min(options)
            groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] | groups[b]]
        assert sorted(map(sorted, groups)) == sorted(registers.agglomerate(ids, dist, forced))


def test_windows_have_equal_tokens(spark):
    units = spark.createDataFrame([("a", "one two three, four five six. seven"), ("b", "x y")], "unit_id string, text string")
    got = {(r.unit_id, r.k): r.text for r in registers.windows(units, 2).collect()}
    assert got == {("a", 0): "one two ", ("a", 1): "three, four ", ("a", 2): "five six. ", ("b", 0): "x y"}


def test_names_are_masked_within_sentences_only(spark):
    rows = spark.createDataFrame([("Anna met Boris. Clara saw Dora",)], "t string")
    assert rows.select(registers.mask_names(rows.t)).first()[0] == "Anna met ◼. Clara saw ◼"


def test_split_ignores_order_and_keeps_groups(spark):
    rows = [(f"p{i}", f"work{i // 3}", "ethics") for i in range(30)]
    both = [admission.grouped_split(spark.createDataFrame(r, "id string, group string, domain string"), "domain").collect() for r in (rows, rows[::-1])]
    assert sorted(both[0]) == sorted(both[1]) and len(both[0]) == 10
    assert sorted([r.partition for r in both[0]].count(p) for p in ("train", "development", "test")) == [2, 2, 6]


def element(spark, rows):
    texts = sorted({f for fs in admission.REQUIRED.values() for f in fs if f != "steps"})
    schema = "id string, class string, clusters array<string>, locators array<string>, flags array<string>, conflicts_with array<string>, domains array<string>, steps array<string>, " + ", ".join(f"{t} string" for t in texts)
    schema += ", metrics struct<transfer double, reasoning double, pressure double, discrimination double, transfer_cases long, pressure_cases long, corpus_hits long, observations long>"
    base = {"clusters": ["c01", "c02"], "locators": ["a", "b"], "flags": [], "conflicts_with": [], "domains": [], "steps": ["s"]} | {t: "text" for t in texts}
    return spark.createDataFrame([base | r for r in rows], schema)


def procedure(i, **more):
    return {"id": i, "class": "procedure", "metrics": {"transfer": 0.9, "reasoning": 0.8, "transfer_cases": 5} | more.pop("metrics", {})} | more


def test_admission_rules(spark):
    variation = lambda i, d: {"id": i, "class": "variation", "metrics": {"discrimination": d, "observations": 50}}
    verdict = lambda i, period: {"id": i, "class": "verdict", "period": period, "metrics": {"corpus_hits": 4}}
    rows = [procedure("a"), procedure("b", metrics={"transfer": 0.4}), verdict("c", "1843"), verdict("d", ""), variation("e", 0.4), variation("f", 0.8), procedure("g", conflicts_with=["h"]), procedure("h"), procedure("i", metrics={"transfer": 1.5})]
    got = {r.id: r for r in admission.decide(element(spark, rows)).collect()}
    assert {i: r.decision for i, r in got.items()} == {"a": "retain", "b": "cut", "c": "retain", "d": "cut", "e": "cut", "f": "retain", "g": "pending", "h": "pending", "i": "cut"}
    assert got["a"].score == pytest.approx(0.87) and got["i"].error == "invalid: transfer" and (got["a"].rank, got["c"].rank, got["f"].rank) == (1, 2, 3)


def test_core_budget_of_the_worked_example(spark):
    columns = [*admission.CORE, "firsthand_ratio", "total_tokens", "n_clusters"]
    rows = [(3, 5, 2, 4, 3, 2, 0.9, 180_000, 11), (3, 5, 2, 4, 3, 2, 0.9, 30_000, 11), (99, 99, 99, 99, 99, 99, 0.9, 900_000, 20)]
    got = admission.core_budget(spark.createDataFrame(rows, columns)).collect()
    assert [(r.supply, r.core_budget) for r in got] == [(5510, 5510), (5510, 4000), (8340, 7500)]


def scored(spark, change=lambda j, c, d, s: s, ties=(), issues=(0, 0)):
    base = dict(zip(judging.DIMENSIONS, (4, 3, 3, 3, 3)))
    rows = [("r", j, c, slot, d, change(j, c, d, s)) for j in (1, 2) for c in (1, 2, 3) for slot in "AB" for d, s in base.items()]
    wins = [("r", j, c, "tie" if (j, c) in ties else "AB"[j - 1]) for j in (1, 2) for c in (1, 2, 3)]
    frame = spark.createDataFrame
    judged = judging.recognition(frame(rows, "run string, judge int, case_id int, slot string, dim string, score int"), frame(wins, "run string, judge int, case_id int, effective string"), frame([("r", 1, issues[0]), ("r", 2, issues[1])], "run string, judge int, n_issues int"))
    return judging.outcome(judged).first().outcome, {r.judge: r.score for r in judged.collect()}


@pytest.mark.parametrize("kwargs, outcome", [
    ({}, "passed"),
    ({"change": lambda j, c, d, s: 1 if d == "specificity" else 4}, "failed"),
    ({"change": lambda j, c, d, s: 1 if d == "interaction" else 4}, "failed"),
    ({"change": lambda j, c, d, s: {"reasoning": 2}.get(d, 3) if c == 1 else 4}, "failed"),
    ({"ties": {(1, 1), (1, 2)}}, "inconclusive"),
    ({"ties": {(1, 1), (1, 2), (2, 1), (2, 2)}}, "failed"),
    ({"change": lambda j, c, d, s: None if (j, c, d) == (1, 1, "reasoning") else s}, "inconclusive"),
    ({"issues": (1, 0)}, "inconclusive"),
])
def test_recognition(spark, kwargs, outcome):
    said, scores = scored(spark, **kwargs)
    assert said == outcome
    if not kwargs:
        assert scores == {1: 80.0, 2: 80.0}


def events(*rows):
    base = {"kind": "reserve", "item": "i", "role": "judge", "fingerprint": "f", "candidate": "c", "retry": False, "result": "completed", "amount": None}
    return [base | {"workflow": 1, "seq": k} | r for k, r in enumerate(rows)]


SCHEMA = "workflow long, seq long, kind string, item string, role string, fingerprint string, candidate string, retry boolean, result string, amount long"


@pytest.mark.parametrize("rows, decisions", [
    ([{}, {}], ["reserved", "reuse"]),
    ([{"item": f"i{k}", "role": "candidate", "candidate": "c"} for k in range(9)], ["reserved"] * 8 + ["stopped"]),
    ([{"item": f"i{k}", "role": "candidate", "candidate": f"c{k}"} for k in range(4)] + [{"item": "x", "role": "baseline"}, {"item": "x", "role": "neighbor"}], ["reserved"] * 3 + ["candidate limit"] + ["role not dispatched"] * 2),
    ([{"result": None}, {}, {"retry": True, "result": "failed"}], ["reserved", "needs retry", "reserved"]),
    ([{"kind": "stop"}, {}, {"kind": "authorize", "amount": 1}, {}], ["stop", "stopped", "authorize", "reserved"]),
    ([{}, {"fingerprint": "g"}, {"kind": "repair"}, {"fingerprint": "g"}, {"kind": "repair"}], ["reserved", "needs repair pass", "repair", "reserved", "repair refused"]),
    ([{"item": "a"}, {"item": "b"}, {"item": "c"}], ["reserved", "reserved", "judge limit"]),
])
def test_replay(spark, rows, decisions):
    got = ledger.replay(spark.createDataFrame(events(*rows), SCHEMA)).orderBy("seq").collect()
    assert [r.decision for r in got] == decisions and got[-1].used == decisions.count("reserved")


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"workflow": rng.randrange(3), "seq": k, "kind": rng.choice(["reserve"] * 9 + ["repair"]), "item": f"i{rng.randrange(4)}", "role": rng.choice(["judge", "candidate"]), "fingerprint": rng.choice("ab"), "candidate": rng.choice("xyzw"), "retry": rng.random() < 0.3, "result": rng.choice(["completed", "failed"]), "amount": None} for k in range(60)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        whole.filter(f"seq >= {part * 20} AND seq < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.decide_stream(source).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("decided").collect())) == sorted(map(tuple, ledger.replay(whole).collect()))


def test_digest_is_canonical():
    assert ledger.digest({"b": 1, "a": "é"}) == ledger.digest({"a": "é", "b": 1})
    with pytest.raises(ValueError):
        ledger.encoded(float("nan"))


def test_chinese_features_equal_plain_counting(spark):
    import re
    import statistics

    from loomtext.functions import lexicons as L
    from loomtext.plans.style import CHINESE

    got = {(r.unit_id, r.dim): r.value for r in registers.features_zh(spark.createDataFrame([(str(i), t) for i, t in CHINESE], "unit_id string, text string"), ("北京",), ("大学",)).collect()}
    for i, text in CHINESE:
        n = len(re.findall(L.HAN, text))
        lengths = sorted(x for x in (len(re.findall(L.HAN, s)) for s in re.split(L.SENTENCE_END_ZH, text)) if x)
        rate = lambda words: 10000 * sum(text.count(w) for w in words) / n if n else 0.0
        want = {"mean_sentence_len": statistics.mean(lengths) if lengths else 0, "median_sentence_len": statistics.median(lengths) if lengths else 0, "p90_sentence_len": lengths[min(len(lengths) - 1, int(0.9 * len(lengths)))] if lengths else 0,
                "long_sentence_share": sum(x > 40 for x in lengths) / len(lengths) if lengths else 0, "hedge_rate": rate(L.HEDGES_ZH), "booster_rate": rate(L.BOOSTERS_ZH), "connective_rate": rate(L.SCAFFOLDING_ZH), "first_person_rate": rate(L.FIRST_ZH), "second_person_rate": rate(L.SECOND_ZH),
                "question_rate": rate("？?"), "title_mark_rate": rate("《"), "core_term_density": rate(["北京"]), "flagship_term_density": rate(["大学"])}
        assert {d: got[str(i), d] for d in want} == pytest.approx(want) and len(want) == 13


def test_blind_sample_offsets(spark):
    rows = [("a", " ".join(f"w{k}" for k in range(1000))), ("b", "only three words"), ("c", "")]
    got = registers.blind_sample(spark.createDataFrame(rows, "cluster_id string, text string"), per_cluster=3, length=50).collect()
    assert sorted(r.passage_id for r in got) == list(range(1, 10))
    for r in got:
        n = {"a": 1000, "b": 3, "c": 0}[r.cluster_id]
        lo = min(n // 10, 500, max(0, n - 50))
        assert lo <= r.start < max(lo + 1, n - 50 + 1) and r.passage.split() == dict(rows)[r.cluster_id].split()[r.start : r.start + 50]
