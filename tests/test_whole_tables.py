"""Queries against plain Python over every row of the tables at sf0.01."""

import random
import re
from collections import defaultdict

from __spark_entry__ import queries
from loomtext.operators import admission, package

DATA = "/root/testdata/sf0.01"


def test_document_issues_list_the_imperative_lines_of_every_document(spark):
    want = set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        lines = (("Keep the token budget\nin /home/me. " if r.doc_id % 5 == 0 else "Zz ") + r.text).split("\n")
        words = [re.match(r"[A-Za-z]+\b", line.strip(" ")) for line in lines]
        if any(w and w[0].lower() in package.IMPERATIVES for w in words):
            want.add(str(r.doc_id))
    got = queries()["H6_document_issues"](spark, DATA).filter("issue = 'imperative line'").collect()
    assert sorted(r.path for r in got) == sorted(want) and any(int(i) % 5 for i in want)


def test_replacements_cover_every_call(spark):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id").orderBy("event_id").collect():
        usable = r.event_id % 7 != 0 or r.event_id % 2 == 0
        groups[str(r.user_id % 50), str(r.event_id % 40)].append((usable, r.event_id % 2 == 0))
    want = {k: (len(v), len(v) > 1, len(v) == 1 or (len(v) == 2 and not v[0][0] and v[1][1])) for k, v in groups.items()}
    got = {(r["item"], r["fingerprint"]): (r["attempts"], r["replaced"], r["allowed"]) for r in queries()["G7_replacements"](spark, DATA).collect()}
    assert got == want and sum(n for n, *_ in got.values()) == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_text_issues_name_audit_words_and_second_person_lines(spark):
    files = [
        ("a.md", "---\nname: token\ndescription: plain\ndescription: 'A Token budget, scores'\n---\ncorpus of tokens\n"),
        ("b.md", "---\nname: x\ndescription: budgets and tokens\n---\nIs it for You?\n"),
        ("c.md", "description: a corpus\nyour youth\n"),
        ("d.md", "---\nDescription: probed\n---\n给你看\n"),
        ("e.pdf", None),
    ]
    got = {(r.path, r.issue) for r in package.text_issues(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {("a.md", "banned token budget"), ("a.md", "audit word token"), ("a.md", "audit word budget"), ("b.md", "second person line"), ("d.md", "second person line"), ("d.md", "banned probe"), ("e.pdf", "raw file")}


def test_uncovered_lines_equal_plain_marking(spark):
    rng = random.Random(4)
    texts = {f"f{i}": "\n".join(rng.choice(["word", "", " "]) for _ in range(rng.randint(0, 30))) for i in range(12)}
    passages = [(f"f{rng.randint(0, 13)}", rng.randint(-3, 35), rng.randint(-3, 35)) for _ in range(30)]
    passages += [passages[0], ("f0", None, 3), ("f1", 2, None), ("f2", 5, 4_000_000_000), ("f3", -4_000_000_000, 1)]
    marked = {p: set() for p in texts}
    for path, first, last in passages:
        if path in texts and None not in (first, last):
            low, high = min(first, last), max(first, last)
            marked[path] |= {n for n in range(1, 40) if low <= n <= high}
    want = [(p, n) for p, t in texts.items() for n, line in enumerate(t.split("\n"), 1) if line.strip(" ") and n not in marked[p]]
    files = spark.createDataFrame([*texts.items(), ("none", None)], "path string, text string")
    got = package.uncovered_lines(files, spark.createDataFrame(passages, "path string, first long, last long")).collect()
    assert sorted((r.path, r.line_no) for r in got) == sorted(want) and want


def test_style_cap_takes_its_share_of_all_retained(spark):
    rows = [(f"s{i}", "stable_style", 9 - i // 2) for i in range(6)] + [(f"p{i}", "procedure", 1) for i in range(9)]
    frame = spark.createDataFrame(rows, "id string, class string, score int")
    got = [(r.id, r.place, r.in_core) for r in admission.style_cap(frame).orderBy("place").collect()]
    assert got == [(f"s{i}", i + 1, i < 3) for i in range(6)]
    assert admission.style_cap(frame.limit(0)).count() == 0


def test_reachable_follows_deep_links_and_loops(spark):
    links = [(f"d{i}.md", f"d{i + 1}.md") for i in range(12)] + [("d5.md", "d0.md"), ("x.md", "y.md"), ("d3.md", "d3.md"), (None, "z.md"), ("d0.md", None)]
    found = spark.createDataFrame(links, "path string, target string")
    got = sorted(r.path for r in package.reachable(found, ["d1.md", "d1.md"]).collect())
    assert got == sorted(f"d{i}.md" for i in range(13))
    assert package.reachable(found, []).count() == 0
    assert [r.path for r in package.reachable(found.limit(0), ["a.md"]).collect()] == ["a.md"]
