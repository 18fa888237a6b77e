import random
import re
from collections import Counter

import duckdb
import pytest
from loomtext.functions import lexicons as L
from loomtext.operators import cleaning, counted, registers, style, style_zh, works
from loomtext.plans import style as plans
from pyspark.sql import functions as F


def brute(items, k):
    first = {x: i for i, x in reversed(list(enumerate(items)))}
    return sorted(Counter(items).items(), key=lambda x: (-x[1], first[x[0]]))[:k]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_ngrams_and_bigrams_of_documents_are_counted_without_a_shuffle(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("大大学京天气我x。 ") for _ in range(n)) for n in (0, 1, 3, 40, 30_000)] + [None, "大" * 9, "鿿一" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = style_zh.ngrams(docs, (2, 3, 4))
    assert exchanges(got) == 0
    want = set()
    for i, t in enumerate(texts):
        han = "".join(c for c in t or "" if "一" <= c <= "鿿")
        for n, k in ((2, 25), (3, 25), (4, 15)):
            grams = [han[j : j + n] for j in range(len(han) - n + 1)]
            grams = [g for g in grams if not set(g) & set(L.STOP_CHARS_ZH)]
            want |= {(i, g, h, p, n) for p, (g, h) in enumerate(brute(grams, k), 1)}
    assert {(r.doc_id, r.gram, r.hits, r.place, r.n) for r in got.collect()} == want

    english = spark.createDataFrame([(i, " ".join(rng.choice(["the", "Time", "people", "of", "İt", "way's", "x-y"]) for _ in range(n))) for i, n in enumerate((0, 1, 2, 500))] + [(9, None)], "doc_id long, text string")
    for mine, theirs in ((style.document_top_words, style.top_words), (style.document_top_bigrams, style.top_bigrams)):
        assert exchanges(mine(english)) == 0
        assert sorted(mine(english).collect()) == sorted(theirs(style.content_words(english)).collect())


def test_literals_are_counted_like_replacements(spark):
    parts = ("我们", "我", "大大", "大大大", "?", "😀", "😀我", "ab", "b")
    rng = random.Random(6)
    texts = ["", "大" * 7, "😀我们😀我?", "aab" * 3] + ["".join(rng.choice("我们大?😀ab") for _ in range(200)) for _ in range(20)]
    seen = counted.Literals(parts)
    for t in texts:
        assert seen.of(t) == [len(re.findall(L.HAN, t)), *[t.count(p) for p in parts]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rates = style_zh.phrase_rates(docs, ("我们", "大大"))
    assert rates._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # each text is visited once
    assert {r.doc_id for r in rates.collect()} == {i for i, t in enumerate(texts) if re.search(L.HAN, t)}


def test_forms_that_share_beginnings_match_as_a_list_by_length():
    forms = ["a", "ab", "abc", "b", "bcd", *L.LIGATURES]
    listed = re.compile(r"\b(?:" + "|".join(sorted(forms, key=len, reverse=True)) + r")\b")
    shared = re.compile(r"\b" + cleaning._any_of(forms) + r"\b")
    assert cleaning._any_of(["ab", "abc", "b"]) == "(?:a(?:b(?:c)?)|b)"
    rng = random.Random(7)
    text = " ".join(rng.choice(forms) + rng.choice(["", "", "x", "-", "'s", "ab"]) for _ in range(3000))
    assert [m.span() for m in listed.finditer(text)] == [m.span() for m in shared.finditer(text)]


@pytest.mark.parametrize("name, parts", [("B6_paragraph_lengths", "paragraphs"), ("B6_sentence_lengths", "sentences")])
def test_lengths_of_odd_texts_equal_the_sql(spark, name, parts):
    texts = ["", "123", " ", None, "a\n\n\n b\n \t\nc d e", "a\r\n\r\nb", "a\n\x0c\nb c"]
    texts += ["a\n \nb", "a\n\x0b\nb c", "a\n  \nb", "a\n\u0085\nb"] if parts == "paragraphs" else []
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(plans.ORACLES[name]).fetchall())
    assert sorted(map(tuple, style.lengths(spark.createDataFrame(rows, "doc_id long, text string"), parts).collect())) == want


def test_sizes_of_works_equal_those_of_their_texts(spark):
    rows = [("a", 1, "x y"), ("a", 2, None), ("a", 3, " 大学 "), ("b", 4, ""), ("b", 5, "大" * 30), ("c", 6, "one")]
    docs = spark.createDataFrame(rows, "w string, i long, text string")
    sizes = registers.unit_sizes(docs, "w")
    assert "collect_list" not in sizes._jdf.queryExecution().executedPlan().toString()
    units = style.joined_by(docs, "w", ["i"]).withColumnRenamed("w", "unit_id")
    assert sorted(sizes.collect()) == sorted(registers.text_sizes(units).collect())
    assert sorted(registers.size_problems(sizes, 9).collect()) == sorted(registers.unit_problems(units, 9).collect())


def test_windows_of_beginnings_equal_those_of_whole_works(spark):
    rng = random.Random(8)
    rows = [(f"w{i % 4}", i, rng.choice(["", "12 !", None, "One two. Three", "a " * 9, "word; " * 400])) for i in range(200)] + [("w9", 999, "a b c d e f"), ("w9", 1000, " tail 7")]
    docs = spark.createDataFrame(rows, "w string, i long, text string")
    whole = style.joined_by(docs, "w", ["i"]).withColumnRenamed("w", "unit_id")
    begun = works.beginnings(docs, "w", ["i"], 6)
    assert sorted(registers.windows(begun, 2).collect()) == sorted(registers.windows(whole, 2).collect())
    assert begun.agg(F.max(F.length("text"))).first()[0] < whole.agg(F.max(F.length("text"))).first()[0]


def test_measures_of_works_keep_no_text_and_read_it_in_few_passes(spark):
    docs = spark.createDataFrame([("a", 1, "One two. Three"), ("a", 2, "four five?")], "w string, i long, text string")
    held = works.summaries(works.english(docs, "w", ["i"]), "w", ["i"], False)
    assert held.columns == ["w", "i", "_cut", "_opens", "_closes", "_brk"]
    assert "MapInArrow" not in (plan := held._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in plan
