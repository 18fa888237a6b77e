"""What works measure from large tables: the fast ways give what the plain ones give, and rare items stay in their task."""

import random
import re
from collections import Counter

from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import counted, style, style_zh, works
from loomtext.plans.style import HAN_FOR, LATIN
from pyspark.sql import functions as F

ODD = ["Mr.", "e.g.", "E.G...", "vs", "etc.", "no.", "Time", "people say.", "Yes!", "no?", "'tis", "-x", "--", "-'", "'", "(A)", '"Q."', "9", "don't-", "x" * 40 + ".", "\x1c", *map(chr, (0xE9, 0x200B, 0x212A, 0x17F, 0x20000)), chr(0x17F) + "t.", chr(0x65E5) + chr(0x3002)]
BLANKS = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\v", " \n \n ", "\n\x85\n", *map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000))]


def _odd_texts(seed, n=300):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) + rng.choice(BLANKS) for _ in range(rng.choice([1, 2, 5, 60]))) for _ in range(n)]
    made += [rng.choice(BLANKS) + t for t in made[:40]] + [t.rstrip() for t in made[40:90]]
    return [*made, "", " ", "　\n", ".", "A", "a. B", ". A", "a.B.  C", None]


def test_words_are_those_of_the_pattern():
    for text in _odd_texts(1):
        assert counted.words(text) == [w.lower() for w in re.findall(L.WORD, text or "")], text


def test_content_ends_are_the_first_and_last_content_words():
    rng = random.Random(2)
    for text in [*_odd_texts(3), "the " * 500 + "word " + "of " * 900, "word" * 300, "a b c " * 300, *[" ".join(rng.choice(["the", "of", "it", "-", "house"]) for _ in range(80)) for _ in range(50)]]:
        held = counted.content(text)
        assert counted._ends(text) == {"first": held[0] if held else None, "last": held[-1] if held else None}, text


def test_prose_is_what_the_expressions_give(spark):
    docs = spark.createDataFrame(list(enumerate(t for t in _odd_texts(4) if t is not None)), "i long, text string").repartition(3)
    text, bare = F.col("text"), F.regexp_replace("text", T.unicode(r"^\s+|\s+$"), "")
    last = lambda p: F.regexp_replace(F.lower(F.element_at(F.split(p, T.unicode(r"\s+"), -1), -1)), r"\.+$", "")
    for merged in (False, True):
        joins = (lambda p: last(p).isin(*L.ABBREVIATIONS)) if merged else (lambda p: F.lit(False))
        pieces = F.transform(T.sentences(text), lambda p: F.struct(F.regexp_count(p, F.lit(L.WORD)).cast("long").alias("n"), joins(p).alias("joins")))
        plain = docs.select("i", counted.cut_pieces(pieces).alias("c"), bare.rlike("""^["'(A-Z0-9]""").alias("o"), bare.rlike("[.!?]$").alias("e"), T.word_lengths(T.paragraphs(text)).alias("p"))
        want = {r.i: (sorted(r.c.inside), r.c.ends, r.o, r.e, Counter(r.p)) for r in plain.collect()}
        found = docs.select("i", counted.prose(text, merged).alias("c"))
        got = {r.i: (sorted(r.c.inside), r.c.ends, r.c.opens, r.c.closes, Counter({h.length: h.n for h in r.c.paragraphs})) for r in found.collect()}
        assert got == want


def test_chunks_are_cut_where_the_work_has_them(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([0, 1, 3, 7, 8, 30]))) for _ in range(40)]
    sizes = [len(t.split()) for t in texts]
    rows = [(i, t, sum(sizes[:i])) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i long, text string, b long").select("i", counted.chunk_parts(F.col("text"), F.col("b"), 7).alias("c")).collect()
    whole = " ".join(texts).split()
    chunks = [whole[k : k + 7] for k in range(0, len(whole), 7)]
    shared = {}
    for r in got:
        for p in r.c.parts:
            words, m = shared.setdefault(p.chunk, (set(), [0]))
            assert len(p.w.split()) == len(set(p.w.split()))  # repeated words are sent once
            words.update(p.w.split())
            m[0] += p.m
    assert all(words == set(chunks[k]) and m == [len(chunks[k])] for k, (words, m) in shared.items())
    inner = [c for k, c in enumerate(chunks) if k not in shared]
    assert sum(r.c.chunks for r in got) == len(inner) and sum(r.c.distinct for r in got) == sum(len(set(c)) for c in inner)


def test_rare_bigrams_stay_in_their_task(spark):
    rng = random.Random(6)
    rare = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(5))
    docs = [(w, i, " ".join(x for _ in range(60) for x in (rare(), rare(), *rng.choice([("heavy", "water"), ("water", "works"), ("zebra",)])))) for i in range(60) for w in ("big", None)]
    docs += [("few", 1, "alpha"), ("few", 2, "beta alpha beta"), ("few", 3, ""), ("ties", 1, "delta gamma delta gamma omega sigma omega sigma")]
    df = spark.createDataFrame(docs, "work string, i long, text string").repartition(5)
    over = df.filter("false").select("work", F.lit("").alias("bigram"))
    kept = works.promising(df, over, "work", 2)
    counts = counted.partial_counts(kept, "work", ["i"], "text", "bigram", counted.bigrams_in(), ["_keep"])
    of = lambda rows, w: {r.bigram for r in rows if r.work == w}
    rows = counts.collect()
    everything = Counter(b for w, _, t in docs if w == "big" for b in counted.bigrams(t))
    assert len(everything) > 5000 and {b for b, _ in everything.most_common(2)} <= of(rows, "big") and len(of(rows, "big")) < 500
    assert of(rows, "few") == {"beta alpha", "alpha beta"}
    held = works.top_bigrams(df, "work", ["i"], 3).collect()
    for w in ("big", None, "few", "ties"):
        found = counted.top(counted.bigrams("\n\n".join(t for v, _, t in sorted((d for d in docs if d[0] == w), key=lambda d: d[1]))), 3)
        assert sorted((r.place, r.bigram, r.hits) for r in held if r.work == w) == [(k, b, n) for k, (b, n) in enumerate(found, 1)]


def test_markup_and_letters_as_the_expressions_have_them(spark):
    rng = random.Random(7)
    bits = ["---\n", "t: x\n", "```", "```\n", "# h\n", "## \n", " > q\n", ">", "- a\n", "* ", "+\t", "-", "[a](b)", "[", "](", ")", "|", "\n", "\r", " ", "\x85# x", "正文。", "a, b.", " "]
    docs = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(400)] + [(-1, None), (-2, "---\na\n---\nb")], "i long, text string")
    plain = F.col("text")
    for pattern, new in style_zh.MARKUP:
        plain = F.regexp_replace(plain, T.unicode(pattern), new)
    out = docs.select(style_zh.strip_markup(F.col("text")).alias("a"), plain.alias("b"), counted.translated(F.col("text"), LATIN, HAN_FOR).alias("c"), F.translate("text", LATIN, HAN_FOR).alias("d"))
    assert out.filter("NOT (a <=> b AND c <=> d)").count() == 0


def test_texts_are_not_shuffled_to_learn_which_is_first(spark):
    docs = spark.range(50).select(F.lit("w").alias("work"), F.col("id").alias("i"), F.lit("---\nx\n---\n日").alias("text"))
    found = works.chinese(docs, "work", ["i"])
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r._t.startswith("日") for r in found.collect()) == 1


def test_whole_works_equal_their_joined_texts_on_odd_texts(spark):
    texts = _odd_texts(8, 120)
    docs = [(f"w{i % 2}", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "work string, i long, text string").repartition(5)
    rows = works.english(df, "work", ["i"])
    kept = {(r.work, r.i): r.text for r in rows.collect()}
    joined = spark.createDataFrame([(w, "\n\n".join(t for (v, _), t in sorted(kept.items()) if v == w)) for w in ("w0", "w1")], "doc_id string, text string")
    got = {r.work: r for r in works.measures_en(rows, "work", ["i"]).collect()}
    for r in style.measured(joined).collect():
        assert got[r.doc_id].words == r.n_words and abs(got[r.doc_id].mean_segment_ttr_500 - r.mean_segment_ttr_500) < 1e-12
