import json
import re

import pytest
from loomtext.functions import lexicons as L
from loomtext.functions import text as T
from loomtext.operators import cleaning, retrieval, segmentation, style
from loomtext.sources import html, readers, sinks
from pyspark.sql import functions as F


def one(spark, column, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_repair_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "rst Dierence transporta- tion pre- and  post-war self-love filepos12 tries"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.repaired for r in cleaning.repair(docs).collect()}
    assert got == {1: "first Dierence transportation pre- and post-war self-love tries", 2: "", 3: None}
    assert cleaning.repair(docs, aggressive=True).filter("doc_id = 1").first().repaired.endswith(" trifles")


def test_repairs_do_not_cascade(spark):
    assert one(spark, cleaning.repair_ligatures(F.col("text"), {"aa": "bb", "bb": "cc"}), "aa bb aa") == ["bb cc bb"]
    assert one(spark, cleaning.join_hyphens(F.col("text")), "pre- and xx", "ab- cd- ef", "a- bc") == ["pre- and xx", "abcd- ef", "a- bc"]


def test_sentence_merge_follows_the_last_word(spark):
    text = "I met Dr. Smith. He said hello. Last etc. One more."
    assert one(spark, T.sentences(F.col("text")), text) == [["I met Dr.", "Smith.", "He said hello.", "Last etc.", "One more."]]
    # a piece that ends in an abbreviation joins the one before it; the first has none before
    assert one(spark, T.merged_sentences(F.col("text")), text) == [["I met Dr.", "Smith.", "He said hello. Last etc.", "One more."]]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 11, 30, 99])
def test_distribution_indexes(spark, n):
    values = [(i * 7) % (n + 1) for i in range(n)]
    rows = spark.createDataFrame([(values,)], "v array<int>").select(T.distribution(F.col("v")).alias("d")).first().d
    if not n:
        assert rows is None
        return
    s = sorted(values)
    assert (rows.n, rows.p10, rows.p90, rows.low, rows.high) == (n, s[max(0, int(0.1 * n) - 1)], s[min(n - 1, int(0.9 * n))], s[0], s[-1])


def test_segment_ttr_drops_the_tail(spark):
    words = ["a"] * 500 + ["b", "c"] * 250 + ["d"] * 499
    got = one(spark, style.mean_segment_ttr(F.split("text", " ")), " ".join(words), "a b a")
    assert got == [pytest.approx((1 / 500 + 2 / 500) / 2), pytest.approx(2 / 3)]


def test_bounds_and_their_problems(spark):
    lines = segmentation.lines(spark.createDataFrame([("f", "intro\n# A\nx\n# B\ny\nz")], "doc_id string, text string"))
    spec = [("c01", "f", "^# A", "^# B", None, None), ("c02", "f", None, None, 2, 2), ("c03", "f", "^# Z", None, None, None), ("c04", "f", "^# B", "^# A", None, None), ("c05", "f", None, None, 5, 3), ("c06", "g", None, None, None, None), ("c07", "f", None, None, None, None)]
    spec = spark.createDataFrame(spec, "id string, doc_id string, start string, end string, start_line int, end_line int")
    got = {r.id: (r.first, r.last, r.problem) for r in segmentation.resolve_bounds(lines, spec).collect()}
    assert got["c01"] == (1, 3, None) and got["c02"] == (1, 2, None) and got["c07"] == (0, 6, None)
    assert [got[c][2] for c in ("c03", "c04", "c05", "c06")] == ["start marker not found", "end marker not found after start", "end is not after start", "missing file"]


def test_kwic_windows_and_python_patterns(spark):
    docs = spark.createDataFrame([(1, "a\n b" * 200 + " needle " + "c" * 2000), (2, None), (3, "NEEDLE needle needle")], "doc_id int, text string")
    got = retrieval.kwic(docs, r"(?<=\s)needle|^needle").collect()
    assert [r.offset for r in got if r.doc_id == 3] == [0, 7] and len(got) == 3
    first = next(r for r in got if r.doc_id == 1)
    flat = re.sub(r"\s+", " ", "a\n b" * 200 + " needle " + "c" * 2000)
    assert first.window == flat[first.offset - 250 : first.offset + 6 + 900]
    assert retrieval.bad_alternation(r"a\|b") and not retrieval.bad_alternation("a|b")


def test_finders_agree():
    names = ["aa", "a", "aba", "ba"]
    found = sorted(retrieval._finder(names)("aabaaaba"))
    want = sorted((n, m.start()) for n in names for m in re.finditer(re.escape(n), "aabaaaba"))
    assert found == want


def test_page_text(spark):
    page = "<html><style>p{}</style><h1>T</h1><p>a <b>b</b></p><!-- no --><blockquote>q</blockquote><script>x</script>"
    assert one(spark, html.text_of(F.col("text")), page)[0].split() == ["#", "T", "a", "b", ">", "q"]


def test_file_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in {"a.txt": "one", "deep/b.md": "two\nlines", "c.MARKDOWN": "three", "d.csv": "no"}.items():
        (tmp_path / "in" / name).write_text(text)
    assert sorted(r.text for r in readers.text_files(spark, str(tmp_path / "in")).collect()) == ["one", "two\nlines"]
    assert sorted(r.text for r in readers.notes(spark, str(tmp_path / "in")).collect()) == ["one", "three", "two\nlines"]
    assert readers.package_tree(spark, str(tmp_path / "in")).count() == 4
    (tmp_path / "units.json").write_text(json.dumps({"units": [{"path": "x"}, {"unit_id": "b", "label": "B", "path": "y", "clusters": ["c01"]}]}))
    assert [(r.unit_id, r.label, r.path) for r in readers.units(spark, str(tmp_path / "units.json")).orderBy("unit_id").collect()] == [("b", "B", "y"), ("u01", "u01", "x")]
    (tmp_path / "terms.txt").write_text("# note\n one \n\ntwo\n")
    assert [r.term for r in readers.terms(spark, str(tmp_path / "terms.txt"), comments=True).orderBy("position").collect()] == ["one", "two"]
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert sinks.write_once(df, str(tmp_path / "once")) and not sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        sinks.write_once(df.withColumn("s", F.lit("b")), str(tmp_path / "once"))
    lines = spark.createDataFrame([("c01", 1, "x"), ("c01", 0, "w"), ("c02", 0, "y")], "id string, line_no int, line string")
    told = sinks.cluster_texts(lines, str(tmp_path / "out")).collect()
    assert [p.read_text() for p in (tmp_path / "out" / "clusters" / "id=c01").glob("part*")] == ["w\nx\n"]
    assert sorted((r.id, r.source, r.n_lines, r.words, r.small) for r in told) == [("c01", "clusters/id=c01", 2, 2, True), ("c02", "clusters/id=c02", 1, 1, True)]
    sinks.json_artifact(df, str(tmp_path / "artifact"))
    assert [p.read_text() for p in (tmp_path / "artifact").glob("part*")] == ['{"i":1,"s":"a"}\n']


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"x": 1.5}',), ('{"x": NaN}',), ("nope",), ('{"x": 1e999}',)], "j string")
    got = readers.strict_json(rows, "j", "x double", numbers=("x",)).collect()
    assert [r.error is None for r in got] == [True, False, False, False]


def test_word_lists_are_disjoint_where_they_must_be():
    assert not set(L.HEDGES) & set(L.BOOSTERS) and len(L.DIMENSIONS) == 13 and len(L.LIGATURES) == 132
