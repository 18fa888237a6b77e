import html
import re
import time

import duckdb
import pytest
from loomtext.llm import maintext as M


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p> a \n b </p>\n<p>c", "a b\nc"),
        ("<p>x&amp;amp;y &lt;b&gt; caf&eacute; &#x41;&nbsp;z</p>", "x&amp;y <b> café A z"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>a<b>b</b>c</p><p>d<br>e</p></article><footer>f</footer>", "T\nabc\nd e"),
        ("<article><p>a</p><aside>s</aside><div class='ad-slot'>buy</div><form>mail</form><p>b</p><div id=comments><p>nice</p></div></article>", "a\nb"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open <p>z", "yes"),
        ("<nav>never closed<article><p>kept</p></article>", "kept"),
        ("<div class=page-with-sidebar><p>long enough to be the text</p></div><div class=sidebar><p>side</p></div>", "long enough to be the text"),
        ("<p class=notice>cookies<p>one paragraph of text", "one paragraph of text"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc d\ne"),
        ("<a title='x>y' href=z>link</a> text", "link text"),
        ("<article><article class=comment><p>reader</p></article><p>a</p></article>", "a"),
    ],
)
def test_pages(page, want):
    assert M.main_text(page) == want


def test_surge_and_dive_without_any_declared_article():
    menu = "".join(f"<div><a href=/{k}>Entry {k}</a></div>" for k in range(8))
    text = "".join(f"<div>Sentence {k} of the text, which has some length.</div>" for k in range(6))
    teasers = "".join(f"<div><a href=/t{k}>Read on {k}</a></div>" for k in range(5)) + "<div>imprint</div>"
    want = "\n".join(f"Sentence {k} of the text, which has some length." for k in range(6))
    assert M.main_text(f"<body>{menu}{text}{teasers}</body>") == want


def test_stretches_equal_a_plain_reading_of_the_sums():
    import random

    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 5, 1]) for _ in range(rng.randint(0, 20))]
        heavy, runs = [k for k, x in enumerate(w) if x], []
        for k in heavy:  # lines belong together unless a whole window without weight lies between
            if runs and k - runs[-1][1] <= M.WINDOW:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        assert M.stretches(w) == [tuple(r) for r in runs]


def test_all_pages_equal_a_reading_of_their_article():
    for i, page in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " "))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert M.main_text(page) == "\n".join(filter(None, want)), i


@pytest.mark.parametrize("part", ["<div><b>", "<p>a", '<a href="x', "<", "<nav>", "<!--", "<a b='", "</p>", "&amp", "<script>"])
def test_long_broken_pages_take_linear_time(part):
    began = time.process_time()
    M.main_text(part * 40_000)
    assert time.process_time() - began < 10


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, "t"), (2, "v", "<p>é&copy;</p>" * 2, "t"), (3, "w", "<p>" + "word " * 100_000, "t")]
    out = M.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in out.collect())
    assert got == [(0, "", 0, 0), (1, "u", 1, 1), (1, "u", 1, 1), (2, "v", 5, 5), (3, "w", 499_999, 499_999)]
    assert M.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
