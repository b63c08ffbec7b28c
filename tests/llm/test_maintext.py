import re
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import maintext
from tests.compare import assert_same, connection

TREE = maintext.grown()


def kept(html):
    return maintext.kept_blocks(html, TREE)


def test_query_matches_sql(spark, sf_dir):
    assert assert_same(spark, connection(sf_dir), "op11", maintext.op11_main_text, maintext.OP11_SQL, sf_dir) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_query_matches_the_marked_article(spark, sf_dir):
    """A second reading of these pages: the article element is cut at p and h1, and the references decoded."""
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n\n".join(x for x in parts if x)
    got = maintext.op11_main_text(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_learns_its_table_and_matches_brute_force():
    x, y = maintext.labelled()
    assert ((TREE.predict(x) >= 0.5) == y).mean() > 0.99
    assert maintext.FEATURES.index("words_after") in TREE.feature  # a neighbour decides where nothing is marked

    def gini(part):
        return 2 * part.sum() * (len(part) - part.sum()) / len(part) if len(part) else 0.0

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for b in (values[1:] + values[:-1]) / 2:
            under = x[:, f] <= b
            if min(under.sum(), (~under).sum()) >= 2:
                drop = gini(y) - gini(y[under]) - gini(y[~under])
                if best is None or drop > best[0] + 1e-9:
                    best = (drop, f, b)
    assert (TREE.feature[0], TREE.bound[0]) == pytest.approx(best[1:])
    # each page left out in turn is told by the others
    right = total = 0
    for k in range(len(maintext.PAGES)):
        tree = maintext.grown(maintext.PAGES[:k] + maintext.PAGES[k + 1 :])
        a, b = maintext.labelled(maintext.PAGES[k : k + 1])
        right, total = right + ((tree.predict(a) >= 0.5) == b).sum(), total + len(b)
    assert right / total > 0.85


def test_features():
    found = maintext.blocks("<div><p>one two <a href=x>three</a></p><p>four</p></div><div class=ad>five six</div>")
    assert [b[:3] for b in found] == [("one two three", 3, 1), ("four", 1, 0), ("five six", 2, 0)]
    x = {n: maintext.features(found)[:, i].tolist() for i, n in enumerate(maintext.FEATURES)}
    assert x["words"] == [3, 1, 2] and x["words_before"] == [0, 3, 1] and x["words_after"] == [1, 2, 0]
    assert x["links"] == pytest.approx([1 / 3, 0, 0]) and x["links_before"] == pytest.approx([0, 1 / 3, 0]) and x["mark"] == [0, 0, -1]


SIDE = [
    "<nav><ul><li><a href=/a>Home page of ours</a></li></ul></nav>", "<header><p>A long line above the page that says who we are and what we do.</p></header>", "<footer><p>All rights are kept by those who wrote what you read here, in every land.</p></footer>",
    "<aside><p>Another story that you may like as well, about something else.</p></aside>", "<div class='left-sidebar'><p>Words at the side of the page, many of them, more than a few.</p></div>", "<div id=\"cookieNotice\"><p>We keep crumbs.</p><button>Fine</button></div>",
    "<div class=ad>Buy these things now, they are cheap and they are good.</div>", "<form><label>Name</label><input name=n><p>Tell us who you are and where you live.</p><select><option>one<option>two</select></form>",
    "<script>var a = '</p><p>no text';</script>", "<style>p{margin:0}</style>", "<!-- <p>not here</p> -->", "<section id=comments><h3>Two comments</h3><article class=comment><p>I read all of this and I liked the most of it, thank you.</p></article></section>",
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", "<div id=content>%s</div>", "<div class=page-with-sidebar><div class='post-content'>%s</div></div>"])
def test_parts_beside_the_article(wrap):
    main = "<h1>A title</h1><p>One.</p><p>A <b>longer</b> piece of text with <a href=/x>one link</a> in it.</p><p><a href=/y>All link</a></p><ul><li>x<li>y</ul>"
    want = ["A title", "One.", "A longer piece of text with one link in it.", "All link", "x", "y"]
    assert kept("<body>" + "".join(SIDE[:9]) + wrap % main + "".join(SIDE[9:])) == want
    for side in SIDE:
        if not side.startswith("<header"):  # a head inside the article is its own
            assert kept("<body>" + wrap % (main + side + "<p>last</p>")) == [*want, "last"], side


def test_without_marks():
    text = "<p>%s</p>" % ("word " * 40)
    page = "<body><div><a>One</a> <a>Two</a></div><div><h1>A title of five words</h1>" + text + "<p>short one</p>" + text + "</div><div><ul><li><a>More of this</a></ul></div>"
    assert kept(page) == ["A title of five words", ("word " * 40).strip(), "short one", ("word " * 40).strip()]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []), (" \n\t", []), ("plain words without any tag at all", ["plain words without any tag at all"]), ("<article>a&nbsp;&nbsp;b &lt;i&gt; &#8364; &amp &am &bogus; x < y</article>", ["a b <i> € & &am &bogus; x < y"]),
        ("<article><p>one<p>two<br>three<div>four</p>five", ["one", "two three", "four", "five"]), ("<article><p title='a > b'>in</p><p x=\">\">on</p><p it's>up</p></article>", ["in", "on", "up"]),
        ("<article><p>a</p><!-- open <p>b</p>", ["a"]), ("<article><p>a</p><script>open <p>b</p>", ["a"]), ("<article><p>a</p><p cl", ["a"]), ("<ARTICLE><P>a</P></ARTICLE>", ["a"]), ("<article>a</nav></section></b>b</article>", ["a", "b"]),
    ],
)
def test_broken_pages(html, want):
    assert kept(html) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'", '"', "=", "<!--", "-->", "<script>", "</script>", "word", " ", "&amp;", "<article>", "</article>", "<br>", "<li>", "\n"]), max_size=40))
def test_any_page(parts):
    html = "".join(parts)
    for text, words, linked, *_ in maintext.blocks(html):
        assert text == " ".join(text.split()) and words == len(text.split()) > 0 and 0 <= linked <= words
    kept(html)


@pytest.mark.parametrize("piece", ["<div>", "</section>", '<a "', "<!--", "<p>w", "<a b='", "<", "x" * 50, "<script>"])
def test_long_pages_in_linear_time(piece):
    maintext.blocks("<div>" * 50_000 + piece * 100_000)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(None, None, "t"), (1, "", "t"), (1, "<article>a", "t"), (1, "<article>a", "t"), (2, "<article>" + "<p>w</p>" * 50_000, "t")]
    pages = spark.createDataFrame([(*r, 5, "p") for r in rows], "page_id long, html string, text string, n_chars int, page string")
    out = maintext.main_text(pages)
    assert out.columns == ["page_id", "page", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars, r.page) for r in out.collect()) == [(0, "", 0, "p"), (1, "", 0, "p"), (1, "a", 1, "p"), (1, "a", 1, "p"), (2, "w\n\nw\n\nw\n\n", 149_998, "p")]
    assert maintext.main_text(pages.limit(0)).count() == 0
    assert maintext.main_text(pages.select("html")).columns == ["text", "n_chars"]
    found = maintext.page_blocks(pages.filter("page_id = 1")).collect()
    assert [(r.page.page_id, r.place, r.block, r.words, r.link_density, r.score) for r in found] == [(1, 0, "a", 1, 0.0, 1.0)] * 2
