"""Main text of web pages: flat text blocks, told from boilerplate by a decision tree.

A page is cut at its block tags into a flat run of blocks. Each block has its number of words, its link density and those
of its two neighbours, whether it is a heading, the share of its container in the page's free text, and whether the page's
marks put it in the article (1), beside it (-1) or say nothing (0). The tree is grown on ``PAGES``, a small labelled
table. A page is worked on by itself, so nothing is shuffled, and one pass over its tags makes its blocks.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import as_struct, need, table, texts_of, without

# Names of HTML's elements by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title noscript template iframe textarea svg object canvas audio video xmp noembed noframes".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hgroup address details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIDE_TAGS = frozenset("nav footer aside form button select option datalist fieldset legend dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
# What authors call the parts of a page in class, id and role.
SIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toolbar topbar skip
    sidebar side aside rail widget widgets footer foot bottom contentinfo complementary masthead
    cookie cookies consent gdpr notice notices notification notifications alert alertdialog dialog disclaimer copyright legal
    privacy popup modal overlay paywall newsletter subscribe subscription signup login register search form
    comment comments commentlist reply replies respond discussion disqus
    share sharing social related recommended recommendations trending popular hidden""".split()
)
HEAD_NAMES = frozenset("header head banner".split())
MAIN_NAMES = frozenset("article articlebody main content maincontent post entry story".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A wrapper that only says whether the page has such a part.
ABOUT = re.compile(r"(?:^|[-_])(?:no|with|without|has|js)[-_]", re.I)

FEATURES = ("mark", "heading", "share", "words", "links", "words_before", "links_before", "words_after", "links_after")


def marks(attrs: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role name the main part, a part beside it, and a head."""
    main = side = head = False
    for value in NAMED.findall(attrs):
        for name in value.strip("\"'").split():
            if ABOUT.search(name):
                continue
            words = {w.lower() for w in WORDS_OF.findall(name)} | {name.lower()}
            own = bool(words & MAIN_NAMES)
            main |= own
            side |= bool(words & SIDE_NAMES)
            head |= bool(words & HEAD_NAMES) and not own
    return main, side, head


def blocks(html: str) -> list[tuple[str, int, int, bool, bool, bool, int]]:
    """(text, words, linked words, main, side, heading, container) of each block, in page order.

    Tags may stay open, cross or miss: an end tag closes up to its own start, or nothing. What is never closed
    (comment, script, tag) reaches to the end of the page. Each tag is looked at once, however deep it lies.
    """
    out: list[tuple[str, int, int, bool, bool, bool, int]] = []
    stack = [("", False, 0, False, 0)]  # tag, main, side (2: a form, which may hold a whole page), heading, container
    open_: dict[str, int] = {}
    held: list[str] = []
    linked, link_at, containers, at, n = 0, 0, 1, 0, len(html)

    def text(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            piece = html[start:end]
            held.append(unescape(piece) if "&" in piece else piece)
            if link_at:
                linked += len(held[-1].split())

    def close() -> None:
        nonlocal linked
        if held:
            found = "".join(held).split()
            if found:
                _, main, side, heading, container = stack[-1]
                out.append((" ".join(found), len(found), min(linked, len(found)), main, side > 0, heading, container))
            held.clear()
        linked = 0

    def pop() -> None:
        nonlocal link_at
        open_[stack.pop()[0]] -= 1
        if link_at > len(stack):
            link_at = 0

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at, tag = m.end(), m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            link_at = 0 if m["end"] else len(stack)
        if tag in INLINE:
            continue
        close()
        if m["end"]:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in UNREAD:
            over = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = html.find(">", over.start()) + 1 if over else n
            at = at or n
            continue
        if tag in VOID:
            continue
        while stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY.get(tag, ()):
            pop()
        _, main, side, heading, container = stack[-1]
        if tag not in ("html", "body"):
            to_main, to_side, to_head = marks(m["attrs"]) if m["attrs"] else (False, False, False)
            to_side |= tag in SIDE_TAGS and tag != "form"
            to_side |= (to_head or tag == "header") and not main
            here = not to_side and (to_main or tag in MAIN_TAGS)
            side = 1 if to_side or side == 1 else 0 if here else 2 if tag == "form" else side
            if not main and (here or tag not in PARTS):  # the marked main part is one container
                container, containers = containers, containers + 1
            main = main or here
        stack.append((tag, main, side, heading or tag in HEADINGS, container))
        open_[tag] = open_.get(tag, 0) + 1
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """A row of ``FEATURES`` for each of a page's blocks; beyond the page's ends there are no words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], np.float64)
    links = np.array([b[2] for b in found], np.float64) / words
    main, side, heading = (np.array([b[i] for b in found], bool) for i in (3, 4, 5))
    inside = main & ~side
    mark = np.where(inside, 1.0, np.where(side | inside.any(), -1.0, 0.0))
    _, own = np.unique([b[6] for b in found], return_inverse=True)
    held = np.bincount(own, words * (1 - links) * ~side)
    share = held[own] / max(held.max(), 1.0)
    before, after = (lambda x: np.concatenate(([0.0], x[:-1]))), (lambda x: np.concatenate((x[1:], [0.0])))
    return np.column_stack((mark, heading, share, words, links, before(words), before(links), after(words), after(links)))


class DecisionTree:
    """A binary tree grown by the largest drop of the Gini impurity; equal drops go to the earlier feature and threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.feature, self.bound, self.low, self.high, self.value = [], [], [], [], []
        self.depth, self.least = depth, least
        self._grow(x, y.astype(np.float64), 0)

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        at = len(self.value)
        for column, v in ((self.feature, -1), (self.bound, 0.0), (self.low, at), (self.high, at), (self.value, float(y.mean()))):
            column.append(v)
        split = self._split(x, y) if level < self.depth and 0 < y.mean() < 1 else None
        if split:
            self.feature[at], self.bound[at] = split
            under = x[:, split[0]] <= split[1]
            self.low[at] = self._grow(x[under], y[under], level + 1)
            self.high[at] = self._grow(x[~under], y[~under], level + 1)
        return at

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, n, total = None, len(y), y.sum()
        least = 2 * total * (n - total) / n - 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            fit = np.flatnonzero((v[1:] > v[:-1]) & (k >= self.least) & (n - k >= self.least))
            if not len(fit):
                continue
            k, a = k[fit], ones[fit]
            b = total - a
            impurity = 2 * a * (k - a) / k + 2 * b * (n - k - b) / (n - k)
            i = int(np.argmin(impurity))
            if impurity[i] < least - 1e-12:
                least, best = impurity[i], (f, float(v[fit[i]] + v[fit[i] + 1]) / 2)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of label 1 in the leaf of each row."""
        feature, bound, low, high = (np.array(c) for c in (self.feature, self.bound, self.low, self.high))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            under = x[np.arange(len(x)), feature[at]] <= bound[at]
            at = np.where(feature[at] < 0, at, np.where(under, low[at], high[at]))
        return np.array(self.value)[at]


#: The labelled table: pages in which each text stands for a number of words, + where it is main text, - where it isn't.
PAGES = (
    "<body><nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav><div class=ad>-9</div><article><h1>+7</h1><p>+80</p><p>+1</p><p>+24</p></article><footer>-14</footer>",
    "<body><header><a>-2</a></header><main><h1>+5</h1><p>+46</p><p>+3</p><h2>+2</h2><p>+31</p><ul><li>+4</li><li><a>+3</a></li></ul></main><aside><h3>-2</h3><p>-38</p><p>-22</p></aside><footer><p>-40</p></footer>",
    "<body><div id=menu><a>-1</a></div><div class=content><h1>+6</h1><p>+2</p><p><a>+4</a></p><p>+64</p><div class=share><a>-1</a></div></div><div class=comments><h3>-2</h3><div class=comment><p>-45</p></div><div class=comment><p>-6</p></div></div>",
    "<body><div class=cookie-notice><p>-21</p><button>-1</button></div><article><header><h1>+9</h1><p>+4</p></header><p>+33</p><blockquote><p>+17</p></blockquote><aside>-12</aside><p>+29</p><footer>-6</footer></article><section id=comments><article><p>-52</p></article></section>",
    "<body><form><fieldset>-3</fieldset><p>-12</p><button>-1</button></form><article><h1>+4</h1><p>+1</p></article><div class=sidebar><p>-60</p><a>-5</a></div>",
    "<body><article><p>+19</p><table><tr><td>+1</td><td>+2</td></tr><tr><td>+1</td><td><a>+1</a></td></tr></table><p>+55</p></article><div class=newsletter><p>-26</p></div>",
    "<body><div><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></div><div><h1>+8</h1><p>+57</p><p>+4</p><p>+36</p><p>+71</p></div><div><a>-3</a> <a>-2</a></div><div>-5</div>",
    "<body><table><tr><td><a>-2</a><br><a>-2</a></td></tr></table><div><h2>+5</h2><p>+25</p><p>+11</p><p>+48</p></div><div><p>-8</p></div>",
    "<body><p><a>-1</a> <a>-1</a> <a>-1</a></p><h1>+4</h1><p>+63</p><p>+40 <a>+2</a></p><p>+12</p><p>+39</p><p><a>-2</a> <a>-3</a></p><p><a>-9</a></p><p><a>-7</a> -1</p><p><a>-12</a></p>",
    "<body><div><a>-2</a></div><div><p>+90</p><p>+7</p><h3>+3</h3><p>+44</p></div><div><h4>-2</h4><ul><li><a>-6</a></li><li><a>-8</a></li><li><a>-7</a></li></ul></div><div>-4 <a>-2</a></div>",
    "<body><div><h1>+6</h1><p>+30</p><p>+28</p><p><a>+2</a> +20</p><p>+52</p><p>+2</p><p>+41</p></div><div><p>-10 <a>-4</a></p><p>-3</p></div>",
    "<body><div><ul><li>-1</li><li>-1</li><li>-2</li></ul></div><div><h1>+5</h1><p>+100</p><p>+60</p></div><div><ul><li>-3</li><li>-2</li></ul></div>",
    "<body><div><p>-30</p><p>-44</p></div><article><h1>+3</h1><p>+2</p></article><div><p>-25</p></div><p>-9</p>",
    "<body><div><h3>-4</h3><p>-50</p></div><article><div><p>+12</p></div><div><section><h2>+2</h2><p>+90</p></section></div><p><a>+6</a></p><p><a>+1</a></p></article>",
    "<body><div><p>+35</p><p>+42</p><p>+3</p></div><div class=related><p>-40</p><p>-31</p></div><nav>-8</nav><footer><p>-66</p><p>-20</p></footer>",
    "<body><p>-2</p><p>-3</p><p>-2</p><h1>+5</h1><p>+60</p><p>+3</p><p>+48</p><p>-3</p><p>-2</p><p>-4</p>",
    "<body><p>-1</p><p>-2</p><p>-4</p><h2>+4</h2><p>+70</p><p>+33</p><p>+2</p><p>+25</p><p>-2</p><p>-5</p><p>-1</p><p>-3</p>",
    "+7",
    "<p>+3</p>",
    "<body><div>+12</div>",
    "<body><aside><p>-30</p></aside><section><p>+22</p><p>+18</p></section><form><p>-11</p><button>-2</button></form><div class=banner>-15</div>",
)


def labelled(pages=PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of a labelled table."""
    rows, labels = [], []
    for page in pages:
        told = re.sub(r"[+-](\d+)", lambda m: " ".join([m[0][0]] * int(m[1])), page)
        found = blocks(told)
        rows.append(features(found))
        labels += [b[0][0] == "+" for b in found]
    return np.concatenate(rows), np.array(labels)


def grown(pages=PAGES) -> DecisionTree:
    return DecisionTree(*labelled(pages))


def kept_blocks(html: str, tree: DecisionTree) -> list[str]:
    found = blocks(html)
    return [b[0] for b, p in zip(found, tree.predict(features(found)), strict=True) if p >= 0.5]


def page_blocks(pages: DataFrame, html_col: str = "html", tree: DecisionTree | None = None) -> DataFrame:
    """A row for each block: the page's other columns as ``page``, ``place`` from 0, ``block``, ``words``, ``link_density``,
    and ``score``, the tree's share of main text. Pages without blocks give no rows."""
    need(pages, html_col)
    tree = tree or grown()
    rest = pages.drop(html_col)

    def run(batches):
        for batch in batches:
            for i, html in enumerate(texts_of(batch.column(1))):
                found = blocks(html)
                if not found:
                    continue
                x = features(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array([b[0] for b in found], pa.string()), pa.array([b[1] for b in found], pa.int64()), pa.array(x[:, FEATURES.index("links")]), pa.array(tree.predict(x))],
                    ["page", "place", "block", "words", "link_density", "score"],
                )

    kept = pages.select(as_struct(rest).alias("page"), F.col(f"`{html_col}`").alias("html"))
    return kept.mapInArrow(run, f"page {kept.schema['page'].dataType.simpleString()}, place int, block string, words long, link_density double, score double")


def main_text(pages: DataFrame, html_col: str = "html", tree: DecisionTree | None = None) -> DataFrame:
    """The columns of ``pages`` but the html, and ``text``, the blocks of main text joined by a blank line, and ``n_chars``.

    Defined cases: null, empty and blank pages, and pages without main text, have the empty text; a page without any tag
    is one block, judged by its words; repeated rows give the same text each; very long pages are read whole; null ids and further columns pass
    through, but columns called text or n_chars give way to the operator's own; an empty table gives no rows.
    """
    need(pages, html_col)
    tree = tree or grown()
    rest = without(pages, html_col, "text", "n_chars")

    def run(batches):
        for batch in batches:
            texts = ["\n\n".join(kept_blocks(html, tree)) for html in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page", "text", "n_chars"])

    kept = pages.select(F.struct(F.lit(0).alias("row"), as_struct(rest).alias("rest") if rest.columns else F.lit(None).alias("rest")).alias("page"), F.col(f"`{html_col}`").alias("html"))
    done = kept.mapInArrow(run, f"page {kept.schema['page'].dataType.simpleString()}, text string, n_chars long")
    return done.select(*[F.col(f"page.rest.`{c}`").alias(c) for c in rest.columns], "text", "n_chars")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Holds for pages that mark their article and have no part beside it inside, as those of the given table; long names of
#: character references only.
OP11_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) as body from pages),
t as (select page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') as body from a),
d as (select page_id, url, replace(replace(replace(replace(regexp_replace(body, '&amp;?', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', '''') as body from t),
b as (select page_id, url, list_filter(list_transform(string_split(body, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as parts from d)
select page_id, url, array_to_string(parts, chr(10) || chr(10)) as text, length(array_to_string(parts, chr(10) || chr(10)))::bigint as n_chars from b
"""
