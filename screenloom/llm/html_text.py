"""Main text of HTML pages by the maximum-scoring contiguous region.

A page becomes a row of words and tags. Words score positive and tags negative, with log-odds weights fitted on labelled
pages; one linear scan finds the best contiguous region. What can't be part of an article (navigation, forms, adverts,
comments of readers and the like) is in no region. On pages with article or main elements, words and tags within and
without these have weights of their own, so that the elements are evidence and the scan draws the bounds.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|/?([a-zA-Z][^\s/>]*)|[!?/])")
_SPECIAL = re.compile(r"[>\"']")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|\d+")
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements that are no part of an article, whatever they hold.
_OUT_TAGS = set("nav footer aside form noscript template iframe object embed svg canvas button select option textarea dialog menu head audio video map script style title datalist fieldset applet frameset".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
_OUT_NAMES = set("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer footers comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login signin search disclaimer paywall hidden dropdown teaser teasers skip topbar".split())
_NOT_OUT = {"has", "with", "no", "without", "main", "article"}
_ROOTS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _outside(tag: str, attrs: str) -> bool:
    if tag in _OUT_TAGS:
        return True
    if not attrs or tag in ("html", "body") or tag in _ROOTS:
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in _OUT_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = _NAME.findall(one)
                if parts and parts[0] not in _NOT_OUT and not _OUT_NAMES.isdisjoint(parts):
                    return True
    return False


def kind_of(tag: str) -> str:
    return "tag:prose" if tag in ("p", "br", "blockquote") or tag in _HEADINGS else "tag:link" if tag == "a" else "tag:inline" if tag in _INLINE else "tag:block"


class _Tokens:
    """The tags of a page one after the other, in linear time whatever quotes, comments and tags stay unclosed."""

    def __init__(self, page: str):
        self.page, self.last, self.dead, self.walk = page, page.rfind(">"), set(), False

    def _end(self, at: int) -> int:
        """The end of a tag whose attributes begin at ``at``: past the first > outside quotes, else the first > at all.

        A quote from which no such > can be reached is remembered, so each is followed once.
        """
        if not self.walk:
            if m := _QUOTED.match(self.page, at):
                return m.end()
            self.walk = True
        page, seen, here = self.page, [], at
        while m := _SPECIAL.search(page, here):
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.dead.update(seen)
        return page.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Of the first tag, comment or declaration from ``at`` on: start, end, name (empty if none), whether it closes, attributes."""
        page = self.page
        while m := _OPEN.search(page, at, max(at, self.last + 1)):
            if m[0] == "<!--":
                end = page.find("-->", m.end()) + 3
                return m.start(), end if end > 2 else len(page), "", False, ""
            if m[0] == "<![CDATA[":
                end = page.find("]]>", m.end()) + 3
                return m.start(), end if end > 2 else len(page), "", False, ""
            if m[1]:
                end = self._end(m.end())
                return m.start(), end, m[1].lower(), m[0][1] == "/", page[m.end() : end - 1]
            return m.start(), page.find(">", m.end()) + 1, "", False, ""
        # Without a > nothing but a comment can begin, and it has no end.
        found = [x for x in (page.find("<!--", at), page.find("<![CDATA[", at)) if x >= 0]
        return (min(found), len(page), "", False, "") if found else None


class _Open:
    """The open elements (name, and pruned, root and header as they were before it), with the places of each name."""

    def __init__(self):
        self.items: list[tuple[str, bool, int, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> str:
        return self.items[-1][0] if self.items else ""

    def push(self, name: str, *before) -> None:
        self.at.setdefault(name, []).append(len(self.items))
        if name not in _INLINE:
            self.blocks.append(len(self.items))
        self.items.append((name, *before))

    def pop(self) -> tuple[bool, int, bool]:
        name, *before = self.items.pop()
        self.at[name].pop()
        if name not in _INLINE:
            self.blocks.pop()
        return tuple(before)

    def close(self, name: str) -> tuple[bool, int, bool] | None:
        """What was before the innermost element of that name, which ends with all in it; None if there is none, or if a
        block is open within an inline one."""
        places = self.at.get(name)
        if not places or name in _INLINE and self.blocks and self.blocks[-1] > places[-1]:
            return None
        k, before = places[-1], None
        while len(self.items) > k:
            before = self.pop()
        return before


def events(page: str):
    """(kind, text, root) of words of text runs and tags outside pruned elements, in page order.

    kind is word, word:link, break (a block begins or ends) or a tag's; root numbers the outermost article or main
    element around (0: none).
    """
    out: list[tuple[str, str, int]] = []
    tokens, stack = _Tokens(page), _Open()
    pruned, root, roots, header, links, at, heading = False, 0, 0, False, 0, 0, 0
    n = len(page)
    while at < n:
        m = tokens.next(at)
        end = m[0] if m else n
        if end > at and not pruned and not (header and not heading):
            out.append(("word:link" if links else "word", page[at:end], root))
        if not m:
            break
        _, at, tag, closing, attrs = m
        if not tag:
            continue
        if not closing and tag in _RAW:
            found = _RAW_END[tag].search(page, at)
            at = page.find(">", found.end()) + 1 or n if found else n
            continue
        if not pruned:
            out.append((kind_of(tag), "", root))
            if tag == "br":
                out.append(("word", " ", root))
            elif tag not in _INLINE:
                out.append(("break", "", root))
        if tag in _HEADINGS:
            heading = max(0, heading + (-1 if closing else 1))
        if tag == "a":
            links = 0 if closing else 1
        if tag in _VOID or tag in _INLINE and tag not in ("span", "label", "a", "small") or tag == "p":
            if tag != "p" or closing or not _outside(tag, attrs):
                if tag == "p" and stack.top() == "p":  # also where the next paragraph begins
                    pruned, root, header = stack.pop()
                continue
        if closing:
            before = stack.close(tag)
            if before:
                pruned, root, header = before
                if not pruned:
                    out.append(("break" if tag not in _INLINE else kind_of(tag), "", root))
            continue
        if attrs.endswith("/") and tag in ("svg", "path", "circle", "use"):
            continue
        if tag not in _INLINE and stack.top() == "p":
            pruned, root, header = stack.pop()
        stack.push(tag, pruned, root, header)
        if tag in _ROOTS and not root:
            roots += 1
            root = roots
        if tag == "header":
            if root:
                header = True
            else:
                pruned = True
        pruned = pruned or _outside(tag, attrs)
    return out


def placed(row: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """``row`` with kinds by place (word:in, word:out, tag:in, tag:out) if any of it is in an article or main element."""
    if not any(root for _, _, root in row):
        return row
    return [(k if k == "break" else f"{k[: k.index(':')] if ':' in k else k}:{'in' if root else 'out'}", text, root) for k, text, root in row]


#: Labelled pages: what stands between the marks is the main text.
LABELLED = (
    "<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><ul><li><a>One</a></li><li><a>Two</a></li></ul></div>[[<div><h1>A river returns</h1><p>After nine dry summers the river that gave the town its name has come back, and with it the herons that nest along the lower bank.</p><p>Nobody had planned for it. The pumps were sold, <a>the mill</a> was a museum, and the council had let the old bridge fall in.</p></div>]]<div><a>Imprint</a> | <a>Terms</a> | <a>Top</a></div></body>",
    "<table><tr><td><a>Start</a></td><td><a>Shop</a></td><td><b>Hot</b></td></tr></table>[[<p>Bread needs time more than it needs skill. Mix the flour and water in the evening, leave the bowl in a cool place and go to bed.</p><p>In the morning fold the dough twice, wait, and <i>only then</i> add the salt.</p><ul><li>500 g of flour, as coarse as you like it</li><li>350 g of water and a little patience</li></ul>]]<div><span>Tags:</span> <a>bread</a>, <a>oven</a></div><div>Next <a>Soup</a></div>",
    "<div><img><a>Logo</a></div><div><span>Menu</span><a>A</a><a>B</a><a>C</a></div><div><div>[[<p>The committee met three times before it could agree on what the question was.</p><blockquote>We are not lost, the chairman said, we are early.</blockquote><p>By then the minutes ran to forty pages and the coffee had gone cold.</p>]]</div></div><div><div><a>More</a></div><div><a>Older</a></div></div>",
    "<body><div><a>Home</a> <a>Blog</a> <a>About</a></div><div><p>Half price until Sunday.</p></div><article>[[<h1>On keeping bees</h1><p>A hive is a household that nobody runs, and it took me three winters to stop trying.</p><h2>What to buy</h2><ul><li>a veil</li><li><a>a smoker</a> that stays lit</li></ul><p>The rest can wait until <b>May</b>.</p>]]</article><div><p>You may like these.</p><a>Wasps</a> <a>Honey</a></div></body>",
    "<body><div><span>Search</span> <a>Index</a></div><main>[[<h2>Minutes</h2><p>Present were all but one.</p><table><tr><td>Roof</td><td>agreed, after a long argument about slate</td></tr></table><p>The next meeting is in spring.</p>]]</main><div><div>Page 3 of 9</div><a>Next</a></div></body>",
)


#: Of pages without and with article or main elements, whose weights are fitted apart.
_KINDS = (("word", "word:link", "tag:prose", "tag:link", "tag:inline", "tag:block"), ("word:in", "word:out", "tag:in", "tag:out"))


def fit(pages=LABELLED) -> dict[str, float]:
    """Log-odds of each kind inside against outside the main text; words kept positive and tags negative."""
    counts = {True: Counter(), False: Counter()}
    for page in pages:
        inside = False
        for kind, text, _ in placed(events(page)):
            if text.strip() in ("[[", "]]"):
                inside = text.strip() == "[["
            elif kind != "break":
                counts[inside][kind] += len(text.split()) if kind.startswith("word") else 1
    weights = {}
    for kinds in _KINDS:
        n, m = (sum(counts[at][k] for k in kinds) + len(kinds) for at in (True, False))
        for k in kinds:
            v = math.log((counts[True][k] + 1) / n) - math.log((counts[False][k] + 1) / m)
            weights[k] = max(v, 0.02) if k.startswith("word") else min(v, -0.02)
    return weights


WEIGHTS = fit()


def extract(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The main text: its blocks in page order, joined by one line feed; empty for null, empty or text-free pages."""
    if not page:
        return ""
    row = placed(events(page))
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (kind, text, _) in enumerate(row):  # the best contiguous region; the first of equals
        if kind == "break":
            continue
        total += weights[kind] * (len(text.split()) if kind.startswith("word") else 1)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    lo, hi = region
    while lo < hi and row[lo][0] == "break":
        lo += 1
    while lo and row[lo - 1][0] != "break":  # to the ends of its first and last blocks
        lo -= 1
    while hi < len(row) and row[hi][0] != "break":
        hi += 1
    blocks, held = [], []
    for kind, text, _ in [*row[lo:hi], ("break", "", 0)]:
        if kind == "break":
            if held and (block := " ".join(_html.unescape("".join(held)).split())):
                blocks.append(block)
            held = []
        elif text:
            held.append(text)
    return "\n".join(blocks)


def main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the main text of its column ``html`` (string), and n_chars, its code points.

    Null and empty pages give empty text; every row, repeated ones too, gives one row, and an empty table none; columns named
    ``out`` or n_chars give way. Of regions of equal score the first counts. A page is read whole, in linear time.
    """
    base = df.drop(*[c for c in (out, "n_chars") if c != html])
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            texts = [extract(p) for p in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return base.mapInArrow(run, schema).withColumn("n_chars", F.length(out).cast("long"))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_html_text": op1_html_text}
SQL: dict[str, str] = {}
