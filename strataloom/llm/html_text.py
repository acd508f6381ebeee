"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block-level tags, without building a tree.
A block's features are its words and link density, those of its neighbours, the
kind of its tag, and what is open around it: a content container, surrounding
parts (menus, side columns, notices, comments) inside of that container, and
surrounding parts outside of it. A decision tree, trained on the blocks of the
small labelled pages below, decides which blocks are article text; those are
joined in page order.

Null and empty pages have an empty text. Markup that is cut off, unclosed or
wrongly nested never fails: whatever follows is read as far as it goes. Tags are
found in one pass over a page of any length, and no part of a page is dropped for
its length. Repeated rows get a row each. Extra columns of any name do not matter:
only the three columns named are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "in_main", "inner", "outer", "is_text")
#: Begins the blocks of a labelled page that are article text.
MARK = "§"


def _labelled_pages() -> tuple[str, ...]:
    """Pages labelled by hand; what a block says does not matter, so words are fillers and only their number is real."""
    t = lambda n: " ".join(["parola"] * n)
    k = lambda n: f"{MARK} {t(n)}"
    a = lambda n: f"<a href='/x'>{t(n)}</a>"
    menu = "<nav><ul>" + "".join(f"<li>{a(n)}</li>" for n in (1, 1, 2, 1, 3)) + "</ul></nav>"
    bare_menu = "<div><ul>" + "".join(f"<li>{a(n)}</li>" for n in (1, 2, 1, 3)) + "</ul></div>"
    foot = f"<footer><p>{t(7)}</p><p>{a(2)} | {a(1)} | {a(2)}</p></footer>"
    bare_foot = f"<div><p>{a(2)} {a(3)} {a(1)}</p><p>{t(5)}</p></div>"
    return (
        # news with an article container, and what frames it inside and outside
        f"<header><div>{a(1)}</div><p>{t(5)}</p></header>{menu}<div class='ad'>{t(8)}</div><div id='cookie-banner'><p>{t(30)}</p><button>{t(1)}</button></div>"
        f"<article><header><h1>{k(9)}</h1></header><p>{k(80)}</p><p>{k(60)} {a(4)} {t(10)}</p><div class='ad'>{t(4)}</div><h2>{k(2)}</h2><p>{k(40)}</p><ul><li>{k(3)}</li><li>{k(12)}</li><li>{k(1)}</li></ul>"
        f"<aside><h3>{t(2)}</h3><p>{t(40)}</p><ul><li>{a(6)}</li><li>{a(8)}</li></ul></aside><blockquote>{k(25)}</blockquote><figure><figcaption>{k(7)}</figcaption></figure><p>{k(1)}</p><p>{k(150)}</p><footer><p>{t(4)}</p></footer></article>"
        f"<section id='comments'><h2>{t(2)}</h2><article class='comment'><p>{t(30)}</p></article><article class='comment'><p>{t(60)}</p></article></section><div class='sidebar'><p>{t(50)}</p><ul><li>{a(5)}</li></ul></div>{foot}",
        # a page without a container: long blocks, short ones between them, then link lists and a line of credit
        f"{bare_menu}<div id='content'><h1>{k(8)}</h1><p>{k(70)}</p><p>{k(55)}</p><p>{k(6)}</p><p>{k(48)}</p><h2>{k(3)}</h2><p>{k(90)}</p><ul><li>{k(3)}</li><li>{k(8)}</li><li>{k(1)}</li></ul><p>{k(40)}</p>"
        f"<table><tr><td>{k(1)}</td><td>{k(4)}</td></tr></table><p>{k(30)}</p></div><div><p>{a(4)} {a(5)}</p><p>{t(2)}</p><p>{a(3)}</p></div>{bare_foot}",
        f"<div><p>{t(3)}</p></div>{bare_menu}<div><h1>{k(4)}</h1><div>{k(90)}</div><div>{k(28)} {a(3)}</div><p>{k(14)}</p><p>{k(45)}</p></div><div>{a(6)}</div><div>{t(4)}</div><div>{a(7)}</div><div>{t(5)}</div><div>{a(2)}</div>",
        # a layout whose name sounds like a side column, around the article; teasers beside it are articles too
        f"{menu}<div class='layout side by'><article><h1>{k(6)}</h1><p>{k(64)}</p><p>{k(35)}</p><h2>{k(2)}</h2><p>{k(50)}</p><ul><li>{k(7)}</li><li>{k(4)}</li></ul><p>{k(33)}</p></article></div>"
        f"<aside><article><h3>{a(5)}</h3><p>{t(8)}</p></article><article><h3>{a(4)}</h3><p>{t(10)} {a(2)}</p></article></aside><div class='related-posts'><article><a href='/y'>{t(6)}</a></article><article><a href='/z'>{t(9)}</a></article></div>{foot}",
        f"<div class='social box'><article><p>{k(75)}</p><p>{k(9)}</p><p>{k(44)}</p></article></div><div class='sidebar'><article><h4>{a(6)}</h4><p>{t(6)}</p></article></div>{menu}",
        # guides in a main element: notices, shares and forms inside
        f"{menu}<main><h1>{k(5)}</h1><div class='notice'><p>{t(20)}</p></div><p>{k(22)}</p><pre>{k(15)}</pre><h2>{k(1)}</h2><p>{k(10)}</p><dl><dt>{k(1)}</dt><dd>{k(9)}</dd></dl><div class='share'>{a(1)} {a(1)}</div><form><p>{t(12)}</p></form>"
        f"<p>{k(30)} {a(14)}</p><p>{k(5)}</p><div class='newsletter'><p>{t(25)}</p></div><p>{k(3)}</p><table><tr><td>{k(2)}</td><td>{k(1)}</td><td>{k(6)}</td></tr></table><p>{a(2)}</p><p>{k(18)}</p></main><div class='comments-list'><p>{t(45)}</p><p>{t(3)}</p></div>{foot}",
        f"<main><p>{k(2)}</p></main>", f"<article><p>{k(1)}</p></article><footer>{t(3)}</footer>", f"<div role='main'><ul><li>{k(5)}</li><li>{k(3)} </li></ul><p>{a(3)}</p><p>{k(12)}</p></div>{bare_foot}",
        # little but links
        f"{bare_menu}<div><p>{a(12)} {t(2)}</p><p>{a(9)}</p><p>{t(4)}</p><p>{a(30)} {t(4)}</p></div><div>{t(5)}</div>",
    )


_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_FRAME = frozenset("nav header footer aside form button dialog menu head fieldset label".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())
#: Words of a class, id or role that name what surrounds an article.
_FRAME_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|alert|banner|billboard|breadcrumbs?|byline|captcha|comments?|complementary|consent|contentinfo|cookies?|copyright|dialog|disqus|dropdown|feedback|foot|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pager|pagination|paywall|popup|privacy|promo\w*|recommend\w*|related|remarks?|replies|reply|respond|responses|search|share|sharing|sidebar|side|signup|sitemap|skip|social|sponsor\w*|subscribe|subscription|tags|teaser|toolbar|topbar|trending|widget)",
    re.I,
)
#: Words that say nothing beside those: a name of both kinds only is a frame's; any other word makes it the name of something else.
_PLAIN_WORDS = re.compile(
    r"(?:\d+|site|page|main|top|bottom|left|right|primary|secondary|global|wrapper|wrap|container|box|block|list|items?|bar|area|section|inner|outer|content|layout|row|col|column|links?|text|title|heading|posts?|articles?|entry|blog|user|readers?|form|btn|buttons?|icons?|media|panel|module|region|group|body|head|mobile|desktop|sticky|fixed|all|more|count|threads?|unit|slot|message|results?|policy|us|the|to|a)",
    re.I,
)
#: Those that make an article element a reader's comment or a teaser, and no container.
_MINOR_WORDS = re.compile(r"(?:ads?|adv|advert\w*|comments?|promo\w*|remarks?|replies|reply|respond|responses|sponsor\w*|teaser)", re.I)
#: Parts of names that tell what a layout has or lacks beside the article.
_MODIFIERS = re.compile(r"(?<![^\s_-])(?:with|without|has|no)[_-]\S*", re.I)
_STOP = re.compile(r"[<>\"']")
_TAG_NAME = re.compile(r"[a-z][a-z0-9:-]*", re.I)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg iframe object math select textarea title".split()}


def _frame_name(name: str, words: re.Pattern = _FRAME_WORDS) -> bool:
    """Whether one of the names in an attribute is a frame's, word for word."""
    for one in name.split():
        parts = [x for x in re.split(r"[_-]+", one) if x]
        if any(words.fullmatch(x) for x in parts) and all(words.fullmatch(x) or _PLAIN_WORDS.fullmatch(x) for x in parts):
            return True
    return False


def _minor(attributes: str) -> bool:
    """Whether an article element's names make it a comment or a teaser."""
    return "=" in attributes and any(_frame_name(m[2] or m[3] or m[4] or "", _MINOR_WORDS) for m in _NAMES.finditer(attributes) if m[1].lower() in ("class", "id"))


def _framed(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element surrounds the article rather than holding it."""
    if tag in _FRAME and not (tag == "header" and in_main):
        return True
    if tag in ("html", "body") or "=" not in attributes:
        return False
    for m in _NAMES.finditer(attributes):
        name = m[2] or m[3] or m[4] or ""
        if in_main:
            name = re.sub(r"\bheader\b", "", name, flags=re.I)
        if m[1].lower() != "aria-label" and _frame_name(_MODIFIERS.sub("", name)):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` is over (past its bracket); -1 if no bracket closes it before the next opens."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return len(page)  # cut off
        if m[0] == ">":
            return m.end()
        if m[0] == "<":
            return -1
        shut = page.find(m[0], m.end())
        at = shut + 1 if shut >= 0 else m.end()


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all markup in order, in one pass; comments, declarations and elements without text of the page have no name, or their own in upper case."""
    at = page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            shut = page.find("-->", at + 4)
            end = shut + 3 if shut >= 0 else len(page)
            yield at, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            shut = page.find(">", at + 2)
            end = shut + 1 if shut >= 0 else len(page)
            yield at, end, "", False, ""
        else:
            closing = page[at + 1 : at + 2] == "/"
            name = _TAG_NAME.match(page, at + 1 + closing)
            if name:
                end = _tag_end(page, name.end())
                if end >= 0:
                    low, attributes = name[0].lower(), page[name.end() : end].removesuffix(">")
                    if low in _RAW and not closing:
                        shut = _RAW[low].search(page, end)
                        end = shut.end() if shut else len(page)
                        yield at, end, low.upper(), False, ""
                    else:
                        yield at, end, low, closing, attributes
            elif at + 1 + closing >= len(page):  # cut off
                end = len(page)
                yield at, end, "", False, ""
        at = page.find("<", end if end >= 0 else at + 1)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, words in links, in main, frames inside of it, frames outside, text tag) of every block with text, in page order."""
    out: list[tuple[str, int, int, int, int, int, int]] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements that matter, each with what was open around it: mains, inner and outer frames
    mains = inner = outer = links = 0
    kind, held, linked = "", [], []

    def flush() -> None:
        if held:
            found = html.unescape("".join(held)).split()
            if found:
                inside = len(html.unescape(" ".join(linked)).split())
                out.append((" ".join(found), len(found), inside, int(mains > 0), int(inner > 0), int(outer > 0), int(kind in _TEXT)))
        held.clear()
        linked.clear()

    at = 0
    for start, end, tag, ending, attributes in tags(page):
        if start > at:
            raw = page[at:start]
            held.append(raw)
            if links:
                linked.append(raw)
        at = end
        if not tag or tag.isupper():
            if tag in ("SVG", "OBJECT", "IFRAME", "SELECT", "TEXTAREA"):
                held.append(" ")
            continue
        if tag == "a":
            links = 0 if ending else 1
        if tag not in _INLINE and tag != "br":
            flush()
            links = 0 if tag in ("p", "div", "li") else links
            kind = "" if ending else tag
        elif tag == "br":
            held.append(" ")
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, mains, inner, outer = stack[k]
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            _, mains, inner, outer = stack.pop()
        if tag == "body" and stack:
            _, mains, inner, outer = stack[0]
            stack.clear()
        main = tag in _MAIN or "itemprop" in attributes and "articleBody" in attributes or 'role="main"' in attributes or "role='main'" in attributes
        minor = tag == "article" and _minor(attributes)
        main = main and not minor
        frame = minor or not main and _framed(tag, attributes, mains > 0)
        if frame and tag in _INLINE:
            flush()
        if main or frame or tag in ("div", "section", "ul", "ol", "table", "td") and not attributes.rstrip().endswith("/"):
            stack.append((tag, mains, inner, outer))
            if main and tag == "article":  # teasers beside an article are articles, too
                outer, inner = outer + inner, 0
            elif main:
                outer = inner = 0
            mains, inner = mains + main, inner + frame
    if at < len(page):
        held.append(page[at:])
        if links:
            linked.append(page[at:])
    flush()
    return out


def features(found: list[tuple[str, int, int, int, int, int, int]]) -> np.ndarray:
    """The FEATURES of each block."""
    raw = np.array([x[1:] for x in found], dtype=np.float64).reshape(-1, 6)
    words, links = raw[:, 0], 100 * raw[:, 1] / np.maximum(raw[:, 0], 1)
    before, after = (lambda v: np.concatenate(([0.0], v[:-1]))), (lambda v: np.concatenate((v[1:], [0.0])))
    return np.stack([words, links, before(words), before(links), after(words), after(links), raw[:, 2], raw[:, 3], raw[:, 4], raw[:, 5]], axis=1)


def grow(rows: np.ndarray, depth: int = 6):
    """A decision tree over labelled rows by Gini impurity: (feature, threshold, low branch, high branch) or a verdict."""
    y = rows[:, -1]
    if not depth or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(t))
    if best[0] == np.inf:
        return bool(y.mean() >= 0.5)
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def verdicts(tree, x: np.ndarray) -> np.ndarray:
    """The tree's verdict on each row."""
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, t, low, high = tree
    down = x[:, f] <= t
    return np.where(down, verdicts(low, x), verdicts(high, x))


def labelled(pages: Iterable[str]) -> np.ndarray:
    """FEATURES, then 1 for article text, of all blocks of pages whose article blocks begin with MARK."""
    rows = []
    for page in pages:
        found = blocks(page)
        marked = [b[0].startswith(MARK) for b in found]
        plain = [(b[0], b[1] - m, *b[2:]) for b, m in zip(found, marked, strict=True)]
        rows.append(np.column_stack((features(plain), np.array(marked, dtype=np.float64))))
    return np.concatenate(rows)


LABELLED = labelled(_labelled_pages())
TREE = grow(LABELLED)


def main_text(page: str, tree=TREE) -> str:
    """The article's text: the blocks the tree accepts, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b[0] for b, ok in zip(found, verdicts(tree, features(found)).tolist(), strict=True) if ok)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in slices(batch, "h"):
                texts = [main_text(r.decode("utf-8", "replace")) if r else "" for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").slice(at, len(raw)), batch.column("u").slice(at, len(raw)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col(id_column).cast("long").alias("i"), F.col(url_column).cast("string").alias("u"), F.col(html_column).alias("h")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
