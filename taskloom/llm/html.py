"""Main text of web pages by tree scoring (operator 3).

The markup becomes a tree (tags may be left open). Subtrees that are boilerplate
by their tag or role are cut off. Each paragraph earns points for its length and
commas, discounted by the share of link text, and passes them to its ancestors,
less with each level. An element whose class or id has a word of boilerplate is
dropped after that, unless it holds an article or main element or most of the
page's points; a word whose elements hold most of them together marks nothing.
The best container is kept, or the article or main element around it, or else
the smallest one around it that holds most of the points, with all of its
siblings that are not mostly links. The text of what is kept is joined block by
block; nothing else is dropped and nothing is cut.

A page is one row and is handled alone, so the memory of a task is that of a
batch of pages. Defined results: null, empty and markup-only pages have an empty
text; null ids and urls and repeated rows are returned as they come; other
columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from taskloom.llm.words import batch_of, slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-hidden|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

# Elements by their meaning in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CUT = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "template", "svg", "canvas", "object", "applet", "audio", "video",
       "dialog", "menu", "head", "math", "map"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
# Words of class and id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
         "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "comment", "comments",
         "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "share", "sharing",
         "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "pagination", "pager", "toolbar", "skip",
         "copyright", "disclaimer"}
# Words that say of a class what state or neighbours an element has, and words that make a header one of the text.
STATES = {"has", "with", "no", "without", "open", "closed", "enabled", "disabled"}
TEXTS = {"article", "post", "entry", "story", "content", "section"}
HEADERS = {"header", "masthead", "banner"}
# Words that inside a text mark a part of it.
PARTS = HEADERS | {"notice", "alert", "disclaimer"}
# Discussions may be longer than the text they are about.
THREADS = {"comment", "comments", "disqus", "replies", "respond"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHOLE = {"html", "body", "article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
            "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}
#: Levels that a paragraph's points climb.
LEVELS = 6
#: Points of text outside a discussion that let the discussion go even if it is longer.
ENOUGH = 3.0
#: Points of a short paragraph: what holds less is no text that a name could hide.
LEAST = 2.0
#: Share of link text from which a sibling is a list of links.
LINKS = 1 / 3


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "names", "inside", "points", "chars", "linked", "mass", "whole")

    def __init__(self, tag: str, parent: Node | None, cut: bool, names: frozenset | set = frozenset()):
        self.tag, self.parent, self.cut, self.names = tag, parent, cut, names
        self.children: list[Node | str] = []
        self.points = self.chars = self.linked = self.mass = 0.0
        self.whole = tag in ("article", "main")
        # in an article or main element
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def boilerplate(tag: str, found: dict[str, str], parent: Node) -> bool:
    if tag in CUT:
        return True
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    return tag == "header" and not (parent.inside or parent.tag in ("article", "main"))


def names_of(tag: str, found: dict[str, str], parent: Node) -> set[str]:
    """Words of class and id that mark the element as boilerplate."""
    out = set()
    if tag in WHOLE or tag == "header":
        return out
    for token in (found.get("class", "") + " " + found.get("id", "")).split():
        ws = [w.lower() for w in WORD.findall(token)]
        if not STATES.intersection(ws):
            hit = NAMES.intersection(ws)
            out |= hit - HEADERS if TEXTS.intersection(ws) else hit
    if out & PARTS and (parent.inside or parent.tag in ("article", "main") or (tag in PARAGRAPH or tag in HEADINGS) and parent.tag not in ("html", "body", "")):
        out -= PARTS
    return out


def tree(page: str) -> Node:
    root = node = Node("", None, False)
    at, low = 0, None
    while m := TOKEN.search(page, at):
        if m.start() > at and not node.cut:
            node.children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                # an end tag never reaches beyond the element that holds the text
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in CLOSES:
            up = node
            while up is not root and (up.tag in INLINE or up.tag == "p" or up.tag in CLOSES[tag]):
                if up.tag in CLOSES[tag]:
                    node = up.parent
                up = up.parent
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if "=" in m[3] and not node.cut else {}
        cut = node.cut or boilerplate(tag, found, node)
        child = Node(tag, node, cut, names_of(tag, found, node) if found and not cut else frozenset())
        if not child.cut:
            node.children.append(child)
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + tag, at)
            at = len(page) if end < 0 else end
            node = child
        elif tag not in VOID and not m[3].endswith("/"):
            node = child
    if at < len(page) and not node.cut:
        node.children.append(html.unescape(page[at:]))
    return root


def walk(root: Node):
    """Nodes, each after its children; without recursion, because pages may nest deeply."""
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            yield node
        else:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, Node)]


def paragraphs(nodes: list[Node]) -> list[tuple[Node, float]]:
    """Every paragraph with its points; sets chars, linked and mass (points within) of all nodes."""
    commas, out = {}, []
    for n in nodes:
        n.chars = n.linked = n.mass = 0.0
    for n in nodes:
        text = [c for c in n.children if isinstance(c, str)]
        own = sum(len(t.strip()) for t in text)
        n.chars += own
        commas[n] = commas.get(n, 0) + sum(t.count(",") + t.count("\uff0c") for t in text)
        if n.tag == "a":
            n.linked = n.chars
        direct = any(isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag in INLINE and c.chars for c in n.children)
        if n.chars and (n.tag in PARAGRAPH or n.tag in ("div", "section", "article", "main", "body", "") and direct):
            points = (1 + commas[n] + min(n.chars / 100, 3)) * (1 - n.linked / n.chars)
            n.mass += points
            out.append((n, points))
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.mass += n.mass
            n.parent.whole |= n.whole
            if n.tag in INLINE:
                commas[n.parent] = commas.get(n.parent, 0) + commas[n]
    return out


def drop_named(root: Node) -> None:
    """Take elements named as boilerplate out of the tree."""
    nodes = list(walk(root))
    paragraphs(nodes)
    # where articles hold text, a name outside of them stands
    total = sum(n.mass for n in nodes if n.tag in ("article", "main") and not n.inside)
    all_over = total == 0
    total = total or root.mass
    named = {}
    for n in nodes:
        if n.names and not n.whole:
            here = all_over or n.inside
            if here and n.mass * 2 > total and n.mass >= LEAST and not (n.names & THREADS and total - n.mass >= ENOUGH):
                n.names = frozenset()
            else:
                named[n] = n.names
    if not named:
        return
    shares, above = {}, {}
    for n in reversed(nodes):
        have, own = above.get(n.parent, frozenset()), named.get(n, frozenset())
        above[n] = have | own if own else have
        for w in own - have - THREADS if all_over or n.inside else ():
            shares[w] = shares.get(w, 0.0) + n.mass
    nothing = {w for w, mass in shares.items() if mass * 2 > total and mass >= LEAST}
    gone = set()
    for n, names in named.items():
        n.names = names if not (all_over or n.inside) else names - nothing
        if n.names:
            gone.add(n)
    for n in {n.parent for n in gone}:
        n.children = [c for c in n.children if isinstance(c, str) or c not in gone]


def scored(root: Node) -> list[Node]:
    nodes = list(walk(root))
    for n, points in paragraphs(nodes):
        up = n.parent if n.tag in PARAGRAPH else n
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points / max(1, 2 * level)
            up = up.parent
    return nodes


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    drop_named(root)
    worth = lambda n: n.points * (1 - n.linked / n.chars) if n.chars else 0.0
    best = max(scored(root), key=worth)
    if worth(best) <= 0:
        return blocks([root])
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        return blocks([up])
    while best.mass * 2 <= root.mass:
        best = best.parent
    if best.parent is None:
        return blocks([best])
    return blocks(textlike(best))


def textlike(best: Node) -> list[Node | str]:
    """The node and its siblings that are not mostly links; text and inline elements in a row count as one."""
    kept, run = [], []

    def close():
        chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in run)
        if chars and sum(x.linked for x in run if isinstance(x, Node)) < LINKS * chars:
            kept.extend(run)
        run.clear()

    for c in best.parent.children:
        if isinstance(c, str) or c.tag in INLINE and c is not best:
            run.append(c)
            continue
        close()
        if c is not best and c.names:
            continue
        if c is best or c.chars and c.linked < LINKS * c.chars or c.tag in HEADINGS:
            kept.append(c)
    close()
    return kept


def blocks(roots: list[Node]) -> str:
    out, line = [], []

    def flush():
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(roots))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        else:
            if x.tag not in INLINE:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return " ".join(out)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield batch_of(list(zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), texts, map(len, texts))), SCHEMA)

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)
