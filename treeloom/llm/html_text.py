"""Main text of web pages by scoring the containers of a page's tree."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*+\"|=\s*'[^']*+'|=)*+)>", re.S)
#: A name, and its value if it has one; names inside values are not met.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'][^\"']*[\"']?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What HTML's elements are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer frame frameset head header iframe input label math menu meter nav noembed noframes noscript object "
    "optgroup option output progress script select style svg template textarea title video xmp".split())
PARAGRAPHS = frozenset("p pre blockquote td div section article main dd li center".split())
#: An open element of the left is ended by the start of one of the right.
ENDED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"])}
#: What the contract leaves out, as a class, an id or a role names it.
PARTS = {
    "menu": "menu menubar nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar search",
    "edge": "header footer banner contentinfo",
    "side": "sidebar aside complementary related social share sharing",
    "notice": "notice notices notification notifications cookie cookies consent alert alertdialog popup modal overlay newsletter subscribe subscription signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
    "reader": "comment comments reply replies discussion"}
UNLIKELY = frozenset(w for words in PARTS.values() for w in words.split())
READERS = frozenset(PARTS["reader"].split())
#: Words of layout: the word before them says what a block is.
LAYOUT = frozenset(
    "area bar block box button buttons bottom col column container count elem element form group icon icons inner item items left link links list outer panel posts right row section "
    "slot stories text title top unit wrap wrapper".split())
#: Words by which a name speaks of something beside the block.
BESIDE = frozenset("above after before below free has is no non not of on with without".split())
LISTS = frozenset("ul ol dl dir".split())
TRUSTED = frozenset(["html", "body", "article", "main"])
BLOCK_LENGTH, COMMA, SHARE = 25, ",，、،", 0.2
#: Of the page's prose: a block with a name of UNLIKELY that holds so much, in
#: paragraphs, is the article itself; so is a form of that share. A block with
#: such a word elsewhere in its name keeps so much of its score.
WHOLE, WHOLE_FORM, DOUBT = 0.75, 0.5, 0.7


class Node:
    __slots__ = ("chars", "drop", "kids", "links", "mark", "name", "score", "up")

    def __init__(self, name, up, drop, mark=0):
        self.name, self.up, self.drop, self.mark = name, up, drop, mark
        self.kids: list = []  # strings, in page order with the nodes
        self.chars = self.links = 0
        self.score = None


#: Marks of a block: a doubt, the name of what is no article, not to be shown.
DOUBTED, NAMED, HIDDEN = 1, 2, 3


def _name(token: str) -> int:
    """What one class, id or role says: by the last word that is not layout."""
    words = [w.lower() for w in WORDS.findall(token)]
    whole = "".join(words)
    if whole in UNLIKELY:
        return HIDDEN if whole in READERS else NAMED
    if UNLIKELY.isdisjoint(words) and UNLIKELY.isdisjoint(map("".join, zip(words, words[1:], strict=False))):
        return 0
    if not BESIDE.isdisjoint(words):
        return DOUBTED
    while len(words) > 1 and words[-1] in LAYOUT and "".join(words[-2:]) not in UNLIKELY:
        words.pop()
    head = words[-1] if words[-1] in UNLIKELY else "".join(words[-2:])
    return DOUBTED if head not in UNLIKELY else HIDDEN if head in READERS else NAMED


def _marked(name: str, attributes: str) -> int:
    """The mark of a start tag, by its attributes."""
    mark = 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return mark
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return HIDDEN
        elif name in TRUSTED:
            continue
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        elif key in ("class", "id", "role"):
            mark = max([mark, *map(_name, value.split())])
    return mark


def parse(page: str) -> Node:
    """The tree of a page's block elements. Inline elements leave no node but
    mark the text in links; end tags that were left out are filled in; end tags
    without a start are passed over."""
    root = at = Node("#root", None, False)
    cut = page.rfind(">") + 1  # no tag ends beyond; one that only begins there goes
    begun = re.compile(r"<[a-zA-Z/!?]").search(page, cut)
    link, inline_drop, pos, end = 0, [], 0, begun.start() if begun else len(page)

    def put(text):
        if at.drop or inline_drop or not text:
            return
        text = html.unescape(text) if "&" in text else text
        n = len(text) - text.count(" ")
        if n or at.kids:
            at.kids.append(text)
            at.chars += n
            at.links += n if link else 0

    while pos < end:
        m = TAG.search(page, pos, cut)
        if not m:
            put(page[pos:end])
            break
        put(page[pos:m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link = 0
            if inline_drop and inline_drop[-1] == name:
                inline_drop.pop()
            elif name not in INLINE:
                up = at
                while up is not None and up.name != name:
                    up = up.up
                if up is not None and up.up is not None:
                    at, inline_drop, link = up.up, [], 0
            continue
        if name in INLINE:
            if name == "a":
                link = 1
            if inline_drop and name == inline_drop[0]:
                inline_drop.append(name)
            elif not at.drop and not inline_drop and _marked(name, m[3]) >= NAMED:
                inline_drop.append(name)
            continue
        if name in RAW:
            close = CLOSE[name].search(page, pos)
            pos = page.find(">", close.start()) + 1 or end if close else end
            continue
        if name in VOID:
            if name in ("br", "hr"):
                put("\n")
            continue
        up = at  # end what this one ends, not beyond the nearest box
        while up.up is not None and name in ENDED_BY.get(up.name, ()):
            up = up.up
        at = up
        mark = _marked(name, m[3])
        node = Node(name, at, at.drop or bool(inline_drop) or name in SKIPPED or mark == HIDDEN, mark)
        at.kids.append(node)
        if not m[3].endswith("/") or name not in ("svg", "math"):
            at = node
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes that were not dropped, parents first."""
    out = [root]
    for node in out:
        out += [k for k in node.kids if type(k) is Node and not k.drop]
    return out


def _prose(n: Node) -> int:
    """Characters outside links of a block that reads like a paragraph."""
    return n.chars - n.links if n.name in PARAGRAPHS and n.chars >= BLOCK_LENGTH else 0


def _settle(nodes: list[Node]) -> None:
    """Drop the blocks named as no article, and forms, unless the page's
    article is inside: most of its prose, in two paragraphs or more, with no
    article element elsewhere."""
    named = [n for n in nodes if n.mark == NAMED or n.name == "form"]
    if not named:
        return
    prose = {id(n): [_prose(n), int(_prose(n) > 0)] for n in nodes}
    for n in reversed(nodes):
        if n.up is not None:
            prose[id(n.up)][0] += prose[id(n)][0]
            prose[id(n.up)][1] += prose[id(n)][1]
    articles = [set(map(id, _up(n))) for n in nodes if n.name in ("article", "main") and n.chars + sum(k.chars for k in n.kids if type(k) is Node)]
    total = prose[id(nodes[0])][0]
    for n in named:
        share = WHOLE if n.mark == NAMED else WHOLE_FORM
        held, blocks = prose[id(n)]
        if total and held >= share * total and blocks >= (2 if n.mark == NAMED else 1) and all(id(n) in up for up in articles):
            n.mark = DOUBTED if n.mark == NAMED else n.mark
        else:
            n.drop = True


def _up(n):
    while n is not None:
        yield n
        n = n.up


def _text(top: list, skip) -> str:
    """Texts of the nodes in page order, without recursion, so any depth does."""
    out, stack = [], list(reversed(top))
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif not x.drop and not skip(x):
            out.append("\n")
            stack.append("\n")
            stack += reversed(x.kids)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none.

    Each paragraph passes a point, one for each comma and up to three for its
    length to its parent, half to the next ancestor and less to each further
    one, all discounted by the share of its text in links. The container with
    most points after its own discount is kept, the first of equal ones, or
    the article element round it, with the siblings that score a fifth of it
    or read like paragraphs. All its blocks are kept but those that are
    doubted by their name and mostly links, and menus before its first or,
    outside an article element, after its last paragraph: lists of two items
    or more, each mostly links.
    """
    if not page:
        return ""
    root = parse(page)
    _settle(_nodes(root))
    nodes = _nodes(root)
    own = {id(n): (n.chars, n.links) for n in nodes}
    for n in reversed(nodes):  # children come after their parents
        if n.up is not None:
            n.up.chars += n.chars
            n.up.links += n.links
    for n in nodes:
        n.score = 0.0
    for n in nodes:
        chars, links = own[id(n)]
        if n.name in PARAGRAPHS and chars >= BLOCK_LENGTH and n.up is not None:
            text = "".join(k for k in n.kids if type(k) is str)
            points = (1 + sum(text.count(c) for c in COMMA) + min(chars / 100, 3)) * (1 - links / chars)
            up, level = (n.up if n.name in ("p", "pre", "blockquote", "li", "dd", "td") else n), 1
            while up is not None and level < 6:
                up.score += points / level
                up, level = up.up, level + 1
    dense = lambda n: n.links / n.chars if n.chars else 0.0
    linked = lambda n: n.chars and n.links > 0.5 * n.chars
    doubted = lambda n: n.mark == DOUBTED and linked(n)

    def menu(n):
        items = [k for k in n.kids if type(k) is Node and not k.drop and k.chars] if n.name in LISTS and linked(n) else []
        return len(items) > 1 and all(map(linked, items))

    def shown(top, after=True):
        """Their text without what is doubted and menus at the edges."""
        order, stack = [], list(reversed(top))
        while stack:
            n = stack.pop()
            if type(n) is Node and not n.drop:
                order.append(n)
                if not menu(n):
                    stack += reversed(n.kids)
        prose = [k for k, n in enumerate(order) if n.name in PARAGRAPHS and own[id(n)][0] - own[id(n)][1] > 0 and not linked(n)]
        edge = {id(n) for k, n in enumerate(order) if menu(n) and prose and (k < prose[0] or after and k > prose[-1])}
        return _text(top, lambda n: id(n) in edge or doubted(n))

    final = {id(n): n.score * (1 - dense(n)) * (DOUBT if n.mark == DOUBTED else 1) for n in nodes}
    best = max(nodes, key=lambda n: final[id(n)])
    if final[id(best)] <= 0:
        return _text([root], lambda n: menu(n) or doubted(n))
    while best.up is not None and best.up.up is not None and final[id(best.up)] >= 0.75 * final[id(best)]:
        best = best.up
    up = best
    while up is not None and up.name != "article":
        up = up.up
    if up is not None:
        return shown([up], after=False)
    if best.up is None:
        return shown([best])
    keep, least = [], max(1.0, SHARE * final[id(best)])
    for k in best.up.kids:
        if k is best or type(k) is Node and not k.drop and (
                final[id(k)] >= least or k.name in ("p", "pre", "blockquote", "h1", "h2", "h3") and k.chars and dense(k) < 0.25):
            keep.append(k)
    return shown(keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows without the html, with text and n_chars (code points).

    Null and empty pages give the empty text; other columns, nulls in them and
    repeated rows stay, and repeated pages give the same text; columns named text or n_chars are replaced; an empty
    table gives no rows. One page is held at a time, whole.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.col(html_col).cast("string").alias("__html"), *keep)
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for b in batches:
            got = [main_text(p.as_py()) for p in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
