"""Operator 4: main text of HTML pages by tree scoring.

Tags are read once from left to right into a tree of block elements; inline tags leave no trace but
the share of link text. Paragraph-like blocks give points for their length and commas to their parent
and half as many to each next ancestor; an element's points are discounted by its link density. The best
container is kept with those of its siblings that score well or read like prose.

Elements that are furniture by their tag are left out, but for a header inside an article, which is the article's own. Lists and tables that are mostly links are
left out unless they stand right between paragraphs. Elements that only their class, id or role calls so are
left out too, unless they hold what the article begins with (the first main, h1, article or element named as content,
whichever of these the page has first in this order) and over half of the prose that no other such element holds: wrappers carry such names.
Names of states ("has-sidebar", "menu-open") say nothing, and a name that says content beside one that says furniture leaves the element to its score.

Defined results: null or empty html gives an empty text; pages of any length and depth are read whole in linear time; tags
that are cut off, never closed or closed twice are repaired as far as the tree needs; of containers with equal scores the
first in the page is best; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul"
    " button select option iframe object canvas svg video audio map".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Their content is no markup; it ends at their own end tag only.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
#: Never part of an article; a form may wrap a page, so it is judged as an element named furniture is.
FURNITURE = frozenset("head nav header footer aside menu dialog button select option fieldset search svg canvas object video audio map iframe title".split())
#: An open p ends where one of these begins; other elements end where their like begins.
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select body html article section div main".split())
_BIT = {name: 1 << k for k, name in enumerate(sorted(set().union(*LIKE.values())))}
_LIKE_BITS = {name: sum(_BIT[x] for x in likes) for name, likes in LIKE.items()}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}
#: Words in names (class, id, role, label) that mark furniture, notices, adverts and reader comments.
FURNITURE_WORD = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|notice|alert|dialog|footer|foot|footnav|header|masthead|menu|nav|navbar|navigation|newsletter|pagination|pager|popup|modal|overlay|promo\w*|"
    r"related|recommend\w*|share|sharing|social|sidebar|sidenav|skip|sponsor\w*|subscribe|subscription|toolbar|widget|contentinfo|complementary|search|login|signup|toc)\d*\Z",
    re.IGNORECASE,
)
ARTICLE = re.compile(r"article|body|content|entry|main|page|post|story|text", re.IGNORECASE)
#: First and last words of names that tell a state of the page, not what the element is.
STATE_FIRST = frozenset("has have no with without is not js show hide".split())
STATE_LAST = frozenset("open opened closed enabled disabled visible hidden active inactive on off collapsed expanded allowed layout".split())
WORD_BOUND = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their text belongs to the element around them, which is the container.
PARAGRAPHS = HEADINGS | frozenset("p pre li td blockquote dd dt".split())
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
VALUE_OR_END = re.compile(r""">|=\s*(["'])""")
SENTENCE = re.compile(r"[.!?…。]['\"”’»)]*$")
COMMAS = re.compile(r"[,،、，]")
PROSE = frozenset("p pre blockquote".split())
#: A sibling joins the best container from this share of its score.
SIBLING_SHARE = 0.2
LINKY = 0.5
#: What of its points an element hands to the one around it.
HANDED_ON = 0.5
#: An element named furniture with more than this share of the page's prose may be a wrapper.
WRAPPER_SHARE = 0.5


class Node:
    __slots__ = ("bonus", "chars", "children", "drop", "in_p", "like", "links", "name", "named", "parent", "prose", "score")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, named: bool = False, bonus: float = 0.0):
        self.name, self.parent, self.drop, self.named, self.bonus = name, parent, drop, named, bonus
        self.children: list = []  # nodes, and texts as (string, link characters)
        self.score = 0.0
        self.chars = self.links = self.prose = 0
        # Whether a p, and which elements of LIKE, are open around here within the scope: what a start tag may close.
        scope = name in SCOPES or parent is None
        self.in_p = name == "p" or (not scope and parent.in_p)
        self.like = 0 if scope else parent.like | _BIT.get(name, 0)


def _names(value: str) -> tuple[bool, bool]:
    """Whether a class, id, role or label has a name of furniture, and one of an article."""
    furniture = article = False
    for name in value.split():
        words = [w for w in WORD_BOUND.split(name) if w]
        if not words or words[0].lower() in STATE_FIRST or words[-1].lower() in STATE_LAST:
            continue
        if any(map(FURNITURE_WORD.match, words)):
            furniture = True
        elif ARTICLE.search(name):
            article = True
    return furniture, article


def _tag_end(page: str, at: int) -> int:
    """The place after the tag that begins at ``at``; quotes may hold a '>'. The end of the page if it is cut off."""
    close = page.find(">", at)
    if close < 0:
        return len(page)
    inner = page[at:close]
    if '"' not in inner and "'" not in inner:
        return close + 1
    while m := VALUE_OR_END.search(page, at):
        if not m[1]:
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if not at:  # never closed: not a quote
            end = page.find(">", m.end())
            return len(page) if end < 0 else end + 1
    return len(page)


def parse(page: str) -> Node:
    """The tree of block elements with their texts."""
    root = Node("#root", None)
    node, pieces, in_link, linked = root, [], 0, 0
    at, size = 0, len(page)
    open_of: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                node.children.append((text, min(linked, len(text))))
            pieces, linked = [], 0

    def text(t: str) -> None:
        nonlocal linked
        pieces.append(t)
        if in_link:
            linked += len(t.strip())

    def close(names: frozenset[str] | set[str]) -> None:
        """Closes the nearest open element of these names with all in it; there is one."""
        nonlocal node
        while True:
            open_of[node.name] -= 1
            found, node = node.name in names, node.parent
            if found:
                return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:  # a bogus comment
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        name = m[0].lower()
        at = _tag_end(page, m.end())
        if closing:
            if name == "a":
                in_link = 0
            elif name in BLOCKS:
                flush()
                if open_of[name]:
                    close({name})
                in_link = 0
            elif name == "br":
                text(" ")
            continue
        if name in RAW:
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end:
                at = end.start()
            else:
                endless.add(name)
                at = size if name in ("script", "style") else at
            if name not in BLOCKS:
                if end:
                    at = _tag_end(page, end.end())
                continue
        if name == "a":
            in_link = 1
            continue
        if name == "br":
            text(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if name in PARAGRAPH_ENDS and node.in_p:
            close({"p"})
        if node.like & _LIKE_BITS.get(name, 0):
            close(LIKE[name])
            while node.name in LIKE[name]:
                close(LIKE[name])
        if name in VOID:
            continue
        # A header inside an article is the article's own: its title.
        drop, named, bonus = name in FURNITURE and not (name == "header" and open_of["article"]), name == "form", 0.0
        tag = page[m.end() : at]
        if "=" in tag or "hidden" in tag:
            article = False
            for key, value in ATTRIBUTE.findall(tag):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role", "aria-label"):
                    x, y = _names(value)
                    named, article = named or x, article or y
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    drop = True
            if name in ("body", "html", "article", "main") and article or name in ("body", "html"):
                named = False
            bonus = 5.0 if article and not named else 0.0
            named = named and not (article and name != "form")
        bonus += 10.0 if name in ("article", "main") and not named else 0.0
        child = Node(name, node, drop, named, bonus)
        node.children.append(child)
        open_of[name] += 1
        node = child
        in_link = 0
    flush()
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Kept nodes, parents first, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]


def _drop_named(root: Node) -> None:
    """Drops the elements named furniture, but for wrappers of the article."""
    nodes = list(_walk(root))
    if not any(n.named for n in nodes):
        return
    kinds = (lambda n: n.name == "main", lambda n: n.name == "h1", lambda n: n.name == "article", lambda n: n.bonus > 0)
    starts: list[Node | None] = [None] * len(kinds)
    for node in nodes:
        node.prose = sum(len(c[0]) - c[1] for c in node.children if not isinstance(c, Node))
        if not node.named:
            for k, fits in enumerate(kinds):
                if starts[k] is None and fits(node):
                    starts[k] = node
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.prose += node.prose
    around, up = set(), next((s for s in starts if s is not None), None)  # what the article begins with, and all around it
    while up is not None:
        around.add(up)
        up = up.parent
    # The prose outside such elements is what a wrapper has to hold the larger part of: long comments do not count.
    inside, others = set(), 0
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
        elif node.named and node not in around:
            inside.add(node)
            others += node.prose
    for node in nodes:
        node.drop = node.drop or (node.named and not (node in around and node.prose > WRAPPER_SHARE * (root.prose - others)))


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    _drop_named(root)
    nodes = list(_walk(root))
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node):
                continue
            text, links = c
            node.chars += len(text)
            node.links += links
            points = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - links / len(text))
            holder = node.parent if node.name in PARAGRAPHS else node
            holder.score += points
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.score += HANDED_ON * node.score
            node.parent.chars += node.chars
            node.parent.links += node.links
    final = {}
    for node in nodes:
        density = node.links / node.chars if node.chars else 0.0
        final[node] = (node.score + node.bonus * bool(node.score)) * (1 - density)
    boxes = [n for n in nodes if n.score > 0 and n.name != "p" and n.name not in HEADINGS]
    if not boxes:
        return ""
    best = max(boxes, key=final.__getitem__)
    chosen = [best]
    if best.parent is not None:
        need = max(1.0, SIBLING_SHARE * final[best])
        chosen = []
        for c in best.parent.children:
            if c is best:
                chosen.append(c)
            elif isinstance(c, Node):
                if not c.drop and c.chars and c.links < LINKY * c.chars:
                    prose = c.name == "p" and c.links < 0.25 * c.chars
                    # A block of nothing but a sentence, inside a wrapper, is judged as bare text there is.
                    plain = best.parent.name not in ("body", "html", "#root") and not c.links and not any(isinstance(x, Node) for x in c.children) and SENTENCE.search(c.children[-1][0])
                    if c.name in HEADINGS or prose or plain or final[c] >= need:
                        chosen.append(c)
            elif best.parent.name not in ("body", "html", "#root") and c[1] == 0 and SENTENCE.search(c[0]):
                chosen.append(c)
    return " ".join(_texts(chosen))


def _linky(c: Node) -> bool:
    return c.name in ("ul", "ol", "table", "div", "section") and c.chars > 0 and c.links > LINKY * c.chars


def _amid_prose(c: Node, before: object, after: object) -> bool:
    """A list or table right between paragraphs, or a heading and a paragraph, is part of what they tell, even of links alone."""
    prose = lambda x, names: isinstance(x, Node) and not x.drop and x.name in names and x.chars > 0 and x.links <= LINKY * x.chars
    return c.name in ("ul", "ol", "table") and prose(before, PROSE | HEADINGS) and prose(after, PROSE)


def _texts(chosen: list) -> Iterator[str]:
    stack = [c for c in reversed(chosen) if not (isinstance(c, Node) and _linky(c))]
    while stack:
        c = stack.pop()
        if not isinstance(c, Node):
            yield c[0]
        elif not c.drop:
            inner = c.children
            stack += [x for k, x in reversed(list(enumerate(inner))) if not (isinstance(x, Node) and _linky(x) and not _amid_prose(x, inner[k - 1] if k else None, inner[k + 1] if k + 1 < len(inner) else None))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: one map over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
