"""Main text of web pages by tree scoring.

A page is parsed to a tree. Every paragraph passes points - one, one per comma, up to three for its length - to its
ancestors: all to the parent, half to the grandparent, a third over the level to those above. A container's points are
discounted by its link density, the best one is kept together with the siblings that score alike or read as prose and
the headings and lists next to it, and it is widened to the article or main element around it, to a main only if that holds more than its article.

Menus, page headers, footers, sidebars, adverts, notices, forms and reader comments are left out: by element or role, or
where a word of the class, id or label of a block container says so; if other words stand beside it, the container's share
of the page's text and a heading that reads as its id can speak against it. Comments are known by the heading over them, too,
and by blocks that each tell who wrote them and when. Names that are topics as well (legal, discussion, search) only count
for containers with little text of their own, and a form only if most of the page's text lies outside it. Headings, paragraphs and inline elements are never left out by a name. Blocks that are mostly links are left out
outside of article and main only. Text is never cut.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, table, together

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
QUOTE_OR_END = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open ones of the second set, up to an element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
} | {h: (set(HEADINGS), {"article", "div", "section", "body", "main", "td"}) for h in HEADINGS}
SCOPE = frozenset("table td th button caption html object".split())

#: Elements and roles that hold no main text.
OUT = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input label legend iframe object embed applet svg canvas "
    "audio video map dialog menu noembed noframes xmp datalist".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())

#: Words of class or id that name reader comments; those that name what is never an article; those that are topics too.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menubar sidebar sidenav masthead topbar ad ads adv advert adverts advertisement advertising adslot adsense sponsored "
    "outbrain taboola cookie cookies gdpr consent popup lightbox newsletter signup signin paywall breadcrumb breadcrumbs pagination pager toolbar skiplink footer".split()
)
TOPIC_WORDS = frozenset(
    "menu side aside rail foot header banner sponsor promo promotion promoted notice notices notification alert modal overlay dialog subscribe "
    "subscription login register share sharing social related recommended recommendations widget widgets skip copyright legal disclaimer search form "
    "hidden reply replies respond responses discussion reactions".split()
)
CONTENT_WORDS = frozenset("article content main body post entry story text page".split())
#: With these words a header is the title of the text.
TITLED_WORDS = frozenset("article post entry story".split())
#: Words that say nothing about what a container holds; a name counts only if the rest of it are such words.
PLAIN_WORDS = CONTENT_WORDS | frozenset(
    "site global top bottom left right primary secondary wrapper wrap container inner outer box bar area section block list item items link links button "
    "buttons btn icon icons row col column panel group module component region zone slot unit holder wp td js mobile desktop sticky fixed thread new to the".split()
)
#: Topics of which one word says enough, whatever the words beside it, where a container holds no text to speak of.
ONE_WORD = frozenset("banner promo subscribe sharing share related recommended overlay modal".split())
#: Headings over reader comments, and parts of a comment: who wrote it, and when.
COMMENTS_HEADING = re.compile(r"(?:\d+ )?(?:(?:reader|user) )?(?:comments?|responses|replies|join the discussion|leave a (?:comment|reply))(?: \d+)?")
WHO, WHEN = re.compile(r"author|avatar|commenter|user-?name|vcard|byline", re.I), re.compile(r"date|time|ago\b", re.I)
#: How surely a container is left out: reader comments, other parts that are no article, forms, names that are topics too.
COMMENTS, SURE, FORM, TOPIC = 4, 3, 2, 1
#: Paragraph points from which a container with a topic's name is text, and the share of the page left that undoes SURE.
TEXT_POINTS, LEAST_LEFT = 5.0, 0.1
#: The share of a main's paragraph points with which its article is the main text.
NEARLY_ALL = 0.8
CONTROLS = frozenset("input textarea select button form".split())
WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")

CONTAINER_POINTS = {"article": 10, "main": 8, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "li": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)
LEVELS = 5

#: Blocks that are judged by their links as one, not by each of their items.
LINK_BLOCKS = frozenset("ul ol menu dir dl table div section details fieldset center address figure".split())
LISTS = frozenset("ul ol dl table pre blockquote figure".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "length", "linked", "commas", "points", "blocks", "total", "mark", "loose", "names", "holds", "signs")

    def __init__(self, tag: str, parent: Node | None, out: bool = False) -> None:
        self.tag, self.parent, self.kids, self.out = tag, parent, [], out
        self.length = self.linked = self.commas = self.blocks = 0
        self.points = self.total = 0.0
        self.mark, self.loose, self.names, self.holds, self.signs = 0, False, (), 0, 0


def is_out(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element, by its tag, role or hiding, is not part of a main text."""
    if tag in OUT or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    lower = attributes.lower()
    if not any(k in lower for k in ("role", "hidden", "style")):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "role" and value.lower() in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def marked(tag: str, attributes: str) -> tuple[int, bool, tuple[str, ...]]:
    """What the names of a block container (or of a skip link) say it is, 0 for nothing; whether other words stand in that name
    too, so that its text is asked as well; and its id's words."""
    mark, loose, own = FORM if tag in ("form", "fieldset") else 0, False, ()
    if tag not in BLOCK and tag != "a" or tag in HEADINGS or tag in ("p", "body", "article", "main") or not attributes:
        return mark, loose, own
    lower = attributes.lower()
    if "class" not in lower and "id" not in lower and "aria-label" not in lower:
        return mark, loose, own
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "aria-label"):
            continue
        for token in html.unescape(value.strip("\"'")).split():
            words = tuple(w.lower() for w in WORD.findall(token))
            if name == "id":
                own = words
            if tag == "a" and not {"skip", "skiplink"} & set(words):
                continue
            plain = all(w in PLAIN_WORDS or w in TOPIC_WORDS or w in OUT_WORDS or w in COMMENT_WORDS or len(w) == 1 for w in words)
            found = 0
            if COMMENT_WORDS.intersection(words):
                found = COMMENTS
            elif OUT_WORDS.intersection(words):
                found = SURE
            elif (TOPIC_WORDS if plain else ONE_WORD).intersection(words) - ({"header"} if TITLED_WORDS.intersection(words) else set()):
                found = TOPIC
            if (found, plain) > (mark, not loose):
                mark, loose = found, not plain
    return mark, loose and mark != FORM, own


def sign_of(tag: str, attributes: str) -> int:
    """Whether an element tells who wrote something (1) or when (2)."""
    if not attributes:
        return 2 * (tag == "time")
    said = " ".join(v for n, v in ATTRIBUTE.findall(attributes) if n.lower() in ("class", "rel", "itemprop", "datetime")) if "=" in attributes else ""
    return (WHO.search(said) is not None) + 2 * (tag == "time" or WHEN.search(said) is not None)


class Stack:
    """The open elements, with the places of each tag, of blocks and of scopes, so that nothing is looked for step by step."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.blocks = [root], {}, []

    def last(self, tags) -> int:
        """The place of the innermost open element of the tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """End the element at a place and all inside it."""
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()


def parse(page: str) -> list[Node]:
    """The elements of a page in document order, the first being a root that the page lies in.

    Every part of the page is passed over once or twice, however deep its elements nest and whatever is left unclosed.
    """
    root = Node("#root", None)
    nodes, stack = [root], Stack(root)
    at = 0
    spent: set[str] = set()  # quotation marks that do not occur any more
    quoted = True

    def tag_end(at: int) -> int:
        """Where the tag ends whose attributes begin here; after a tag that quotes swallow, quotes count for nothing."""
        nonlocal quoted
        start = at
        while quoted:
            m = QUOTE_OR_END.search(page, at)
            if m is None:
                quoted = False
            elif m[0] == ">":
                return m.end()
            else:
                close = -1 if m[0] in spent else page.find(m[0], m.end())
                if close < 0:
                    spent.add(m[0])
                at = m.end() if close < 0 else close + 1
        return page.find(">", start) + 1

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            break
        end = tag_end(m.end()) if m[2] else m.end()
        if not end:  # no tag ends any more: the rest is text
            break
        if m.start() > at:
            stack.nodes[-1].kids.append(page[at : m.start()])
        at = end
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            place = stack.last((tag,))
            # an inline end tag does not reach out of its block
            if place and (tag in BLOCK or not stack.blocks or stack.blocks[-1] < place):
                stack.close(place)
            continue
        if tag in BLOCK:
            place = stack.last(("p",))
            if place > stack.last(SCOPE):
                stack.close(place)
        if tag in CLOSES:
            ends, until = CLOSES[tag]
            place = stack.last(ends)
            if place > stack.last(until):
                stack.close(place)
        up = stack.nodes[-1]
        node = Node(tag, up, up.out or is_out(tag, attributes, stack.last(("article", "main")) > 0))
        node.mark, node.loose, node.names = marked(tag, attributes)
        node.signs = sign_of(tag, attributes)
        up.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node)
    if at < len(page):
        stack.nodes[-1].kids.append(page[at:])
    return nodes


def measure(nodes: list[Node]) -> None:
    """Text length, length inside links, commas, block children and paragraph points of every element, from the leaves up."""
    for node in reversed(nodes):
        node.length = node.linked = node.commas = node.blocks = 0
        node.total = 0.0
        if node.out:
            continue
        for kid in node.kids:
            if isinstance(kid, str):
                text = kid.strip()
                node.length += len(text)
                node.commas += text.count(",") + text.count("，") + text.count("、")
            elif not kid.out:
                node.length += kid.length
                node.linked += kid.linked
                node.commas += kid.commas
                node.blocks += kid.blocks + (kid.tag in BLOCK)
                node.total += kid.total
        if node.tag == "a":
            node.linked = node.length
        node.total += paragraph_points(node)


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def is_paragraph(node: Node) -> bool:
    """Whether it is a block of text without blocks in it."""
    return node.tag in BLOCK and not node.blocks and node.tag not in HEADINGS


def paragraph_points(node: Node) -> float:
    """The points of a paragraph, one for loose text of 25 characters among blocks, else none."""
    if node.out or not node.length:
        return 0.0
    if is_paragraph(node):
        return (1 + node.commas + min(node.length / 100, 3)) * (1 - density(node))
    return float(node.blocks > 0 and any(isinstance(k, str) and len(k.strip()) >= 25 for k in node.kids))


def inside(node: Node) -> Iterator[Node]:
    """The elements under one."""
    stack = [k for k in node.kids if isinstance(k, Node)]
    while stack:
        kid = stack.pop()
        yield kid
        stack += [k for k in kid.kids if isinstance(k, Node)]


def words_of(node: Node) -> tuple[str, ...]:
    text = "".join(k for n in (node, *inside(node)) for k in n.kids if isinstance(k, str))
    return tuple(w.lower() for w in WORD.findall(html.unescape(text)))


def named_by_heading(node: Node) -> bool:
    """Whether the first heading reads as the id, as generated anchors of an article's sections do."""
    first = next((k for k in node.kids if isinstance(k, Node)), None)
    return first is not None and first.tag in HEADINGS and bool(node.names) and words_of(first) == node.names


def note_held(nodes: list[Node]) -> None:
    """Whether elements hold an article or main (1), and controls or comments (2), left out ones included; and who and when."""
    for node in reversed(nodes):
        own = (node.tag in ("article", "main")) + 2 * (node.tag in CONTROLS or node.mark == COMMENTS)
        if node.parent is not None:
            node.parent.holds |= node.holds | own
            node.parent.signs |= node.signs


def comment_parts(nodes: list[Node]) -> list[Node]:
    """Containers that are reader comments by what they hold: those after a heading that says so, and those of two alike blocks or
    more of which each tells who wrote it and when."""
    found = []
    for node in nodes:
        if node.out or node.parent is None:
            continue
        if node.tag in HEADINGS and COMMENTS_HEADING.fullmatch(" ".join(re.findall(r"[a-z]+|\d+", html.unescape("".join(k for n in (node, *inside(node)) for k in n.kids if isinstance(k, str))).lower()))):
            up = node.parent
            kids = [k for k in up.kids if isinstance(k, Node)]
            rest = kids[kids.index(node) + 1 :]
            found += [node, *itertools.takewhile(lambda k: k.tag not in HEADINGS, rest)] if up.tag in ("article", "main", "body") or kids[0] is not node else [up]
        elif node.tag in ("ol", "ul", "div", "section"):
            kids = [k for k in node.kids if isinstance(k, Node) and k.tag in BLOCK and not k.out]
            if len(kids) > 1 and all(k.tag == kids[0].tag and k.signs == 3 and k.tag in ("li", "div", "article", "section") for k in kids):
                found.append(node)
    return found


def is_text(node: Node, page: float) -> bool:
    """Whether a form, or a container with a topic's name, holds text of the page, whose paragraph points are given."""
    if node.total > page / 2 or node.mark == FORM:
        return node.total > page / 2 or bool(node.holds & 1)
    if density(node) > 0.25 or node.holds & 2:
        return False
    headed = any(isinstance(k, Node) and k.tag in HEADINGS for k in node.kids)
    return node.total >= TEXT_POINTS or node.total > 0 and headed


def leave_out(nodes: list[Node]) -> None:
    """Leave out marked containers: first what surely is no article, then forms and topics by their share of the rest."""

    def apply(drop: frozenset[int]) -> list[Node]:
        gone = []
        for node in nodes:
            if node.out:
                continue
            if node.parent is not None and node.parent.out or id(node) in drop:
                node.out = True
                gone.append(node)
        if gone:
            measure(nodes)
        return gone

    note_held(nodes)
    measure(nodes)
    whole = nodes[0].total

    def told(node: Node) -> bool:
        """Whether a name that holds other words too is to be taken at its word: its text does not speak against it."""
        if node.total > whole / 2 or node.holds & 1 or named_by_heading(node):
            return False
        return node.mark == COMMENTS or node.total < TEXT_POINTS or density(node) > 0.25 or bool(node.holds & 2)

    for mark, least in ((COMMENTS, 0.0), (SURE, LEAST_LEFT)):
        before = nodes[0].total
        gone = apply(frozenset(id(n) for n in nodes if n.mark == mark and (told(n) if n.loose else not (mark == SURE and named_by_heading(n)))))
        if gone and before >= TEXT_POINTS and nodes[0].total <= least * before:
            for node in gone:
                node.out = False
            measure(nodes)
    page = nodes[0].total
    apply(frozenset(id(n) for n in comment_parts(nodes) if n.total <= page / 2 and not n.holds & 1))
    apply(frozenset(id(n) for n in nodes if n.mark in (FORM, TOPIC) and not n.out and not named_by_heading(n) and not is_text(n, page)))


def score(nodes: list[Node]) -> dict[int, Node]:
    """Pass the paragraphs' points up; returns the containers that got any."""
    containers: dict[int, Node] = {}
    for node in nodes:
        points = paragraph_points(node)
        own = is_paragraph(node)
        if node.out or not node.length or not (own or points):
            continue
        up, level = (node.parent if own else node), 0
        while up is not None and level < LEVELS:
            if id(up) not in containers:
                containers[id(up)] = up
                up.points = CONTAINER_POINTS.get(up.tag, 0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    return containers


def choose(nodes: list[Node]) -> list[Node]:
    """The elements whose text is the main text, in page order."""
    containers = score(nodes)
    if not containers:
        return [nodes[0]]
    value = {k: n.points * (1 - density(n)) for k, n in containers.items()}
    best = containers[max(value, key=value.get)]
    up, article = best, None
    while up is not None:  # the outermost article or main is the whole of it, or the article that holds nearly all of that
        if up.tag in ("article", "main"):
            best, article = up, up if up.tag == "article" else article
        up = up.parent
    if article is not None and article.total >= NEARLY_ALL * best.total:
        best = article
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, 0.2 * value.get(id(best), 0.0))
    kept: list[Node] = []
    ahead: list[Node] = []  # headings, kept if what they head is
    for kid in best.parent.kids:
        if kid is best:
            kept += [*ahead, kid]
            ahead = []
        elif isinstance(kid, Node) and not kid.out and kid.length and kid.tag in HEADINGS:
            ahead.append(kid)
        elif isinstance(kid, Node) and not kid.out and kid.tag in BLOCK:
            prose = kid.tag == "p" and (kid.length > 80 and density(kid) < 0.25 or 0 < kid.length <= 80 and not kid.linked and best.tag not in ("article", "main"))
            alike = value.get(id(kid), 0.0) >= least and density(kid) < 0.5 and (kid.tag == best.tag or best.tag not in ("article", "main"))
            listed = kid.tag in LISTS and kid.length and density(kid) < 0.25
            if prose or alike or listed:
                kept += [*ahead, kid]
            if kid.length:
                ahead = []
    return kept


def blocks(top: Node) -> list[str]:
    """The blocks of text under an element, in page order, without parts that are out or mostly links."""
    found: list[str] = []
    held: list[str] = []
    up = top
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    whole = up is not None

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append(text)

    stack: list[Node | str | None] = [top]
    while stack:
        kid = stack.pop()
        if kid is None:
            close()
        elif isinstance(kid, str):
            held.append(html.unescape(kid))
        elif not kid.out:
            block = kid.tag in BLOCK
            if kid is not top and not whole and kid.tag in LINK_BLOCKS and kid.linked and density(kid) > 0.5:
                continue
            if block:
                close()
                stack.append(None)
            elif kid.tag == "br":
                held.append(" ")
            stack += reversed(kid.kids)
    close()
    return found


def main_text(page: str | None) -> str:
    """The main text of a page: blocks of single-spaced text joined by an empty line; empty for null or no text."""
    if not page:
        return ""
    nodes = parse(page)
    leave_out(nodes)
    return "\n\n".join(b for top in choose(nodes) for b in blocks(top))


def extract_main_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` (its code points) added or replaced; every other column stays.

    Null, empty and text-less pages give an empty text and 0. Pages are read whole at any length; repeated rows give
    repeated results and an empty table an empty one. Columns are matched by their exact names.
    """
    df, back = apart(df, html_col, "text", "n_chars")
    text = free_name(df, "main_text")

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch.tolist()], dtype=object)

    kept = [c for c in df.columns if c not in ("text", "n_chars")]
    found = df.select("*", extract(html_col).alias(text))
    return together(found.select(*[F.col(c) for c in kept], F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars")), back)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


SQL: dict[str, str] = {}
