"""Main text of web pages by composite text density.

Every page becomes a tree of elements without furniture (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments). Some elements always are furniture. Words of
class, id and role only raise a suspicion: a suspect is furniture where over half of its text is links, or where it is
a thread of comments. A word that hardly names a subject (not in ``LOOSE``), or any as a role, is sure: such
a part of an article is furniture too, unless it is over half of it, or a header that holds its heading. Other suspects do not
compete outside articles, but come back with the chosen elements: inside the heart and elsewhere all but sure ones, in
the heart also a sure one of over half of its characters. Headings are no suspects. Each element then gets its characters per tag, adjusted for links, and each
element's density sum is that of its children. All elements but those inside a line compete: the one of the
highest sum is the heart of the page. The text is the heart, the innermost article around it, and every
element around that, up to the body, that is at least as dense as the body: the threshold on the path to
the body. Beside that path, elements as dense as the body are taken as well, and parts alike (the same element and
the same words of class, id and role) with at least ``TWIN`` of the sum. Nothing more is dropped inside.

Blocks are block-level elements; white space inside a block, line breaks included, is one space.

Cases: a null, empty or text-free page gives the empty string; broken markup is read as far
as it goes (open elements end with the page, a cut tag is dropped); equal sums go to the element
that comes first; repeated rows give equal texts; an empty table gives an empty result.
Work is one row at a time with one tree in memory, so pages need no shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import e as EULER
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import whole_text, with_fields

# Fixed values of the language HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
SCOPES = frozenset("article aside body blockquote details div dl fieldset figure footer form header html li main nav ol section table td th ul".split())
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}

#: Elements that never belong to the main text.
FURNITURE = frozenset("""head title script style noscript template nav header footer aside form menu dialog button input
select textarea label iframe object embed svg canvas audio video map""".split())
#: Words of class, id and role that mark furniture.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle alert aside banner breadcrumb breadcrumbs
consent contentinfo cookie cookies copyright disclaimer dialog footer form gdpr header login masthead menu menubar modal nav navbar
navigation newsletter notice notification notifications overlay pager pagination paywall popup promo promoted promotion related search share
sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets""".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: Those that may as well name a part of a text.
LOOSE = frozenset("""alert copyright disclaimer discussion form navigation notice notification notifications promotion related responses
search share sharing social tags""".split())
SURE = (MARKS | COMMENTS) - LOOSE
THREAD = COMMENTS - LOOSE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WORDS = re.compile(r"[a-z]+")
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


#: Elements inside a line; they never compete.
PHRASING = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup
time tt u var""".split())
TWIN = 0.2


class Element:
    __slots__ = ("tag", "words", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "kept", "aside", "role", "full")

    def __init__(self, tag: str, words: frozenset, parent: "Element | None", role: frozenset = frozenset()):
        self.tag, self.words, self.parent, self.role, self.children = tag, words, parent, role, []


class TreeBuilder(HTMLParser):
    """Builds a tree from markup as it is found; elements that must not nest end each other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("html", frozenset(), None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head") and tag == "html":
            return
        if tag in BLOCKS:
            self._leave({"p"}, SCOPES)
        if tag in ENDS_SIBLING:
            self._leave(ENDS_SIBLING[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in WORDS.findall(v.lower()))
        role = frozenset(w for k, v in attrs if k == "role" and v for w in WORDS.findall(v.lower()))
        element = Element(tag, words, self.here, role)
        self.here.children.append(element)
        if tag not in VOID:
            self.here = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _leave(self, tags, stop):
        """Ends the innermost open element among ``tags``, unless one of ``stop`` lies between."""
        at = self.here
        while at is not None and at.tag not in tags:
            if at.tag in stop:
                return
            at = at.parent
        if at is not None and at.parent is not None:
            self.here = at.parent

    def handle_endtag(self, tag):
        self._leave({tag}, frozenset() if tag in SCOPES else SCOPES - {tag})

    def handle_data(self, data):
        self.here.children.append(data)


def depth_first(root: Element):
    """Elements in page order, without recursion: pages may nest deeper than Python allows."""
    stack = [root]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(x for x in reversed(at.children) if isinstance(x, Element))


def without_furniture(root: Element) -> Element:
    """Takes furniture and suspects out of the tree; an element around an article or main part stays.

    ``kept`` are the children without furniture, ``aside`` tells suspects, which may come back.
    """
    order = list(depth_first(root))
    holds, inside = set(), {}  # inside: the innermost article around an element
    for at in order:
        part = at.tag in ("article", "main") and not at.words & COMMENTS
        if part and at.tag == "article":
            inside[id(at)] = at
        elif at.parent is not None and id(at.parent) in inside:
            inside[id(at)] = inside[id(at.parent)]
        if part:
            while at is not None and id(at) not in holds:
                holds.add(id(at))
                at = at.parent
    suspects = []
    for at in order:
        at.aside = False
        if at.parent is None or at.tag in ("html", "body"):
            continue
        marked = at.words & COMMENTS and at.tag != "main" and id(at) not in holds
        marked = marked or at.words & MARKS and id(at) not in holds
        if at.tag in FURNITURE and (at.tag not in ("header", "form") or id(at) not in holds):
            at.tag = ""
        elif marked and at.tag not in HEADINGS:
            suspects.append(at)
    for at in reversed(order):
        inner = [x for x in at.children if isinstance(x, Element) and x.tag]
        at.own = sum(len("".join(x.split())) for x in at.children if isinstance(x, str))
        at.full = at.chars = at.own + sum(x.chars for x in inner)
        at.link_chars = at.chars if at.tag == "a" else sum(x.link_chars for x in inner)
    threads = comment_threads(suspects) if suspects else set()
    for at in suspects:
        if 2 * at.link_chars > at.chars or id(at) in threads:
            at.tag = ""
        else:
            article = inside.get(id(at))
            at.aside = article is None or is_sure(at) and 2 * at.full <= article.full
    for at in order:
        at.kept = [x for x in at.children if not isinstance(x, Element) or x.tag]
        at.children = [x for x in at.kept if not isinstance(x, Element) or not x.aside]
    return root


def is_sure(at: Element) -> bool:
    """Whether a word of a suspect, or its role, says furniture whatever it holds; comments of readers are blocks."""
    words = at.words & SURE
    if at.tag not in BLOCKS:
        words -= THREAD
    if words == {"header"} and any(x.tag in HEADINGS for x in depth_first(at)):
        words = frozenset()
    return bool(words or at.role & MARKS)


def comment_threads(suspects: list[Element]) -> set[int]:
    """Suspects that are comments of readers: articles, and blocks with such a block in or beside them."""
    marked = [x for x in suspects if x.words & COMMENTS and x.tag in BLOCKS]
    found = {id(x) for x in marked if x.tag == "article"}
    around, beside = {id(x): x for x in marked}, {}
    for x in marked:
        if x.words & THREAD:
            beside.setdefault(id(x.parent), []).append(id(x))
    found.update(i for same in beside.values() if len(same) > 1 for i in same)
    seen = set()
    for x in marked:
        at = x.parent if x.words & THREAD else None
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            if id(at) in around:
                found.add(id(at))
            at = at.parent
    return found


def restore(element: Element, whole: bool) -> None:
    """Brings suspects back into a chosen element: those that are not sure, in the ``whole`` one also most of its text."""
    for at in depth_first(element):
        for x in at.kept:
            if isinstance(x, Element) and x.aside and (whole and 2 * x.full > element.full or not is_sure(x)):
                x.aside = False
        at.children = [x for x in at.kept if not isinstance(x, Element) or not x.aside]


def measure(root: Element) -> list[Element]:
    """Characters, tags and densities of every element; the elements in page order."""
    order = list(depth_first(root))
    for at in reversed(order):
        inner = [x for x in at.children if isinstance(x, Element)]
        at.chars = at.own + sum(x.chars for x in inner)
        at.tags = len(inner) + sum(x.tags for x in inner)
        linked = at.tag == "a"
        at.link_chars = at.chars if linked else sum(x.link_chars for x in inner)
        at.link_tags = sum(x.link_tags + (x.tag == "a") for x in inner)
    per_char = root.link_chars / max(root.chars, 1)
    for at in order:
        at.density = density(at, per_char)
    for at in order:
        at.total = sum(x.density for x in at.children if isinstance(x, Element))
    return order


def density(at: Element, links_per_char: float) -> float:
    """Characters per tag times the logarithm of (text per link text * tags per link tag)."""
    if not at.chars:
        return 0.0
    tags, plain = max(at.tags, 1), max(at.chars - at.link_chars, 1)
    base = log(at.chars / plain * at.link_chars + links_per_char * at.chars + EULER)
    ratio = at.chars / max(at.link_chars, 1) * tags / max(at.link_tags, 1)
    return at.chars / tags * log(max(ratio, 1.0)) / log(max(base, 1.1))


def main_elements(root: Element) -> list[Element]:
    """The elements whose texts are the main text, in page order; none is inside another."""
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    best = max((x for x in order if x is body or x is not root and x.tag not in PHRASING), key=lambda x: (x.total, x.chars))
    outer = best
    while outer is not None and outer.tag != "article":
        outer = outer.parent
    best = outer or best
    heart = best
    while best is not body and best.parent not in (None, root, body) and best.parent.density >= body.density:
        best = best.parent
    path, at = set(), best.parent
    while best is not body and at is not None:
        path.add(id(at))
        at = at.parent
    chosen, stack = [], [body if best is body or id(body) in path else root]
    while stack:
        at = stack.pop()
        if at is best or id(at) not in path and (at.density >= body.density or alike(at, best)):
            chosen.append(at)
        elif id(at) in path:
            stack.extend(x for x in reversed(at.children) if isinstance(x, Element) and x.chars and (x.tag not in PHRASING or id(x) in path or x is best))
    if heart is not body:
        restore(heart, True)
    for at in chosen:
        restore(at, False)
    return chosen


def alike(at: Element, best: Element) -> bool:
    """Whether an element beside the chosen one is a part of the same kind."""
    named = at.words or at.tag in ("article", "section")
    return bool(named and at.parent is best.parent and (at.tag, at.words) == (best.tag, best.words) and at.total >= TWIN * best.total)


def block_texts(elements: list[Element]) -> str:
    """Text of the blocks in page order, a line each."""
    lines, parts, stack = [], [], list(reversed(elements))

    def close():
        if line := " ".join("".join(parts).split()):
            lines.append(line)
        parts.clear()

    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(at)
        elif at is None:
            close()
        elif at.tag in ("br", "wbr"):
            parts.append(" " if at.tag == "br" else "")
        else:
            block = at.tag in BLOCKS
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(at.children))
    close()
    return "\n".join(lines)


def main_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(CUT_TAG.sub("", html))
    builder.close()
    return block_texts(main_elements(without_furniture(builder.root)))


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and its length ``n_chars`` for every page."""
    keep = list(keep)
    schema = with_fields(pages.select(*keep), "text string, n_chars bigint")

    def extract(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h) for h in batch.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, whole_text(F.col(html)).alias("_html")).mapInArrow(extract, schema)
