"""HTML main text by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with its open elements. The graph has a node for
each block and for each element that divides a page. A linear classifier gives a block the cost of either label, which
become its capacities to the source (content) and the sink (boilerplate), from its text alone: length, end, links, tag, and
words of boilerplate in a class, id or role around it, by how sure they are. What an element's tag says for certain
(article and main, or menus, footers, forms and the like) is the element's capacity. Smoothness edges lead from a block to
the next one and to the element that holds it, and from an element to the one around it (DOM proximity). The maximum flow
separates the two: blocks that the source still reaches are the article. So a short line in an article is kept and prose
in a footer is not, because of their edges and against their own costs.

A tag or word of boilerplate counts for nothing where its element holds an article or main, beside a word of content, or
after a word of state (with-sidebar).

Nodes whose own capacity is at least that of all their edges have their label in every minimum cut; they are settled
first and their edges folded into their neighbours' capacities, so that flow is pushed only where it decides.

Defined results: a null or empty html has an empty text; broken markup is read as browsers do where that is simple (an
open paragraph ends at the next block, stray end tags are skipped); only the contents of scripts, styles, titles and text
areas are not read; controls, graphics and fallbacks have the cost of boilerplate up to their end tag, and none if there is
no end tag before the next of their kind; formulas and objects are text like any other; equal rows each get their result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sceneloom import ship

from .common import slices

# HTML's element names by their part in a page, and words of class, id and role that authors use.
BLOCK = frozenset("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noframes noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul video audio canvas svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
APART = frozenset("noscript iframe noframes template svg select button".split())
FOREIGN = frozenset("svg math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPE = frozenset("html body table td th article section div main button form nav aside footer header blockquote".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu search fieldset head".split())
BAD_WORDS = frozenset("nav navbar navigation menu menubar masthead footer foot sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted share sharing social comment comments commentlist disqus respond related recommended recommendations subscribe subscription newsletter popup modal login signin signup pagination pager contentinfo".split())
LOOSE_WORDS = frozenset("header bottom side notice notices notification alert discussion reply replies overlay register form widget toolbar copyright legal disclaimer complementary skip hidden".split())
GOOD_WORDS = frozenset("article content main post entry story body text prose maincontent articlebody postbody".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
SECTIONS = frozenset("article main section nav aside header footer div body form".split())
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDS = re.compile(r"</(%s)(?=[\s/>])" % "|".join(sorted(RAW)), re.I)
NEXT = {tag: re.compile(r"<(/?)%s(?=[\s/>])" % tag, re.I) for tag in APART}

SURE = 1e6  # of what a tag says for certain
WORD, LOOSE = 4.0, 1.0  # costs of words
NEXT_TO, ACROSS, HELD, IN, UP = 1.0, 0.25, 5.0, 1.0, 0.75  # edges: to the next block, if in another section; to the element that holds it, if that is certain or not; to the element around
STATE = frozenset("with without has have no is".split())


class Element:
    __slots__ = ("tag", "parent", "hidden", "good", "cost", "holds", "article", "link", "foreign", "section", "sure", "word", "group")

    def __init__(self, tag: str, raw: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        words: set[str] = set()
        self.hidden = False
        if raw and raw.strip(" /"):
            for name, value in ATTRIBUTE.findall(raw):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    for part in value.split():
                        before = ""
                        for w in WORDS.findall(part):
                            w = w.lower()
                            if before not in STATE:
                                words.add(w)
                            before = w
                        words.add(part.lower())
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    self.hidden = True
        self.article = (parent is not None and parent.article) or tag in ("article", "main")
        self.link = (parent is not None and parent.link) or tag == "a"
        self.foreign = (parent is not None and parent.foreign) or tag in FOREIGN
        self.holds = False
        self.good = bool(words & GOOD_WORDS)
        self.cost = 0.0 if self.good or tag in ("html", "body") else WORD if words & BAD_WORDS else LOOSE if words & LOOSE_WORDS else 0.0
        if tag in ("article", "main"):
            above = parent
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        self.section = self if parent is None or tag in SECTIONS else parent.section

    def settle(self) -> None:
        """The element's capacity, the cost of words in it, and the node that its blocks hang on, once the page is read and
        the parent's are known."""
        above = self.parent
        boilerplate = self.hidden or self.tag in BOILERPLATE or self.tag in APART or (self.tag == "header" and not self.article)
        self.sure = SURE if self.tag in ("article", "main") else -SURE if boilerplate and not self.holds else 0.0
        cost = 0.0 if self.holds else self.cost
        self.word = 0.0 if self.sure > 0 else max(cost, above.word if above is not None else 0.0)
        node = self.sure != 0 or cost > 0 or (self.section is self and not above.group.sure) if above is not None else True
        if above is not None and above.group.sure < 0 and self.sure <= 0:
            node = False
        self.group = self if node else above.group


def blocks(page: str) -> list[tuple[str, Element, float]]:
    """(text, innermost element, share of its characters in links) of each block with text, in page order."""
    out: list[tuple[str, Element, float]] = []
    stack = [Element("html", "", None)]
    made = stack[:]
    # where each tag is open, and for each open element the topmost one at or below it that bounds a search, of both kinds
    open_at: dict[str, list[int]] = {"html": [0]}
    bounds: list[tuple[int, int]] = [(0, 0)]
    text: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append((joined, owner, linked / total if total else 0.0))
            text.clear()
            linked = total = 0

    owner, at, n = stack[0], 0, len(page)

    def say(part: str) -> None:
        nonlocal linked, total, owner
        if not total:
            if not text or not part.isspace():
                owner = stack[-1]
        size = len(part.strip())
        total += size
        if stack[-1].link:
            linked += size
        text.append(part)

    def drop(to: int) -> None:
        for e in reversed(stack[to:]):
            open_at[e.tag].pop()
        del stack[to:], bounds[to:]

    def last(tags: tuple[str, ...]) -> int:
        return max((places[-1] for t in tags if (places := open_at.get(t))), default=0)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = TAG.match(page, lt)
        if m is None:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing, raw = m[1] or m[4], m[3] or m[6]
        if tag in BLOCK:
            flush()
        if closing:
            i = last((tag,))
            if i and (tag in SCOPE or i > bounds[-1][0]):
                drop(i)
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = ("p",) if tag in CLOSES_P else ("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else (tag,)
            i = last(same)
            if i and i >= bounds[-1][1]:
                drop(i)
        if raw and raw.rstrip().endswith("/") and (tag in FOREIGN or stack[-1].foreign):
            continue
        if tag in APART and ((e := NEXT[tag].search(page, at)) is None or not e[1]):
            continue
        if tag in RAW:
            while (e := ENDS.search(page, at)) is not None and e[1].lower() != tag:
                at = e.end()
            at = n if e is None else n if (close := page.find(">", e.end())) < 0 else close + 1
            continue
        if tag not in VOID:
            stack.append(Element(tag, raw, stack[-1]))
            made.append(stack[-1])
            i = len(stack) - 1
            open_at.setdefault(tag, []).append(i)
            scope = i if tag in SCOPE else bounds[-1][0]
            bounds.append((scope, i if tag in SCOPE or tag in ("ul", "ol", "dl") else bounds[-1][1]))
    flush()
    for e in made:
        e.settle()
    return out


def leaning(text: str, element: Element, links: float) -> float:
    """The classifier's log odds that a block is content, from its text and the words around it."""
    n = text.count(" ") + 1
    score = 1.5 if n >= 20 else 0.5 if n >= 8 else -1.0
    score += 0.5 if text[-1] in ".!?…\"”»" else -0.25
    score -= 3.0 * links * (links > 0.5)
    if element.tag == "p":
        score += 1.0
    elif element.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td"):
        score += 0.75
    elif element.tag == "li":
        score -= 0.5
    if element.good and element.tag in ("p", "h1"):
        score += 2.0
    return score - element.word


def max_flow_side(capacity: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut. capacity: to the source if above 0, else to the sink; edges: both ways."""
    n = len(capacity)
    s = list(capacity)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(s[i]) >= sum(near[i].values()):
            side[i] = s[i] > 0
            for j, c in near[i].items():
                s[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        # shortest augmenting paths on the residual graph of what is undecided
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        flow[source] = {i: s[i] for i in rest if s[i] > 0}
        flow[sink] = {}
        for i in rest:
            if s[i] < 0:
                flow[i][sink] = -s[i]
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                u = queue.popleft()
                for v, c in flow[u].items():
                    if c > 1e-12 and v not in came:
                        came[v] = u
                        queue.append(v)
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            push = min(flow[u][v] for u, v in path)
            for u, v in path:
                flow[u][v] -= push
                flow[v][u] = flow[v].get(u, 0.0) + push
        for i in rest:
            side[i] = i in came
    return [bool(x) for x in side]


def graph(found: list[tuple[str, Element, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities of the blocks' nodes, then of their elements', and the edges."""
    capacity = [leaning(*b) for b in found]
    edges: list[tuple[int, int, float]] = []
    at: dict[int, int] = {}

    def node(e: Element) -> int:
        new: list[Element] = []
        while id(e) not in at:
            at[id(e)] = len(capacity)
            capacity.append(e.sure)
            new.append(e)
            if e.sure or e.parent is None:
                break
            e = e.parent.group
        for e in new:
            if not e.sure and e.parent is not None:
                edges.append((at[id(e)], at[id(e.parent.group)], UP))
        return at[id(new[0])] if new else at[id(e)]

    for i, (_, e, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_TO if found[i - 1][1].section is e.section else ACROSS))
        edges.append((i, node(e.group), HELD if e.group.sure else IN))
    return capacity, edges


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    side = max_flow_side(*graph(found))
    return " ".join(b[0] for b, kept in zip(found, side) if kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row for each row of pages."""
    ship(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(h.as_py()) for h in piece.column("html")]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
