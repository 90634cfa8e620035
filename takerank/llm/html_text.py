"""Main text of HTML pages by tree scoring.

The page is parsed into a tree with the repairs that browsers make (a paragraph ends where a block
begins, void elements have no content, what is left open ends with its parent). Menus, headers and
footers of the page, asides, forms, scripts, comments of readers, notices and adverts go, by element,
role or the words of class and id; words of class and id remove nothing that holds a large share of
the page's running text, readers' comments, adverts and cookie notes apart, and are not heeded if no
text would be left. Each paragraph-like block gives points for its length and commas,
discounted by its link density, to its parent in full, to the grandparent by half and to further
ancestors by a third of that of the generation before. The container of the best score is kept with
those of its siblings that score a fifth as much or are paragraphs of running text; a container
yields to an ancestor that holds the text of several such containers.

A null or empty page, and one without text, gives an empty text; an empty table gives an empty result.
Only the html column is read beside the id and url, which may be null; each page is handled alone, so
repeated rows give equal results. Neither the length of a page nor the depth of its elements is bounded.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from takerank.llm.cluster import ready

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
GONE = frozenset("script style template noscript iframe object embed svg canvas audio video nav aside footer form button select option input textarea label fieldset dialog menu head title".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = frozenset("p pre blockquote li td dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
# Words of class and id names, and roles, of what is not the article.
# With each, the share of the page's running text up to which they go; a wrapper that holds more is not what its name says.
_WORDS = (
    (r"ad|ads|advert\w*|adsense|sponsor\w*|cookies?|consent|comments?|commentlist|commenters?|disqus|respond|reply|replies", 1.0),
    (r"banner|breadcrumb\w*|sidebar\w*|side-?bar|aside|footer|masthead|site-?header|page-?header|newsletter|subscri\w*|popup|modal|overlay|login|signup|pagination|pager|toolbar|widget\w*", 0.5),
    (r"promo\w*|nav\w*|menu\w*|notice\w*|comment\w*|social|share|sharing|related|recommend\w*|search|skip\w*|hidden", 0.2),
)
GONE_NAME = tuple((re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I), share) for words, share in _WORDS)
# Names that tell of a state or of another part: has-sidebar, comments-open, hidden-print.
MODIFIER = re.compile(r"(?:(?<![^\s_-])(?:has|no|with|without)[_-]\S+|(?<!\S)[\w-]+[_-](?:open|closed|enabled|disabled|on|off)(?!\S)|(?<!\S)hidden-(?:print|xs|sm|md|lg|xl|mobile|phone|tablet|desktop)(?!\S))", re.I)
GONE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())

# A quote opens a value only after an equals sign, as browsers read it; one that is never closed is a plain character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])[^\s=\"']*/\s*$")
_WANTED = frozenset({"class", "id", "role", "hidden", "aria-hidden", "style"})
_WHITE = re.compile(r"\s+")
_COMMA = re.compile("[,、，]")
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENTER, TEXT, LEAVE = range(3)


class Node:
    """An element: its children are elements and strings. The figures are set by measure()."""

    __slots__ = ("children", "commas", "linked", "most", "name", "own", "own_linked", "parent", "running", "score", "size")

    def __init__(self, name: str, parent: Node | None, most: float | None = None):
        self.name, self.parent, self.children = name, parent, []
        self.most = most  # by its class or id it goes if it holds no larger a share of the running text; None: it stays
        self.clear()

    def clear(self) -> None:
        self.size = self.linked = self.running = 0  # characters of its text, of that in links, of running text outside links
        self.own = self.own_linked = self.commas = 0  # of the text that lies in no block inside it
        self.score = 0.0


def walk(root: Node) -> Iterator[tuple[int, Node | str]]:
    """What lies under a node in page order, with the nodes as they are entered and left; the depth of the tree does not matter."""
    todo: list[tuple[int, Node | str]] = [(ENTER, root)]
    while todo:
        event = todo.pop()
        yield event
        kind, x = event
        if kind == ENTER:
            todo.append((LEAVE, x))
            todo.extend((TEXT if isinstance(c, str) else ENTER, c) for c in reversed(x.children))


def _gone(name: str, attributes: str) -> tuple[bool, float | None]:
    """Whether an element goes for sure, and the share of the running text up to which it goes by its class or id."""
    most = None
    if name in GONE:
        return True, most
    if not attributes.strip() or name in {"html", "body"}:
        return False, most
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key not in _WANTED:
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in GONE_ROLE):
            return True, most
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, most
        if key in {"class", "id"} and name not in {"article", "main"}:
            named = MODIFIER.sub(" ", value)
            most = max((share for words, share in GONE_NAME if words.search(named)), default=most or 0.0) if named.strip() else most
            most = most or None
    return False, most


def measure(root: Node) -> None:
    """Set the figures of all nodes. Running text: runs of 25 characters or more between blocks, outside links and what goes whatever it holds."""
    size = linked = running = run = 0
    links = sure = 0  # open links, open elements that go for sure
    owners: list[Node] = []
    before: list[tuple[int, int, int]] = []
    for kind, x in walk(root):
        if kind == TEXT:
            n = len(" ".join(x.split()))
            if n:
                n += x[-1].isspace()
                size += n
                owners[-1].own += n
                owners[-1].commas += len(_COMMA.findall(x))
                if links:
                    linked += n
                    owners[-1].own_linked += n
                elif not sure:
                    run += n
            continue
        edge = x.name in BLOCK or x.most is not None or x is root
        if edge:
            running += run if run >= 25 else 0
            run = 0
        if kind == ENTER:
            x.clear()
            before.append((size, linked, running))
            links += x.name == "a"
            sure += x.most == 1
            if x.name in BLOCK or x is root:
                owners.append(x)
        else:
            a, b, c = before.pop()
            x.size, x.linked, x.running = size - a, linked - b, running - c
            links -= x.name == "a"
            sure -= x.most == 1
            if x.name in BLOCK or x is root:
                owners.pop()


def _prune(root: Node) -> None:
    """Take away what goes by its class or id: it holds a small share of the running text, or links for the most part."""
    measure(root)
    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.most is None or not (c.most == 1 or c.running <= c.most * root.running or 2 * c.linked > c.size)]
        todo.extend(c for c in n.children if not isinstance(c, str))


class _Open:
    """The elements that are open, by depth and by name."""

    def __init__(self, root: Node):
        self.root = root
        self.stack: list[tuple[str, Node | None, Node]] = []  # name, its node unless it is gone, the node that takes children
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # depths of blocks that are no paragraphs
        self.gone = 0

    @property
    def node(self) -> Node:
        return self.stack[-1][2] if self.stack else self.root

    def push(self, name: str, own: Node | None) -> None:
        depth = len(self.stack)
        self.stack.append((name, own, self.node if own is None else own))
        self.at[name].append(depth)
        if name in BLOCK and name != "p":
            self.blocks.append(depth)
        self.gone += own is None

    def last(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of one of the names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, depth: int) -> None:
        """Close all elements from a depth on."""
        while len(self.stack) > depth:
            name, own, _ = self.stack.pop()
            self.at[name].pop()
            if name in BLOCK and name != "p":
                self.blocks.pop()
            self.gone -= own is None


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I)


def parse(page: str, by_name: bool = True) -> Node:
    """The tree of a page without what is not the article; texts are strings among the children. Time is linear in the page."""
    root = Node("#root", None)
    opened = _Open(root)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            if not opened.gone:
                opened.node.children.append(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            depth = opened.last((name,))
            if depth >= 0 and (name in BLOCK or opened.last(("td", "th", "table")) <= depth):
                opened.close(depth)
            continue
        if opened.at.get("head") and name not in IN_HEAD:  # a head that was left open ends here
            opened.close(opened.at["head"][0])
        if name in CLOSES_P or name in _ENDS:
            ends = _ENDS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            depth = opened.last(ends)
            stop = opened.last(_STOPS.get(name, set()) | {"button", "table"} - ends)
            if name not in {"td", "th", "tr"} and opened.blocks:
                stop = max(stop, opened.blocks[-1])
            if depth >= 0 and depth >= stop:
                opened.close(depth)
        if name in VOID or (name not in BLOCK | RAW and _SELF_CLOSED.search(attributes)):
            if not opened.gone:
                opened.node.children.append(" ")
                if name == "hr":
                    opened.node.children.append(Node("hr", opened.node))
            continue
        if name in RAW:
            at = _end_of(name).search(page, at).end()
            continue
        # the header of an article holds its headline; that of a page does not
        if opened.gone or (name == "header" and opened.last(("article", "main")) < 0):
            opened.push(name, None)
            continue
        sure, most = _gone(name, attributes)
        if sure:
            opened.push(name, None)
            continue
        child = Node(name, opened.node, most if by_name else None)
        opened.node.children.append(child)
        opened.push(name, child)
    if by_name:
        _prune(root)
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order; a run of text between blocks is a block of its own."""
    out: list[str] = []
    run: list[str] = []
    for kind, x in walk(node):
        if kind == TEXT:
            run.append(x)
        elif x.name in BLOCK or x is node:
            text = _WHITE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)
    return out


def score(root: Node) -> Node:
    """The container of the best score; nodes are measured and scored."""
    measure(root)
    best = root
    for kind, n in walk(root):
        if kind != LEAVE or n.own < 25 or n.name in HEADING:
            continue
        points = (1 + n.commas + n.own / 100) * (1 - n.own_linked / n.own)
        share, up = 1.0, n.parent if n.name in LEAF else n
        while up is not None and share > 0.05:
            up.score += points * share
            share = 0.5 if share == 1 else share / 3
            up = up.parent
    for kind, n in walk(root):
        if kind == LEAVE and n.score > best.score:
            best = n
    return best


def _kept(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    best = score(root)
    # a text split over several containers belongs to what holds them all
    while best.parent is not None and best.name not in {"article", "main", "body", "html", "#root"} and best.parent.name not in {"html", "#root"}:
        others = sum(c.score for c in best.parent.children if not isinstance(c, str) and c is not best)
        if best.parent.name not in {"article", "main"} and others < 0.5 * best.score:
            break
        best = best.parent
    if best.parent is None:
        return [best]
    least = max(3.0, best.score / 5)
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif not isinstance(c, str) and c.name != "a":
            density = c.linked / c.size if c.size else 1.0
            running = c.name == "p" and density < 0.25 and c.size > 80
            if (c.score >= least or running or (c.name in HEADING and c.name != "h6" and best.name not in {"article", "main"})) and density < 0.5:
                out.append(c)
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by an empty line."""
    if not page:
        return ""
    text = "\n\n".join(b for n in _kept(parse(page)) for b in blocks(n))
    return text or "\n\n".join(b for n in _kept(parse(page, by_name=False)) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    ready(pages.sparkSession)
    rows = pages.selectExpr("page_id", "url", "cast(html AS string) AS html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.dtypes[0][1]}, url {rows.dtypes[1][1]}, text string, n_chars long")
