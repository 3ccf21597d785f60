"""Main text of HTML pages by scoring the tree of a page."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import bounded_batches, slices

# Element names of the HTML standard by how they are treated here, and words that class names and ids use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("applet audio button canvas datalist dialog footer form frameset head header iframe map math menu nav noframes noscript object option select svg template title video".split())
ASIDE = frozenset(["aside"])
RAW = frozenset("script style textarea xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("blockquote dd figcaption li p pre td".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
UNWANTED = re.compile(
    r"(?:^|[_-])(?:ads?|adsbygoogle|advert\w*|alerts?|banners?|breadcrumbs?|byline|captcha|comments?|consent|cookie\w*|copyright|disclaimer|disqus|discussion|footer|gdpr|header|masthead|menus?|modal|nav\w*|newsletter|notices?|notification"
    r"|outbrain|pagination|pager|popup|promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|shoutbox|side-?bar\w*|side-?nav\w*|sign-?up|skyscraper|social|sponsor\w*|subscri\w*|taboola|tags?|toc|toolbar|widgets?)(?:$|[_-])",
    re.I,
)
#: Class names that tell how an element is laid out, or that something is absent.
LAYOUT = re.compile(r"^(?:has|no|not|with|without|is|hide|show|two|three|single)[_-]|[_-](?:layout|page|left-of|right-of|less)$", re.I)
#: Words that an article's own parts carry too.
HEADS = re.compile(r"^(?:\w+[_-])*header(?:[_-]\w+)*$", re.I)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CONTAINERS = frozenset(["article", "main"])

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element; children are elements and strings in page order."""

    __slots__ = ("tag", "parent", "children", "score", "text", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.score, self.text, self.linked = tag, parent, [], 0.0, 0, 0


def _left_out(tag: str, attributes: str, inside: bool, by_class: bool) -> bool:
    """Whether an element can never be main text; inside: within an article or main element, whose headers are its own."""
    if tag == "header" and inside:
        return False
    if tag in DROPPED or tag in ASIDE or tag in RAW:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value) or name == "role" and value.lower() in ROLES:
            return True
        if by_class and name in ("class", "id") and tag not in CONTAINERS:
            for word in value.split():
                if UNWANTED.search(word) and not LAYOUT.search(word) and not (inside and HEADS.match(word)):
                    return True
    return False


def _within(node: Node | None) -> bool:
    while node is not None and node.tag not in CONTAINERS:
        node = node.parent
    return node is not None


def parse(page: str, by_class: bool = True) -> Node:
    """Tree of a page without what can never be main text. Unclosed and misnested tags are put right as browsers do it, roughly."""
    root = Node("html", None)
    at, skipped, depth = root, "", 0
    position, end = 0, len(page)
    while position < end:
        m = TOKEN.match(page, position)
        position = m.end()
        tag = m[2]
        if tag is None:
            if not skipped and page[m.start()] != "<":
                at.children.append(m[0])
            elif not skipped and m[0] == "<":
                at.children.append("<")
            continue
        tag = tag.lower()
        if tag in RAW and not m[1]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, position)
            position = close.end() if close else end
            continue
        if skipped:  # inside a left-out element: only its own tags are counted
            if tag == skipped and not m[3].endswith("/"):
                depth += -1 if m[1] else 1
                if not depth:
                    skipped = ""
            elif m[1] and tag in ("body", "html"):
                skipped = ""
            continue
        if m[1]:
            if tag == "br":
                at.children.append(" ")
                continue
            node = at
            while node is not root and node.tag != tag and not (node.tag in ("td", "th", "table") and tag not in BLOCKS):
                node = node.parent
            if node is not root and node.tag == tag:
                at = node.parent
            continue
        if tag == "p" or tag in CLOSES_P:
            node = at
            while node is not root and node.tag not in ("p", "td", "th", "table", "button", "article", "section", "div", "blockquote", "li"):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in ENDS:
            ended, within = ENDS[tag]
            node, last = at, None
            while node is not root and node.tag not in within:
                last = node if node.tag in ended else last
                node = node.parent
            if last is not None:
                at = last.parent
        if tag in VOID:
            at.children.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if _left_out(tag, m[3], (tag == "header" or m[3] != "") and _within(at), by_class):
            if not m[3].endswith("/"):
                skipped, depth = tag, 1
            continue
        node = Node(tag, at)
        at.children.append(node)
        if not m[3].endswith("/"):
            at = node
    return root


def _measure(root: Node) -> list[Node]:
    """All elements in page order, with the length of their text and of that inside links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if type(c) is Node)
    for node in reversed(order):
        for c in node.children:
            if type(c) is Node:
                node.text += c.text
                node.linked += c.text if c.tag == "a" else c.linked
            else:
                node.text += len(c) if not c.isspace() else 0
    return order


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _own_text(node: Node) -> str:
    """Text of a node without that of blocks inside it."""
    parts, stack = [], [iter(node.children)]
    while stack:
        for c in stack[-1]:
            if type(c) is not Node:
                parts.append(c)
            elif c.tag not in BLOCKS:
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
    return "".join(parts)


def best_container(root: Node) -> tuple[Node, list[Node]]:
    """The element with the most points, and those of its siblings that belong to the text."""
    order = _measure(root)
    scored = []
    for node in order:
        loose = node.tag not in PARAGRAPHS and node.tag in BLOCKS | {"html"} and any(type(c) is str and not c.isspace() for c in node.children)
        if node.tag not in PARAGRAPHS and not loose or node.tag in HEADINGS:
            continue
        text = _own_text(node)
        size = len(SPACE.sub(" ", text).strip())
        if size < 25:
            continue
        points = (1 + text.count(",") + text.count("،") + text.count("、") + text.count("，") + min(size / 100, 3.0)) * (1 - _density(node))
        up, level = node if loose else node.parent, 0
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored.append(up)
            up, level = up.parent, level + 1
    if not scored:
        return root, []
    top = max(scored, key=lambda n: n.score * (1 - _density(n)))  # the first of equals
    declared = top  # a page's own article or main element around the best container is taken whole
    while declared is not None and declared.tag not in CONTAINERS:
        declared = declared.parent
    if declared is not None:
        top = declared
    least = max(10.0, top.score * 0.2)
    beside = []
    for node in top.parent.children if top.parent is not None else []:
        if type(node) is not Node or node is top:
            continue
        whole = node.score * (1 - _density(node)) >= least
        prose = node.tag == "p" and (node.text > 80 and _density(node) < 0.25 or node.text and not node.linked and re.search(r"[.!?](?:\s|$)", _own_text(node)))
        if whole or prose:
            beside.append(node)
    return top, beside


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order: character references decoded, white space as one space, trimmed."""
    out, parts = [], []
    declared = _within(node)  # an article's own lists are kept

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack = [(node, iter(node.children))]
    while stack:
        owner, rest = stack[-1]
        for c in rest:
            if type(c) is not Node:
                parts.append(c)
                continue
            if c.tag in BLOCKS:
                end()
                if not declared and c.tag in ("ul", "ol", "table", "div", "section") and c.text and _density(c) > 0.5 and c.linked > 20:
                    continue  # a list of links
            stack.append((c, iter(c.children)))
            break
        else:
            if owner.tag in BLOCKS:
                end()
            stack.pop()
    end()
    return out


def _text_of(root: Node) -> str:
    top, beside = best_container(root)
    if not beside:
        return "\n".join(blocks(top))
    chosen = {id(n) for n in beside} | {id(top)}
    return "\n".join(b for n in top.parent.children if id(n) in chosen for b in blocks(n))


def main_text(page: str) -> str:
    """The article of a page, blocks joined by one newline; empty where a page has no text.

    Where class names and ids would leave nothing, as on a wrapper around the whole
    article, the page is read again without them.
    """
    return _text_of(parse(page)) or _text_of(parse(page, by_class=False))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty; a page without text gives an empty string and 0.
    Repeated rows are extracted each on their own. Empty input gives an empty
    result. Tags that are cut off, unclosed or misnested do not stop extraction.
    """

    def task(batches):
        for batch in batches:
            for low, high, texts in slices(batch.column("html")):
                found = [main_text(texts.bytes(i).decode("utf-8")) for i in range(high - low)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(low, high - low), batch.column("url").slice(low, high - low), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(task, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
