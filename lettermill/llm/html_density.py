"""Main text of web pages by composite text density.

For every node of a page: characters, characters in links, tags and link tags below it; its density is characters per
tag, adjusted by a logarithm to a base that grows with the share of links. The density sum of a node adds up those of the
blocks below it. From the node of the largest sum the path goes up to the body; the least density on it is the threshold.
Each subtree on the path or beside it that reaches the threshold gives its node of the largest sum, in page order: these are
the article. Parts go whose markup names them as navigation, header, footer, sidebar, notice, advert, form or comment,
unless they hold all of the page's articles or, on a page without any, most of its prose. Lists of links
below the threshold go where the whole body is the article.

A block is the text between the edges of block elements; its white space becomes single blanks, and a line break is
white space. Blocks are joined by line feeds in the order of the page. Unclosed elements end where HTML ends them.

Results for odd rows: a null or empty page, or one without text, gives an empty text of 0 characters; broken markup is read
as far as it goes; rows with equal or null ids stay apart; columns besides those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .work import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of a page's text; the raw ones hold no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset("head noscript template svg canvas audio video object select option button input label form fieldset nav footer aside dialog menu".split())
#: Dropped elements that may wrap a page's article all the same.
WRAPPERS = frozenset("form fieldset".split())
_CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
_OWN_KIND = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table body html div section article main aside nav header footer form blockquote".split())

_ENDED = frozenset({"p"}.union(*_OWN_KIND.values()))

#: Words in a class, id or role that name what is not the article.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adslot|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|nav|navbar|navigation|menu|menubar|breadcrumbs?|masthead|topbar|site-header|page-header|header|footer|"
    r"site-footer|page-footer|sidebar|side|aside|complementary|contentinfo|search|widgets?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommended|recommendations|more-stories|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|toolbar|skip-link|hidden|tags?|toc|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Names that tell how a container looks, and names of parts of the article.
_STATE = re.compile(r"(?:^|[_-])(?:has|with|no|without|is|not|layout)[_-]", re.I)
#: What readers add may be longer than the article and hold articles of its own.
_REPLIES = re.compile(r"comment|disqus|respond|replies|reply", re.I)
_OF_ARTICLE = re.compile(r"article|post|entry|story|content", re.I)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+)|([^\s=/]+)")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "wraps", "within", "scope", "open", "parent", "items", "chars", "link_chars", "tags", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, noise: bool, parent: Node | None):
        self.tag, self.noise, self.wraps, self.parent, self.items = tag, noise, noise and (tag in WRAPPERS or tag not in DROPPED), parent, []
        # Whether it stands in an article; the nearest element that ends searches for open paragraphs and cells, and what is open below that one.
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.scope = self if parent is None or tag in _SCOPE else parent.scope
        self.open: dict[str, int] | None = {} if self.scope is self else None

    def children(self) -> Iterator[Node]:
        return (x for x in self.items if isinstance(x, Node))


def _is_noise(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROPPED:
        return True
    inside = parent.within
    if tag == "header" and not inside:
        return True
    if not attributes.strip() or tag in ("body", "html", "article", "main"):
        return False
    for name, value, alone in _ATTRIBUTE.findall(attributes):
        name = (name or alone).lower()
        value = unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role"):
            for word in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).split():
                found = None if _STATE.match(word) else _NOISE.search(word)
                if found and not (found[0].strip("_-").lower() == "header" and (inside or _OF_ARTICLE.search(word))):
                    return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Text ("", text), tags (name, attributes) and ends (/name), with the place after each; send() a place to go on from there.

    Every character is passed over a bounded number of times: what never ends is text up to the end of the page.
    """
    at, end, lone = 0, len(page), set()
    while at < end:
        less = page.find("<", at)
        if less < 0:
            yield "", page[at:], "", end
            return
        if page.startswith("<!--", less):
            after = page.find("-->", less + 4)
            after = end if after < 0 else after + 3
            name = None
        elif page.startswith(("<!", "<?"), less):
            after = page.find(">", less) + 1
            name = None
        elif name := _NAME.match(page, less + 1):
            after = name.end()
            while found := _STOP.search(page, after):
                after = found.end()
                if found[0] == ">":
                    break
                # A quote that never closes is a mark like any other.
                close = -1 if found[0] in lone else page.find(found[0], after)
                if close < 0:
                    lone.add(found[0])
                else:
                    after = close + 1
            else:
                after = 0
        else:
            yield "", page[at : less + 1], "", less + 1
            at = less + 1
            continue
        if not after:
            yield "", page[at:], "", end
            return
        if less > at:
            yield "", page[at:less], "", less
        at = after
        if name:
            moved = yield ("/" if page[less + 1] == "/" else "") + name[1].lower(), page[name.end() : after - 1], "", after
            at = moved or at


def parse(page: str) -> Node:
    """The tree of a page; texts stand in it with their references decoded."""
    root = here = Node("html", False, None)
    depth: dict[str, int] = {}
    texts: list[str] = []

    def up(node: Node) -> Node:
        """Closes what is open up to the node; each element is closed once, so all calls together pass over each once."""
        nonlocal here
        while here is not node:
            depth[here.tag] -= 1
            if here.tag in _ENDED:
                here.parent.scope.open[here.tag] -= 1
            here = here.parent
        return here

    def down(node: Node) -> Node:
        depth[node.tag] = depth.get(node.tag, 0) + 1
        if node.tag in _ENDED:
            counts = node.parent.scope.open
            counts[node.tag] = counts.get(node.tag, 0) + 1
        return node

    def flush() -> None:
        if texts:
            here.items.append(unescape("".join(texts)))
            texts.clear()

    found, go = tokens(page), None
    while True:
        try:
            tag, content, _, at = found.send(go)
        except StopIteration:
            break
        go = None
        if not tag:
            texts.append(content)
            continue
        flush()
        if tag[0] == "/":
            tag = tag[1:]
            if depth.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                up(node.parent)
            elif tag == "br" or tag == "p":
                here.items.append(Node(tag, False, here))
            continue
        if tag in ("html", "body"):
            if tag == "body" and here.tag == "head":
                up(here.parent)
            if tag == "body" and here is root:
                here.items.append(Node("body", False, here))
                here = down(here.items[-1])
            continue
        if here.tag == "head" and tag not in ("meta", "link", "base", "title", "script", "style", "noscript", "template"):
            up(here.parent)
        ends = ({"p"} if tag in _CLOSES_P else set()) | _OWN_KIND.get(tag, set())
        # An open paragraph, item or cell ends here, with what was left open inside it.
        if any(here.scope.open.get(x) for x in ends):
            node = here
            while node.tag not in ends:
                node = node.parent
            up(node.parent)
        node = Node(tag, _is_noise(tag, content, here), here)
        node.wraps = node.wraps and not _REPLIES.search(content)
        here.items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            go = (page.find(">", close.end()) + 1 if close else 0) or len(page)
        elif tag not in VOID and not content.endswith("/"):
            here = down(node)
    flush()
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first; without recursion, as trees may be deep."""
    out, wait = [], [root]
    while wait:
        node = wait.pop()
        out.append(node)
        wait += [x for x in node.items if isinstance(x, Node)]
    return out


def unwrap(root: Node) -> None:
    """Takes the mark of noise from what holds all of the page's articles, or most of the prose of a page without any."""
    nodes = _in_order(root)
    prose, articles = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in reversed(nodes):
        if node.noise and not node.wraps or node.tag == "a":
            continue
        articles[node] += node.tag in ("article", "main")
        prose[node] += sum(len(_SPACES.sub("", x)) for x in node.items if isinstance(x, str))
        if node.parent is not None:
            prose[node.parent] += prose[node]
            articles[node.parent] += articles[node]
    for node in nodes:
        if node.noise and node.wraps and (articles[node] == articles[root] if articles[root] else 2 * prose[node] > prose[root]):
            node.noise = False


def measure(root: Node) -> None:
    """Fills in counts, densities and density sums; noise counts as nothing."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        node.density = node.density_sum = 0.0
        if node.noise:
            continue
        for item in node.items:
            if isinstance(item, str):
                node.chars += len(_SPACES.sub("", item))
            elif not item.noise:
                node.chars += item.chars
                node.link_chars += item.link_chars
                node.tags += item.tags + 1
                node.link_tags += item.link_tags + (item.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if node.noise or not node.chars:
            continue
        plain = node.chars - node.link_chars
        base = math.log(node.chars * node.link_chars / max(1, plain) + share * node.chars + math.e)
        ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
        node.density = node.chars / max(1, node.tags) * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0) + 1.0)
    # Inline elements are part of the text that they stand in: a sum is over the blocks below a node, through inline ones.
    for node in reversed(nodes):
        node.density_sum = sum(c.density if c.tag in BLOCK else c.density_sum for c in node.children())


def article(root: Node) -> tuple[list[Node], float]:
    """The subtrees of the page's text in page order, and the threshold."""
    unwrap(root)
    measure(root)
    inside: list[Node] = []
    wait = [root]
    while wait:
        node = wait.pop()
        if not node.noise:
            wait += node.children()
            if node.chars:
                inside.append(node)
    if not inside:
        return [], 0.0
    best = max(inside, key=lambda n: n.density_sum)
    threshold, node = best.density, best
    while node is not None and node.tag != "html":
        threshold = min(threshold, node.density)
        node = node.parent
    if best.density_sum <= 0:
        return [next((n for n in inside if n.tag == "body"), root)], threshold
    # On the path and beside it, each subtree that reaches the threshold gives its node of the largest sum.
    largest = {}
    for node in reversed(inside):
        largest[node] = max([node, *(largest[c] for c in node.children() if c in largest)], key=lambda n: n.density_sum)
    chosen, wait = {best}, list(root.children())
    while wait:
        node = wait.pop()
        if node in largest and node.density >= threshold:
            chosen.add(largest[node])
            wait += node.children()
    out, wait = [], [root]
    while wait:
        node = wait.pop()
        if node in chosen:
            out.append(node)
        else:
            wait += reversed(list(node.children()))
    return out, threshold


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks below a node, in order."""
    out, held = [], []

    def close() -> None:
        line = _SPACES.sub(" ", "".join(held)).strip()
        held.clear()
        if line:
            out.append(line)

    wait: list = [node]
    while wait:
        item = wait.pop()
        if isinstance(item, str):
            held.append(item)
        elif item is None:
            close()
        elif item.tag == "br":
            held.append(" ")
        elif not item.noise and not (item is not node and node.tag in ("body", "html") and item.tag in ("ul", "ol", "dl", "table", "div", "section") and item.chars and item.link_chars > 0.5 * item.chars and item.density < threshold):
            if item.tag in BLOCK:
                close()
                wait.append(None)
            wait += reversed(item.items)
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes, threshold = article(root)
    return "\n".join(line for node in nodes for line in blocks(node, threshold))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in T.steps(batches, "html"):
        texts = [main_text(x) for x in step.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([step.column("id"), step.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def page_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    source = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"))
    return source.mapInArrow(_extracted, "id bigint, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_column, "url": url_column})


def op5_page_texts(spark, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
