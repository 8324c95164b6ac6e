"""Text of an HTML body, from one pass over its tags with a stack.

Blocks stand on lines of their own, list items behind a mark and their depth, quotes behind a mark, cells of a row on one line
with bars between; preformatted text keeps its white space. Scripts, styles, heads and what is hidden by attribute or style leave
no text, an image leaves its alternative text, and links may be listed at the end. Lines are not wrapped. No page raises
an error, and the work is linear in its length, whatever its tags.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Elements by how they are laid out.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style head title template noscript textarea object iframe svg".split())
_HIDDEN_STYLE = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9:-]*")
_SPACE = re.compile(r"[ \t\r\n\f\xa0]+")
#: Levels of lists and quotes that are shown.
DEEPEST = 20
_NO_TARGET = ("#", "mailto:", "cid:", "javascript:", "tel:")


class _Text:
    """Lines made so far and the elements that are open."""

    def __init__(self, references: bool):
        self.lines: list[str] = []
        self.line: list[str] = []
        #: Whether the line holds more than white space.
        self.filled = False
        #: Open elements: name, whether hidden.
        self.open: list[tuple[str, bool]] = []
        self.names: defaultdict[str, int] = defaultdict(int)
        self.hidden = 0
        #: Open lists: kind, number of the last item, place of its element in the stack.
        self.lists: list[list] = []
        self.mark: str | None = None
        self.references, self.targets, self.links = references, [], []

    def text(self, value: str) -> None:
        if self.hidden:
            return
        self.filled = self.filled or not value.isspace()
        if not self.names["pre"]:
            self.line.append(value)
            return
        first, *rest = value.split("\n")
        self.line.append(first)
        for part in rest:
            self.end_line()
            self.line.append(part)

    def end_line(self) -> None:
        if not self.line:
            return
        text = "".join(self.line)
        self.line, self.filled = [], False
        text = text.replace("\r", "").rstrip() if self.names["pre"] else _SPACE.sub(" ", text).strip().removesuffix(" |").strip()
        if not text:
            return
        indent = "  " * min(len(self.lists), DEEPEST) if self.mark is None else self.mark
        self.mark = None
        self.lines.append("> " * min(self.names["blockquote"], DEEPEST) + indent + text)

    def begin(self, name: str, attributes: str) -> None:
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        if name in _BLOCKS:
            self.end_line()
        if name == "br":
            self.end_line()
        elif name == "img" and found.get("alt"):
            self.text(found["alt"])
        if name == "li" and self.lists:
            if self.lists[-1][2] is not None:
                self.close_to(self.lists[-1][2])
            self.lists[-1][1] += 1
            self.lists[-1][2] = len(self.open)
            self.mark = "  " * min(len(self.lists) - 1, DEEPEST) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "* ")
        elif name in ("td", "th") and self.filled:
            self.line.append(" | ")
        if name in _VOID:
            return
        hidden = "hidden" in found or bool(_HIDDEN_STYLE.search(found.get("style", "")))
        self.open.append((name, hidden))
        self.names[name] += 1
        self.hidden += hidden
        if name in ("ul", "ol"):
            start = found.get("start", "1")
            self.lists.append([name, (int(start) if start.isdecimal() and len(start) < 9 else 1) - 1, None])
        elif name == "a":
            self.links.append(found.get("href", ""))

    def end(self, name: str) -> None:
        if not self.names[name]:
            if name == "p":
                self.end_line()
            return
        if name in ("td", "th", "tr", "li") and self.names["table"] + len(self.lists) == 0 and self.open[-1][0] != name:
            return
        k = len(self.open) - 1
        while self.open[k][0] != name:
            k -= 1
        self.close_to(k)

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            name, hidden = self.open[-1]
            if name in _BLOCKS:
                self.end_line()
            self.open.pop()
            self.names[name] -= 1
            self.hidden -= hidden
            if name in ("ul", "ol"):
                self.lists.pop()
                self.mark = None
            elif name == "a":
                self.link(self.links.pop())

    def link(self, target: str) -> None:
        if self.references and not self.hidden and target and not target.lower().startswith(_NO_TARGET):
            self.targets.append(target)
            self.line.append(f" [{len(self.targets)}]")


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins at a place ends; a > inside quotes doesn't end it if the quotes are closed soon."""
    end = page.find(">", at)
    for _ in range(16):
        if end < 0:
            return -1
        inside = page[at:end] if end - at < 1 << 16 else ""
        if "=" not in inside:
            return end
        for mark in ('"', "'"):
            if inside.count(mark) % 2 and "=" + mark in inside.replace(" ", ""):
                closing = page.find(mark, end, end + (1 << 12))
                if closing > 0:
                    end = page.find(">", closing)
                    break
        else:
            return end
    return end


def html_to_text(page: str | None, references: bool = False) -> str | None:
    """The text of a page; null for null. references: lists the targets of links behind it."""
    if page is None:
        return None
    out, low, at, size = _Text(references), page.lower(), 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin == size - 1:
            out.text(html.unescape(page[at:]))
            break
        if begin > at:
            out.text(html.unescape(page[at:begin]))
        after = page[begin + 1]
        if low.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
        elif after in "!?":
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
        elif after.isascii() and (after.isalpha() or after == "/" and page[begin + 2 : begin + 3].isalpha()):
            end = _tag_end(page, begin + 1)
            if end < 0:
                out.text(html.unescape(page[begin:]))
                break
            closing = after == "/"
            name = _NAME.match(low, begin + 1 + closing, begin + 33)[0]
            at = end + 1
            if closing:
                out.end(name)
            elif name in _RAW:
                shut = low.find(f"</{name}", at)
                # A head or a template that nothing ends hides no body.
                if shut >= 0:
                    stop = page.find(">", shut)
                    at = size if stop < 0 else stop + 1
                elif name in ("script", "style"):
                    at = size
            else:
                out.begin(name, page[begin + 1 + len(name) : end])
        else:
            out.text("<")
            at = begin + 1
    out.close_to(0)
    out.end_line()
    return "\n".join(out.lines + [f"[{k}] {t}" for k, t in enumerate(out.targets, 1)])
