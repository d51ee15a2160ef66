"""One page of HTML to Markdown, in one pass over its tags with a stack of open elements.

A small per-row helper of ``operators.text.html_to_markdown``, which runs it over Arrow batches. The time is linear
in the page also for pages that leave elements and quotes open.
"""

from __future__ import annotations

import re
from html import unescape

# Elements whose text is not part of the document; they end at their own closing tag, or with the page.
DROPPED = frozenset(("script", "style", "head", "noscript", "template"))
RAW = frozenset(("script", "style", "noscript", "template"))  # what looks like a tag in them is none
FRAME = frozenset(("nav", "footer"))  # dropped unless asked for
BLOCKS = frozenset(("p", "div", "article", "section", "blockquote", "main", "header", "aside", "figure", "figcaption", "address", "form",
                    "fieldset", "details", "summary", "dl", "dt", "dd", "caption"))
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
# Elements that ``Page`` knows by their start and by their end; the tags of others are passed over.
ENDED = frozenset((*HEADINGS, *BLOCKS, "ul", "ol", "a", "pre", "code", "td", "th", "tr", "table"))
STARTED = ENDED | {"br", "li", "img", "hr"}
DEEPEST = 32  # lists within more lists than this are indented no further
MARK = "\x02"  # stands around the number of a verbatim block until line breaks are settled

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")  # a whole tag without quotes behind its name
ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z0-9:_-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"\s+")
_ends: dict[str, re.Pattern] = {}


def _pattern(kind: str, name: str) -> re.Pattern:
    key = kind + name
    if key not in _ends:
        inner = rf"</{name}\s*>" if kind == "raw" else rf"<(?:(/?){name}\b[^>]*>|({'|'.join(sorted(RAW))})\b)"
        _ends[key] = re.compile(inner, re.I)
    return _ends[key]


def after_element(html: str, at: int, name: str) -> int:
    """Where an element goes on after its closing tag; elements of its name within it are counted."""
    if name in DROPPED:
        found = _pattern("raw", name).search(html, at)
        return found.end() if found else len(html)
    depth = 1
    while found := _pattern("own", name).search(html, at):
        at = found.end()
        if found.group(2):
            at = after_element(html, at, found.group(2).lower())
        else:
            depth += -1 if found.group(1) else 1
            if not depth:
                return at
    return len(html)


def escaped_cell(text: str) -> str:
    """Text of a table cell: one line, with bars and backslashes marked."""
    return SPACES.sub(" ", text).strip().replace("\\", "\\\\").replace("|", "\\|")


class Page:
    """What is written so far: a stack of texts, the open elements that hold one, and the open lists."""

    def __init__(self):
        self.texts: list[list[str]] = [[]]
        self.open: list[tuple[str, object]] = []  # kind, data; each has the text above the one it was opened in
        self.lists: list[list] = []
        self.verbatim: list[str] = []
        self.n_pre = 0
        self.fresh = False  # right after a list mark, where no line breaks

    def write(self, text: str) -> None:
        if text:
            self.texts[-1].append(text)
            self.fresh = False

    def text(self, raw: str) -> None:
        """Text between tags."""
        text = unescape(raw).replace("\xa0", " ") if "&" in raw else raw
        if self.open and self.open[-1][0] == "table" and not text.strip():
            return
        if not (self.fresh and not text.strip()):
            self.write(text)

    def line(self) -> None:
        if self.inside("cell"):
            self.write(" ")
        elif not self.fresh and not (self.lists and (len(self.lists) > 1 or self.lists[-1][2]) and self.texts[-1]
                                     and self.texts[-1][-1].endswith("\n")):
            self.write("\n")  # items of a list follow each other without a blank line

    def inside(self, kind: str) -> bool:
        return any(k == kind for k, _ in reversed(self.open[-3:])) if self.open else False

    def push(self, kind: str, data: object = None) -> None:
        self.open.append((kind, data))
        self.texts.append([])
        self.fresh = False

    def pop(self) -> None:
        kind, data = self.open.pop()
        text = "".join(self.texts.pop())
        self.fresh = False
        if kind == "link":
            label = SPACES.sub(" ", text).strip()
            self.write(f"[{label}]({data})" if label else text)
        elif kind == "cell":
            self.open[-1][1][-1].append(text)
        elif kind == "pre":
            self.n_pre = 0
            if self.inside("cell"):
                self.write(text)
            else:
                self.verbatim.append(text.removeprefix("\n").removesuffix("\n"))
                self.write(f"\n{MARK}{len(self.verbatim) - 1}{MARK}\n")
        else:
            self.write(text)  # what stood in the table outside of its cells comes before it
            rows = [row for row in data if row]
            if self.inside("cell"):
                self.write(" " + " ".join(SPACES.sub(" ", c).strip() for row in rows for c in row) + " ")
            elif rows:
                lines = ["|" + "".join(escaped_cell(c) + "|" for c in row) for row in rows]
                self.write("\n" + "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]) + "\n")

    def close(self, kind: str) -> bool:
        """End the innermost open element of a kind, and what is open in it, unless a cell lies between."""
        if self.open and self.open[-1][0] == kind:
            self.pop()
            return True
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == kind:
                while len(self.open) > i:
                    self.pop()
                return True
            if self.open[i][0] in ("cell", "table") and kind in ("link", "pre") or self.open[i][0] == "table":
                return False
        return False

    def start(self, name: str, attributes: str) -> None:
        if name == "td" or name == "th":  # the most frequent first
            self.close("cell")
            if self.open and self.open[-1][0] == "table":
                if not self.open[-1][1]:
                    self.open[-1][1].append([])
                self.push("cell")
            else:
                self.write(" ")
        elif name in HEADINGS:
            self.line()
            if not self.inside("cell"):
                self.write(HEADINGS[name])
        elif name == "br":
            self.line()
        elif name in BLOCKS:
            self.line()
        elif name in ("ul", "ol"):
            start = attribute(attributes, "start")
            self.lists.append([name, int(start) if start and start.isdecimal() and len(start) < 9 else 1, False])
        elif name == "li":
            kind, number, _ = self.lists[-1] if self.lists else ("ul", 1, False)
            self.fresh = False
            self.line()
            if self.lists:
                self.lists[-1][1:] = [number + 1, True]
            if not self.inside("cell"):
                self.write("  " * min(DEEPEST, max(0, len(self.lists) - 1)) + (f"{number}. " if kind == "ol" else "- "))
                self.fresh = True
        elif name == "a":
            self.close("link")
            href = attribute(attributes, "href")
            if href:
                self.push("link", href.strip().replace(" ", "%20").replace(")", "%29"))
        elif name == "img":
            alt = attribute(attributes, "alt")
            if alt:
                self.write(f"![{alt}]({attribute(attributes, 'src') or ''})")
        elif name == "pre":
            self.line()
            if not self.n_pre:
                self.push("pre")
                self.n_pre = 1
        elif name == "code":
            if not self.n_pre:
                self.write("`")
        elif name == "hr":
            self.write("\n\n* * *\n\n")  # three dashes would part pages
        elif name == "table":
            self.push("table", [])
        elif name == "tr":
            self.close("cell")
            if self.open and self.open[-1][0] == "table":
                self.open[-1][1].append([])

    def end(self, name: str) -> None:
        if name in ("td", "th", "tr"):
            self.close("cell")
        elif name in HEADINGS or name in BLOCKS:
            self.fresh = False
            self.line()
        elif name in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            if not self.lists:
                self.fresh = False
                self.line()
        elif name == "a":
            self.close("link")
        elif name == "pre":
            self.close("pre")
        elif name == "code":
            if not self.n_pre:
                self.write("`")
        elif name == "table":
            self.close("cell")
            if self.open and self.open[-1][0] != "table":
                self.close("table")
            elif self.open:
                self.pop()

    def markdown(self) -> str:
        while self.open:
            self.pop()
        text = re.sub(r"\n{2,}", "\n\n", "".join(self.texts[0])).strip("\n")
        if self.verbatim:
            pieces = text.split(MARK)
            text = "".join(f"```\n{self.verbatim[int(p)]}\n```" if i % 2 else p for i, p in enumerate(pieces))
        return text


def attribute(attributes: str, name: str) -> str | None:
    for m in ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() == name:
            return unescape(next(g for g in m.groups()[1:] if g is not None))
    return None


def to_markdown(html: str, keep_frame: bool = False) -> str:
    html = html.replace(MARK, "")
    page, at, size = Page(), 0, len(html)
    dropped = DROPPED if keep_frame else DROPPED | FRAME
    unpaired: set[str] = set()  # quotes without another one further on

    def tag_end(at: int) -> int:
        """Where the tag's ``>`` is, quoted ones passed over; -1 if there is none."""
        while found := STOP.search(html, at):
            char, at = found.group(), found.end()
            if char == ">":
                return found.start()
            if char not in unpaired:
                other = html.find(char, at)
                if other < 0:
                    unpaired.add(char)
                else:
                    at = other + 1
        return -1

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        if lt > at:
            page.text(html[at:lt])
        if plain := PLAIN_TAG.match(html, lt):
            closing, tag, attributes = plain.groups()
            at = plain.end()
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        else:
            name = NAME.match(html, lt)
            if name is None and html[lt + 1:lt + 2] not in ("!", "?"):
                page.write("<")
                at = lt + 1
                continue
            end = tag_end(name.end()) if name else html.find(">", lt)
            if end < 0:
                end = html.find(">", lt)  # a quote that is never closed counts as a character
            if end < 0:
                page.text(html[lt:])
                break
            at = end + 1
            if name is None:
                continue
            closing, tag = name.groups()
            attributes = html[name.end():end]
        tag = tag.lower()
        if closing:
            if tag in ENDED:
                page.end(tag)
        elif tag in dropped:
            if tag == "head" and not re.compile(r"</head\s*>", re.I).search(html, at):
                body = re.compile(r"<body\b", re.I).search(html, at)
                at = body.start() if body else size
            else:
                at = after_element(html, at, tag)
        elif tag in STARTED:
            page.start(tag, attributes)
    return page.markdown()
