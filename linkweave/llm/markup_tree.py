"""A tree of the parts of a text in HTML, Markdown, wiki or LaTeX markup, often mixed.

The parser proposes; it doesn't decide. HTML is read by its tags, wherever lines break: lists, items, tables and other containers are
nodes that hold what stands between their tags. Everything else is read by lines: what may be a heading, item, code block or
formula becomes a node with its content; nested items stand below the item they are indented under, what stands within a would-be code block
below it, and formulas within running text below the paragraph, item or heading that holds them. No text is lost: rows of tables and
captions are text. Furniture of pages is left out where more than its look speaks for it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from linkweave.llm.page_lines import PAGE_NUMBER, header_key, header_shape

KINDS = ("none", "heading", "item", "code", "formula")
FAMILIES = ("text", "box", "row", "hash", "underlined", "equals", "h", "section", "bullet", "ordered", "stars", "li", "latexitem", "fence", "pre", "highlight", "verbatim", "dollar", "dollars", "bracket", "paren", "equation", "math")
_FAMILY = {f: k for k, f in enumerate(FAMILIES)}
CODES = ("fence", "pre", "highlight", "verbatim")
ITEMS = ("bullet", "ordered", "stars", "li", "latexitem")
INLINE = ("dollar", "dollars", "bracket", "paren", "math")


@dataclass
class Node:
    family: str
    content: str
    raw: str
    line: int
    parent: int = -1
    attributes: str = ""
    facts: dict[str, int] = field(default_factory=dict)
    mates: int = 0  # siblings of the same family right before and after
    number: int = -1
    follows: int = 0  # whether its number continues that of a neighbour
    depth: int = 0
    coded: bool = False  # whether a would-be code block is above it
    siblings: int = 0
    alike: int = 0  # siblings of its family
    below: int = 0  # nodes below it
    text: int = 0  # characters of content in its subtree
    span: tuple[int, int] | None = None  # where it stands in the content of its parent


_HASH = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_EQUALS = re.compile(r"^\s*(={1,6})(?!=)\s*(.+?)\s*(?<!=)\1\s*$")
_UNDER = re.compile(r"^\s*(?:={3,}|-{3,})\s*$")
_SECTION = re.compile(r"^\s*\\((?:sub)*section|chapter|(?:sub)?paragraph)\*?\s*\{(.*?)\}\s*(?:\\label\{[^}]*\}\s*)?$")
_BULLET = re.compile(r"^\s*([-*+•])[ \t]+(\S.*)$")
_STARS = re.compile(r"^\s*([*#]{2,6}|[*#]+:)[ \t]+(\S.*)$")
_ORDERED = re.compile(r"^\s*(\d{1,3})[.)][ \t]+(\S.*)$")
_ITEM = re.compile(r"^\s*\\item\b(?:\[[^\]]*\])?\s*(.*)$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})\s*([^`]*)$")
_VERBATIM = ("verbatim", "lstlisting", "minted", "alltt")
_ENV = re.compile(r"\\begin\{(verbatim|lstlisting|minted|alltt|equation|align|gather|displaymath|eqnarray|multline|math)(\*?)\}(?:\[[^\]]*\]|\{[^}]*\})?")
_LIST_ENV = re.compile(r"^\s*\\(begin|end)\{(itemize|enumerate|description|figure|table|tabular|center|document|quote|abstract)\*?\}")
_MATH = re.compile(r"<math\b([^>]*)>(.*?)</math\s*>", re.I | re.S)
_INLINE = re.compile(r"<math\b([^>]*)>(.*?)</math\s*>|\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.I | re.S)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)")
_BLOCKISH = frozenset("#=<\\-*+•~`|$![{:;&0123456789")
_TABLE_RULE = re.compile(r"^[\s|:+=-]+$")
_IMAGE = re.compile(r"^!\[([^\]]*)\]\([^)]*\)\s*$|^\[\[(?:File|Image):(?:[^|\]]*\|)*([^|\]]*)\]\]\s*$", re.I)

#: Elements that are blocks, in lower case. All others are within running text.
_TAG = re.compile(r"<(/?)(h[1-6]|li|ul|ol|dl|dt|dd|div|p|table|thead|tbody|tfoot|tr|blockquote|section|article|header|footer|main|nav|aside|figure|figcaption|pre|syntaxhighlight|source|hr|body|html|head|script|style)(?=[\s/>])([^<>]*)>", re.I)
_HOLDS_CODE = ("pre", "syntaxhighlight", "source")
_CODE_TAG = re.compile(r"\s*<code\b([^>]*)>", re.I)
_CODE_END = re.compile(r"</code\s*>\s*$", re.I)
_CELL = re.compile(r"</?t[dh]\b[^<>]*>", re.I)
_BREAK = re.compile(r"<br\s*/?>", re.I)
_OPAQUE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^`\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)|\\begin\{(verbatim|lstlisting|minted|alltt)\}.*?(?:\\end\{\2\}|\Z)|`[^`\n]+`", re.M | re.S)


def _laid_out(text: str, drop: set[int]) -> tuple[list[str], list[int], dict[int, tuple]]:
    """Lines, their numbers in the text, and by index the block tags that stand in place of a line: ``(what, name, attributes, inner, raw)``."""
    lines = text.split("\n")
    if not _TAG.search(text):
        return lines, list(range(len(lines))), {}
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    shut = [(m.start(), m.end()) for m in _OPAQUE.finditer(text)] if "`" in text or "~" in text or "\\begin" in text else []
    tags = [m for m in _TAG.finditer(text) if not (shut and _within(shut, m.start()))]
    out: list[str] = []
    numbers: list[int] = []
    events: dict[int, tuple] = {}
    at = 0

    def number(pos: int) -> int:
        return bisect_right(starts, pos) - 1

    def emit(end: int) -> None:
        nonlocal at
        if end > at:
            first = number(at)
            got = text[at:end].split("\n")
            # what is left of a line beside a tag is a line only if it holds something
            keep = [(x, first + k) for k, x in enumerate(got) if x.strip() or 0 < k < len(got) - 1]
            out.extend(x for x, _ in keep)
            numbers.extend(k for _, k in keep)
        at = max(at, end)

    def event(what: str, m: re.Match, inner: str, end: int) -> None:
        nonlocal at
        if inner and drop and what in ("h", "li", "tr"):
            first = number(m.end())
            inner = "\n".join(x for k, x in enumerate(inner.split("\n"), first) if k not in drop)
        events[len(out)] = (what, m.group(2).lower(), m.group(3), inner, text[m.start() : end])
        out.append("")
        numbers.append(number(m.start()))
        at = end

    for k, m in enumerate(tags):
        if m.start() < at:  # within a block that is taken whole
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        emit(m.start())
        if closing or name == "hr":
            event("close" if closing else "rule", m, "", m.end())
        elif name in _HOLDS_CODE or name in ("script", "style", "tr") or name[0] == "h" and name[1:].isdigit():
            end = re.compile(rf"</{name}\s*>", re.I).search(text, m.end())
            if name[0] == "h" and end is None or name == "tr" and end is None:  # never closed: to the next block or the end of its line
                stop = min([text.find("\n", m.end()) % (len(text) + 1), *[t.start() for t in tags[k + 1 : k + 2]]])
                event(name if name == "tr" else "h", m, text[m.end() : stop], stop)
                continue
            stop, after = (end.start(), end.end()) if end else (len(text), len(text))
            what = "code" if name in _HOLDS_CODE else "none" if name in ("script", "style") else "tr" if name == "tr" else "h"
            event(what, m, text[m.end() : stop], after)
            if what == "code":
                events[len(out) - 1] += (end is not None,)
        elif name in ("li", "dt", "dd"):
            stop = tags[k + 1].start() if k + 1 < len(tags) else len(text)
            blank = re.compile(r"\n[ \t]*\n").search(text, m.end(), stop)
            stop = blank.start() if blank else stop
            event("li" if name == "li" else "open", m, text[m.end() : stop] if name == "li" else "", stop if name == "li" else m.end())
        else:
            event("open", m, "", m.end())
    emit(len(text))
    return out, numbers, events


def _within(spans: list[tuple[int, int]], pos: int) -> bool:
    k = bisect_right(spans, (pos, 1 << 62)) - 1
    return k >= 0 and spans[k][0] <= pos < spans[k][1]


_UNFINISHED = re.compile(r"[^.!?:;\]})>\"”|]\s*$")


def furniture(lines: list[str]) -> set[int]:
    """Lines with nothing but a page number, and those with the look of a running header for which more speaks: a page number in or beside
    it, the same line twice, or a sentence that goes on across it, between blank lines."""
    numbers, headers = set(), {}
    for i, line in enumerate(lines):
        if len(line) > 110 or not (s := line.strip()):
            continue
        if len(s) < 40 and PAGE_NUMBER.match(line) and s[0] not in "*•-#":
            numbers.add(i)
        elif len(s) < 90 and s[0] not in "#=<\\-*+•~`$![{:;&" and header_shape(line) == 2:
            headers[i] = header_key(line)
    if not headers:
        return numbers
    often = Counter(key for key, _ in headers.values())
    out = set(numbers)
    for i, (key, paged) in headers.items():
        if paged or often[key] > 1 or numbers & {i - 2, i - 1, i + 1, i + 2}:
            out.add(i)
            continue
        a, b = i - 1, i + 1
        while a >= 0 and (not lines[a].strip() or a in numbers):
            a -= 1
        while b < len(lines) and (not lines[b].strip() or b in numbers):
            b += 1
        if a >= 0 and b < len(lines) and a < i - 1 and b > i + 1 and _UNFINISHED.search(lines[a]) and lines[b].lstrip()[:1].islower():
            out.add(i)
    return out


def parse(text: str) -> list[Node]:
    """The nodes of a text, parents before what is below them."""
    original = text.split("\n")
    drop = furniture(original)
    lines, numbers, events = _laid_out(text, drop) if "<" in text else (original, range(len(original)), {})
    skip = drop if lines is original else {k for k, x in enumerate(numbers) if x in drop and lines[k] == original[x]}
    nodes: list[Node] = []
    paragraph: list[str] = []
    started = [0]
    item: int = -1  # the item that is open for further lines
    boxes: list[tuple[str, int]] = []  # open containers, by name
    nest: list[tuple[int, int]] = []  # indents and indices of the open Markdown items
    n = len(lines)
    k = 0

    def above() -> int:
        return boxes[-1][1] if boxes else -1

    def close() -> None:
        nonlocal item
        if item >= 0:
            _inline(item, nodes)
            item = -1
        if paragraph:
            joined = " ".join(paragraph)
            _put(nodes, Node("text", joined, joined, started[0], parent=above()))
            _inline(len(nodes) - 1, nodes)
            paragraph.clear()

    def add(node: Node, parent: int | None = None) -> int:
        close()
        if node.family not in ("bullet", "ordered", "stars"):
            nest.clear()
        node.parent = above() if parent is None else parent
        return _put(nodes, node)

    def block(family: str, begin: int, raw: str, content: list[str], attributes: str = "", closed: bool = True) -> None:
        at = add(Node(family, "\n".join(content), raw, begin, attributes=attributes))
        nodes[at].facts["closed"] = int(closed)
        if family in CODES:
            for x, inner in enumerate(content):
                for child in _line(inner, begin + x):
                    child.parent = at
                    _put(nodes, child)

    def open_(name: str, raw: str, line: int, attributes: str = "") -> None:
        boxes.append((name, add(Node("box", "", raw, line, attributes=attributes))))

    def shut(name: str) -> None:
        close()
        if any(x == name for x, _ in boxes):
            while boxes.pop()[0] != name:
                pass

    def until(begin: int, mark: str) -> int:
        j = begin
        while j < n and mark not in lines[j]:
            j += 1
        return j

    def more(s: str, line: str) -> None:
        if item >= 0:
            nodes[item].content += " " + s
            nodes[item].raw += "\n" + line
        else:
            if not paragraph:
                started[0] = numbers[k]
            paragraph.append(s)

    while k < n:
        line = lines[k]
        s = line.strip()
        if k in events:
            what, name, attributes, inner, raw, *rest = events[k]
            at = numbers[k]
            if what == "open":
                if name == "p" and boxes and boxes[-1][0] == "p":  # a paragraph ends where the next one begins
                    shut("p")
                open_(name, raw, at, attributes)
            elif what == "close":
                shut(name)
            elif what == "h":
                _inline(add(Node("h", " ".join(inner.split()), raw, at, attributes=attributes)), nodes)
            elif what == "li":
                if boxes and boxes[-1][0] == "li":  # an item that was never closed
                    shut("li")
                i = add(Node("li", " ".join(inner.split()), raw, at, attributes=attributes))
                _inline(i, nodes)
                if boxes and boxes[-1][0] in ("ul", "ol"):
                    boxes.append(("li", i))
            elif what == "tr":
                cells = [c for c in (" ".join(x.split()) for x in _CELL.split(inner)) if c]
                if cells:
                    _inline(add(Node("row", " | ".join(cells), raw, at, attributes=attributes)), nodes)
            elif what == "code":
                m = _CODE_TAG.match(inner)
                body = _CODE_END.sub("", inner[m.end() :] if m else inner).strip("\n")
                block("pre" if name == "pre" else "highlight", at, raw, body.split("\n"), attributes + (m.group(1) if m else ""), rest[0])
            elif what == "rule":
                close()
            k += 1
            continue
        if not s:
            close()
            k += 1
            continue
        c = s[0]
        if k in skip:  # page furniture ends nothing
            k += 1
            continue
        if c not in _BLOCKISH and "\\begin{" not in s:
            if k + 1 < n and lines[k + 1][:3] in ("---", "===") and _UNDER.match(lines[k + 1]) and not paragraph and item < 0 and len(lines[k + 1].strip()) > 2:
                _inline(add(Node("underlined", s, line, numbers[k])), nodes)
                k += 2
                continue
            if nest and item < 0 and line[0] not in " \t":
                nest.clear()
            more(s, line)
            k += 1
            continue
        if m := _FENCE.match(line):
            j = k + 1
            while j < n and not (lines[j].strip().startswith(m.group(1)) and not lines[j].strip().strip("`~")):
                j += 1
            block("fence", numbers[k], "\n".join(lines[k : j + 1]), lines[k + 1 : j], m.group(2), j < n)
            k = j + 1
            continue
        if m := _ENV.search(line):
            mark = f"\\end{{{m.group(1)}{m.group(2)}}}"
            if m.start() and line[: m.start()].strip():
                more(line[: m.start()].strip(), line[: m.start()])
            j = until(k, mark)
            raw = "\n".join(lines[k : j + 1])
            body, _, after = raw[m.end() :].partition(mark)
            verbatim = m.group(1) in _VERBATIM
            block("verbatim" if verbatim else "equation", numbers[k], raw, body.strip("\n").split("\n") if verbatim else [body.strip("\n")], "", j < n)
            if after.strip():  # what stands behind it on its line
                lines[j] = after
                k = j
                continue
            k = j + 1
            continue
        if s == "$$" or s == "\\[":
            j = until(k + 1, "$$" if c == "$" else "\\]")
            block("dollars" if c == "$" else "bracket", numbers[k], "\n".join(lines[k : j + 1]), ["\n".join(lines[k + 1 : j])], "", j < n)
            k = j + 1
            continue
        if c == "\\" and (m := _LIST_ENV.match(line)):
            close()
            if m.group(1) == "begin":
                open_(m.group(2), line, numbers[k])
            else:
                shut(m.group(2))
            k += 1
            continue
        found = _line(line, numbers[k])
        if found:
            head = found[0]
            if head.family in ITEMS:
                head.facts["glued"] = int(bool(paragraph))
                if head.family == "ordered" and paragraph:  # perhaps a line of the paragraph: proposed, and kept in it too
                    paragraph.append(s)
                    head.parent = above()
                    _put(nodes, head)
                    k += 1
                    continue
                indent = len(line) - len(line.lstrip())
                if head.family in ("bullet", "ordered", "stars"):
                    level = len(_STARS.match(line).group(1)) if head.family == "stars" else indent
                    close()
                    while nest and nest[-1][0] >= level:
                        nest.pop()
                    item = add(head, nest[-1][1] if nest else None)
                    nest.append((level, item))
                else:
                    item = add(head)
            else:
                i = add(head)
                if head.family not in INLINE:
                    _inline(i, nodes)
            k += 1
            continue
        if c == "|" or c in "{!" and s[:2] in ("{|", "! "):
            close()
            if not _TABLE_RULE.match(s) and not s.startswith(("{|", "|}", "|-")):
                cells = [x for x in (" ".join(x.split()) for x in re.split(r"(?<!\\)\|+|!!", s.lstrip("!"))) if x]
                if cells:
                    _inline(add(Node("row", " | ".join(cells), line, numbers[k])), nodes)
            k += 1
            continue
        if m := _IMAGE.match(s):
            close()
            if caption := (m.group(1) or m.group(2) or "").strip():
                _put(nodes, Node("text", caption, line, numbers[k], parent=above()))
            k += 1
            continue
        if _UNDER.match(line) or s.startswith("<!--") and s.endswith("-->") or re.match(r"\\(?:includegraphics|centering|label|bibliography\w*|maketitle|hline|(?:begin|end)\{[^}]*\})(?:\[[^\]]*\])?(?:\{[^}]*\})*\s*$", s):
            close()  # nothing but markup
            k += 1
            continue
        more(s, line)
        k += 1
    close()
    _relate(nodes)
    return nodes


def _put(nodes: list[Node], node: Node) -> int:
    if node.parent >= 0:
        up = nodes[node.parent]
        node.depth, node.coded = up.depth + 1, up.coded or up.family in CODES
    nodes.append(node)
    return len(nodes) - 1


def _line(line: str, k: int) -> list[Node]:
    """What a single line may be."""
    s = line.strip()
    if not s:
        return []
    c = s[0]
    if c == "#" and (m := _HASH.match(line)) and m.group(2):
        return [Node("hash", m.group(2), line, k)]
    if c == "=" and (m := _EQUALS.match(line)):
        return [Node("equals", m.group(2), line, k)]
    if c == "<":
        if (m := _MATH.match(s)) and m.end() == len(s):
            return [Node("math", m.group(2), line, k, attributes=m.group(1))]
        return []
    if c == "\\":
        if m := _SECTION.match(line):
            return [Node("section", m.group(2), line, k)]
        if m := _ITEM.match(line):
            return [Node("latexitem", m.group(1), line, k)]
        if s.startswith("\\[") and s.endswith("\\]") and len(s) > 4:
            return [Node("bracket", s[2:-2], line, k)]
        if s.startswith("\\(") and s.endswith("\\)") and s.count("\\(") == 1:
            return [Node("paren", s[2:-2], line, k)]
        return []
    if c == "$":
        if s.startswith("$$") and s.endswith("$$") and len(s) > 4:
            return [Node("dollars", s[2:-2], line, k)]
        return []
    if (m := _BULLET.match(line)) and not PAGE_NUMBER.match(line):
        return [Node("bullet", m.group(2), line, k)]
    if c in "*#" and (m := _STARS.match(line)):
        return [Node("stars", m.group(2), line, k)]
    if c.isdigit() and (m := _ORDERED.match(line)):
        return [Node("ordered", m.group(2), line, k, number=int(m.group(1)))]
    return []


def _inline(holder: int, nodes: list[Node]) -> None:
    """Formulas within the content of a node, below it. Between all neighbouring dollar signs there may be one, however far apart."""
    text, line = nodes[holder].content, nodes[holder].line
    found: list[Node] = []

    def put(family: str, content: str, a: int, b: int, attributes: str = "") -> None:
        found.append(Node(family, content, text[a:b], line, parent=holder, attributes=attributes, span=(a, b)))

    if "\\" in text or "<" in text or "$$" in text:
        for m in _INLINE.finditer(text):
            if m.group(2) is not None:
                put("math", m.group(2), *m.span(), m.group(1))
            else:
                family, content = next((f, g) for f, g in zip(("paren", "bracket", "dollars"), m.groups()[2:]) if g is not None)
                put(family, content, *m.span())
    if "$" in text:
        at = [i for i, ch in enumerate(text) if ch == "$" and (i == 0 or text[i - 1] != "\\") and text[i - 1 : i] != "$" and text[i + 1 : i + 2] != "$"]
        for a, b in zip(at, at[1:]):
            if b - a > 1:
                put("dollar", text[a + 1 : b], a, b + 1)
    for node in sorted(found, key=lambda x: x.span):
        _put(nodes, node)


def _relate(nodes: list[Node]) -> None:
    """Statistics of siblings and subtrees."""
    last: dict[int, Node | None] = {}
    count: Counter = Counter()
    alike: Counter = Counter()
    for x in nodes:
        count[x.parent] += 1
        alike[(x.parent, x.family)] += 1
        if x.family in INLINE:
            continue
        if x.family in ("text", "box"):
            last[x.parent] = None
            continue
        before = None if x.facts.get("glued") else last.get(x.parent)  # what stands before it is prose
        if before is not None and before.family == x.family:
            x.mates += 1
            before.mates += 1
            if x.number == before.number + 1 > 0:
                x.follows = before.follows = 1
        last[x.parent] = x
    for x in reversed(nodes):
        x.text += len(x.content)
        x.siblings, x.alike = count[x.parent] - 1, alike[(x.parent, x.family)] - 1
        if x.parent >= 0:
            up = nodes[x.parent]
            up.below += 1 + x.below
            if x.span is None:
                up.text += x.text


_OPERATORS = re.compile(r"[=^_<>+*/|]|\\[A-Za-z]+")
_WORDS = re.compile(r"(?<![\\\w])[a-z]{3,}(?![\w}])")


AMOUNT = re.compile(r"\d[\d.,]*\s+\W*(?:\\?(?:it|em|emph|bf|textbf|textit|span|b|i)\b\W*(?:class\W+\w\W+)?)?[a-z]{2,}")


#: Buckets of the tokens of attributes: names, and the words of class, id and lang.
TOKENS = 12


def _bucket(token: str) -> int:
    h = 0
    for b in token.lower().encode():
        h = (h * 31 + b) & 0xFFFF
    return h % TOKENS


def features(x: Node, nodes: list[Node]) -> list[int]:
    """Small integers: family, attribute tokens, depth, what stands above, statistics of siblings and subtree, and the form of the content.

    Those of the family come first; ``len(FAMILIES)`` of them.
    """
    c = x.content.strip()
    n = len(c)
    words = len(_WORDS.findall(c))
    tokens = [0] * TOKENS
    if x.attributes:
        for name, value in _ATTRIBUTE.findall(x.attributes):
            tokens[_bucket(name)] = 1
            if name.lower() in ("class", "id", "lang", "display"):
                for t in value.strip("\"'").split():
                    tokens[_bucket(t)] = 1
    hot = [0] * len(FAMILIES)
    hot[_FAMILY[x.family]] = 1
    up = nodes[x.parent] if x.parent >= 0 else None
    return hot + tokens + [
        int(x.coded),
        min(x.depth, 7),
        0 if up is None else 1 + (up.family in ITEMS) + 2 * (up.family in CODES) + 3 * (up.family in ("text", "row")),
        int(x.span is not None),
        min(x.mates, 3),
        min(15, x.siblings),
        min(15, 16 * x.alike // max(1, x.siblings)),
        min(15, x.below),
        min(15, 16 * x.text // max(1, len(x.raw))),
        0 if up is None else min(15, 16 * up.text // max(1, len(up.raw))),
        x.follows,
        x.facts.get("glued", 0),
        x.facts.get("closed", 1),
        min(15, 16 * n // max(1, len(x.raw))),
        min(15, n // 8),
        min(15, words),
        min(15, len(_OPERATORS.findall(c))),
        int("\\" in c),
        int(c[:1].isdigit()),
        int(c[:1].isupper()),
        int(c[-1:] in ".!?"),
        min(15, 16 * sum(ch.isalpha() for ch in c) // max(1, n)),
        int("://" in c),
        min(3, x.content.count("\n")),
        int(x.content[-1:] == " ") + 2 * int(x.content[:1] == " "),
        int(c[:1].isdigit() and AMOUNT.match(c) is not None),
    ]


# Emphasis, links and notes, in whatever markup.
_RULES: list[tuple[re.Pattern, str]] = [
    (re.compile(r"<ref\b[^>]*>.*?</ref>|<ref\b[^>]*/>|<!--.*?-->|\\label\{[^}]*\}|~?\\cite\w*\{[^}]*\}|\[\^[^\]]+\]|\{\{(?:cn|citation needed)[^}]*\}\}", re.S | re.I), ""),
    (re.compile(r"\(?\\footnote\{(?:[^{}]|\{[^{}]*\})*\}\)?"), ""),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)|\[\[(?:File|Image):(?:[^|\]]*\|)*([^|\]]*)\]\]", re.I), r"\1\2"),
    (re.compile(r"\\href\{[^}]*\}\{([^}]*)\}|\\(?:url|caption|texttt|textbf|textit|emph|underline|textsc|mathrm)\{((?:[^{}]|\{[^{}]*\})*)\}|\{\\(?:bf|it|em|tt|sc)\s+([^{}]*)\}"), r"\1\2\3"),
    (re.compile(r"\[([^\]\[]*)\]\((?:[^()\s]|\([^)]*\))*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+ ([^\]]+)\]"), r"\1"),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"'''(.+?)'''|''(.+?)''"), r"\1\2"),
    (re.compile(r"\*\*(.+?)\*\*|__(.+?)__"), r"\1\2"),
    (re.compile(r"(?<![\w*])\*(\S(?:[^*]*\S)?)\*(?![\w*])|(?<![\w_])_(\S(?:[^_]*\S)?)_(?![\w_])|`([^`]+)`"), r"\1\2\3"),
]
_LIGHT = re.compile(r"[\\<\[*_'`&{~]")
_ESCAPE = re.compile(r"\\([&%#_$*{}`~\[\]()!|>+.-])")


def clean(text: str) -> str:
    """Running text without markup and escapes, blanks made single."""
    if _LIGHT.search(text):
        for p, r in _RULES:
            text = p.sub(r, text)
        if "&" in text:
            text = unescape(text)
        if "\\" in text or "~" in text:
            text = re.sub(r"\\textasciitilde(?:\{\})?|\\~(?:\{\})?", "~", text)
            text = re.sub(r"(?<=\w)~(?=\\?\w)(?![^\s]*/)", " ", text) if "://" not in text else text
            text = _ESCAPE.sub(r"\1", text)
    return " ".join(text.split())


def piece(kind: str, x: Node) -> str:
    """The content of a node as what it was decided to be."""
    if kind == "code":
        first = next((y for y in x.content.split("\n") if y.strip()), "")
        return (unescape(first) if x.family == "pre" else first).strip()
    if kind == "formula":
        c = unescape(x.content) if x.family == "math" else x.content
        return " ".join(re.sub(r"\\label\{[^}]*\}", "", c).split())
    return clean(x.content)
