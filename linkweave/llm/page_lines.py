"""Lines of a scanned page: running headers, page numbers, and words divided between lines."""

from __future__ import annotations

import re

# Hyphens that end a line within a word.
BREAKS = "‐¬\u00ad-"

# Characters and what they are often misread as.
CONFUSIONS = [
    ("l", "1"), ("i", "1"), ("i", "l"), ("o", "0"), ("O", "0"), ("s", "5"), ("S", "5"), ("b", "6"), ("B", "8"), ("g", "9"), ("g", "q"), ("z", "2"),
    ("e", "c"), ("c", "e"), ("a", "o"), ("n", "u"), ("u", "n"), ("h", "b"), ("t", "f"), ("f", "t"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("d", "cl"),
    ("cl", "d"), ("w", "vv"), ("li", "h"), ("ri", "n"), ("I", "l"), ("l", "I"), ("l", "|"), ("i", "|"),
]


def misread(word: str) -> set[str]:
    """What a word may look like with one character misread."""
    return {word[:i] + b + word[i + len(a) :] for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)}


_N = r"(?:\d{1,4}|[ivxlc]{1,7})"
_MARK = r"[|–—·•~\-]"
PAGE_NUMBER = re.compile(
    rf"^\s*(?:{_MARK}\s*)?(?:\d{{1,4}})(?:\s*{_MARK})?\s*$"
    rf"|^\s*[\[(]\s*\d{{1,4}}\s*[\])]\s*$"
    rf"|^\s*(?:{_MARK}\s*)?(?:p|pp|pg|page|seite|s|página|pagina|pág)\.?\s*{_N}(?:\s*(?:of|/|von|de|sur)\s*\d{{1,4}})?(?:\s*{_MARK})?\s*$"
    rf"|^\s*\d{{1,4}}\s*(?:of|/)\s*\d{{1,4}}\s*$",
    re.I,
)
_LEAD = re.compile(rf"^\s*(?:\d{{1,4}}(?:\s{{2,}}|\t|\s*[|·]\s*)|[|·]\s*)")
_TAIL = re.compile(r"(?:(?:\s{2,}|\t|\s*[|·]\s*)\d{1,4}|\s*[|·])\s*$")
# The small words of titles and names.
_SMALL = set("of and on the in for et al al. & by to a an de der und la vol. no. vol no".split())
_SMALL |= {x for w in _SMALL for x in misread(w) if not x.isdigit()}
_WORD = re.compile(r"^(?:[A-ZÀ-Þ][\w'’-]*\.?,?|[A-Z]\.(?:-?[A-Z]\.)*|\d{1,4}|\(\d{4}\)|\d{1,3}\(\d{1,3}\))$")
_ABBREVIATED = re.compile(r"(?:\b[ao][l1]|\b[A-Z][a-z]{0,4})\.$")
_TITLE = re.compile(r"^(?:The|Thc|Tbe|A|An|On)(?: [\w-]+){1,5} (?:of|0f|in|for|on|and|from)(?: (?:the|a|an))? [A-ZÀ-Þ][\w-]+$")
# Parts of bibliographic entries that may fill a line of their own.
_ENTRY_PART = re.compile(r"^(?:J [A-Z][\w-]+|[A-Z][\w-]+) Res\.$|^(?:In:? )?Proceedings of the [\w-]+$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_MARKUP = re.compile(r"^\s*(?:#{1,6}\s|[*+-]\s|\d+[.)]\s|>|\||\\|<|\{|=|!\[|\[\[|%|:|;)|^(?: {4}|\t)|^\s*(?:-{3,}|={3,}|\*{3,})\s*$")
_ENVIRONMENT = re.compile(r"\\begin\{(\w+\*?)\}")
_TAGGED = re.compile(r"<(pre|code|syntaxhighlight|source|math)\b[^>]*>", re.I)


def header_key(line: str) -> tuple[str, bool]:
    """The text of a would-be header without page number, folded, and whether it had one."""
    bare = _TAIL.sub("", _LEAD.sub("", line)).strip()
    return " ".join(bare.split()).casefold(), bare != line.strip()


_ODD = re.compile(r"[;:!?\"<>{}\\=$@/\[\]]")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
# the end of a sentence or entry, and the names that begin one, are no header
_SENTENCE_END = re.compile(r"(?:\w{3,}|\b[ao][l1]|\d)\.\s+[A-ZÀ-Þ]")
_ABBREVIATION_FIRST = re.compile(r"[A-Z]\w{0,3}\.\s")
_ENTRY_NAME = re.compile(r"\b[A-ZÀ-Þ][\w-]+ [A-Z]{1,2}(?:,|\.(?:\s|$))")
_PROPER = re.compile(r"[A-ZÀ-Þ]\w+")


def header_shape(line: str) -> int:
    """0: not the form of a running header; 1: of a title in sentence case; 2: of names, a journal or capitals."""
    s = line.strip()
    if not s or s[0].islower() or s[-1] in ",;:-" or len(s) > 110:
        return 0
    if not s[0].isupper():
        s = _LEAD.sub("", s)
    bare = _TAIL.sub("", s).strip()
    upper = bare.upper() == bare
    if upper and len(bare) > 6:
        bare = " ".join(w.lower() if w.lower() in _SMALL else w.capitalize() for w in bare.split())
        bare = bare[:1].upper() + bare[1:]
    if not bare or not bare[0].isupper() or len(bare) > 90 or _ODD.search(bare) or bare[-1] in ",-" or bare[-1] == "." and not _ABBREVIATED.search(bare):
        return 0
    words = bare.split()
    if len(words) < 2:
        return 0
    small = proper = 0
    for w in words:
        if w.lower() in _SMALL:
            small += 1
        elif _WORD.match(w):
            proper += 1
    if small + proper < len(words) - 5:
        return 0
    if _SENTENCE_END.search(bare) and not _ABBREVIATION_FIRST.match(bare) or _ENTRY_NAME.search(bare) or _ENTRY_PART.match(bare) or not _LETTERS.search(bare):
        return 0
    if upper:
        return 2
    if small + proper == len(words) and any(w.lower() not in _SMALL and _PROPER.match(w) for w in words):
        return 2 if words[0].lower() not in ("the", "a", "an", "in", "to", "as", "no", "for", "on", "by") else 1
    return 1 if _TITLE.match(bare) else 0


_SIGNS = frozenset("`~$\\<#*+-=|>![:;%{0123456789")
_UNDERLINE = re.compile(r"^\s*(?:={3,}|-{3,})\s*$")
_NUMBERED_HEADER = re.compile(r"^\s*[–—·|-]?\s*\d{1,4}\s")
_LISTS = ("itemize", "enumerate", "document", "description")


def line_kinds(lines: list[str]) -> list[str]:
    """For each line: blank, code (or formula or environment), mark (markup), or text."""
    out: list[str] = []
    fence = closing = ""
    last = len(lines) - 1
    for k, line in enumerate(lines):
        if fence:
            out.append("code")
            if line.lstrip().startswith(fence):
                fence = ""
            continue
        if closing:
            out.append("code")
            if closing in line:
                closing = ""
            continue
        s = line.strip()
        if not s:
            out.append("blank")
            continue
        c = s[0]
        if c not in _SIGNS:
            if "\\begin{" in s or "<" in s and _TAGGED.search(s):
                pass
            elif line[0] == "\t" or line.startswith("    "):
                out.append("mark")
                continue
            else:
                nxt = lines[k + 1] if k < last else ""
                out.append("mark" if nxt[:3] in ("---", "===") and _UNDERLINE.match(nxt) and out[-1:] != ["text"] else "text")
                continue
        if m := _FENCE.match(line):
            fence = m.group(1)
            out.append("code")
        elif s == "$$" or s == "\\[":
            closing = "$$" if "$" in s else "\\]"
            out.append("code")
        elif (m := _ENVIRONMENT.search(line)) and f"\\end{{{m.group(1)}}}" not in line:
            if m.group(1).rstrip("*") in _LISTS:
                out.append("mark")
            else:
                closing = f"\\end{{{m.group(1)}}}"
                out.append("code")
        elif (m := _TAGGED.search(line)) and f"</{m.group(1)}>" not in line.lower():
            closing = f"</{m.group(1)}>"
            out.append("code")
        elif k < last and _UNDERLINE.match(lines[k + 1]) and out[-1:] != ["text"]:
            out.append("mark")
        elif _MARKUP.match(line) and not PAGE_NUMBER.match(line) and not _NUMBERED_HEADER.match(line):
            out.append("mark")
        else:
            out.append("text")
    return out


def _stuffed(lines: list[str], i: int, width: int) -> bool:
    """Whether a filled paragraph could have ended line i there: the next line's first word wouldn't have fitted."""
    nxt = lines[i + 1].split(None, 1) if i + 1 < len(lines) else []
    return not nxt or len(lines[i].rstrip()) + 1 + len(nxt[0]) > width


class Page:
    """A text by lines: ``lines``, their ``kinds``, and ``found``, the furniture.

    ``found`` holds (line index, kind, key, strength); kinds are page_number and running_header. Strength 1 is a title
    that may as well be the first line of a text; ``skip`` holds the lines of the others.
    """

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.found: list[tuple[int, str, str, int]] = []
        if len(self.lines) == 1:
            self.kinds = ["text"]
            self.skip: set[int] = set()
            return
        lines, kinds = self.lines, line_kinds(self.lines)
        self.kinds = kinds
        out: list[tuple[int, str, str, int]] = []
        keys: dict[str, int] = {}
        width = -1
        for i, line in enumerate(lines):
            if kinds[i] != "text":
                continue
            if len(line) < 40 and PAGE_NUMBER.match(line):
                out.append((i, "page_number", "", 2))
                continue
            shape = header_shape(line)
            if not shape:
                continue
            if width < 0:
                width = max((len(x.rstrip()) for x, k in zip(lines, kinds) if k == "text" and "://" not in x and "www." not in x), default=0)
            key, paged = header_key(line)
            keys[key] = keys.get(key, 0) + 1
            alone = (i == 0 or kinds[i - 1] == "blank") and (i + 1 == len(lines) or kinds[i + 1] == "blank")
            sure = shape == 2 or paged or alone or i > 0 or line.upper() == line or not _stuffed(lines, i, width)
            out.append((i, "running_header", key, 2 if sure else 1))
        near = {i for i, kind, _, _ in out if kind == "page_number"}
        self.found = [(i, kind, key, 2 if kind == "running_header" and (keys[key] > 1 or near & {i - 1, i + 1, i - 2, i + 2}) else strength) for i, kind, key, strength in out]
        self.skip = {x[0] for x in self.found if x[3] > 1}


_DIVIDED = re.compile(rf"(?<![\w{BREAKS}’'])([^\W\d_]+)([{BREAKS}])$")
_REST = re.compile(r"^([^\W\d_]+)(?![\w’'])(-?)")
BLANKED = re.compile(rf"(?<![\w{BREAKS}’'/.])([^\W\d_]+)([{BREAKS}])[ \t]+([^\W\d_]+)(?![\w’'])(-?)")
URLISH = re.compile(r"(?:https?|ftp)://|www\.", re.I)


SPACED = tuple(h + " " for h in BREAKS)


def divided(page: Page) -> list[tuple[str, str, str, bool]]:
    """``(head, hyphen, rest, by line)`` of the words divided at line ends, furniture lines between or not, or by what was one."""
    out = []
    lines, kinds, skip = page.lines, page.kinds, page.skip
    for i, line in enumerate(lines):
        if kinds[i] == "code" or i in skip:
            continue
        body = line.rstrip()
        if body and body[-1] in BREAKS and (m := _DIVIDED.search(body)) and not URLISH.match(body.split()[-1]):
            j = i + 1
            while j < len(lines) and (j in skip or kinds[j] == "blank"):
                j += 1
            crossed = any(x in skip for x in range(i + 1, j))
            if j < len(lines) and (j == i + 1 or crossed):
                r = _REST.match(lines[j].lstrip())
                if r and not r.group(2):
                    out.append((m.group(1), m.group(2), r.group(1), True))
        if any(h in line for h in SPACED):
            for m in BLANKED.finditer(line):
                if not m.group(4):
                    out.append((m.group(1), m.group(2), m.group(3), False))
    return out
