"""TEI XML as rows: sentences as arrays of tokens, notes, and reference entries.

Sentences are mixed content, whose order Spark's XML source doesn't keep, so files are parsed in Python, once, and everything the three
extractors need comes out of that one pass. A file that doesn't parse gives a row of kind ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import paper_ids
from linkweave.sources.files import read_binary
from linkweave.session import filled

_NS = "{http://www.tei-c.org/ns/1.0}"
_ID = "{http://www.w3.org/XML/1998/namespace}id"
#: Ancestors under which nothing is running text.
SKIPPED = frozenset(("figure", "figDesc", "table", "listBibl", "biblStruct", "back", "front"))
SCHEMA = (
    "paper_id string, file string, kind string, id string, container string, para int, sent int, eligible boolean, direct boolean, in_references boolean,"
    " tokens array<struct<kind:string,target:string,text:string>>, marker string, content string, url string"
)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element) -> str:
    return "".join(e.itertext())


def tokens(s: ET.Element) -> list[dict]:
    """A sentence as ``text`` and references of kinds foot, bibr and url with their targets, in order."""
    out: list[dict] = []

    def add(kind: str, target: str | None, text: str | None) -> None:
        if text or kind != "text":
            if kind == "text" and out and out[-1]["kind"] == "text":
                out[-1]["text"] += text
            else:
                out.append({"kind": kind, "target": target, "text": text or ""})

    def visit(e: ET.Element) -> None:
        for child in e:
            kind = child.get("type") if _tag(child) == "ref" else None
            if kind in ("foot", "bibr", "url"):
                target = child.get("target") or ""
                add(kind, target if kind == "url" else target.lstrip("#"), _text(child))
            else:
                add("text", None, child.text)
                visit(child)
            add("text", None, child.tail)

    add("text", None, s.text)
    visit(s)
    return out


def _entry_text(b: ET.Element) -> str:
    """An entry's text where the raw one is missing: authors, title, venue, year and address."""
    names = []
    for p in b.iter(f"{_NS}persName"):
        fore = " ".join((f.text or "").strip() for f in p.findall(f"{_NS}forename"))
        sur = p.find(f"{_NS}surname")
        name = f"{fore} {(sur.text or '').strip() if sur is not None else ''}".strip()
        if name:
            names.append(name)
    by = {}
    for t in b.iter(f"{_NS}title"):
        by.setdefault(t.get("level"), (t.text or "").strip())
    title = next((by[k] for k in "amsj" if by.get(k)), "")
    venue = [x for x in (next((t.text.strip() for lv in "jms" for t in b.findall(f".//{_NS}{part}/{_NS}title[@level='{lv}']") if t.text), "") for part in ("monogr", "series")) if x]
    date = b.find(f".//{_NS}date[@type='published']")
    year = re.match(r"\d{4}", date.get("when", "")) if date is not None else None
    ptr = b.find(f".//{_NS}ptr")
    parts = [", ".join(names), title, *venue, year.group() if year else "", ptr.get("target", "") if ptr is not None else ""]
    return ". ".join(p for p in parts if p)


_WEB = re.compile(r"(?i)^(?:(?:https?|ftp)://|www\.)")


def rows_of(paper: str, file: str, xml: bytes | str) -> list[dict]:
    """All rows of a paper: kinds sentence, note, entry or error."""
    base = dict.fromkeys(("id", "container", "para", "sent", "eligible", "direct", "in_references", "tokens", "marker", "content", "url")) | {"paper_id": paper, "file": file}
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return [base | {"kind": "error", "content": str(e)}]
    up = {c: p for p in root.iter() for c in p}

    def path(e: ET.Element) -> list[ET.Element]:
        out = []
        while e in up:
            e = up[e]
            out.append(e)
        return out

    out: list[dict] = []
    # containers in the order in which mentions come: prose of the body, the abstract, captions
    body = root.find(f".//{_NS}body")
    held: list[tuple[str, ET.Element]] = [("body", p) for p in body.iter(f"{_NS}p")] if body is not None else []
    for a in root.iter(f"{_NS}abstract"):
        held += [("abstract", p) for p in list(a.iter(f"{_NS}p")) or [a]]
    held += [("caption", f) for f in body.iter(f"{_NS}figDesc")] if body is not None else []
    seen: set[ET.Element] = set()
    for k, (kind, box) in enumerate(held):
        inner = list(box.iter(f"{_NS}s"))
        above = path(box)
        names = {_tag(x) for x in above}
        foot = any(_tag(x) == "note" and x.get("place") == "foot" for x in [box, *above])
        good = kind != "body" or not names & SKIPPED and not foot
        refs = any(_tag(x) == "div" and x.get("type") == "references" for x in above)
        for j, s in enumerate(inner or ([box] if kind != "body" else [])):
            seen.add(s)
            out.append(base | {"kind": "sentence", "container": kind, "para": k, "sent": j, "eligible": good, "direct": s is not box and up.get(s) is box, "in_references": refs, "tokens": tokens(s)})
    rest = [s for s in root.iter(f"{_NS}s") if s not in seen]
    for j, s in enumerate(rest):
        refs = any(_tag(x) == "div" and x.get("type") == "references" for x in path(s))
        out.append(base | {"kind": "sentence", "container": "other", "para": len(held) + j, "sent": 0, "eligible": False, "direct": False, "in_references": refs, "tokens": tokens(s)})
    for n in root.iter(f"{_NS}note"):
        if n.get("place") == "foot" and n.get(_ID) and not any(_tag(x) == "div" and x.get("type") == "references" for x in path(n)):
            out.append(base | {"kind": "note", "id": n.get(_ID), "sent": len(out), "marker": n.get("n") or n.get(_ID), "content": " ".join(" ".join(n.itertext()).split())})
    for lb in root.iter(f"{_NS}listBibl"):
        for b in lb.findall(f"{_NS}biblStruct"):
            if not b.get(_ID):
                continue
            ptr, raw = b.find(f".//{_NS}ptr"), b.find(f".//{_NS}note[@type='raw_reference']")
            text = " ".join(raw.text.split()) if raw is not None and raw.text else ""
            url = (ptr.get("target") or "").strip() if ptr is not None else ""
            if not _WEB.match(url):
                m = re.search(r"(?i)https?://\S+|ftp://\S+|www\.\S+", text)
                url = m.group().rstrip(".,;:)>]\"'") if m else ""
            out.append(base | {"kind": "entry", "id": b.get(_ID), "sent": len(out), "content": text or _entry_text(b), "url": url if _WEB.match(url) else ""})
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["paper_id", "file", "kind", "id", "container", "para", "sent", "eligible", "direct", "in_references", "tokens", "marker", "content", "url"]
    for b in batches:
        rows = [r for p, f, x in zip(b["paper_id"], b["file"], b["content"]) for r in rows_of(p, f, x)]
        df = pd.DataFrame(rows, columns=names)
        for c in ("para", "sent"):
            df[c] = df[c].astype("Int32")
        for c in ("eligible", "direct", "in_references"):
            df[c] = df[c].astype("boolean")
        yield df


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all ``*.tei.xml`` below a folder, else of all ``*.xml``."""
    files = read_binary(spark, path, "*.tei.xml")
    if files.select("path").isEmpty():
        files = read_binary(spark, path, "*.xml")
    f = files.select(paper_ids.from_file(F.col("path")).alias("paper_id"), F.col("path").alias("file"), "content")
    return f.mapInPandas(filled(_parse), SCHEMA)
