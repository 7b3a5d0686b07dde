"""The Markdown dialect: mentions of addresses in body, footnotes and references, with their context.

Input is ``paper_id, file, text``, a row per paper, characters normalised at the scan. Every step stays within the paper's row or is an
equi-join on the paper; Python only finds spans, as Spark's regular expressions return no offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from linkweave.functions.text import MD_LINK, unwrap_links
from linkweave.functions.urls import GRAMMARS, clean_url, let, urls_in_text
from linkweave.operators import citations as cite
from linkweave.operators.predicates import bibliographic_line, body_url
from linkweave.operators.regions import body_and_references, body_region, split_references, trim_front
from linkweave.operators.scoring import first_by
from linkweave.operators.sentences import SPAN, joined_lines, markdown_paragraphs, markdown_sentences, md_sentence_spans, paragraph_spans
from linkweave.session import cut, once

_URL = re.compile(GRAMMARS["markdown"])
_LINK = re.compile(MD_LINK)
# Words near a link that speak of a resource, and those that speak of a citation.
_RESOURCE = re.compile(r"\b(?:available|download|repository|github|gitlab|source code|dataset|data set|database|access|deposited|supplement|figshare|zenodo|protocol|code)\b")
_CITATION = re.compile(r"\b(?:et al\.?|\d{4}[a-z]?|fig\.|table|doi\.org/10\.|journal|lancet|nature|science)\b")
CANDIDATES = ArrayType(StructType([StructField("raw", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("source", StringType()), StructField("line", StringType())]))


def url_candidates(text: str) -> list[tuple[str, int, int, str, str]]:
    """Printed addresses and targets of links of a text: raw address, offsets, source, and its line. Hosts of e-mail addresses are none."""
    out = []

    def line(a: int) -> str:
        end = text.find("\n", a)
        return text[text.rfind("\n", 0, a) + 1 : end if end >= 0 else len(text)]

    mails = [(m.start(), m.end()) for m in re.finditer(r"[\w.+-]+@[\w.-]+", text)] if "@" in text else []
    for m in _URL.finditer(text):
        a, b = m.span(1)
        if not any(x <= a < y for x, y in mails):
            out.append((m.group(1), a, b, "raw_url", line(a)))
    for m in _LINK.finditer(text):
        if m.group().startswith("!") or not _URL.match(m.group(2)):
            continue
        near = text[max(0, m.start() - 120) : m.end() + 120].lower()
        if _URL.search(m.group(1)) or _RESOURCE.search(near) and not _CITATION.search(m.group(1).lower() + " " + near):
            out.append((m.group(2), m.start(2), m.end(2), "markdown_link", line(m.start())))
    return sorted(out, key=lambda o: (o[1], o[2], o[0]))


@F.pandas_udf(CANDIDATES)
def _candidates(c: pd.Series) -> pd.Series:
    names = ("raw", "start", "end", "source", "line")
    return c.map(lambda t: None if t is None else [dict(zip(names, o)) for o in url_candidates(t)])


@F.pandas_udf(SPAN)
def _body_paragraphs(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else [{"text": x, "start": a, "end": b} for x, a, b in markdown_paragraphs(t, keep_bullets=True)])


class Contexts:
    """The sentences around places of a text, as ``local, sent_start, target, preceding, trailing``: None where there is no paragraph, no sentence: None within."""

    def __init__(self, text: str):
        self.text, self.paragraphs = text, paragraph_spans(text, skip_images=False)
        self.starts = [a for a, _ in self.paragraphs]
        self.sentences: dict[int, list[tuple[str, int, int]]] = {}

    def at(self, pos: int) -> tuple | None:
        k = bisect_right(self.starts, pos) - 1
        if k < 0 or pos > self.paragraphs[k][1]:
            return None
        if k not in self.sentences:
            self.sentences[k] = markdown_sentences(joined_lines(self.text[slice(*self.paragraphs[k])]))
        s, local = self.sentences[k], pos - self.paragraphs[k][0]
        i = next((i for i, (_, a, b) in enumerate(s) if a <= local <= b), None)
        if i is None:
            return local, None, None, None, None
        return local, s[i][1], s[i][0], s[i - 1][0] if i else None, s[i + 1][0] if i + 1 < len(s) else None


def _at(spans: Column, pos: Column) -> Column:
    return F.try_element_at(F.filter(spans, lambda s: (s["start"] <= pos) & (pos <= s["end"])), F.lit(1))


def _index_at(spans: Column, pos: Column) -> Column:
    at = F.array_position(F.transform(spans, lambda s: (s["start"] <= pos) & (pos <= s["end"])), F.lit(True))
    return F.when(at > 0, at.cast("int"))


def _with_sentence(df: DataFrame, local: Column) -> DataFrame:
    """``target, preceding, trailing`` and the sentence's offset, for rows with a paragraph ``para`` and a position in it."""
    d = df.withColumn("_sents", md_sentence_spans(F.col("para.text"))).withColumn("_local", local)
    d = d.withColumn("_i", _index_at(F.col("_sents"), F.col("_local"))).filter("_i is not null")
    d = d.withColumn("target", F.try_element_at("_sents", F.col("_i"))["text"]).withColumn("sent_start", F.try_element_at("_sents", F.col("_i"))["start"])
    d = d.withColumn("preceding", F.when(F.col("_i") > 1, F.try_element_at("_sents", F.greatest(F.col("_i") - 1, F.lit(1)))["text"])).withColumn("trailing", F.try_element_at("_sents", F.col("_i") + 1)["text"])
    return d.withColumn("at_paragraph_start", F.col("preceding").isNull()).withColumn("at_paragraph_end", F.col("trailing").isNull())


def body(md: DataFrame) -> DataFrame:
    """``paper_id, file, location, url, preceding, target, trailing, at_paragraph_start, at_paragraph_end, source, start_char, end_char``."""
    d = once(md, "body", body_region(F.col("text"))).filter("body is not null").select("paper_id", "file", F.col("body").alias("text"))
    d = d.select("paper_id", "file", "text", _body_paragraphs("text").alias("paras"), _candidates("text").alias("cands"))
    c = d.select("paper_id", "file", "paras", F.explode("cands").alias("c")).withColumn("url", clean_url(F.col("c.raw"))).filter("url <> ''")
    c = c.withColumn("para", _at(F.col("paras"), F.col("c.start"))).filter("para is not null").drop("paras")
    c = c.filter(body_url(F.col("para.text"), F.col("c.line"), F.col("url"), F.col("c.source")))
    local = F.greatest(F.lit(0), F.least(F.length("para.text"), F.col("c.start") - F.col("para.start")))
    s = _with_sentence(c, local)
    out = s.select("paper_id", "file", F.lit("body").alias("location"), "url", "preceding", "target", "trailing", "at_paragraph_start", "at_paragraph_end", F.col("c.source").alias("source"), F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"))
    return first_by(out, ["paper_id", "file", F.lower("url"), F.lower("target")], ["start_char", "end_char", "source"])


_NOTE = r"(?i)^\s*(?:\[\^?([A-Za-z0-9]+)\]\s*:?|\^([A-Za-z0-9]+)\s*:?|([⁰¹²³⁴⁵⁶⁷⁸⁹]+)|(\d{1,3})|([*†‡§¶]))\s*[:.)\-]?\s*(.*?(?:https?://|ftp://|www\.|doi\s*:\s*10\.|10\.\d{4,9}/|(?:github|gitlab|bitbucket)\.com/|(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|io|ai)\b).*)$"
# What a line begins with that may be a note.
_MAY_BE_NOTE = r"\n(?=[ \t\x0B\f\r]*[\[\^⁰¹²³⁴⁵⁶⁷⁸⁹0-9*†‡§¶])"
_INLINE = r"(?i)\\footnote\{([^{}]*(?:https?://|www\.|ftp://|doi\s*:|10\.)[^{}]*)\}"


def footnotes(md: DataFrame) -> DataFrame:
    """``paper_id, file, body, note_ix, marker, marker_norm, footnote_text, urls, start, kind``: the notes of a body that bear an address.

    ``body`` is the text with standalone notes made blank, so that offsets stay.
    """
    notes = _notes(md).select("paper_id", "file", "body", F.explode("notes").alias("n"))
    return _with_norm(notes.select("paper_id", "file", "body", "n.marker", "n.footnote_text", "n.start", "n.kind", "n.urls"))


def _with_norm(notes: DataFrame) -> DataFrame:
    return notes.withColumn("marker_norm", cite.marker_norm(F.col("marker"))).withColumn("note_ix", F.concat_ws(":", "marker", "start"))


def _notes(md: DataFrame) -> DataFrame:
    """``paper_id, file, body, notes``: the notes of a body as an array in its row."""

    def note(x: Column) -> Column:
        """Of a line that is a note its text, addresses and marker; null for others."""
        said = lambda t: F.struct(x.alias("line"), t.alias("text"), urls_in_text(t).alias("urls"), F.regexp_replace(x, _NOTE + r"(?s:.*)", "$1$2$3$4$5").alias("marker"))
        return F.when(x.rlike(_NOTE) & ~bibliographic_line(x), let(let(F.trim(F.regexp_extract(x, _NOTE, 6)), said), lambda n: F.when(F.size(n["urls"]) > 0, n)))

    # a text is cut before the lines that may be notes; each of those is looked at once
    parts = F.transform(F.split("raw", _MAY_BE_NOTE), lambda x: let(F.substring_index(x, "\n", 1), lambda line: F.struct(x.alias("x"), note(line).alias("n"))))
    gone = lambda p: F.concat(F.repeat(F.lit(" "), F.length(p["n"]["line"])), F.substring(p["x"], F.length(p["n"]["line"]) + 1, F.length(p["x"])))
    blanked = F.array_join(F.transform("parts", lambda p: F.when(p["n"].isNull(), p["x"]).otherwise(gone(p))), "\n")
    d = once(md, "raw", split_references(F.col("text"))[0]).filter("raw is not null").select("paper_id", "file", "raw")
    d = once(once(d, "parts", parts), "body", F.when(F.exists("parts", lambda p: p["n"].isNotNull()), blanked).otherwise(F.col("raw")))
    as_note = lambda n, at: F.struct(n["marker"].alias("marker"), n["text"].alias("footnote_text"), at.alias("start"), F.lit("standalone").alias("kind"), n["urls"].alias("urls"))
    alone = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<marker:string,footnote_text:string,start:int,kind:string,urls:array<string>>>").alias("l")),
        lambda acc, p: F.struct((acc["at"] + F.length(p["x"]) + 1).alias("at"), F.when(p["n"].isNotNull(), F.concat(acc["l"], F.array(as_note(p["n"], acc["at"])))).otherwise(acc["l"]).alias("l")),
    )["l"]
    said = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, _INLINE, 1), r"(?U)\s+", " "))
    inner = F.transform(F.regexp_extract_all("raw", F.lit(_INLINE), F.lit(0)), lambda x, k: F.struct(F.concat(F.lit("inline"), (k + 1).cast("string")).alias("marker"), said(x).alias("footnote_text"), (F.position(x, F.col("body")) - 1).cast("int").alias("start"), F.lit("inline").alias("kind"), urls_in_text(said(x)).alias("urls")))
    notes = F.when(F.col("raw").contains("\\"), F.concat(alone, F.filter(inner, lambda n: F.size(n["urls"]) > 0))).otherwise(alone)
    return once(d, "notes", notes).select("paper_id", "file", "body", "notes")


OCC = ArrayType(StructType([StructField("start", IntegerType()), StructField("surface", StringType())]))


_RAISED, _PLAIN = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


@lru_cache(maxsize=4096)
def _marker_form(marker: str) -> re.Pattern | None:
    """The surfaces of a marker. Every alternative begins with its first character, so that a search passes over all others at once."""
    plain = marker.strip().strip("[]()^:.").translate(_PLAIN)
    if not plain:
        return None
    forms = [re.escape(v) for v in dict.fromkeys((marker, plain, plain.translate(_RAISED)))]
    first = [rf"\^{v}" for v in forms] + forms
    attached = "|".join(rf"{v}(?<=[A-Za-z_)\]]{v})(?=[,.;:!?)\]\s])" for v in first)
    return re.compile("|".join([*(rf"\[{v}\]" for v in forms), attached] if plain.isdigit() else [attached]))


def marker_places(text: str, marker: str) -> list[tuple[int, str]]:
    """Where a marker stands in a text: in brackets, or attached to a word or bracket and followed by a blank or punctuation."""
    form = _marker_form(marker)
    return [(m.start(), m.group()) for m in form.finditer(text)] if form else []


CITED = StructType(
    [StructField(n, IntegerType()) for n in ("score", "at")]
    + [StructField("surface", StringType()), StructField("para", BooleanType())]
    + [StructField(n, IntegerType()) for n in ("local", "sent_start")]
    + [StructField(n, StringType()) for n in ("target", "preceding", "trailing")]
)
_NOTE_FIELDS = "marker string, footnote_text string, start int, kind string, urls array<string>"
_KINDS = {IntegerType(): pa.int32(), StringType(): pa.string(), BooleanType(): pa.bool_()}


def _cited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each note of ``paper_id, file, body, notes`` with the best place of its marker and the sentence there.

    The best place is the nearest, those behind the note and those of a front matter far from it later. Addresses pass as they come.
    """
    for batch in batches:
        notes = batch.column("notes")
        paper = pc.list_parent_indices(notes)
        fields = dict(zip((f.name for f in notes.type.value_type), notes.flatten().flatten()))
        texts = batch.column("body").to_pylist()
        out: list[tuple] = []
        last = around = None
        for i, m, s, k, n in zip(paper.to_pylist(), *(fields[c].to_pylist() for c in ("marker", "start", "kind", "footnote_text"))):
            t = texts[i]
            occ = [(s, "\\footnote{" + n + "}")] if k == "inline" else marker_places(t, m)
            best = min(((abs(a - s) + 500 * (a > s) + 2000 * (a < 1000 and s > 2500), a, x) for a, x in occ), default=None)
            if best is None:
                out.append((None,) * 9)
                continue
            if around is None or i != last:
                last, around = i, Contexts(t)
            c = around.at(best[1])
            out.append((*best, c is not None, *(c or (None,) * 5)))
        if out:
            found = {f.name: pa.array(c, _KINDS[f.dataType]) for f, c in zip(CITED, zip(*out))}
            yield pa.RecordBatch.from_pydict({"paper_id": batch.column("paper_id").take(paper), "file": batch.column("file").take(paper), **fields, **found})


def _around(df: DataFrame) -> DataFrame:
    """Rows whose place is in a sentence, with ``at_paragraph_start, at_paragraph_end``."""
    return df.filter("target is not null").withColumn("at_paragraph_start", F.col("preceding").isNull()).withColumn("at_paragraph_end", F.col("trailing").isNull())


def restored_footnotes(md: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with the note put into the citing sentence, and the notes that found none with their reason."""
    cited = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CITED)
    n = _with_norm(_notes(md).mapInArrow(_cited, f"paper_id string, file string, {_NOTE_FIELDS}, {cited}"))
    lost = n.filter("at is null or not para")
    lost = lost.select("paper_id", "file", "marker", "urls", "footnote_text", F.when(F.col("at").isNull(), "marker_not_found").otherwise("sentence_not_found").alias("reason"))
    s = _around(n)
    rows = s.select("paper_id", "file", F.lit("footnote").alias("location"), "marker", "marker_norm", F.explode("urls").alias("url"), "footnote_text", "preceding", F.col("target").alias("original_sentence"), "trailing", "at_paragraph_start", "at_paragraph_end", F.col("surface").alias("marker_surface"), F.col("at").alias("marker_start_char"), F.col("start").alias("footnote_start_char"), "kind", (F.col("local") - F.col("sent_start")).alias("_a"))
    rows = first_by(rows, ["paper_id", "file", "marker_norm", F.lower("url"), F.lower("original_sentence")], ["footnote_start_char"])
    # the note is put in where rows are left, so that its text isn't shuffled twice
    restored = cite.splice_offset(F.col("original_sentence"), F.col("_a"), F.col("_a") + F.length("marker_surface"), F.col("footnote_text"))
    rows = rows.select("paper_id", "file", "location", "marker", "marker_norm", "url", "footnote_text", "preceding", restored.alias("target"), "original_sentence", "trailing", "at_paragraph_start", "at_paragraph_end", "marker_surface", "marker_start_char", "footnote_start_char", "kind")
    return rows, lost


def reference_entries(md: DataFrame) -> DataFrame:
    """``paper_id, file, body, entry_ix, index, full_text, urls, pub_year, first_author, second_author, keys`` of every paper's list."""
    e = _lists(md).select("paper_id", "file", "body", F.posexplode("entries").alias("entry_ix", "e"))
    return cite.with_keys(e.select("paper_id", "file", "body", "entry_ix", "e.index", "e.full_text"))


def _lists(md: DataFrame) -> DataFrame:
    """``paper_id, file, body, entries`` of every text with a list of references that has entries."""
    d = once(md, "parts", body_and_references(F.col("text"))).filter("parts.refs <> ''")
    entries = let(cite.numbered_entries(F.col("parts.refs")), lambda n: F.when(F.size(n) > 0, n).otherwise(cite.paragraph_entries(F.col("parts.refs"))))
    return once(d, "entries", entries).filter("size(entries) > 0").select("paper_id", "file", unwrap_links(trim_front(F.col("parts.body"))).alias("body"), "entries")


# A name and a year as they are cited, in parentheses or not.
_OPENED = {")": "(", "]": "["}
_NAME = r"[A-Z][A-Za-z'’`-]{2,}"
_AUTHOR_YEAR = re.compile(rf"{_NAME}(?:\s+et al\.?|\s+(?:and|&)\s+{_NAME})?,?\s+[(\[]?(?:19|20)\d{{2}}[a-z]?[)\]]?")


def author_years(t: str) -> list[tuple[int, str]]:
    """Every place of the form of an author-year citation. A closing bracket without its opening one isn't part of it."""
    out = []
    for m in _AUTHOR_YEAR.finditer(t):
        s = m.group()
        if s[-1] in _OPENED and _OPENED[s[-1]] not in s:
            s = s[:-1]
        out.append((m.start(), s))
    return out


OCCURRENCES = "paper_id string, file string, style string, start int, end int, surface string, inner string, inside_parenthetical boolean, para boolean, local int, sent_start int, target string, preceding string, trailing string"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every citation of ``paper_id, file, body`` with the sentence it is in."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in OCCURRENCES.split(", "))])
    for batch in batches:
        rows: list[tuple] = []
        for paper, file, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if t is None:
                continue
            # author-year: every occurrence of that form is looked up, instead of searching the body for every key
            found = [*cite.numeric_occurrences(t), *(("author_year", a, a + len(s), s, None, False) for a, s in author_years(t))]
            around = Contexts(t) if found else None
            for o in found:
                c = around.at(o[1])
                rows.append((paper, file, *o, c is not None, *(c or (None,) * 5)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def restored_references(md: DataFrame) -> DataFrame:
    """Mentions with the entry put into the citing sentence, for numeric and author-year citations of entries that bear an address."""
    lists = cut(_lists(md), "lists")
    entries = lists.select("paper_id", F.posexplode("entries").alias("entry_ix", "e")).select("paper_id", "entry_ix", "e.index", "e.full_text")
    look = cite.lookup(cite.with_keys(entries), "paper_id", "entry_ix").select("paper_id", "key", F.col("index").alias("reference_index"), F.col("full_text").alias("reference_entry"), "urls", "entry_ix")
    occ = lists.select("paper_id", "file", "body").mapInArrow(_occurrences, OCCURRENCES)
    folded = F.translate(F.lower(F.regexp_replace("surface", r"(?U)\s+", " ")), "[]", "()")
    # keys lose the brackets around them, so that one that ends in a year in parentheses has no closing one
    ay = F.col("style") == "author_year"
    keys = F.when(ay, F.array(F.regexp_replace(folded, r"^[()\[\] ]+|[()\[\] ]+$", ""))).otherwise(F.transform(cite.expand_numeric(F.col("inner")), lambda n: n.cast("string")))
    occ = once(occ, "keys", keys).withColumn("key", F.explode("keys")).drop("keys", "inner").withColumn("marker", F.when(ay, F.col("surface")).otherwise(F.col("key")))
    occ = first_by(occ.join(look, ["paper_id", "key"]), ["paper_id", "file", "start", "end", "entry_ix"], ["marker"])
    s = _around(occ)
    a = F.col("local") - F.col("sent_start")
    s = s.withColumn("restored", cite.splice_offset(F.col("target"), a, a + (F.col("end") - F.col("start")), F.col("reference_entry"), F.col("marker")))
    rows = s.select("paper_id", "file", F.lit("reference").alias("location"), F.col("marker").alias("citation_marker"), F.col("style").alias("citation_style"), F.explode("urls").alias("url"), "reference_entry", "preceding", F.col("restored").alias("target"), F.col("target").alias("original_sentence"), "trailing", "at_paragraph_start", "at_paragraph_end", "inside_parenthetical", F.col("surface").alias("citation_surface"), F.col("start").alias("citation_start_char"), "reference_index")
    return first_by(rows, ["paper_id", "file", "citation_marker", F.lower("url"), F.lower("original_sentence"), "citation_start_char"], ["url"])
