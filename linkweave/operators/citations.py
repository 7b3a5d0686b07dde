"""Markers, citations, reference lists, and putting notes and entries back into citing sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from linkweave.functions.text import DIGITS, SUPERSCRIPTS, match_key, plain_digits, raised_digits
from linkweave.functions.urls import let, urls_in_text
from linkweave.session import once

# --- markers ---


def clean_marker(c: Column) -> Column:
    """Without brackets and punctuation around."""
    return F.regexp_replace(F.trim(c), r"^[\[\]().,;\s]+|[\[\]().,;\s]+$", "")


def marker_key(c: Column) -> Column:
    """The number or symbols that a note begins with; null if none."""
    m = F.regexp_extract(F.trim(c), r"^\[?(\d+|[*†‡§¶‖∗⋆★☆]+)(?:\]|\.)?", 1)
    return F.when(m != "", m)


def marker_norm(c: Column) -> Column:
    return plain_digits(F.regexp_replace(F.trim(c), r"^[\[\]()^:.]+|[\[\]()^:.]+$", ""))


def marker_variants(c: Column) -> Column:
    """The surfaces a marker may have, longest first: as given, plain and, for numbers, raised."""
    n = marker_norm(c)
    all_ = F.array_distinct(F.filter(F.array(c, n, F.when(n.rlike(r"^\d+$"), raised_digits(n))), lambda x: x.isNotNull() & (x != "")))
    return F.transform(F.array_sort(F.transform(all_, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("v")))), lambda s: s["v"])


# --- numeric citations ---

_RANGE = r"^(\d{1,4})\s*[-–−]\s*(\d{1,4})\b"


def expand_numeric(c: Column, dialect: str = "markdown", compat: bool = True) -> Column:
    """The numbers of a citation group's inner text, as an array of integers.

    markdown: sorted and distinct, ranges of up to 100; with ``compat`` a comma and a blank make a range, as in the reference.
    layout: in order; parts between commas, semicolons and blanks; a range with blanks in it gives its ends.
    """
    if dialect == "layout":
        parts = F.filter(F.split(F.trim(c), r"[,;\s]+"), lambda x: x != "")

        def numbers(p: Column) -> Column:
            a, b = F.regexp_extract(p, r"^(\d+)[–\-](\d+)$", 1), F.regexp_extract(p, r"^(\d+)[–\-](\d+)$", 2)
            lo, hi = F.nullif(a, F.lit("")).cast("int"), F.nullif(b, F.lit("")).cast("int")
            none = F.array().cast("array<int>")
            return F.when(lo.isNotNull(), F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(none)).when(p.rlike(r"^\d+$"), F.array(p.cast("int"))).otherwise(none)

        return F.flatten(F.transform(parts, numbers))
    text = F.regexp_replace(F.regexp_replace(c, "[–−]", "-"), ", ", "-" if compat else ",")
    parts = F.transform(F.split(text, r"\s*[,;]\s*"), lambda x: F.trim(x))

    def of(p: Column) -> Column:
        lo, hi = F.nullif(F.regexp_extract(p, _RANGE, 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract(p, _RANGE, 2), F.lit("")).cast("int")
        none = F.array().cast("array<int>")
        one = F.nullif(F.regexp_extract(p, r"^(\d{1,4})\b", 1), F.lit("")).cast("int")
        fits = (lo > 0) & (lo <= hi) & (hi <= lo + 100)
        return F.when(lo.isNotNull(), F.when(fits, F.sequence(lo, F.greatest(lo, hi))).otherwise(none)).when(one.isNotNull(), F.array(one)).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, of))))


_BRACKET = re.compile(r"\[(\d{1,4}(?:\s*[,;\-–−]\s*\d{1,4})*(?:\s*,\s*(?:Chapter|Ch\.|§|Sec\.|Section|p\.|pp\.|Thm\.|Theorem|Eq\.|Fig\.|Table)[^\]]*)?)\]")
_RAISED = re.compile(rf"[{SUPERSCRIPTS}]+(?:[,\-–−][{SUPERSCRIPTS}]+)*")
_ATTACHED = re.compile(r"\b([A-Za-z][A-Za-z0-9_./+\-]*?)(\d{1,4})(?=[,.;:)\]\s])")
_ATTACHED_END = re.compile(r"\d(?=[,.;:)\]\s])")
_IN_ATTACHED = re.compile(r"[A-Za-z0-9_./+\-\d]")
_IN_ATTACHED_ALL = re.compile(r"[A-Za-z0-9_./+\-\d]*")
# What a number at the end of a word belongs to, rather than to a citation.
_LABEL = re.compile(r"(?i)^(?:Fig|Table|Eq|Sec|Ref|Chapter|KIC|PMC|PMID|COVID|H1N1|H5N1|SARS|MERS)-?")
OCCURRENCE = ArrayType(
    StructType(
        [
            StructField("style", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("surface", StringType()),
            StructField("inner", StringType()),
            StructField("inside_parenthetical", BooleanType()),
        ]
    )
)


def _attached(text: str) -> Iterator[re.Match]:
    """The matches of ``_ATTACHED``: none goes beyond a run of the characters it allows, so only runs with a digit that may end one are searched."""
    done = 0
    for end in _ATTACHED_END.finditer(text):
        b = end.end()
        if b <= done:
            continue
        a = b
        while a > done and _IN_ATTACHED.match(text, a - 1):
            a -= 1
        done = _IN_ATTACHED_ALL.match(text, b).end()
        yield from _ATTACHED.finditer(text, a, done + 1)


def _within(text: str, a: int, b: int) -> bool:
    left, right = text.rfind("(", 0, a), text.find(")", b)
    return left >= 0 <= right and a - left < 180 and right - b < 180


def numeric_occurrences(text: str) -> list[tuple[str, int, int, str, str, bool]]:
    """Bracketed, raised and word-attached numbers of a text: style, offsets, surface, inner text, whether in parentheses."""
    out = [("bracket_number", m.start(), m.end(), m.group(), m.group(1)) for m in _BRACKET.finditer(text)]
    raised = str.maketrans(SUPERSCRIPTS, DIGITS)
    if not text.isascii():
        out += [("superscript_number", m.start(), m.end(), m.group(), m.group().translate(raised)) for m in _RAISED.finditer(text)]
    for m in _attached(text):
        if not (_LABEL.match(m.group(1) + m.group(2)) and len(m.group(1)) < 10):
            out.append(("baseline_numeric", m.start(2), m.end(2), m.group(2), m.group(2)))
    return [(*o, _within(text, o[1], o[2])) for o in sorted(out, key=lambda o: (o[1], o[2]))]


@F.pandas_udf(OCCURRENCE)
def numeric_spans(c: pd.Series) -> pd.Series:
    names = ("style", "start", "end", "surface", "inner", "inside_parenthetical")
    return c.map(lambda t: None if t is None else [dict(zip(names, o)) for o in numeric_occurrences(t)])


# --- reference lists ---


def numbered_entries(refs: Column) -> Column:
    """Entries ``index, full_text`` of a numbered list: lines that begin one, each with the lines to the next; none for fewer than two."""
    start = r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s+"

    def add(acc: Column, line: Column) -> Column:
        last = F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), line)
        return F.when(line.rlike(start), F.concat(acc, F.array(line))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last))).otherwise(acc)

    blocks = F.aggregate(F.split(refs, "\n"), F.array().cast("array<string>"), add)
    clean = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " ")))
    index = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, start, 1), F.lit("")), F.regexp_extract(b, start, 2))
    entries = F.transform(clean, lambda b: F.struct(index(b).alias("index"), b.alias("full_text")))
    return let(entries, lambda e: F.when(F.size(e) >= 2, e).otherwise(F.slice(e, 1, 0)))


def paragraph_entries(refs: Column) -> Column:
    """Entries of an unnumbered list: its paragraphs, called U1, U2 and so on (``index`` null)."""
    blocks = F.filter(F.transform(F.split(refs, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " "))), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(F.lit(None).cast("string").alias("index"), b.alias("full_text")))


def last_year(c: Column) -> Column:
    """The last year in a text, with its letter; null if none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2}[a-z]?)\b"), F.lit(1)), F.lit(-1))


# Capitalised words of entries that are no surnames.
NOT_NAMES = ["Department", "University", "Press", "Journal", "Proceedings", "Available", "Retrieved"]


def surnames(c: Column) -> Column:
    """The first authors' surnames of an entry: initials first, else surname first; at most two."""
    year = F.regexp_instr(c, F.lit(r"\b(?:19|20)\d{2}[a-z]?\b"))
    head = F.when(year > 0, F.substring(c, F.lit(1), year - 1)).otherwise(F.substring(c, 1, 180))
    head = F.trim(F.regexp_replace(head, r"^\s*(?:\[?\d+\]?|\d+[.)])\s+", ""))
    a = F.regexp_extract_all(head, F.lit(r"(?:^|[,;&]|\band\b|\s)(?:[A-Z]\.?\s*){1,4}([A-Z][A-Za-z'’`-]{2,})\b"), F.lit(1))
    b = F.regexp_extract_all(head, F.lit(r"(?:^|,\s*|;\s*|\band\s+|&\s*)([A-Z][A-Za-z'’`-]{2,})(?:\s+[A-Z]\b|,|:|\.)"), F.lit(1))
    names = F.when(F.size(a) > 0, a).otherwise(b)
    return F.slice(F.filter(names, lambda x: ~x.isin(NOT_NAMES)), 1, 2)


def author_year_keys(first: Column, second: Column, year: Column) -> Column:
    """What may cite an entry of these authors and year; without brackets around; empty without author or year."""
    one = F.array(*[F.concat(first, F.lit(s), year, F.lit(e)) for s, e in ((", ", ""), (" ", ""), (" (", ")"), (" et al., ", ""), (" et al. ", ""), (" et al. (", ")"))])
    two = F.array(*[F.concat(first, F.lit(j), second, F.lit(s), year, F.lit(e)) for j in (" and ", " & ") for s, e in ((", ", ""), (" ", ""), (" (", ")"))])
    none = F.array().cast("array<string>")
    known = first.isNotNull() & (first != "") & year.isNotNull()
    return F.when(known, F.concat(one, F.when(second.isNotNull() & (second != ""), two).otherwise(none))).otherwise(none)


def with_keys(entries: DataFrame, text: str = "full_text", index: str = "index") -> DataFrame:
    """Entries with ``urls``, ``pub_year``, ``first_author``, ``second_author`` and the ``keys`` they are cited by."""
    number = F.regexp_replace(F.col(index), r"\D", "")
    out = once(entries, "urls", urls_in_text(F.col(text), "markdown")).withColumn("pub_year", last_year(F.col(text))).withColumn("_names", surnames(F.col(text)))
    out = out.withColumn("first_author", F.try_element_at("_names", F.lit(1))).withColumn("second_author", F.try_element_at("_names", F.lit(2))).drop("_names")
    ay = author_year_keys(F.col("first_author"), F.col("second_author"), F.col("pub_year"))
    return out.withColumn("keys", F.when(F.col(index).isNotNull(), F.array(number)).otherwise(ay))


def lookup(entries: DataFrame, group: str = "paper_id", order: str = "entry_ix") -> DataFrame:
    """``group, key`` with the first entry of each key that bears an address: the side that citations join."""
    keyed = once(entries.filter(F.size("urls") > 0), "_keys", F.col("keys")).drop("keys").withColumnRenamed("_keys", "keys").withColumn("key", F.explode("keys")).withColumn("key", match_key(F.regexp_replace("key", r"^[\[\]() ]+|[\[\]() ]+$", ""))).filter("key <> ''")
    rank = F.row_number().over(Window.partitionBy(group, "key").orderBy(order))
    return keyed.withColumn("_r", rank).filter("_r = 1").drop("_r")


def index_style(indexed: Column, digits: Column, alpha: Column) -> Column:
    """numeric or alpha if four fifths of the indexed entries are, author_year if none is indexed, else mixed. Columns are counts."""
    return F.when(indexed == 0, "author_year").when(digits >= 0.8 * indexed, "numeric").when(alpha >= 0.8 * indexed, "alpha").otherwise("mixed")


def index_styles(entries: DataFrame, group: str, index: str) -> DataFrame:
    """``group, style`` of every paper's reference list."""
    i = F.regexp_replace(F.trim(F.col(index)), r"^[\[(]+|[\]).]+$", "")
    has = F.col(index).isNotNull() & (F.trim(F.col(index)) != "")
    g = entries.groupBy(group).agg(
        F.sum(has.cast("int")).alias("indexed"), F.sum((has & i.rlike(r"^\d+$")).cast("int")).alias("digits"), F.sum((has & i.rlike(r"^[A-Za-z][A-Za-z0-9+]*$")).cast("int")).alias("alpha")
    )
    return g.select(group, index_style(F.col("indexed"), F.col("digits"), F.col("alpha")).alias("style"))


def allowed_markers(keys: Column) -> Column:
    """Distinct markers whatever their case, with and without brackets, in order."""
    bare = F.transform(keys, lambda k: F.regexp_replace(F.trim(k), r"^[\[(]+|[\]).]+$", ""))
    both = F.filter(F.flatten(F.zip_with(keys, bare, lambda a, b: F.array(a, b))), lambda x: x != "")
    return F.aggregate(both, F.array().cast("array<string>"), lambda acc, u: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(u)), acc).otherwise(F.concat(acc, F.array(u))))


# --- splicing ---


def splice_tag(sentence: Column, marker: Column, text: Column) -> Column:
    """Every ``[CITE:marker]`` becomes `` [text]``; other tags vanish."""
    done = F.replace(sentence, F.concat(F.lit("[CITE:"), marker, F.lit("]")), F.concat(F.lit(" ["), text, F.lit("]")))
    return F.trim(F.regexp_replace(F.regexp_replace(done, r"\[CITE:[^\]]+\]", ""), r"(?U)\s+", " "))


def splice_offset(sentence: Column, start: Column, end: Column, text: Column, marker: Column | None = None) -> Column:
    """What stands from ``start`` to ``end`` (offsets from 0, clamped) replaced by ``[text]``, a blank before it, or by ``[marker text]``."""
    a = F.greatest(F.lit(0), F.least(F.length(sentence), start))
    b = F.greatest(a, F.least(F.length(sentence), end))
    before, after = F.substring(sentence, F.lit(1), a), F.substring(sentence, b + 1, F.length(sentence))
    if marker is not None:
        return F.concat(before, F.lit("["), marker, F.lit(" "), text, F.lit("]"), after)
    gap = F.when((before == "") | before.rlike(r"(?U)[\s\[]$"), "").otherwise(" ")
    return F.concat(before, gap, F.lit("["), text, F.lit("]"), after)


def splice_first(sentence: Column, marker: Column, text: Column) -> Column:
    """``[text]`` put after the first occurrence of ``marker``; nothing where it doesn't occur."""
    at = F.position(marker, sentence)
    end = at + F.length(marker) - 1
    return F.when(at > 0, F.concat(F.substring(sentence, F.lit(1), end), F.lit("["), text, F.lit("]"), F.substring(sentence, end + 1, F.length(sentence)))).otherwise(sentence)


def strip_label(text: Column) -> Column:
    """An entry without its leading ``[n]``, ``(n)``, ``n.`` or ``n``: the first form that fits."""
    out = text
    forms = [r"^\s*\[[^\]]{1,12}\]\s*", r"^\s*\(\d{1,4}\)\s*", r"^\s*\d{1,4}[.)]\s+", r"^\s*\d{1,4}\s+(?=[A-Z])"]
    for i, p in enumerate(reversed(forms)):
        out = F.when(text.rlike(p), F.regexp_replace(text, p, "")).otherwise(out if i else text)
    return out


# --- nearest marker ---


def nearest_markers(occurrences: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """The best occurrence of every note among those of the same ``keys``: least distance, 500 more after the note, 2000 more in a
    front matter far from it. Both have ``start``; notes are told apart by ``note_ix``. Ties go to the first occurrence."""
    o = occurrences.select(*keys, F.col("start").alias("occ_start"), F.col("surface").alias("occ_surface"))
    both = notes.join(o, keys)
    s, f = F.col("occ_start"), F.col("start")
    score = F.abs(s - f) + F.when(s > f, 500).otherwise(0) + F.when((s < 1000) & (f > 2500), 2000).otherwise(0)
    best = both.withColumn("score", score).groupBy(*keys, "note_ix").agg(F.min(F.struct("score", "occ_start", "occ_surface")).alias("b"))
    return best.select(*keys, "note_ix", "b.score", "b.occ_start", "b.occ_surface")
