"""Text columns: folding, keys, and the small rewrites that extraction and evaluation need.

All are expressions inside the JVM, but for NFKC and HTML entities, for which Spark has no function; those see only
the texts that need them. Null stays null unless a docstring says otherwise.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters folded after NFKC, by what replaces them.
FOLDS = [(" ", " "), ("ﬁ", "fi"), ("ﬂ", "fl"), ("“”", '"'), ("’‘", "'"), ("–—−", "-"), ("​﻿", "")]
# Look-alikes of the tilde that one evaluator folds in sentences, and all of them in addresses.
TILDES_IN_TEXT = "∼˜～"
TILDES = "˜∼～∽˜∼∻⁓～̴̃̾"
# Ligatures and invisible or special blanks of converted papers.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
INVISIBLE, BLANKS, DASHES = "­​‌‍﻿", "   ", "–—−"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"

WS = r"(?U)\s+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC; only texts with characters beyond ASCII leave the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def unescape(c: Column) -> Column:
    """HTML entities resolved; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS, " "))


def fold(c: Column, tildes: bool = False) -> Column:
    """The folds of an evaluator on text that is in NFKC already; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for chars, to in [*FOLDS, *([(TILDES_IN_TEXT, "~")] if tildes else [])]:
        c = F.regexp_replace(c, f"[{chars}]", to)
    return collapse_ws(c)


def fold_rare(c: Column, tildes: bool = False) -> Column:
    """``fold`` of a column that is named twice at no cost: text of ASCII has nothing to fold but blanks."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), fold(c, tildes)).otherwise(collapse_ws(F.coalesce(c, F.lit(""))))


def norm_text(c: Column, tildes: bool = False) -> Column:
    """NFKC, folded quotes, dashes and blanks, single spaces; null becomes empty."""
    return fold_rare(nfkc(c), tildes)


def normalize_chars(c: Column, dashes: bool = False) -> Column:
    """Ligatures expanded, invisible characters dropped, special blanks and line ends made plain, entities resolved."""
    for lig, to in LIGATURES:
        c = F.replace(c, F.lit(lig), F.lit(to))
    c = F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{BLANKS}]", " ")
    if dashes:
        c = F.regexp_replace(c, f"[{DASHES}]", "-")
    return F.regexp_replace(unescape(c), r"\r\n?", "\n")


def match_key(c: Column) -> Column:
    """A key for matching only: ligatures, dashes and blanks folded, lower case."""
    for lig, to in LIGATURES:
        c = F.replace(c, F.lit(lig), F.lit(to))
    c = F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{BLANKS}]", " ")
    return F.lower(collapse_ws(F.regexp_replace(c, f"[{DASHES}]", "-")))


def target_skeleton(c: Column) -> Column:
    """A sentence without brackets, its addresses as URL, lower case; ``c`` is normalised text."""
    c = F.regexp_replace(c, r"(?i)\b(?:https?://[^\s\]\[<>\"']+|www\.[^\s\]\[<>\"']+)", " URL ")
    c = F.regexp_replace(c, r"[\[\]()]", " ")
    c = F.regexp_replace(c, r"(?U)(?<!\w)\d+\s+(?=URL\b)", "")
    c = F.regexp_replace(c, r"(?U)\s+([,.;:])", "$1")
    return F.lower(collapse_ws(c))


def squash(c: Column) -> Column:
    """Letters and digits of ASCII only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def plain_digits(c: Column) -> Column:
    return F.translate(c, SUPERSCRIPTS, DIGITS)


def raised_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, SUPERSCRIPTS)


def strip_control(c: Column) -> Column:
    """Without control and zero-width characters; line feeds and tabs stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‍⁠﻿]", "")


def squash_keep_lines(c: Column) -> Column:
    """Inner blanks of each line made single, indentation kept, at most one blank line in a row."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.concat(F.regexp_extract(x, r"^([ \t]*)", 1), collapse_ws(x)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n(?:[ \t]*\n){2,}", "\n\n")


def strip_tags(c: Column) -> Column:
    """Without ``[CITE:x]`` tags."""
    return collapse_ws(F.regexp_replace(c, r"\[CITE:[^\]]*\]", " "))


MD_LINK = r"!?\[([^\]\n]{0,300})\]\(([^)\s]+(?:\)[^\s.,;:]*)?)\)"


def unwrap_links(c: Column) -> Column:
    """Markdown links become their labels; images vanish."""
    return F.when(c.contains("]("), F.regexp_replace(F.regexp_replace(c, r"!\[[^\]\n]{0,300}\]\([^)\s]+(?:\)[^\s.,;:]*)?\)", ""), MD_LINK, "$1")).otherwise(c)


def strip_fences(c: Column) -> Column:
    """Fenced code blocks removed; their line feeds stay, so that lines keep their numbers."""
    lines = F.split(c, "\n")
    step = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.array(F.when(acc["inside"] | x.startswith("```"), F.lit("")).otherwise(x))).alias("out"),
            F.when(x.startswith("```"), ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
        ),
    )
    return F.when(c.contains("```"), F.array_join(step["out"], "\n")).otherwise(c)


def rejoin_lines(lines: Column, guarded: bool = False) -> Column:
    """An array of lines as running text. A final hyphen joins; ``guarded``: only between a letter and a lower-case letter."""

    def add(acc: Column, x: Column) -> Column:
        line = F.trim(x)
        hyphen = acc.endswith("-")
        if guarded:
            hyphen = acc.rlike(r"(?U)\p{L}-$") & line.rlike(r"^\p{Ll}")
        return F.when(line == "", acc).when(acc == "", line).when(hyphen, F.concat(F.regexp_replace(acc, "-$", ""), line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(lines, F.lit("").cast("string"), add)


def merge_piped(a: Column, b: Column) -> Column:
    """The distinct values of two ``x | y`` fields, in order of appearance."""
    both = F.concat(F.split(F.coalesce(a, F.lit("")), r"\|"), F.split(F.coalesce(b, F.lit("")), r"\|"))
    return F.array_join(F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != "")), " | ")


def format_set(urls: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(urls, lambda x: x != ""))), " | ")


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def pick_column(names: list[str], present: list[str], default: str = "") -> Column:
    """The first of the aliases ``names`` that the frame has, as a string column; null becomes ``default``."""
    found = next((n for n in names if n in present), None)
    return F.coalesce(F.col(found).cast("string"), F.lit(default)) if found else F.lit(default)
