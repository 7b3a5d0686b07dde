"""The four rules by which the dialects and evaluators spell paper ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.text import norm_text


def _pad(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}\.\d{3}$"), F.concat(c, F.lit("0"))).otherwise(c)


def exact(c: Column) -> Column:
    """Text folded, ``.pdf`` off, a three-digit suffix padded."""
    return _pad(F.trim(F.regexp_replace(norm_text(c), r"(?i)\.pdf$", "")))


def heuristic_reference(c: Column) -> Column:
    """``.pdf`` and version off, a suffix of one to three digits padded to four."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)\.pdf$", ""), r"v\d+$", ""))
    p = r"^(\d{4}\.)(\d{1,3})$"
    return F.when(s.rlike(p), F.concat(F.regexp_extract(s, p, 1), F.rpad(F.regexp_extract(s, p, 2), 4, "0"))).otherwise(s)


def mllm(c: Column) -> Column:
    """The arXiv id anywhere in the text, without version, padded; else the text without ``.pdf``."""
    s = F.replace(norm_text(c, tildes=True), F.lit(".pdf"), F.lit(""))
    p = r"(\d{4}\.\d{3,5})(?:v\d+)?"
    return _pad(F.when(s.rlike(p), F.regexp_extract(s, p, 1)).otherwise(s))


def from_file(c: Column) -> Column:
    """The id in a file's name: known suffixes off."""
    name = F.regexp_extract(c, r"([^/\\]+)$", 1)
    return F.regexp_replace(name, r"(?i)(?:\.tei)?\.(?:xml|json|md|txt|pdf)$", "")
