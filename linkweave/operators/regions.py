"""Where a text's body ends and its references begin, and what is cut out of the body."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.text import strip_fences
from linkweave.functions.urls import GRAMMARS, let
from linkweave.operators.predicates import footnote_line_with_url

# Headings of reference lists, and of what may follow them.
REFERENCE_HEADINGS = ["references", "reference", "bibliography", "works cited", "literature cited", "reference list", "list of references", "sources", "citations"]
AFTER_REFERENCES = [
    "acknowledgements", "acknowledgments", "author contributions", "competing interests", "conflict of interest", "additional information", "supplementary information",
    "reprints and permissions", "publisher's note", "publisher’s note", "open access", "correspondence", "ethics declarations", "data availability", "code availability",
]
# Headings looked for on the pages of a PDF.
PAGE_HEADINGS = ["references", "bibliography", "works cited", "literature cited", "literature", "sources", "citations", "notes", "reference list", "list of references"]
LAYOUT_HEADINGS = ["references", "bibliography", "works cited", "literature cited", "literature", "sources", "références", "literatur", "bibliografía", "bibliografia", "bibliographie", "referências", "referencias"]
_LAYOUT_REFERENCES = r"(?im)^[ \t]*(?:\d+(?:\.\d+)*\.?\s+)?(?:References(?:\s+(?:and\s+Notes|Cited))?|Bibliography|Works\s+Cited|Literature\s+Cited|Cited\s+References|Reference\s+List|Sources)[ \t]*:?[ \t]*\.?[ \t]*$"
_LAYOUT_ACKNOWLEDGEMENTS = r"(?im)^[ \t]*(?:\d+(?:\.\d+)*\.?\s+)?(?:Acknowledge?ments?|Funding(?:\s+Information)?|Author\s+Contributions)[ \t]*:?[ \t]*\.?[ \t]*$"


def heading_key(line: Column) -> Column:
    """A line as the key of a heading: marks and final punctuation off, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^#{1,6}\s*", ""), r"[:.\-–,\s]+$", "")))


def _holds(line: Column, words: list[str]) -> Column:
    """Whether a line holds any of the words, whatever its case: asked before its key is made, which costs much more."""
    return let(F.lower(line), lambda low: reduce(or_, [low.contains(w) for w in words]))


def _line_offsets(text: Column, hit) -> Column:
    """The offsets (from 0) of the lines for which ``hit`` holds."""
    step = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(hit(x, acc["at"]), F.concat(acc["hits"], F.array(acc["at"]))).otherwise(acc["hits"]).alias("hits")),
    )
    return step["hits"]


# What a line begins with that may be a heading of references: texts are cut before such lines only. Blanks by name, as a complement is slower.
_MAY_BE_HEADING = rf"\n(?=[# \t\x0B\f\r]*(?iu:{'|'.join(REFERENCE_HEADINGS)}))"


def _reference_piece(text: Column, pieces: Column) -> Column:
    """Which of the pieces of a text (from 0) begins with the references' heading: the first in the last 65 %, else the last; null if there is none."""
    hits = F.filter(F.transform(pieces, lambda x, k: F.when(heading_key(F.substring_index(x, "\n", 1)).isin(REFERENCE_HEADINGS), k)), lambda k: k.isNotNull())

    def late(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("late"))
        there = lambda acc: F.when((acc["at"] >= F.floor(F.length(text) * 0.35)) & F.array_contains(found, acc["k"]), acc["k"])
        return F.aggregate(pieces, start, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), (acc["k"] + 1).alias("k"), F.coalesce(acc["late"], there(acc)).alias("late")))["late"]

    # offsets are needed only where there are several
    return let(hits, lambda found: F.when(F.size(found) > 1, F.coalesce(late(found), F.try_element_at(found, F.lit(-1)))).otherwise(F.try_element_at(found, F.lit(1))))


def _at_references(text: Column, use) -> Column:
    """``use(pieces, k)`` of a text's pieces and the one that begins with the references' heading."""
    return let(F.split(text, _MAY_BE_HEADING), lambda p: let(_reference_piece(text, p), lambda k: use(p, k)))


def reference_start(text: Column) -> Column:
    """The offset of the references' heading: the first in the last 65 %, else the last; null if there is none."""
    return _at_references(text, lambda p, k: F.when(k.isNotNull(), F.aggregate(F.slice(p, F.lit(1), k), F.lit(0), lambda at, x: at + F.length(x) + 1)))


def layout_body_end(text: Column) -> Column:
    """The offset where the body of layout text ends: the first references' heading, or acknowledgements in the last 35 %; null for neither."""
    refs = F.nullif(F.regexp_instr(text, F.lit(_LAYOUT_REFERENCES)), F.lit(0)) - 1
    floor = F.floor(F.length(text) * 0.65).cast("int")
    acks = F.nullif(F.regexp_instr(F.substring(text, floor + 1, F.length(text)), F.lit(_LAYOUT_ACKNOWLEDGEMENTS)), F.lit(0)) - 1 + floor
    return F.least(refs, acks)


def _body(t: Column, p: Column, k: Column) -> Column:
    return F.when(k.isNull(), t).when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), k), "\n"), F.lit("\n")))


def _references(p: Column, k: Column) -> Column:
    ends = lambda rest: _line_offsets(rest, lambda x, pos: (pos > 200) & (heading_key(x).isin(AFTER_REFERENCES) | x.rlike(r"(?i)^\s*E-?mail address\s*:")))
    upto = lambda rest: let(F.try_element_at(ends(rest), F.lit(1)), lambda end: F.when(end.isNull(), rest).otherwise(F.substring(rest, F.lit(1), end)))
    return F.when(k.isNull(), F.lit("")).otherwise(let(F.regexp_replace(F.array_join(F.slice(p, k + 1, F.size(p)), "\n"), r"^[^\n]*\n?", ""), upto))


def split_references(text: Column) -> tuple[Column, Column]:
    """Body and references of a Markdown text without fenced code; the references end at a back-matter heading after 200 characters."""
    part = lambda of: let(strip_fences(text), lambda t: _at_references(t, lambda p, k: of(t, p, k)))
    return part(_body), part(lambda _, p, k: _references(p, k))


def body_and_references(text: Column) -> Column:
    """The same as a struct ``body, refs``, for those that need both."""
    return let(strip_fences(text), lambda t: _at_references(t, lambda p, k: F.struct(_body(t, p, k).alias("body"), _references(p, k).alias("refs"))))


def blank_note_lines(text: Column) -> Column:
    """Lines that are notes with an address made blank; offsets stay."""
    has = lambda x: x.rlike(GRAMMARS["markdown"]) & footnote_line_with_url(x)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(has(x), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n")


def body_region(text: Column) -> Column:
    return blank_note_lines(split_references(text)[0])


def trim_front(body: Column) -> Column:
    """From the abstract or introduction on, where one begins early in the text."""
    heading = r"^(?:abstract|1 introduction|introduction)|^(?:background|1\. introduction)\z"
    first = lambda b, early: F.try_element_at(_line_offsets(b, lambda x, at: (at < early) & _holds(x, ["abstract", "introduction", "background"]) & heading_key(x).rlike(heading)), F.lit(1))
    cut_at = lambda b, at: F.when(at.isNull(), b).otherwise(F.substring(b, at + 1, F.length(b)))
    return let(body, lambda b: let(F.greatest(F.lit(3000), F.floor(F.length(b) * 0.35).cast("int")), lambda early: let(first(b, early), lambda at: cut_at(b, at))))


def reference_start_page(toc: Column, page_count: Column) -> Column:
    """The page of the table of contents' entry on references (``[level, title, page]``), else 85 % of the pages."""
    hit = F.try_element_at(F.filter(toc, lambda e: F.try_element_at(e, F.lit(2)).rlike(r"(?i)\breferences?\b")), F.lit(1))
    return F.coalesce(F.try_element_at(hit, F.lit(3)).cast("int"), F.greatest(F.lit(1), F.floor(page_count * 0.85).cast("int")))


def references_cutoff(boxes: DataFrame) -> DataFrame:
    """``paper_id, cut_page, cut_y0``: the first section header that is a references' heading; of ``paper_id, page, boxclass, y0, text``."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("text")), r"[:.]+\s*$", ""), r"^(?:\d+(?:\.\d+)*\.?|[ivxlc]+\.)\s+", ""))
    hit = boxes.filter((F.col("boxclass") == "section-header") & key.isin(LAYOUT_HEADINGS))
    return hit.groupBy("paper_id").agg(F.min(F.struct("page", "y0")).alias("c")).select("paper_id", F.col("c.page").alias("cut_page"), F.col("c.y0").alias("cut_y0"))


def page_heading_line(line: Column) -> Column:
    """Whether a line of a page's text is a references' heading: alone, or with numbers and signs behind it; 60 characters at most."""
    t = F.trim(line)
    key = F.trim(F.regexp_replace(F.lower(t), r"[.:]+$", ""))
    return F.coalesce((F.length(t) <= 60) & key.rlike(rf"^(?:{'|'.join(PAGE_HEADINGS)})[0-9\s().,:;\-–—]*$"), F.lit(False))


def heading_pages(pages: DataFrame) -> DataFrame:
    """``pdf, ref_page``: the first page ``pdf, page, text`` any line of which is a references' heading."""
    hit = F.exists(F.split("text", r"\r?\n"), page_heading_line)
    return pages.filter(hit).groupBy("pdf").agg(F.min("page").alias("ref_page"))


def page_plan(pages: DataFrame) -> DataFrame:
    """``pdf, page, is_body, is_references, tier`` of pages ``pdf, page, text, role``.

    Tier 1: every page of a pdf has a role; mixed pages are both. Tier 2: the pages from the one with a references' heading on are references.
    Tier 3: neither; roles count where there are some (those of the pages of ``tail_pages``, asked for again), any other page is body.
    """
    w = Window.partitionBy("pdf")
    d = pages.withColumn("_n", F.count("*").over(w)).withColumn("_known", F.count("role").over(w)).join(heading_pages(pages), "pdf", "left")
    tier = F.when(F.col("_n") == F.col("_known"), 1).when(F.col("ref_page").isNotNull(), 2).otherwise(3)
    d = d.withColumn("tier", tier)
    late = F.col("page") >= F.col("ref_page")
    body = F.when(F.col("tier") == 2, ~late).otherwise(F.coalesce(F.col("role").isin("body", "mixed"), F.lit(True)))
    refs = F.when(F.col("tier") == 2, late).otherwise(F.coalesce(F.col("role").isin("references", "mixed"), F.lit(False)))
    return d.select("pdf", "page", body.alias("is_body"), refs.alias("is_references"), "tier")


def tail_pages(pages: DataFrame, share: float = 0.7) -> DataFrame:
    """The pages behind ``share`` of each pdf in tier 3, to be classified again."""
    n = F.max("page").over(Window.partitionBy("pdf"))
    plan = page_plan(pages).filter("tier = 3").select("pdf", "page")
    return pages.withColumn("_late", F.col("page") > F.floor(n * share)).filter("_late").drop("_late").join(plan, ["pdf", "page"], "left_semi")


def page_roles(pages: DataFrame) -> DataFrame:
    """``is_body, is_references`` of model-classified pages ``pdf, page, role``; where no page of a pdf has a role, the last 30 % are references."""
    w = Window.partitionBy("pdf")
    n = F.max("page").over(w)
    known = F.max(F.col("role").isNotNull().cast("int")).over(w) == 1
    late = F.col("page") > F.floor(n * 0.7)
    refs = F.when(known, F.coalesce(F.col("role").isin("references", "mixed"), F.lit(False))).otherwise(late)
    body = F.when(known, F.coalesce(F.col("role").isin("body", "mixed"), F.lit(True))).otherwise(~late)
    return pages.withColumn("is_body", body).withColumn("is_references", refs)
