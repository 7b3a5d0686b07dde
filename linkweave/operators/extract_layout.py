"""The layout dialect: mentions from layout text (body) and from layout JSON (footnotes, references).

Layout text is handled by expressions on the paper's row. Of layout JSON a page is a row; boxes, lines and spans are nested arrays, worked on
by higher-order functions, so that only joins on (paper, page, marker) and on (paper, number) shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import collapse_ws, rejoin_lines, strip_control, strip_tags
from linkweave.functions.urls import best_url, clean_url, find_all, is_truncated, recover_wrapped, repair_scheme, urls_in_text
from linkweave.operators import predicates as pr
from linkweave.operators.citations import expand_numeric, marker_key, splice_first, splice_tag
from linkweave.operators.regions import layout_body_end, reference_start_page, references_cutoff
from linkweave.operators.scoring import first_by
from linkweave.operators.sentences import layout_paragraphs, posexplode_context, sentence_with, split_guarded, split_layout, split_pages, split_reference

# --- body, from layout text ---


def body(txt: DataFrame) -> DataFrame:
    """``paper_id, page, location, url, preceding, target, trailing, at_paragraph_start, at_paragraph_end`` of ``paper_id, text``."""
    d = txt.select("paper_id", recover_wrapped(F.col("text")).alias("text")).withColumn("end", layout_body_end(F.col("text")))
    d = d.select("paper_id", F.when(F.col("end").isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("end"))).alias("text"))
    pages = d.select("paper_id", F.posexplode(split_pages(F.col("text"))).alias("page", "text")).filter(F.trim("text") != "")
    paras = pages.select("paper_id", (F.col("page") + 1).alias("page"), F.posexplode(layout_paragraphs(F.col("text"))).alias("para", "raw"))
    kept = F.filter(F.split("raw", "\n"), lambda x: ~pr.layout_footnote_line(x) & ~pr.affiliation_line(x))
    paras = paras.select("paper_id", "page", "para", collapse_ws(F.array_join(kept, "\n")).alias("text")).filter("text <> ''")
    paras = paras.filter(~pr.layout_footnote_paragraph(F.col("text")) & ~pr.reference_entry_paragraph(F.col("text")))
    found = F.transform(find_all(F.col("text"), "layout"), lambda u: repair_scheme(clean_url(u, "layout")))
    found = F.filter(found, lambda u: (u != "") & ~pr.boilerplate_layout(u) & ~is_truncated(u))
    hits = paras.withColumn("urls", found).filter(F.size("urls") > 0).withColumn("sents", split_layout(F.col("text")))
    hits = hits.select("paper_id", "page", "para", "text", "sents", F.posexplode("urls").alias("occ", "url")).withColumn("i", sentence_with(F.col("sents"), F.col("url")))
    # an address that no sentence holds has the paragraph as its sentence
    target = F.coalesce(F.try_element_at("sents", F.col("i") + 1), F.col("text"))
    before = F.when(F.col("i") > 0, F.try_element_at("sents", F.greatest(F.col("i"), F.lit(1))))
    after = F.try_element_at("sents", F.col("i") + 2)
    return hits.select("paper_id", "page", "para", "occ", F.lit("body").alias("location"), "url", before.alias("preceding"), target.alias("target"), after.alias("trailing"), before.isNull().alias("at_paragraph_start"), after.isNull().alias("at_paragraph_end"))


# --- footnotes, from layout JSON ---


def _size(s: Column) -> Column:
    return F.round(F.coalesce(s["size"], F.lit(0.0)), 2)


def main_font_size(boxes: Column) -> Column:
    """The commonest size of the spans of text boxes; of equally common ones that seen first; 10 without any."""
    spans = F.flatten(F.flatten(F.transform(F.filter(boxes, lambda b: b["boxclass"] == "text"), lambda b: F.transform(F.coalesce(b["textlines"], F.array()), lambda x: F.coalesce(x["spans"], F.array())))))
    sizes = F.transform(spans, _size)
    ranked = F.transform(F.array_distinct(sizes), lambda v, i: F.struct(F.size(F.filter(sizes, lambda s: s == v)).alias("n"), (-i).alias("o"), v.alias("v")))
    return F.coalesce(F.array_max(ranked)["v"], F.lit(10.0))


def box_text(box: Column) -> Column:
    return F.trim(F.array_join(F.transform(F.coalesce(box["textlines"], F.array()), lambda x: F.array_join(F.transform(F.coalesce(x["spans"], F.array()), lambda s: F.coalesce(s["text"], F.lit(""))), "")), " "))


def is_note_box(box: Column, main: Column, height: Column) -> Column:
    """A footnote box, or a list item or text in the lower half whose first span is smaller than the main size and begins with a marker;
    not a page number alone."""
    first = F.try_element_at(F.try_element_at(box["textlines"], F.lit(1))["spans"], F.lit(1))
    low = box["boxclass"].isin("list-item", "text") & (F.coalesce(box["y0"], F.lit(0.0)) >= height * 0.5)
    small = (_size(first) < main) & marker_key(strip_control(first["text"])).isNotNull() & ~box_text(box).rlike(r"^\d+$")
    return (box["boxclass"] == "footnote") | F.coalesce(low & small, F.lit(False))


_MARKS = r"(\[[^\]]+\]|\d+|[*†‡§¶‖∗⋆★☆]+)"
_SYMBOL = r"^[*†‡§¶‖∗⋆★☆]+$"


def tag_markers(text: Column, small: Column, registry: Column) -> Column:
    """A span's text with ``[CITE:m]`` for the registered markers in it: numbers where the span is small or raised, symbols always."""
    plain = F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    fits = small | (plain != text)
    # pieces between marks, and the marks, are interleaved
    between = F.split(plain, _MARKS)
    marks = F.regexp_extract_all(plain, F.lit(_MARKS), F.lit(1))

    def one(p: Column) -> Column:
        bare = F.regexp_replace(F.trim(p), r"^[\[\]().]+|[\[\]().]+$", "")
        known = F.array_contains(registry, bare) & (bare.rlike(_SYMBOL) | fits)
        inner = F.filter(F.transform(F.split(bare, r"[,\s]+"), lambda x: F.regexp_replace(x, r"^[\[\]().]+|[\[\]().]+$", "")), lambda x: x != "")
        all_ = (F.size(inner) > 1) & F.forall(inner, lambda x: F.array_contains(registry, x)) & (fits | F.forall(inner, lambda x: x.rlike(_SYMBOL)))
        return F.when(known, F.concat(F.lit("[CITE:"), bare, F.lit("]"))).when(p.startswith("[") & all_, F.array_join(F.transform(inner, lambda x: F.concat(F.lit("[CITE:"), x, F.lit("]"))), "")).otherwise(p)

    return F.array_join(F.zip_with(between, marks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(one(b), F.lit("")))), "")


def line_text(spans: Column, main: Column, registry: Column) -> Column:
    """A line's spans from left to right, with a blank where the gap is 0.6 or more and punctuation, brackets or hyphens don't forbid it."""
    xy = lambda s, k: F.coalesce(F.try_element_at(s["bbox"], F.lit(k)), F.lit(0.0))
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(xy(s, 1).alias("x0"), xy(s, 3).alias("x1"), i.alias("i"), strip_control(F.coalesce(s["text"], F.lit(""))).alias("text"), _size(s).alias("size"))))

    def add(acc: Column, s: Column) -> Column:
        forbidden = acc["out"].rlike(r"(?U)[\s(\[{\-­‐‑‒–−]$") & ~acc["out"].rlike(r"\[CITE:[^\]]*\]$") | s["text"].rlike(r"^[,.;:!?)\]}%'’]")
        gap = (s["x0"] - acc["x1"] >= 0.6) & (acc["out"] != "") & ~forbidden
        tagged = tag_markers(s["text"], s["size"] < main - 0.5, registry)
        out = F.when(s["text"] == "", acc["out"]).when(gap, F.concat(acc["out"], F.lit(" "), tagged)).otherwise(F.concat(acc["out"], tagged))
        return F.struct(out.alias("out"), s["x1"].alias("x1"))

    return F.rtrim(F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(1e9).alias("x1")), add)["out"])


def page_notes(pages: DataFrame) -> DataFrame:
    """Pages ``paper_id, page, p`` with ``main``, ``registry`` (the page's markers) and ``notes``: marker and content of each note box."""
    height = F.coalesce(F.col("p.height"), F.lit(792.0))
    d = pages.withColumn("boxes", F.coalesce("p.boxes", F.array())).withColumn("main", main_font_size(F.col("boxes"))).withColumn("height", height)
    d = d.withColumn("noted", F.filter("boxes", lambda b: is_note_box(b, F.col("main"), F.col("height"))))
    key = lambda b: marker_key(strip_control(F.try_element_at(F.try_element_at(b["textlines"], F.lit(1))["spans"], F.lit(1))["text"]))
    d = d.withColumn("registry", F.array_distinct(F.filter(F.transform("noted", key), lambda k: k.isNotNull())))

    def note(b: Column) -> Column:
        lines = F.filter(F.transform(F.coalesce(b["textlines"], F.array()), lambda x: line_text(F.coalesce(x["spans"], F.array()), F.col("main"), F.col("registry"))), lambda t: t != "")
        whole = collapse_ws(F.array_join(lines, " "))
        return F.struct(key(b).alias("marker"), F.regexp_replace(whole, r"^\s*(?:\[CITE:[^\]]*\]|\[?(?:\d+|[*†‡§¶‖∗⋆★☆]+)[\].]?)\s*", "").alias("content"))

    return d.withColumn("notes", F.filter(F.transform("noted", note), lambda n: n["marker"].isNotNull()))


def _flat_boxes(pages: DataFrame) -> DataFrame:
    b = pages.select("paper_id", "page", F.explode("p.boxes").alias("b"))
    return b.select("paper_id", "page", F.col("b.boxclass").alias("boxclass"), F.col("b.y0").alias("y0"), box_text(F.col("b")).alias("text"))


def footnotes(pages: DataFrame) -> DataFrame:
    """A mention for each marker of a note with an address in a sentence of the same page, before the references' heading."""
    cut = references_cutoff(_flat_boxes(pages))
    d = page_notes(pages).join(cut, "paper_id", "left")
    d = d.filter(F.col("cut_page").isNull() | (F.col("page") <= F.col("cut_page")))
    urls = lambda n: urls_in_text(n["content"], "note", "note")
    good = F.filter(F.transform("notes", lambda n: F.struct(n["marker"].alias("marker"), n["content"].alias("content"), urls(n).alias("urls"))), lambda n: (F.size(n["urls"]) > 0) & ~pr.bibliographic_note(n["content"]))
    d = d.withColumn("good", good).filter(F.size("good") > 0)
    limit = F.when(F.col("page") == F.col("cut_page"), F.col("cut_y0"))
    stays = lambda b: ~is_note_box(b, F.col("main"), F.col("height")) & (b["boxclass"] != "page-header") & (limit.isNull() | (F.coalesce(b["y0"], F.lit(0.0)) < limit))
    bodies = d.select("paper_id", "page", "good", "main", "registry", F.posexplode(F.filter("boxes", stays)).alias("box", "b"))
    lines = F.filter(F.transform(F.coalesce("b.textlines", F.array()), lambda x: line_text(F.coalesce(x["spans"], F.array()), F.col("main"), F.col("registry"))), lambda t: F.trim(t) != "")
    paras = bodies.select("paper_id", "page", "box", "good", rejoin_lines(lines, guarded=True).alias("para")).filter("para <> ''")
    sents = posexplode_context(paras, split_guarded(F.col("para")), "paper_id", "page", "box", "good")
    cites = sents.withColumn("marker", F.explode(F.array_distinct(F.regexp_extract_all("target", F.lit(r"\[CITE:([^\]]+)\]"), F.lit(1)))))
    hit = cites.withColumn("n", F.try_element_at(F.filter("good", lambda n: n["marker"] == F.col("marker")), F.lit(-1))).filter("n is not null")
    blank = lambda c: F.nullif(strip_tags(F.col(c)), F.lit(""))
    out = hit.select("paper_id", "page", "box", "sent_ix", F.lit("footnote").alias("location"), "marker", F.col("n.content").alias("footnote_content"), F.col("n.urls").alias("urls"), strip_tags(F.col("target")).alias("original_sentence"), splice_tag(F.col("target"), F.col("marker"), F.col("n.content")).alias("target"), blank("preceding").alias("preceding"), blank("trailing").alias("trailing"))
    return first_by(out, ["paper_id", F.lower("target")], ["page", "box", "sent_ix", "marker"])


# --- references, from layout JSON ---

_NUMBERED = r"^\s*(\d+)[.)]\s*"


def _page_numbers(pages: DataFrame) -> DataFrame:
    """``paper_id, ref_start``: where a paper's references begin."""
    n = pages.groupBy("paper_id").agg(F.first("toc", ignorenulls=True).alias("toc"), F.coalesce(F.max("page_count"), F.max("page")).alias("n"))
    return n.select("paper_id", reference_start_page(F.coalesce("toc", F.array().cast("array<array<string>>")), F.col("n")).alias("ref_start"))


def reference_list(pages: DataFrame) -> DataFrame:
    """``paper_id, num, text, url, all_urls, page, source``: numbered blocks, then list items, from the references' page on; the first of a number counts.

    Addresses are those of link annotations whose height overlaps the entry's (3 points of margin), then those printed in it.
    """
    d = pages.join(_page_numbers(pages), "paper_id").filter("page >= ref_start")
    spans = lambda x: F.array_join(F.transform(F.coalesce(x["spans"], F.array()), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    full = d.select("paper_id", "page", F.col("p.links").alias("links"), F.posexplode(F.filter(F.coalesce("p.fulltext", F.array()), lambda b: b["type"] == 0)).alias("ix", "b"))
    full = full.select("paper_id", "page", "links", "ix", rejoin_lines(F.transform(F.coalesce("b.lines", F.array()), spans)).alias("text"), F.try_element_at("b.bbox", F.lit(2)).alias("y0"), F.try_element_at("b.bbox", F.lit(4)).alias("y1"), F.lit("fulltext").alias("source")).filter(F.length(F.trim("text")) >= 15)
    box = d.select("paper_id", "page", F.col("p.links").alias("links"), F.posexplode(F.filter(F.coalesce("p.boxes", F.array()), lambda b: b["boxclass"] == "list-item")).alias("ix", "b"))
    box = box.select("paper_id", "page", "links", "ix", box_text(F.col("b")).alias("text"), F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1"), F.lit("box").alias("source"))
    both = full.unionByName(box).withColumn("num", F.nullif(F.regexp_extract("text", _NUMBERED, 1), F.lit("")).cast("int")).filter("num is not null")
    first = first_by(both, ["paper_id", "num"], ["page", F.when(F.col("source") == "fulltext", 0).otherwise(1), "ix"])
    text = F.trim(F.regexp_replace("text", _NUMBERED, ""))
    overlaps = lambda k: (F.try_element_at(k["from"], F.lit(2)) - 3 <= F.col("y1")) & (F.try_element_at(k["from"], F.lit(4)) + 3 >= F.col("y0"))
    linked = F.transform(F.filter(F.coalesce("links", F.array()), lambda k: (k["kind"] == 2) & overlaps(k) & k["uri"].isNotNull()), lambda k: clean_url(k["uri"], "reference"))
    to_web = lambda u: F.when(u.rlike("(?i)^doi:"), F.concat(F.lit("https://doi.org/"), F.trim(F.substring(u, 5, 1 << 20)))).when(u.rlike("(?i)^doi\\.org/"), F.concat(F.lit("https://"), u)).otherwise(u)
    printed = F.filter(F.transform(find_all(text, "reference"), lambda u: to_web(clean_url(u, "reference"))), lambda u: F.length(u) > 10)
    all_ = F.filter(F.concat(linked, printed), lambda u: ~pr.bad_reference_url(u))
    norm = lambda u: F.regexp_replace(F.lower(u), "/+$", "")
    distinct = F.aggregate(all_, F.array().cast("array<string>"), lambda acc, u: F.when(F.exists(acc, lambda x: norm(x) == norm(u)), acc).otherwise(F.concat(acc, F.array(u))))
    out = first.select("paper_id", "num", text.alias("text"), distinct.alias("all_urls"), "page", "source")
    return out.withColumn("url", best_url(F.col("all_urls")))


def references(pages: DataFrame) -> DataFrame:
    """A mention for each number of a bracketed citation in text and captions before the references, whose entry bears an address."""
    refs = reference_list(pages).filter("url is not null").select("paper_id", "num", F.col("text").alias("ref_text"), "url", "all_urls")
    d = pages.join(_page_numbers(pages), "paper_id").filter("page < ref_start")
    boxes = d.select("paper_id", "page", F.posexplode(F.filter(F.coalesce("p.boxes", F.array()), lambda b: b["boxclass"].isin("text", "caption"))).alias("box", "b"))
    sents = posexplode_context(boxes.select("paper_id", "page", "box", box_text(F.col("b")).alias("text")), split_reference(F.col("text")), "paper_id", "page", "box")
    form = r"\[(?:\d+(?:[,;\s\-–]+\d+)*)\]"
    cites = sents.select("*", F.posexplode(F.regexp_extract_all("target", F.lit(f"({form})"), F.lit(1))).alias("occ", "marker"))
    nums = cites.withColumn("num", F.explode(expand_numeric(F.regexp_replace("marker", r"^\[|\]$", ""), "layout")))
    hit = nums.join(refs, ["paper_id", "num"])
    return hit.select("paper_id", "page", F.lit("reference").alias("location"), F.col("num").alias("ref_num"), "url", "all_urls", "marker", F.col("target").alias("original_sentence"), splice_first(F.col("target"), F.col("marker"), F.col("ref_text")).alias("target"), "ref_text", "preceding", "trailing", "at_paragraph_start", "at_paragraph_end")


def layout_hints(lines: DataFrame) -> DataFrame:
    """``paper_id, page, line_height, two_columns`` of lines ``paper_id, page, x0, y0, y1, width``: the median height from 2 to 60, and whether the
    largest gap between left edges is over a tenth of the width (20 lines at least)."""
    from pyspark.sql import Window

    h = F.col("y1") - F.col("y0")
    w = Window.partitionBy("paper_id", "page").orderBy("x0")
    d = lines.withColumn("h", F.when((h >= 2) & (h <= 60), h)).withColumn("gap", F.col("x0") - F.lag("x0").over(w))
    g = d.groupBy("paper_id", "page").agg(F.percentile("h", 0.5).alias("line_height"), F.max("gap").alias("gap"), F.max("width").alias("width"), F.count("*").alias("n"))
    return g.select("paper_id", "page", "line_height", F.coalesce((F.col("n") >= 20) & (F.col("gap") > 0.1 * F.col("width")), F.lit(False)).alias("two_columns"))
