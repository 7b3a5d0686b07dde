"""Queries of the TEI, layout and model dialects, and of scans and sinks.

The tables hold no such files, so every gold row with a target becomes a paper of its own in the dialect's form, with the words of its target as prose; what must be
extracted follows from the form, and the SQL says it. Files are written to the shared folder and read again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import extract_layout, extract_markdown, extract_tei, regions, scoring
from linkweave.operators.predicates import LICENCES, TECHNICAL, any_of
from linkweave.plans.forms import FLAGS, _is
from linkweave.plans.oracle import ws
from linkweave.session import filled, run_dir, table
from linkweave.sources import files, mllm, tei
from linkweave.streaming.incremental import latest, pending

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PROSE = "trim(regexp_replace(regexp_replace(target, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"
_GOLD = f"(select row_id::varchar as paper_id, row_id as i, {_PROSE} as w from pmc_footnote_gold where target is not null)"


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    """``paper_id, w``: the words of every target, ASCII letters only."""
    g = table(spark, sf, "pmc_footnote_gold").filter("target is not null")
    return g.select(F.col("row_id").cast("string").alias("paper_id"), F.trim(F.regexp_replace("target", "[^A-Za-z]+", " ")).alias("w"))


def _filled(template: str) -> Column:
    """A template with ``{w}`` and ``{id}`` filled from the row."""
    given = {"{w}": F.col("w"), "{id}": F.col("paper_id")}
    return F.concat(*[given.get(x, F.lit(x)) for x in re.split(r"(\{w\}|\{id\})", template)])


# --- TEI ---

_TEI = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div>'
    '<p><s>It began so.</s><s>{w} uses <ref type="url" target="https://x.example/r/{id}">a link</ref> well.</s><s>All ended so.</s></p>'
    '<p><s>{w} counts<ref type="foot" target="#f1">1</ref> well.</s></p><p><s>As in <ref type="bibr" target="#b0">[3]</ref> {w}.</s></p></div>'
    '<note place="foot" xml:id="f1" n="1">See https://n.example/n/{id}</note></body>'
    '<back><div type="references"><listBibl><biblStruct xml:id="b0"><note type="raw_reference">Smith. Title. https://b.example/b/{id}</note></biblStruct></listBibl></div></back></text></TEI>'
)


def _tei(spark: SparkSession, sf: str) -> DataFrame:
    docs = _prose(spark, sf).select("paper_id", F.concat("paper_id", F.lit(".tei.xml")).alias("file"), _filled(_TEI).alias("content"))
    return docs.mapInPandas(filled(tei._parse), tei.SCHEMA)


def _kept(sentence: str) -> str:
    flags = " and ".join(f"not ({FLAGS[k][1]})" for k in ("footer", "machine"))
    return f"(select {flags} from (select {sentence} as c))"


_SAID = "trim(w || ' uses https://x.example/r/' || paper_id || ' well.')"
QUERIES["tei_body"] = lambda spark, sf: extract_tei.body(_tei(spark, sf)).select("paper_id", "url", "preceding", "target", "trailing", "source")
ORACLE_SQL["tei_body"] = f"select paper_id, 'https://x.example/r/' || paper_id as url, 'It began so.' as preceding, {_SAID} as target, 'All ended so.' as trailing, 'tagged' as source from {_GOLD} where {_kept(_SAID)}"
QUERIES["tei_footnotes"] = lambda spark, sf: extract_tei.footnotes(_tei(spark, sf)).select("paper_id", "footnote_marker", "footnote_content", F.array_join("urls", " ").alias("urls"), "original_sentence", "target", "at_paragraph_start")
ORACLE_SQL["tei_footnotes"] = f"""select paper_id, '1' as footnote_marker, 'See https://n.example/n/' || paper_id as footnote_content, 'https://n.example/n/' || paper_id as urls, trim(w || ' counts well.') as original_sentence,
  trim(w || ' counts [See https://n.example/n/' || paper_id || '] well.') as target, true as at_paragraph_start from {_GOLD}"""
QUERIES["tei_references"] = lambda spark, sf: extract_tei.references(_tei(spark, sf)).select("paper_id", "reference_id", "citation_marker", "url", "original_sentence", "target")
ORACLE_SQL["tei_references"] = f"""select paper_id, 'b0' as reference_id, '3' as citation_marker, 'https://b.example/b/' || paper_id as url, {ws("'As in [3] ' || w || '.'")} as original_sentence,
  {ws("'As in [3 Smith. Title. https://b.example/b/' || paper_id || '] ' || w || '.'")} as target from {_GOLD}"""
QUERIES["tei_rows"] = lambda spark, sf: _tei(spark, sf).groupBy("kind", "container").agg(F.count("*").alias("n"))
ORACLE_SQL["tei_rows"] = f"select 'sentence' as kind, 'body' as container, 5 * count(*) as n from {_GOLD} union all select 'note', null, count(*) from {_GOLD} union all select 'entry', null, count(*) from {_GOLD}"

# --- layout JSON ---

_BOX = '{"boxclass": "%s", "x0": 0.0, "y0": %s, "x1": 9.0, "y1": %s, "textlines": [{"spans": [%s]}]}'
_SPAN = '{"text": "%s", "size": %s, "bbox": [%s, 0.0, %s, 1.0]}'
_PAGES = (
    '{"toc": [["1", "References", "2"]], "page_count": 2, "pages": [{"page_number": 1, "height": 800.0, "fulltext": [], "links": [], "boxes": ['
    + _BOX % ("text", "10.0", "15.0", ", ".join([_SPAN % ("So {w}", "10.0", "0.0", "5.0"), _SPAN % ("†", "6.0", "5.1", "10.1"), _SPAN % ("here [2]. More.", "10.0", "11.0", "16.0")]))
    + ", "
    + _BOX % ("footnote", "700.0", "705.0", ", ".join([_SPAN % ("†", "6.0", "0.0", "5.0"), _SPAN % ("See http://n.example/{id}", "8.0", "6.0", "11.0")]))
    + ']}, {"page_number": 2, "height": 800.0, "links": [{"kind": 2, "uri": "https://doi.org/10.1/{id}", "from": [0.0, 21.0, 5.0, 24.0]}], "boxes": ['
    + _BOX % ("section-header", "5.0", "10.0", _SPAN % ("References", "12.0", "0.0", "5.0"))
    + '], "fulltext": [{"type": 0, "bbox": [0.0, 20.0, 9.0, 25.0], "lines": [{"spans": [{"text": "2. Smith. Title of it. http://r.example/{id}"}]}]}]}]}'
)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    d = _prose(spark, sf).withColumn("x", F.from_json(_filled(_PAGES), files.LAYOUT))
    d = d.select("paper_id", F.col("paper_id").alias("file"), "x.toc", "x.page_count", F.explode("x.pages").alias("p"))
    return d.select("paper_id", "file", F.col("p.page_number").alias("page"), "toc", "page_count", "p")


QUERIES["layout_footnotes"] = lambda spark, sf: extract_layout.footnotes(_pages(spark, sf)).select("paper_id", "page", "marker", "footnote_content", F.array_join("urls", " ").alias("urls"), "original_sentence", "target", "trailing")
ORACLE_SQL["layout_footnotes"] = f"""select paper_id, 1 as page, '†' as marker, 'See http://n.example/' || paper_id as footnote_content, 'http://n.example/' || paper_id as urls, {ws("'So ' || w || ' here [2].'")} as original_sentence,
  {ws("'So ' || w || ' [See http://n.example/' || paper_id || '] here [2].'")} as target, 'More.' as trailing from {_GOLD}"""
QUERIES["layout_references"] = lambda spark, sf: extract_layout.references(_pages(spark, sf)).select("paper_id", "page", "ref_num", "url", F.array_join("all_urls", " ").alias("all_urls"), "marker", "original_sentence", "target", "trailing")
_L = "'So ' || w || '†here [2].'"
ORACLE_SQL["layout_references"] = f"""select paper_id, 1 as page, 2 as ref_num, 'https://doi.org/10.1/' || paper_id as url, 'https://doi.org/10.1/' || paper_id || ' http://r.example/' || paper_id as all_urls, '[2]' as marker, {_L} as original_sentence,
  'So ' || w || '†here [2][Smith. Title of it. http://r.example/' || paper_id || '].' as target, 'More.' as trailing from {_GOLD}"""
QUERIES["layout_note_boxes"] = lambda spark, sf: extract_layout.page_notes(_pages(spark, sf)).select("paper_id", "page", "main", F.array_join("registry", " ").alias("registry"), F.array_join(F.transform("notes", lambda n: F.concat(n["marker"], F.lit(":"), n["content"])), " ").alias("notes"))
ORACLE_SQL["layout_note_boxes"] = f"select paper_id, 1 as page, 10.0 as main, '†' as registry, '†:See http://n.example/' || paper_id as notes from {_GOLD} union all select paper_id, 2, 10.0, '', '' from {_GOLD}"
QUERIES["layout_reference_list"] = lambda spark, sf: extract_layout.reference_list(_pages(spark, sf)).select("paper_id", "num", "text", "url", "source")
ORACLE_SQL["layout_reference_list"] = f"select paper_id, 2 as num, 'Smith. Title of it. http://r.example/' || paper_id as text, 'https://doi.org/10.1/' || paper_id as url, 'fulltext' as source from {_GOLD}"
QUERIES["layout_cutoffs"] = lambda spark, sf: regions.references_cutoff(extract_layout._flat_boxes(_pages(spark, sf)))
ORACLE_SQL["layout_cutoffs"] = f"select paper_id, 2 as cut_page, 5.0 as cut_y0 from {_GOLD}"


def layout_page_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of ten to a paper, of which every third paper's have roles."""
    p = _prose(spark, sf).select(F.col("paper_id").alias("pdf"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page"))
    role = F.when(F.col("pdf").cast("long") % 3 == 0, F.when(F.col("page") == 5, "mixed").when(F.col("page") > 5, "references").otherwise("body"))
    return regions.page_roles(p.withColumn("role", role)).select("pdf", "page", "is_body", "is_references")


QUERIES["layout_page_roles"] = layout_page_roles
ORACLE_SQL["layout_page_roles"] = f"select paper_id as pdf, page::int as page, case when i % 3 = 0 then page <= 5 else page <= 7 end as is_body, case when i % 3 = 0 then page >= 5 else page > 7 end as is_references from {_GOLD}, range(1, 11) t(page)"


def layout_line_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty lines to a page; those of every second paper stand in two columns."""
    p = _prose(spark, sf).select("paper_id", F.lit(1).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    two = (F.col("paper_id").cast("long") % 2 == 0) & (F.col("k") >= 10)
    return extract_layout.layout_hints(p.select("paper_id", "page", F.when(two, 320.0).otherwise(50.0).alias("x0"), (F.col("k") * 20.0).alias("y0"), (F.col("k") * 20.0 + 8.0 + F.col("k") % 3).alias("y1"), F.lit(600.0).alias("width")))


QUERIES["layout_line_hints"] = layout_line_hints
ORACLE_SQL["layout_line_hints"] = f"select paper_id, 1 as page, 9.0 as line_height, i % 2 = 0 as two_columns from {_GOLD}"

# --- Markdown and layout text ---

_MD = (
    "# Introduction\n\n{w} is available at https://x.example/r/{id}/p today. All ended so.\n\nThe {w} counts7 well.\n\nAs in [2] {w} so. Nothing else.\n\n7 See https://n.example/n/{id}/p for the note.\n\n"
    "Padding text that is long enough to push the list below the third of the whole text, which it must be for the list to be found.\n\n"
    "# References\n\n1. Roe B. Other title. 2001.\n2. Smith J, Doe A. Title. 2019. http://r.example/b/r{id}\n3. Poe C. Third title. 2002.\n"
)
_TXT = (
    "=== PAGE 1 ===\nIt began so. The {w} is at https://code.example/r-\n{id} here. All ended so.\n\n3 http://note.example/x\n\nDepartment of {w} http://office.example/y\n=== PAGE 2 ===\nMore prose at www.second.example/{id} too.\n"
    "References\n[1] A 2001 http://r.example/b\n"
)


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("paper_id", F.concat("paper_id", F.lit(".md")).alias("file"), _filled(_MD).alias("text"))


_MAIL_WORDS = r"(?i)\b(?:e-?mail|email|corresponding author)\b"
_MD_SAID = "trim(w || ' is available at https://x.example/r/' || paper_id || '/p today.')"
_MD_KEPT = f"(select not {_is('c', any_of(LICENCES, '(?i)'))} and not {_is('c', any_of(TECHNICAL))} and not {_is('c', _MAIL_WORDS)} from (select {_MD_SAID} || ' All ended so.' as c))"
QUERIES["markdown_made_body"] = lambda spark, sf: extract_markdown.body(_markdown(spark, sf)).select("paper_id", "url", "preceding", "target", "trailing", "source", "at_paragraph_start")
ORACLE_SQL["markdown_made_body"] = f"select paper_id, 'https://x.example/r/' || paper_id || '/p' as url, null::varchar as preceding, {_MD_SAID} as target, 'All ended so.' as trailing, 'raw_url' as source, true as at_paragraph_start from {_GOLD} where {_MD_KEPT}"
QUERIES["markdown_made_footnotes"] = lambda spark, sf: extract_markdown.restored_footnotes(_markdown(spark, sf))[0].select("paper_id", "marker", "url", "footnote_text", "target", "original_sentence", "kind")
ORACLE_SQL["markdown_made_footnotes"] = f"""select paper_id, '7' as marker, 'https://n.example/n/' || paper_id || '/p' as url, 'See https://n.example/n/' || paper_id || '/p for the note.' as footnote_text,
  {ws("'The ' || w || ' counts [See https://n.example/n/' || paper_id || '/p for the note.] well.'")} as target, {ws("'The ' || w || ' counts7 well.'")} as original_sentence, 'standalone' as kind from {_GOLD}"""
QUERIES["markdown_made_references"] = lambda spark, sf: extract_markdown.restored_references(_markdown(spark, sf)).select("paper_id", "citation_marker", "citation_style", "url", "target", "original_sentence", "trailing", "reference_index")
_ENTRY = "'2. Smith J, Doe A. Title. 2019. http://r.example/b/r' || paper_id"
ORACLE_SQL["markdown_made_references"] = f"""select paper_id, '2' as citation_marker, 'bracket_number' as citation_style, 'http://r.example/b/r' || paper_id as url, 'As in [2 ' || {_ENTRY} || '] ' || w || ' so.' as target, 'As in [2] ' || w || ' so.' as original_sentence,
  'Nothing else.' as trailing, '2' as reference_index from {_GOLD}"""
QUERIES["markdown_made_entries"] = lambda spark, sf: extract_markdown.reference_entries(_markdown(spark, sf)).select("paper_id", "entry_ix", "index", "full_text", F.array_join("urls", " ").alias("urls"), "pub_year", F.array_join("keys", " ").alias("keys"))
ORACLE_SQL["markdown_made_entries"] = f"""select paper_id, k::int as entry_ix, (k + 1)::varchar as index, case k when 0 then '1. Roe B. Other title. 2001.' when 1 then {_ENTRY} else '3. Poe C. Third title. 2002.' end as full_text,
  case k when 1 then 'http://r.example/b/r' || paper_id else '' end as urls, case k when 0 then '2001' when 1 then '2019' else '2002' end as pub_year, (k + 1)::varchar as keys from {_GOLD}, range(0, 3) t(k)"""
QUERIES["markdown_made_notes"] = lambda spark, sf: extract_markdown.footnotes(_markdown(spark, sf)).select("paper_id", "marker", "marker_norm", "footnote_text", F.array_join("urls", " ").alias("urls"), "kind")
ORACLE_SQL["markdown_made_notes"] = f"select paper_id, '7' as marker, '7' as marker_norm, 'See https://n.example/n/' || paper_id || '/p for the note.' as footnote_text, 'https://n.example/n/' || paper_id || '/p' as urls, 'standalone' as kind from {_GOLD}"


def _layout_text(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("paper_id", _filled(_TXT).alias("text"))


QUERIES["layout_made_body"] = lambda spark, sf: extract_layout.body(_layout_text(spark, sf)).select("paper_id", "page", "url", "preceding", "target", "trailing")
ORACLE_SQL["layout_made_body"] = f"""select paper_id, 1 as page, 'https://code.example/r-' || paper_id as url, 'It began so.' as preceding, {ws("'The ' || w || ' is at https://code.example/r-' || paper_id || ' here.'")} as target, 'All ended so.' as trailing from {_GOLD}
  union all select paper_id, 2, 'www.second.example/' || paper_id, null, 'More prose at www.second.example/' || paper_id || ' too.', null from {_GOLD}"""

# --- output of models ---


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("w").alias("restored_sentence"), F.array(F.concat(F.lit("http://a.example/"), "paper_id"), F.lit("http://b.example")).alias("url"), F.lit("Before.").alias("preceding"))
    return _prose(spark, sf).select(F.concat(F.lit("x/"), "paper_id", F.lit("_body_urls.json")).alias("file"), F.to_json(F.struct(F.concat("paper_id", F.lit(".pdf")).alias("pdf_file"), F.array(item).alias("items"))).alias("payload"))


QUERIES["model_items"] = lambda spark, sf: mllm.flatten(_payloads(spark, sf), "body")
ORACLE_SQL["model_items"] = f"select paper_id, 'body' as location, w as target, 'Before.' as preceding, '' as trailing, 'http://a.example/' || paper_id || ' | http://b.example' as url from {_GOLD}"
_PROMPT = "Paper {paper}: {sentence}"
QUERIES["model_prompts"] = lambda spark, sf: _prose(spark, sf).select("paper_id", mllm.prompt(_PROMPT, paper=F.col("paper_id"), sentence=F.nullif("w", F.lit(""))).alias("prompt"))
ORACLE_SQL["model_prompts"] = f"select paper_id, 'Paper ' || paper_id || ': ' || w as prompt from {_GOLD}"
QUERIES["model_calls"] = lambda spark, sf: mllm.call_model(QUERIES["model_prompts"](spark, sf), lambda p: '{"n": %d}' % len(p), parallelism=8).select("paper_id", F.get_json_object("answer", "$.n").cast("int").alias("n"), F.col("error").isNull().alias("fine"))
ORACLE_SQL["model_calls"] = f"select paper_id, length('Paper ' || paper_id || ': ' || w)::int as n, true as fine from {_GOLD}"


def model_page_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Ten pages to a paper in batches of six."""
    p = _prose(spark, sf).select(F.col("paper_id").alias("pdf"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page"), F.lit("t").alias("text"))
    return mllm.page_batches(p).select("pdf", "batch", F.size("pages").alias("n_pages"), F.col("pages")[0]["page"].alias("first_page"))


QUERIES["model_page_batches"] = model_page_batches
ORACLE_SQL["model_page_batches"] = f"select paper_id as pdf, b::int as batch, case when b = 0 then 6 else 4 end as n_pages, case when b = 0 then 1 else 7 end as first_page from {_GOLD}, range(0, 2) t(b)"


def model_own_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An address that three pages of a paper gave, of which the second prints it, but for every third paper."""
    p = _prose(spark, sf).select(F.col("paper_id").alias("pdf"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), F.concat(F.lit("http://own.example/"), "paper_id").alias("url"), "w")
    there = (F.col("page") == 2) & (F.col("pdf").cast("long") % 3 != 0)
    return mllm.own_pages(p.withColumn("page_text", F.concat("w", F.when(there, F.concat(F.lit(" HTTP://own . example/"), "pdf")).otherwise("")))).select("pdf", "page")


QUERIES["model_own_pages"] = model_own_pages
ORACLE_SQL["model_own_pages"] = f"select paper_id as pdf, page::int as page from {_GOLD}, range(1, 4) t(page) where i % 3 = 0 or page = 2"

def model_page_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Ten pages to a paper: a third of the papers have roles on all pages, a third a heading on the seventh, the rest neither."""
    k = F.col("pdf").cast("long") % 3
    p = _prose(spark, sf).select(F.col("paper_id").alias("pdf"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page"))
    role = F.when(k == 0, F.when(F.col("page") == 8, "mixed").when(F.col("page") > 8, "references").otherwise("body")).when((k == 2) & (F.col("page") == 10), "references")
    text = F.when((k == 1) & (F.col("page") >= 7), "Running head\nREFERENCES (2)\nA. B.").otherwise("references are given below")
    return regions.page_plan(p.withColumn("role", role).withColumn("text", text))


QUERIES["model_page_plan"] = model_page_plan
ORACLE_SQL["model_page_plan"] = f"""select paper_id as pdf, page::int as page, (i % 3 + 1)::int as tier, case i % 3 when 0 then page <= 8 when 1 then page < 7 else page < 10 end as is_body,
  case i % 3 when 0 then page >= 8 when 1 then page >= 7 else page = 10 end as is_references from {_GOLD}, range(1, 11) t(page)"""
QUERIES["model_clips"] = lambda spark, sf: _prose(spark, sf).select("paper_id", mllm.clip(F.lit(600.0), F.lit(800.0), "bottom", 0.5)["y0"].alias("y0"), mllm.clip(F.lit(600.0), F.lit(800.0), "top", 0.25)["y1"].alias("y1"), F.length(mllm.text_section(F.repeat("w", 60))).alias("n"))
ORACLE_SQL["model_clips"] = f"select paper_id, 400.0 as y0, 200.0 as y1, case when w = '' then 0 else least(3000, 60 * length(w)) + length(chr(10) || 'TEXT LAYER:' || chr(10) || '---' || chr(10) || chr(10) || '---' || chr(10)) end::int as n from {_GOLD}"


def model_distinct_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every restored item reported by two pages, with other blanks, dashes and case of the address, and once with another marker."""
    p = _prose(spark, sf).select(F.col("paper_id").alias("pdf"), F.explode(F.array(*[F.struct(F.lit(k).alias("page"), F.lit(m).alias("marker"), F.lit(t).alias("tail"), F.lit(u).alias("u")) for k, m, t, u in ((1, "[1]", "a - b", "http://A.example"), (2, " [1] ", "a  –  B", "http://a.example"), (3, "[2]", "a - b", "http://a.example"))])).alias("x"), "w")
    items = p.select("pdf", "x.page", "x.marker", F.concat("w", F.lit(" "), "x.tail").alias("original_sentence"), F.array("x.u").alias("urls"))
    return scoring.distinct_items(items, ["page"]).select("pdf", "page", "marker")


QUERIES["model_distinct_items"] = model_distinct_items
ORACLE_SQL["model_distinct_items"] = f"select paper_id as pdf, k::int as page, case k when 1 then '[1]' else '[2]' end as marker from {_GOLD}, (values (1), (3)) t(k)"
QUERIES["tei_inline"] = lambda spark, sf: extract_tei.inline_addresses(_tei(spark, sf)).select("paper_id", "footnote_marker", "footnote_content", "target", "preceding", "trailing")
ORACLE_SQL["tei_inline"] = f"select paper_id, '' as footnote_marker, 'https://x.example/r/' || paper_id as footnote_content, trim(w || ' uses a link well.') as target, 'It began so.' as preceding, 'All ended so.' as trailing from {_GOLD}"


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of a run over all papers with a text, of the addresses of their notes."""
    notes = table(spark, sf, "footnote").select("paper_id", F.explode("urls").alias("url"))
    papers = table(spark, sf, "md_file").select("paper_id")
    return scoring.run_summary(notes.join(papers.distinct(), "paper_id", "left_semi"), papers)[1]


QUERIES["run_totals"] = run_totals
ORACLE_SQL["run_totals"] = """with n as (select paper_id, unnest(urls) as url from footnote), p as (select distinct paper_id from md_file),
g as (select p.paper_id, count(n.url) as items, count(distinct n.url) as urls from p left join n using (paper_id) group by 1)
select count(*) as papers, count(*) filter (where items > 0) as papers_with_items, sum(items)::bigint as items, sum(urls)::bigint as urls from g"""

# --- scans and sinks ---

_FIELDS = ["paper_id", "target", "url", "location", "label", "split", "none"]


def _written(spark: SparkSession, sf: str, name: str = "gold.csv") -> str:
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    files.write_csv(table(spark, sf, "pmc_footnote_gold"), f"{path}/{name}", ["row_id", *_FIELDS])
    return path


def csv_strings(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_located(spark, f"{_written(spark, sf)}/gold.csv").select("row_id", *_FIELDS)


QUERIES["csv_strings"] = csv_strings
ORACLE_SQL["csv_strings"] = "select row_id::varchar as row_id, " + ", ".join("'' as none" if c == "none" else f"coalesce({c}, '') as {c}" for c in _FIELDS) + " from pmc_footnote_gold"
QUERIES["csv_addresses"] = lambda spark, sf: files.read_urls(spark, f"{_written(spark, sf)}/gold.csv")
ORACLE_SQL["csv_addresses"] = "select coalesce(paper_id, '') as paper_id, coalesce(url, '') as url from pmc_footnote_gold"


def csv_gold_folder(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    g = table(spark, sf, "pmc_footnote_gold").withColumn("Label_", F.col("label")).drop("label").withColumnRenamed("Label_", "Label")
    for k, name in enumerate(("a-gold.csv", "b-gold.csv")):
        files.write_csv(g.filter(F.col("row_id") % 2 == k), f"{path}/{name}", ["row_id", "paper_id", "url", "Label", "split"])
    return files.read_gold_dir(spark, path).select("row_id", "paper_id", "url", "label")


QUERIES["csv_gold_folder"] = csv_gold_folder
ORACLE_SQL["csv_gold_folder"] = "select row_id::varchar as row_id, coalesce(paper_id, '') as paper_id, coalesce(url, '') as url, label from pmc_footnote_gold where trim(split) = 'test' and trim(coalesce(label, '')) <> ''"


def csv_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    g = table(spark, sf, "pmc_footnote_gold")
    rule = F.when(F.col("row_id") % 4 == 0, "genuine_fp").otherwise("exact")
    g = g.select("row_id", "paper_id", rule.alias("match_rule"), F.concat(F.lit("o"), "row_id").alias("url_output"), F.lit("").alias("url_output_norm"), F.when(F.col("row_id") % 3 != 0, F.concat(F.lit("g"), "row_id")).alias("url_gold"), F.lit("n").alias("url_gold_norm"), F.lit("1").alias("pred_label_name"), F.lit("2").alias("gold_label_name"))
    fields = ["row_id", "paper_id", "match_rule", "url_output", "url_output_norm", "url_gold", "url_gold_norm", "pred_label_name", "gold_label_name"]
    for name in ("one_all_predictions.csv", "x_gold_all_predictions.csv"):
        files.write_csv(g, f"{path}/{name}", fields)
    return files.read_predictions(spark, [path]).select("row_id", "url", "pred_label", "gold_label")


QUERIES["csv_predictions"] = csv_predictions
ORACLE_SQL["csv_predictions"] = "select row_id::varchar as row_id, case when row_id % 4 = 0 then 'o' || row_id when row_id % 3 <> 0 then 'g' || row_id else 'n' end as url, '1' as pred_label, '2' as gold_label from pmc_footnote_gold"


def jsonl_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf, "footnote").select("footnote_id", "paper_id", "kind", "urls").distinct(), path)
    d = spark.read.schema("footnote_id long, paper_id string, kind string, urls array<string>").json(path)
    return d.select("footnote_id", "paper_id", "kind", F.array_join("urls", " ").alias("urls"))


QUERIES["jsonl_rows"] = jsonl_rows
ORACLE_SQL["jsonl_rows"] = "select footnote_id, paper_id, kind, array_to_string(urls, ' ') as urls from (select distinct footnote_id, paper_id, kind, urls from footnote)"


def papers_written(spark: SparkSession, sf: str) -> DataFrame:
    """A folder for each paper, read again and counted."""
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    files.write_by_paper(latest(table(spark, sf, "footnote").select("footnote_id", "paper_id", "marker", "loaded_at"), ["footnote_id"], "loaded_at"), path)
    d = spark.read.schema("footnote_id long, marker string, paper_id string").json(path)
    return d.groupBy("paper_id").agg(F.count("*").alias("items"), F.min("footnote_id").alias("first_id"))


QUERIES["papers_written"] = papers_written
ORACLE_SQL["papers_written"] = "select paper_id, count(*) as items, min(footnote_id) as first_id from (select footnote_id, arg_max(paper_id, loaded_at) as paper_id from footnote group by 1) group by paper_id"
QUERIES["papers_pending"] = lambda spark, sf: pending(table(spark, sf, "md_file").select("md_id", "paper_id"), table(spark, sf, "footnote"), "paper_id")
ORACLE_SQL["papers_pending"] = "select md_id, paper_id from md_file where paper_id not in (select paper_id from footnote where paper_id is not null)"
