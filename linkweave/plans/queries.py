"""Queries of the core operators over the test tables. Each runs over whole tables.

There is no table of predictions, so ``predictions`` makes one from the gold rows: every row gives one, some of them damaged in a way that
depends on the row's number.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import paper_ids
from linkweave.functions.similarity import indel_ratio, token_sort_ratio
from linkweave.functions.text import format_set, merge_piped, norm_text, target_skeleton
from linkweave.functions.urls import best_url, canonical_url, prefer_longer, url_set, urls_in_text
from linkweave.operators import citations as cite
from linkweave.operators import extract_layout, extract_markdown, predicates, scoring
from linkweave.operators.matching import candidate_edges, collapse, match_edges, skeleton_merge
from linkweave.operators.packed_values import split_packed
from linkweave.operators.sentences import context_window, posexplode_context, split_guarded, split_layout, split_reference
from linkweave.plans import dialects, forms, oracle
from linkweave.session import cut, table
from linkweave.streaming.incremental import latest

__all__ = ["ORACLE_SQL", "QUERIES"]
ORACLE_SQL = oracle.ORACLE_SQL | forms.ORACLE_SQL | dialects.ORACLE_SQL


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pmc_footnote_gold").withColumn("ix", F.col("row_id"))


def predictions(g: DataFrame) -> DataFrame:
    """Every gold row as a prediction; the host in capitals, a final point, another path, another sentence or another class in some."""
    n = F.col("row_id")
    url = F.when(n % 11 == 0, F.concat("url", F.lit("/elsewhere"))).when(n % 5 == 0, F.upper("url")).when(n % 3 == 0, F.concat("url", F.lit("."))).otherwise(F.col("url"))
    target = F.when(n % 7 == 0, F.concat(F.lit("It is not so that "), "target")).when(n % 13 == 0, F.col("trailing_sentence")).otherwise(F.col("target"))
    label = F.when(n % 9 == 0, ((F.col("label").cast("int") + 1) % 6).cast("string")).otherwise(F.col("label"))
    rule = F.when(n % 17 == 0, "genuine_fp").when(n % 19 == 0, "stage2").otherwise("exact")
    return g.withColumns({"url": url, "target": target, "pred_label": label, "gold_label": F.col("label"), "match_rule": rule})


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- addresses ---


def url_canonical(spark, sf):
    return gold(spark, sf).select("row_id", canonical_url(F.col("url")).alias("url_norm"))


def url_canonical_mllm(spark, sf):
    return gold(spark, sf).select("row_id", canonical_url(F.col("url"), "mllm").alias("url_norm"))


def url_field_set(spark, sf):
    return gold(spark, sf).select("row_id", F.explode(url_set(F.col("url"))).alias("url_norm"))


def url_eval_prf(spark, sf):
    g = cut(gold(spark, sf), "gold")
    gk = scoring.url_keys(g, F.col("paper_id"), F.col("url"), drop_boilerplate=True)
    pk = scoring.url_keys(predictions(g), F.col("paper_id"), F.col("url"))
    return _rounded(scoring.url_prf(gk, pk), "p", "r", "f1")


def footnote_urls(spark, sf):
    return table(spark, sf, "footnote").select("footnote_id", F.explode(urls_in_text(F.col("footnote_text"), "note", "note")).alias("url")).distinct()


def best_urls(spark, sf):
    d = table(spark, sf, "footnote").filter(F.size("urls") > 0)
    return d.select("footnote_id", best_url(F.col("urls")).alias("url")).distinct()


def longer_urls(spark, sf):
    d = table(spark, sf, "reference_entry")
    return d.select("entry_id", F.explode(prefer_longer(F.col("urls"))).alias("url")).distinct()


def document_urls(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(urls_in_text(F.col("text"))).alias("url"))


# --- text and ids ---


def paper_id_rules(spark, sf):
    c = F.col("paper_id")
    return gold(spark, sf).select("row_id", paper_ids.exact(c).alias("id_exact"), paper_ids.heuristic_reference(c).alias("id_reference"), paper_ids.mllm(c).alias("id_mllm"))


def target_keys(spark, sf):
    t = norm_text(F.col("target"), tildes=True)
    return gold(spark, sf).select("row_id", t.alias("target_norm"), target_skeleton(t).alias("skeleton"))


def marker_norms(spark, sf):
    return table(spark, sf, "footnote").select("footnote_id", cite.marker_norm(F.col("marker")).alias("marker")).distinct()


# --- sentences ---


def _sentence_rows(spark, sf, split):
    return posexplode_context(table(spark, sf, "documents"), split(F.col("text")), "doc_id")


def sentences_layout(spark, sf):
    return _sentence_rows(spark, sf, split_layout).select("doc_id", "sent_ix", F.col("target").alias("sentence"))


def sentences_guarded(spark, sf):
    return _sentence_rows(spark, sf, split_guarded).select("doc_id", "sent_ix", F.col("target").alias("sentence"))


def sentence_context(spark, sf):
    return _sentence_rows(spark, sf, split_reference).select("doc_id", "sent_ix", "preceding", "trailing", "at_paragraph_start", "at_paragraph_end")


def sentence_window(spark, sf):
    rows = cut(_sentence_rows(spark, sf, split_reference).select("doc_id", "sent_ix", F.col("target").alias("text")), "sentences")
    return context_window(rows, ["doc_id"], "sent_ix").select("doc_id", "sent_ix", "preceding", "trailing", "at_paragraph_start", "at_paragraph_end")


def sentence_filters(spark, sf):
    s = _sentence_rows(spark, sf, split_reference)
    flags = {"footer": predicates.publisher_footer, "machine": predicates.machine_text, "bibliographic": predicates.bibliographic_line, "caption": predicates.caption_or_table}
    return s.agg(F.count("*").alias("n"), *[F.sum(f(F.col("target")).cast("int")).alias(k) for k, f in flags.items()])


# --- citations ---


_GROUP = r"(\[\d{1,4}(?:\s*[,;\-–]\s*\d{1,4})*\])"


def _cited(spark, sf):
    """Sentences with every number of their marks, groups and ranges."""
    s = _sentence_rows(spark, sf, split_reference)
    docs = table(spark, sf, "documents").select("doc_id", "paper_id")
    marked = s.withColumn("marker", F.explode(F.array_distinct(F.regexp_extract_all("target", F.lit(_GROUP), F.lit(1)))))
    return marked.withColumn("num", F.explode(cite.expand_numeric(F.regexp_replace("marker", r"[\[\]]", "")))).join(docs, "doc_id")


def citation_numbers(spark, sf):
    s = _sentence_rows(spark, sf, split_reference)
    groups = s.select("doc_id", "sent_ix", F.explode(F.regexp_extract_all("target", F.lit(r"\[(\d{1,4}(?:\s*[,;\-–]\s*\d{1,4})*)\]"), F.lit(1))).alias("inner"))
    return groups.select("doc_id", "sent_ix", F.explode(cite.expand_numeric(F.col("inner"))).alias("num"))


def reference_restored(spark, sf):
    e = latest(table(spark, sf, "reference_entry").select("entry_id", "paper_id", "ref_index", "full_text", "urls", "loaded_at"), ["entry_id"], "loaded_at")
    e = scoring.first_by(e.filter("ref_index is not null and size(urls) > 0"), ["paper_id", "ref_index"], ["entry_id"]).select("paper_id", "ref_index", "full_text")
    c = _cited(spark, sf).withColumn("ref_index", F.col("num").cast("string"))
    return c.join(e, ["paper_id", "ref_index"]).select("doc_id", "sent_ix", "marker", "num", cite.splice_first(F.col("target"), F.col("marker"), F.col("full_text")).alias("restored"))


def reference_keys(spark, sf):
    d = table(spark, sf, "reference_entry")
    names = cite.surnames(F.col("full_text"))
    keys = cite.author_year_keys(F.col("first_author"), F.col("second_author"), F.col("pub_year"))
    return d.select("entry_id", cite.last_year(F.col("full_text")).alias("year_found"), F.try_element_at(names, F.lit(1)).alias("author_found"), F.size(keys).alias("n_keys"), F.try_element_at(keys, F.lit(1)).alias("first_key")).distinct()


def index_styles(spark, sf):
    return cite.index_styles(table(spark, sf, "reference_entry"), "paper_id", "ref_index")


def _marks(spark, sf):
    return table(spark, sf, "md_file").filter("text is not null").select("md_id", "paper_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\[\^\w+\])"), F.lit(1)))).alias("surface"), "text").withColumn("marker_norm", cite.marker_norm(F.col("surface")))


def footnote_marks(spark, sf):
    n = latest(table(spark, sf, "footnote").select("footnote_id", "paper_id", "marker_norm", "footnote_text", "loaded_at"), ["footnote_id"], "loaded_at")
    return _marks(spark, sf).join(n, ["paper_id", "marker_norm"]).select("md_id", "footnote_id", "surface", F.concat(F.lit("["), "footnote_text", F.lit("]")).alias("inserted"))


_MARK = re.compile(r"\[\^\w+\]", re.A)


@F.pandas_udf(extract_markdown.OCC)
def _mark_places(text: pd.Series) -> pd.Series:
    """Every occurrence of every mark, with its offset."""
    return pd.Series([[{"start": m.start(), "surface": m.group()} for m in _MARK.finditer(t)] for t in text], dtype="object")


def footnote_nearest_marker(spark, sf):
    n = table(spark, sf, "footnote").filter("start_char is not null").select("paper_id", "marker_norm", F.col("footnote_id").alias("note_ix"), F.col("start_char").alias("start")).distinct()
    m = table(spark, sf, "md_file").filter("text is not null").select("paper_id", F.explode(_mark_places("text")).alias("o")).select("paper_id", "o.start", "o.surface").withColumn("marker_norm", cite.marker_norm(F.col("surface")))
    best = cite.nearest_markers(m, n, ["paper_id", "marker_norm"])
    return best.select(F.col("note_ix").alias("footnote_id"), "score", F.col("occ_start").alias("mark_start"))


# --- extraction ---


def markdown_body(spark, sf):
    d = table(spark, sf, "md_file").select("paper_id", "file", "text")
    return extract_markdown.body(d).select("paper_id", "file", "url", "preceding", "target", "trailing", "source", "start_char")


def layout_body(spark, sf):
    d = table(spark, sf, "md_file").select(F.col("file").alias("paper_id"), "text").filter("text is not null")
    return extract_layout.body(d).select(F.col("paper_id").alias("file"), "page", "para", "occ", "url", "preceding", "target", "trailing")



def _one_per_file(spark, sf):
    """The Markdown texts, each under its file's name, as a paper of its own: reruns of a paper have texts of their own."""
    return table(spark, sf, "md_file").select(F.col("file").alias("paper_id"), "file", "text")


def markdown_footnotes(spark, sf):
    rows, _ = extract_markdown.restored_footnotes(_one_per_file(spark, sf))
    return rows.select("file", "marker", "url", "preceding", "target", "original_sentence", "trailing", "marker_start_char")


def markdown_footnotes_lost(spark, sf):
    _, lost = extract_markdown.restored_footnotes(_one_per_file(spark, sf))
    return lost.select("file", "marker", "footnote_text", "reason")


def markdown_references(spark, sf):
    """Every text followed by a numbered list of those entries of its paper that its marks name: as many as it has marks."""
    e = latest(table(spark, sf, "reference_entry").select("entry_id", "paper_id", "ref_index", "full_text", "loaded_at"), ["entry_id"], "loaded_at").filter("ref_index is not null")
    e = scoring.first_by(e, ["paper_id", "ref_index"], ["entry_id"]).select("paper_id", F.col("ref_index").cast("int").alias("num"), "full_text")
    d = table(spark, sf, "md_file").filter("text is not null").select("md_id", "paper_id", "file", "text")
    cited = d.select("md_id", "paper_id", F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(_GROUP), F.lit(1)), lambda x: cite.expand_numeric(F.regexp_replace(x, r"[\[\]]", "")))))).alias("num"))
    lists = cited.join(e, ["paper_id", "num"]).groupBy("md_id").agg(F.array_sort(F.collect_list(F.struct("num", F.regexp_replace("full_text", r"\s+", " ").alias("t")))).alias("l"))
    refs = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["num"].cast("string"), F.lit("] "), x["t"])), "\n")
    d = d.join(lists, "md_id").select(F.col("file").alias("paper_id"), "file", F.concat("text", F.lit("\n\n## References\n\n"), refs).alias("text"))
    rows = extract_markdown.restored_references(cut(d, "with-lists"))
    return rows.select("file", "citation_marker", "url", "target", "original_sentence", "citation_start_char", "reference_index")


# --- deliveries, sums, sets ---


def latest_footnotes(spark, sf):
    return latest(table(spark, sf, "footnote").select("footnote_id", "paper_id", "marker", "loaded_at"), ["footnote_id"], "loaded_at")


def mentions(spark, sf):
    f = table(spark, sf, "footnote").select("paper_id", F.explode("urls").alias("url")).withColumn("location", F.lit("footnote"))
    r = table(spark, sf, "reference_entry").select("paper_id", F.explode("urls").alias("url")).withColumn("location", F.lit("reference"))
    b = table(spark, sf, "url_candidate").filter("url is not null").select("paper_id", "url").withColumn("location", F.lit("body"))
    return b.unionByName(f).unionByName(r)


def location_rollup(spark, sf):
    m = mentions(spark, sf).rollup("location").agg(F.count("*").alias("items"), F.count_distinct("paper_id").alias("papers"))
    return m.withColumn("location", F.coalesce("location", F.lit("OVERALL")))


def corpus_sums(spark, sf):
    return scoring.corpus_counts(mentions(spark, sf))


def papers_without_gold(spark, sf):
    g = gold(spark, sf).select(paper_ids.exact(F.col("paper_id")).alias("paper_id")).distinct()
    return mentions(spark, sf).select("paper_id").distinct().join(g, "paper_id", "left_anti")


def target_collapse(spark, sf):
    rows = gold(spark, sf).select("ix", F.coalesce("paper_id", F.lit("")).alias("paper_id"), F.coalesce("target", F.lit("")).alias("target"), url_set(F.col("url")).alias("urls"), F.coalesce("label", F.lit("")).alias("label"))
    c = collapse(cut(rows, "rows"), ["paper_id", "target"], filled=("label",))
    return c.select("paper_id", "target", F.col("ix").alias("first_row"), "label", format_set(F.col("urls")).alias("urls"))


def piped_contexts(spark, sf):
    return gold(spark, sf).select("row_id", merge_piped(F.concat_ws("|", "location", "split"), F.col("split")).alias("merged"))


# --- similarity, matching, scores ---


def sentence_ratios(spark, sf):
    d = gold(spark, sf).select("row_id", F.col("target").alias("a"), F.coalesce("trailing_sentence", F.lit("")).alias("b"))
    return _rounded(d.select("row_id", indel_ratio(F.col("a"), F.col("b")).alias("ratio"), token_sort_ratio(F.col("a"), F.col("b")).alias("sorted_ratio")), "ratio", "sorted_ratio")


def candidate_pairs(spark, sf):
    g = cut(gold(spark, sf), "gold")
    rows = lambda d: cut(collapse(scoring.context_rows(d), ["loc", "paper_id", "target_norm"]), "rows")
    e = candidate_edges(rows(g), rows(predictions(g)), on=("loc", "paper_id"))
    return _rounded(e.select("loc", "paper_id", "g", "p", "shared", "sim"), "sim")


def matched_pairs(spark, sf):
    g = cut(gold(spark, sf), "gold")
    rows = lambda d: cut(collapse(scoring.context_rows(d), ["loc", "paper_id", "target_norm"]), "rows")
    return match_edges(candidate_edges(rows(g), rows(predictions(g)), on=("loc", "paper_id")))


def merged_gold(spark, sf):
    m = skeleton_merge(scoring.mllm_rows(gold(spark, sf), "gold", True))
    return m.select("ix", "paper_id", F.size("merged").alias("n_rows"), format_set(F.col("urls")).alias("urls"))


def context_report(spark, sf):
    g = cut(gold(spark, sf), "gold")
    return _rounded(scoring.context_report(g, predictions(g)), "p", "r", "f1").select("location", "tp", "fp", "fn", "p", "r", "f1")


def reference_report(spark, sf):
    g = cut(gold(spark, sf), "gold")
    return scoring.reference_counts(g, predictions(g))


def two_stage_report(spark, sf):
    g = gold(spark, sf)
    acc = scoring.mllm_rows(g, "gold", False).select("paper_id", F.explode("urls").alias("url"), "target_norm")
    return scoring.two_stage_counts(cut(scoring.two_stage(g, predictions(g), acc), "stages"))


def majority_labels(spark, sf):
    g = gold(spark, sf).filter("label is not null and paper_id is not null")
    return scoring.majority(g.select("ix", "paper_id", "label"), ["paper_id"], "label", "ix")


def _classes(granularity: str, variant: int):
    def run(spark, sf):
        g = cut(gold(spark, sf).filter(F.lower(F.trim("split")) == "test"), "gold")
        report = scoring.class_report(scoring.class_counts(g, predictions(g), granularity, variant))
        return _rounded(report, "p", "r", "f1")

    return run


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_packed(table(spark, sf, "pmc_footnote_gold"), "row_id", "url").withColumnsRenamed({"id": "row_id", "value": "url"})


QUERIES = {
    f.__name__: f
    for f in (
        url_canonical, url_canonical_mllm, url_field_set, url_eval_prf, footnote_urls, best_urls, longer_urls, document_urls, paper_id_rules, target_keys, marker_norms,
        sentences_layout, sentences_guarded, sentence_context, sentence_window, sentence_filters, citation_numbers, reference_restored, reference_keys, index_styles,
        footnote_marks, footnote_nearest_marker, markdown_body, markdown_footnotes, markdown_footnotes_lost, markdown_references, layout_body, latest_footnotes, location_rollup, corpus_sums, papers_without_gold, target_collapse, piped_contexts,
        sentence_ratios, candidate_pairs, matched_pairs, merged_gold, context_report, reference_report, two_stage_report, majority_labels, p3_found,
    )
}
QUERIES |= forms.QUERIES | dialects.QUERIES
QUERIES |= {f"class_{g}_v{v}": _classes(g, v) for g in ("fine", "coarse", "binary") for v in (1, 2, 3, 4)}
