"""The TEI dialect: mentions in body, footnotes and references, from the rows of ``sources.tei``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from linkweave.functions.text import collapse_ws
from linkweave.functions.urls import clean_url, compare_key, find_all, repair_scheme, urls_in_text
from linkweave.operators.citations import clean_marker
from linkweave.operators.predicates import keep_body_sentence
from linkweave.operators.scoring import first_by
from linkweave.operators.sentences import context_window, logical_sentences, posexplode_context

_MERGED = ArrayType(StructType([StructField("text", StringType()), StructField("first", IntegerType()), StructField("last", IntegerType())]))


@F.pandas_udf(_MERGED)
def _logical(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda f: None if f is None else [{"text": t, "first": a, "last": b} for t, a, b in logical_sentences(list(f))])


def render(tokens: Column, mode: str, target: Column | None = None, marker: Column | None = None, text: Column | None = None) -> Column:
    """A sentence's tokens as text. body: addresses by their targets. note: footnote marks dropped, but for ``target``'s (or a bibr token that
    reads ``marker``), which become `` [text]``. reference: bibr tokens of ``target`` become ``[marker text]``, addresses by their targets."""

    def one(t: Column) -> Column:
        url = F.coalesce(F.nullif(t["target"], F.lit("")), t["text"])
        if mode == "body":
            return F.when(t["kind"] == "url", url).otherwise(t["text"])
        if mode == "note":
            spliced = F.concat(F.lit(" ["), text, F.lit("]")) if text is not None else F.lit("")
            hit = (t["target"] == target) if target is not None else F.lit(False)
            named = (t["kind"] == "bibr") & (F.trim(t["text"]) == marker) if marker is not None else F.lit(False)
            return F.when(t["kind"] == "foot", F.when(F.coalesce(hit, F.lit(False)), spliced).otherwise("")).when(F.coalesce(named, F.lit(False)), spliced).otherwise(t["text"])
        out = F.when(t["kind"] == "url", url)
        if target is not None:
            out = out.when((t["kind"] == "bibr") & (t["target"] == target), F.concat(F.lit("["), clean_marker(t["text"]), F.lit(" "), text, F.lit("]")))
        return out.otherwise(t["text"])

    return collapse_ws(F.array_join(F.transform(tokens, one), ""))


def body(tei: DataFrame) -> DataFrame:
    """``paper_id, location, url, preceding, target, trailing, at_paragraph_start, at_paragraph_end, source`` of prose, abstract and captions.

    Fragments of a container are gathered (a paragraph's sentences, which are few) and merged into logical sentences first.
    """
    s = tei.filter((F.col("kind") == "sentence") & F.col("eligible") & F.col("container").isin("body", "abstract", "caption"))
    per = s.groupBy("paper_id", "file", "para").agg(F.array_sort(F.collect_list(F.struct("sent", "tokens"))).alias("s"))
    per = per.withColumn("logical", _logical(F.transform("s", lambda x: render(x["tokens"], "body"))))
    per = per.withColumn("tagged", F.transform("logical", lambda m: F.flatten(F.transform(F.slice("s", m["first"] + 1, m["last"] - m["first"] + 1), lambda x: F.transform(F.filter(x["tokens"], lambda t: t["kind"] == "url"), lambda t: F.coalesce(F.nullif(t["target"], F.lit("")), t["text"]))))))
    rows = posexplode_context(per, F.transform("logical", lambda m: m["text"]), "paper_id", "para", "tagged").filter(keep_body_sentence(F.col("target")))
    script = r"(?i)^(?:mailto|tel|javascript|data|file):"
    tags = F.filter(F.transform(F.try_element_at("tagged", F.col("sent_ix") + 1), lambda u: repair_scheme(clean_url(u, "tei"))), lambda u: (u != "") & ~u.rlike(script))
    printed = F.filter(F.transform(find_all(F.col("target"), "tei"), lambda u: repair_scheme(clean_url(u, "tei"))), lambda u: (u != "") & ~u.rlike(script))
    rows = rows.withColumn("tags", tags).withColumn("tag_keys", F.transform("tags", compare_key))
    fresh = F.filter(printed, lambda u: ~F.exists("tag_keys", lambda k: (k != "") & k.contains(compare_key(u))))
    cands = F.concat(F.transform("tags", lambda u, i: F.struct(u.alias("url"), compare_key(u).alias("key"), F.lit("tagged").alias("source"), i.alias("ix"))), F.transform(fresh, lambda u, i: F.struct(u.alias("url"), compare_key(u).alias("key"), F.lit("printed").alias("source"), i.alias("ix"))))
    rows = rows.withColumn("c", cands)
    longer = F.filter("c", lambda a: ~F.exists("c", lambda b: (a["key"] != b["key"]) & b["key"].contains(a["key"]) & (F.length(b["key"]) >= F.length(a["key"]) + 3)))
    out = rows.withColumn("m", F.explode(longer)).select("paper_id", "para", "sent_ix", F.lit("body").alias("location"), F.col("m.url").alias("url"), "preceding", "target", "trailing", "at_paragraph_start", "at_paragraph_end", F.col("m.source").alias("source"), F.col("m.key").alias("key"), F.col("m.ix").alias("ix"))
    return out.dropDuplicates(["paper_id", "para", "sent_ix", "key", "source", "ix"]).drop("key", "ix")


def _sentences(tei: DataFrame) -> DataFrame:
    return tei.filter((F.col("kind") == "sentence") & ~F.coalesce("in_references", F.lit(False))).select("paper_id", "para", "sent", "direct", "tokens")


def notes(tei: DataFrame) -> DataFrame:
    """``paper_id, xml_id, marker, content, urls, ix``: foot notes that bear an address."""
    n = tei.filter("kind = 'note'").select("paper_id", F.col("id").alias("xml_id"), "marker", "content", F.col("sent").alias("ix"), urls_in_text(F.col("content"), "note", "note").alias("urls"))
    return n.filter(F.size("urls") > 0)


def inline_addresses(tei: DataFrame) -> DataFrame:
    """Sentences with a tagged address as footnote items of their own: no marker, the address as the note, nothing to restore."""
    s = context_window(_sentences(tei).withColumn("plain", render(F.col("tokens"), "note")), ["paper_id", "para"], "sent", "plain")
    near = lambda c: F.nullif(F.trim(F.when(F.col("direct"), F.col(c))), F.lit(""))
    m = s.select("*", F.posexplode("tokens").alias("tok", "t")).filter("t.kind = 'url'")
    m = m.withColumn("url", clean_url(F.trim(F.coalesce(F.nullif(F.col("t.target"), F.lit("")), F.col("t.text"))), "note"))
    m = m.filter((F.col("url") != "") & ~F.lower("url").startswith("mailto:") & (F.size(urls_in_text(F.col("url"), "note", "note")) > 0))
    m = m.withColumn("preceding", near("preceding")).withColumn("trailing", near("trailing"))
    return m.select("paper_id", F.lit("footnote").alias("location"), F.lit("").alias("footnote_marker"), F.col("url").alias("footnote_content"), F.array("url").alias("urls"), F.col("plain").alias("original_sentence"), F.col("plain").alias("target"), "preceding", "trailing", F.col("preceding").isNull().alias("at_paragraph_start"), F.col("trailing").isNull().alias("at_paragraph_end"))


def footnotes(tei: DataFrame, inline: bool = False) -> DataFrame:
    """Mentions of foot notes: by linked marks, then by reference marks that read like the mark of a note no mark links to; with ``inline`` addresses
    within sentences too.

    Of equal restored sentences of a paper the first counts.
    """
    n = notes(tei)
    s = _sentences(tei).withColumn("plain", render(F.col("tokens"), "note"))
    s = context_window(s, ["paper_id", "para"], "sent", "plain")
    for c in ("preceding", "trailing"):
        s = s.withColumn(c, F.when(F.col("direct"), F.col(c)))
    marks = s.select("*", F.posexplode("tokens").alias("tok", "t"))
    linked = marks.filter("t.kind = 'foot'").withColumn("xml_id", F.col("t.target")).join(n, ["paper_id", "xml_id"])
    one = linked.withColumn("restored", render(F.col("tokens"), "note", target=F.col("xml_id"), text=F.col("content"))).withColumn("step", F.lit(0))
    by_marker = n.join(linked.select("paper_id", "xml_id").distinct(), ["paper_id", "xml_id"], "left_anti")
    last = n.groupBy("paper_id", "marker").agg(F.max_by("xml_id", "ix").alias("xml_id"))
    by_marker = by_marker.join(last, ["paper_id", "marker", "xml_id"], "left_semi")
    named = marks.filter("t.kind = 'bibr'").withColumn("marker", F.trim("t.text")).join(by_marker, ["paper_id", "marker"])
    two = named.withColumn("restored", render(F.col("tokens"), "note", target=F.col("xml_id"), marker=F.col("marker"), text=F.col("content"))).withColumn("step", F.lit(1))
    cols = ["paper_id", "para", "sent", "tok", "step", F.col("plain").alias("original_sentence"), F.col("restored").alias("target"), "marker", "content", "urls", "preceding", "trailing"]
    both = one.select(*cols).unionByName(two.select(*cols))
    out = first_by(both, ["paper_id", F.lower("target")], ["step", "para", "sent", "tok"])
    out = out.select("paper_id", F.lit("footnote").alias("location"), F.col("marker").alias("footnote_marker"), F.col("content").alias("footnote_content"), "urls", "original_sentence", "target", "preceding", "trailing", F.col("preceding").isNull().alias("at_paragraph_start"), F.col("trailing").isNull().alias("at_paragraph_end"))
    return out.unionByName(inline_addresses(tei)) if inline else out


def references(tei: DataFrame) -> DataFrame:
    """A mention for every citation of an entry that bears an address."""
    e = tei.filter("kind = 'entry' and url <> ''").select("paper_id", F.col("id").alias("reference_id"), F.col("content").alias("reference_text"), "url")
    s = tei.filter((F.col("kind") == "sentence") & F.col("container").isin("body", "caption", "other")).select("paper_id", "para", "sent", "direct", "tokens")
    s = context_window(s.withColumn("plain", render(F.col("tokens"), "reference")), ["paper_id", "para"], "sent", "plain")
    for c in ("preceding", "trailing"):
        s = s.withColumn(c, F.when(F.col("direct"), F.col(c)))
    cites = s.select("*", F.posexplode("tokens").alias("tok", "t")).filter("t.kind = 'bibr'").withColumn("reference_id", F.col("t.target"))
    c = cites.join(e, ["paper_id", "reference_id"])
    return c.select(
        "paper_id", F.lit("reference").alias("location"), "reference_id", clean_marker(F.col("t.text")).alias("citation_marker"), "url", "reference_text", F.col("plain").alias("original_sentence"),
        render(F.col("tokens"), "reference", target=F.col("reference_id"), text=F.col("reference_text")).alias("target"), "preceding", "trailing", F.col("preceding").isNull().alias("at_paragraph_start"), F.col("trailing").isNull().alias("at_paragraph_end"),
    )
