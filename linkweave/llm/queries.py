"""Queries of the llm operators over the test tables, and SQL for those that SQL can express.

Every query runs its operator, with production parameters, over the whole table.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import encoding, format_duplicates, linked_splits, lookalikes, markup, mixing, page_noise, subjects
from linkweave.session import cut, table

P1_UNORDERED = ("paper_id", "url")
P1_EXACT = ("preceding_sentence", "target", "trailing_sentence", "label", "location")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = format_duplicates.copy_pairs(table(spark, sf, "pmc_footnote_gold"), "row_id", P1_UNORDERED, P1_EXACT)
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, sf, "pmc_footnote_gold"), "row_id", P1_UNORDERED, P1_EXACT).select(F.col("id").alias("row_id"), "n_copies")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    facts = cut(linked_splits.entity_facts(table(spark, sf, "pmc_footnote_gold"), ("paper_id", "url"), "file", "split"), "p2-facts")
    return linked_splits.torn_papers(facts, linked_splits.components(facts))


def p2_assigned(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = linked_splits.assign_splits(table(spark, sf, "pmc_footnote_gold"), "row_id", table(spark, sf, "split_target"), ("paper_id", "url"), "file", "split")
    return rows.select(F.col("id").alias("row_id"), "component", "split", "status")


def _roots(comps: DataFrame) -> DataFrame:
    """``node, root``: the components of a table, named by their smallest node."""
    return comps.join(comps.groupBy("component").agg(F.min("node").alias("root")), "component").select("node", "root", *[c for c in comps.columns if c not in ("node", "component")])


def p2_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whole components and what becomes of them; the split only where one was given, as new ones are dealt by hashes."""
    _, t = linked_splits.assign_splits(table(spark, sf, "pmc_footnote_gold"), "row_id", table(spark, sf, "split_target"), ("paper_id", "url"), "file", "split")
    return _roots(t).select("node", "root", "status", F.when(F.col("status") == "kept", F.col("split")).alias("split"), "n")


def p2_next(spark: SparkSession, sf: str) -> DataFrame:
    """The rows in three batches in the order of their loading, each over the table of the one before: the last table."""
    rows = table(spark, sf, "pmc_footnote_gold")
    first, second = rows.agg(F.percentile_approx(F.unix_micros(F.col("loaded_at").cast("timestamp")), [1 / 3, 2 / 3], 10_000)).first()[0] or (0, 0)
    at = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0))
    known = None
    for batch in (rows.filter(at <= first), rows.filter((at > first) & (at <= second)), rows.filter(at > second)):
        _, known = linked_splits.assign_splits(batch, "row_id", table(spark, sf, "split_target"), ("paper_id", "url"), "file", "split", previous=known)
    return _roots(known).select("node", "root", "n")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookalikes.look_alike_pairs(table(spark, sf, "pmc_footnote_gold"), "row_id", "paper_id", ("url", "target"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.consistent_table(table(spark, sf, "pmc_footnote_gold"), "row_id", ("url", "target")).withColumnRenamed("id", "row_id")


def scanned_records(spark: SparkSession, sf: str) -> DataFrame:
    """``kind, id, text`` of the three tables that hold text of scanned pages."""
    parts = [("footnote", "footnote_id", "footnote_text"), ("reference_entry", "entry_id", "full_text"), ("md_file", "md_id", "text")]
    frames = [table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(i).cast("long").alias("id"), F.col(c).alias("text")) for t, i, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return page_noise.page_noise(scanned_records(spark, sf))


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return page_noise.repair(scanned_records(spark, sf)).select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "text").distinct()


def _md(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "md_file").select(F.col("md_id").cast("long").alias("id"), "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = markup.pieces(_md(spark, sf)).select(F.lit("md_file").alias("record_kind"), F.col("id").alias("record_id"), "piece", "content")
    urls = markup.marked_addresses(table(spark, sf, "url_candidate"), "cand_id", "url")
    return pieces.unionByName(urls.select(F.lit("url_candidate").alias("record_kind"), F.col("id").alias("record_id"), F.lit("url").alias("piece"), "content"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean_texts(_md(spark, sf)).select(F.col("id").alias("md_id"), "text")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.sizes(table(spark, sf, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixing.mix(_sized(spark, sf), table(spark, sf, "mix_target")), table(spark, sf, "mix_target")).filter("held_back").select("source")


def p8_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf), table(spark, sf, "mix_target")).select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixing.mix(_sized(spark, sf), table(spark, sf, "mix_target")), table(spark, sf, "mix_target"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    labels = table(spark, sf, "subject_label").select(F.col("doc_id").cast("long").alias("id"), "subject")
    areas = [r["subject"] for r in table(spark, sf, "subject_area").select("subject").distinct().collect()]
    return subjects.subjects_of(docs, labels, areas).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(_subjects(spark, sf), "p9-composition")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return found.join(docs, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n_docs"), F.round(F.sum("share"), 6).alias("weight"))


QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p2_assigned": p2_assigned,
    "p2_status": p2_status,
    "p2_next": p2_next,
    "p4_found": p4_found,
    "p4_consistent": p4_consistent,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_CANON = r"lower(regexp_replace({}, '[\p{{Z}}\p{{P}}\p{{S}}\t\n\x0B\f\r\x1C-\x1F\x{{85}}]+', '', 'g'))"
_P1_KEYED = f"""
keyed as (
  select row_id, preceding_sentence as x0, target as x1, trailing_sentence as x2, label as x3, location as x4,
         coalesce({_CANON.format('paper_id')}, chr(1)) as f0, coalesce({_CANON.format('url')}, chr(1)) as f1
  from pmc_footnote_gold),
grouped as (
  select row_id, dense_rank() over (order by x0, x1, x2, x3, x4, least(f0, f1), greatest(f0, f1)) as g from keyed)
"""
_P2_LINKED = r"""
ids as (
  select row_id, file, lower(trim(split)) as split,
         regexp_replace(upper(coalesce(paper_id, '')), '[^\p{L}\p{N}]+', '', 'g') as a, regexp_replace(upper(coalesce(url, '')), '[^\p{L}\p{N}]+', '', 'g') as b
  from pmc_footnote_gold),
facts as (
  select case when regexp_full_match(a, 'PMC[0-9]{8}') then a when regexp_full_match(b, 'PMC[0-9]{8}') then b end as paper, file, split, count(*) as n from ids group by all),
ends as (select distinct 'p:' || paper as p, 'f:' || file as f from facts where paper is not null and file is not null),
links as (select p as a, f as b from ends union select f, p from ends),
nodes as (select distinct 'p:' || paper as n from facts where paper is not null),
walk as (select n, n as root from nodes union select l.b, w.root from walk w join links l on l.a = w.n)
"""

_P2_ROOTS = (
    _P2_LINKED.replace("nodes as (select distinct 'p:' || paper as n from facts where paper is not null)", "nodes as (select 'p:' || paper as n from facts where paper is not null union select 'f:' || file from facts where file is not null)").rstrip()
    + """,
rooted as (select n as node, min(root) as root from walk group by n),
sized as (
  select r.node, r.root, coalesce(sum(t.n), 0)::bigint as n from rooted r left join facts t on r.node = coalesce('p:' || t.paper, 'f:' || t.file) group by r.node, r.root)
"""
)



def _looks_sql(c: str) -> str:
    """A text by its look, in SQL: each character's own rule and list entry, spelled out from the Unicode database, then composed."""
    one, to, more = [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if not 0xD800 <= code <= 0xDFFF and unicodedata.category(ch) not in ("Cn", "Co"):
            n = lookalikes.clean_of(ch)
            if n != unicodedata.normalize("NFC", ch):
                if len(n) == 1:
                    one.append(ch)
                    to.append(n)
                elif not n:
                    more.append(ch)
    ligatures = [(ch, lookalikes.clean_of(ch)) for ch in "ﬀﬁﬂﬃﬄﬅﬆⅡⅢⅣⅥⅦⅧⅨⅪⅫⅱⅲⅳⅵⅶⅷⅸⅺⅻ"]
    q = lambda x: "'" + x.replace("'", "''") + "'"
    c = f"translate(nfc_normalize({c}), {q(''.join(one))}, {q(''.join(to))})"
    c = f"translate({c}, {q(''.join(more))}, '')"
    for a, b in ligatures:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"nfc_normalize({c})"


ORACLE_SQL = {
    "p4_found": f"""
with seen as (
  select row_id, paper_id, 0 as field, url as form from pmc_footnote_gold where paper_id is not null and url is not null
  union all select row_id, paper_id, 1, target from pmc_footnote_gold where paper_id is not null and target is not null),
looks as (select *, {_looks_sql('form')} as look from seen)
select distinct least(a.row_id, b.row_id) as row_id_a, greatest(a.row_id, b.row_id) as row_id_b
from looks a join looks b on a.paper_id = b.paper_id and a.field = b.field and a.look = b.look and a.form < b.form""",
    "p1_found": f"with {_P1_KEYED} select a.row_id as row_id_a, b.row_id as row_id_b from grouped a join grouped b on a.g = b.g and a.row_id < b.row_id",
    "p1_collapsed": f"with {_P1_KEYED} select min(row_id) as row_id, count(*) as n_copies from grouped group by g",
    "p2_found": f"""
with recursive {_P2_LINKED},
splits as (
  select w.root, t.split from walk w join facts t on w.n = 'p:' || t.paper where t.split is not null
  union select w.root, t.split from walk w join facts t on w.n = 'f:' || t.file where t.split is not null)
select root[3:] as paper_id from splits group by root having count(distinct split) > 1""",
    "p2_status": f"""
with recursive {_P2_ROOTS},
given as (select r.root, min(t.split) as lo, max(t.split) as hi from facts t join rooted r on r.node = coalesce('p:' || t.paper, 'f:' || t.file) and t.split in ('train', 'validation', 'test') group by r.root)
select r.node, r.root, case when g.lo is null then 'new' when g.lo = g.hi then 'kept' else 'quarantined' end as status, case when g.lo = g.hi then g.lo end as split, r.n
from sized r left join given g on r.root = g.root""",
    "p2_next": f"with recursive {_P2_ROOTS} select node, root, n from sized",
}
