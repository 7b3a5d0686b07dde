"""Precision, recall and F1: of address sets, of sentences in context, and of classes of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import paper_ids
from linkweave.functions.similarity import indel_ratio, ratio_bound, sorted_tokens
from linkweave.functions.text import match_key, norm_text, target_skeleton
from linkweave.functions.urls import boilerplate_of_set, url_list_mllm, url_set
from linkweave.operators.matching import THRESHOLD, candidate_edges, collapse, match_edges, skeleton_merge
from linkweave.session import cut

LOCATIONS = ("body", "footnote", "reference")


def prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """``p, r, f1`` added to counts; 0 where nothing is counted."""
    t, a, b = F.col(tp).cast("double"), F.col(fp), F.col(fn)
    p, r = F.coalesce(F.try_divide(t, t + a), F.lit(0.0)), F.coalesce(F.try_divide(t, t + b), F.lit(0.0))
    return df.withColumn("p", p).withColumn("r", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


# --- sets of addresses ---


def url_keys(df: DataFrame, pid: Column, url: Column, drop_boilerplate: bool = False) -> DataFrame:
    """The distinct ``paper_id, url`` of a table, both canonical."""
    out = df.select(paper_ids.exact(pid).alias("paper_id"), F.explode(url_set(url)).alias("url"))
    if drop_boilerplate:
        out = out.filter(~boilerplate_of_set(F.col("url")))
    return out.distinct()


def url_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``paper_id, tp, fp, fn`` of distinct keys ``paper_id, url`` of both sides, for papers of either."""
    g, p = gold.withColumn("in_gold", F.lit(1)), pred.withColumn("in_pred", F.lit(1))
    both = g.join(p, ["paper_id", "url"], "full_outer")
    hit = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).alias
    ig, ip = F.col("in_gold").isNotNull(), F.col("in_pred").isNotNull()
    return both.groupBy("paper_id").agg(hit(ig & ip)("tp"), hit(~ig & ip)("fp"), hit(ig & ~ip)("fn"))


def url_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over all papers."""
    c = url_counts(gold, pred).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    return prf(c)


# --- sentences in context ---


def located(df: DataFrame) -> DataFrame:
    """With ``loc``, the location trimmed and in lower case."""
    return df.withColumn("loc", F.lower(F.trim(F.coalesce("location", F.lit("")))))


def context_rows(df: DataFrame) -> DataFrame:
    """Rows of the simple evaluator: ``ix, loc, paper_id, target_norm, urls, url_raw, label, split``; needs ``ix, paper_id, target, url, location``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = located(df)
    extra = [text(c).alias(c) if c in d.columns else F.lit("").alias(c) for c in ("label", "split")]
    return d.select("ix", "loc", paper_ids.exact(F.col("paper_id")).alias("paper_id"), norm_text(text("target")).alias("target_norm"), url_set(text("url")).alias("urls"), F.trim(text("url")).alias("url_raw"), *extra)


def context_counts(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``loc, tp, fp, fn`` by one-to-one assignment; unmatched gold of boilerplate hosts is forgiven."""
    key = ["loc", "paper_id", "target_norm"]
    g = cut(collapse(context_rows(gold), key, firsts=("url_raw",), filled=("label", "split")), "gold-rows")
    p = cut(collapse(context_rows(pred), key, firsts=("url_raw",)), "pred-rows")
    m = cut(match_edges(candidate_edges(g, p, threshold, ("loc", "paper_id"))), "matched")
    gs = g.join(m.select(F.col("g").alias("ix"), F.lit(1).alias("hit")), "ix", "left")
    ps = p.join(m.select(F.col("p").alias("ix"), F.lit(1).alias("hit")), "ix", "left")
    forgiven = F.exists("urls", boilerplate_of_set)
    a = gs.groupBy("loc").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("tp"), F.sum(F.when(F.col("hit").isNull() & ~forgiven, 1).otherwise(0)).alias("fn"))
    b = ps.groupBy("loc").agg(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("fp"))
    return a.join(b, "loc", "full_outer").select("loc", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])


def reference_counts(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``tp, fp, fn`` by keys (paper, address): hit if any two sentences are alike as sorted words; a prediction counts as wrong only
    where its paper has gold and its key hasn't."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pid = paper_ids.heuristic_reference
    g = gold.select(pid(F.col("paper_id")).alias("paper_id"), F.trim(text("target")).alias("t"), url_set(text("url")).alias("urls")).filter("paper_id <> '' and t <> '' and size(urls) > 0")
    g = cut(g.withColumn("soft", F.exists("urls", boilerplate_of_set)).withColumn("url", F.explode("urls")), "ref-gold")
    p = cut(pred.select(pid(F.col("paper_id")).alias("paper_id"), text("target").alias("t"), F.explode(url_set(text("url"))).alias("url")).filter("paper_id <> ''"), "ref-pred")
    gs = g.select("paper_id", "url", sorted_tokens(F.col("t")).alias("gt")).distinct()
    ps = p.select("paper_id", "url", sorted_tokens(F.col("t")).alias("pt")).distinct()
    near = cut(gs.join(ps, ["paper_id", "url"]).filter(ratio_bound(F.col("gt"), F.col("pt")) >= threshold).withColumn("sim", indel_ratio(F.col("gt"), F.col("pt"))), "ref-near")
    hits = near.filter(F.col("sim") >= threshold).select("paper_id", "url", F.lit(1).alias("hit")).distinct()
    keys = g.groupBy("paper_id", "url").agg(F.max("soft").alias("soft")).join(hits, ["paper_id", "url"], "left")
    a = keys.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("hit").isNull() & ~F.col("soft"), 1).otherwise(0)), F.lit(0)).alias("fn"))
    wrong = p.select("paper_id", "url").distinct().join(g.select("paper_id").distinct(), "paper_id", "left_semi").join(keys.select("paper_id", "url"), ["paper_id", "url"], "left_anti")
    fp = wrong.agg(F.count("*").alias("fp"))
    return a.withColumn("_k", F.lit(1)).join(fp.withColumn("_k", F.lit(1)), "_k").select("tp", "fp", "fn")


def by_location(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each ``loc`` and of OVERALL, whose counts are summed, never averaged."""
    r = counts.rollup("loc").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return prf(r.withColumn("location", F.coalesce("loc", F.lit("OVERALL"))).drop("loc"))


def context_report(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The heuristic evaluation: body and footnote by assignment, reference by keys, and OVERALL."""
    g, p = located(gold), located(pred)
    near = context_counts(g.filter(F.col("loc").isin("body", "footnote")), p.filter(F.col("loc").isin("body", "footnote")), threshold)
    ref = reference_counts(g.filter("loc = 'reference'"), p.filter("loc = 'reference'"), threshold).select(F.lit("reference").alias("loc"), "tp", "fp", "fn")
    return by_location(near.unionByName(ref))


def mllm_rows(df: DataFrame, side: str, with_target: bool) -> DataFrame:
    """Rows of the evaluator of model output: ``ix, paper_id, target_raw, target_norm, skeleton, urls``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = df.select("ix", paper_ids.mllm(F.col("paper_id")).alias("paper_id"), text("target").alias("target_raw"), norm_text(text("target"), tildes=True).alias("target_norm"), url_list_mllm(text("url"), side, text("target") if with_target else None).alias("urls"))
    return d.withColumn("skeleton", target_skeleton(F.col("target_norm")))


def two_stage(gold: DataFrame, pred: DataFrame, accepted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The labelled rows of the two-stage reference evaluation: ``side, ix, stage`` with stages stage1, stage2, extra, fp and fn.

    Gold is merged by skeletons first. Stage 1 matches sentences, stage 2 what is left against accepted sentences
    (``paper_id, url, target_norm``) of the shared addresses; a prediction left over is *extra* where an address that a matched gold row
    claims has an accepted sentence like its own.
    """
    g = cut(skeleton_merge(mllm_rows(gold, "gold", True)).select("ix", "paper_id", "urls", "target_norm"), "gold-merged")
    p = cut(mllm_rows(pred, "pred", True).select("ix", "paper_id", "urls", "target_norm"), "pred-mllm")
    one = cut(match_edges(candidate_edges(g, p, threshold)), "stage1")
    og, op = one.select(F.col("g").alias("ix")), one.select(F.col("p").alias("ix"))
    gl, pl = g.join(og, "ix", "left_anti"), p.join(op, "ix", "left_anti")
    ge = gl.select("paper_id", F.col("ix").alias("g"), F.explode("urls").alias("url"))
    pe = pl.select("paper_id", F.col("ix").alias("p"), F.col("target_norm").alias("pt"), F.explode("urls").alias("url"))
    shared = ge.join(pe, ["paper_id", "url"])
    # only sentences of addresses that a prediction left over has are asked for, twice
    asked = pe.select("paper_id", "url").distinct()
    acc = cut(accepted.select("paper_id", "url", F.col("target_norm").alias("at")).join(asked, ["paper_id", "url"], "left_semi").distinct(), "accepted-sentences")

    def liked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(acc, ["paper_id", "url"]).filter(ratio_bound(F.col("at"), F.col("pt")) >= threshold)
        return cut(near.select(*[c for c in pairs.columns if c != "pt"], indel_ratio(F.col("at"), F.col("pt")).alias("s")), "accepted").filter(F.col("s") >= threshold)

    sim2 = liked(shared).groupBy("g", "p").agg(F.max("s").alias("sim"))
    edges2 = shared.groupBy("paper_id", "g", "p").agg(F.count("*").alias("shared")).join(sim2, ["g", "p"])
    two = cut(match_edges(edges2), "stage2")
    claimed = g.join(one.select(F.col("g").alias("ix")).unionByName(two.select(F.col("g").alias("ix"))), "ix", "left_semi").select("paper_id", F.explode("urls").alias("url")).distinct()
    left = pl.join(two.select(F.col("p").alias("ix")), "ix", "left_anti")
    le = left.select("paper_id", F.col("ix").alias("p"), F.col("target_norm").alias("pt"), F.explode("urls").alias("url")).join(claimed, ["paper_id", "url"], "left_semi")
    extra = liked(le).select(F.col("p").alias("ix")).distinct()
    row = lambda df, side, stage: df.select(F.lit(side).alias("side"), "ix", F.lit(stage).alias("stage"))
    out = row(og, "gold", "stage1").unionByName(row(op, "pred", "stage1"))
    out = out.unionByName(row(two.select(F.col("g").alias("ix")), "gold", "stage2")).unionByName(row(two.select(F.col("p").alias("ix")), "pred", "stage2"))
    out = out.unionByName(row(gl.join(two.select(F.col("g").alias("ix")), "ix", "left_anti"), "gold", "fn"))
    return out.unionByName(row(extra, "pred", "extra")).unionByName(row(left.join(extra, "ix", "left_anti"), "pred", "fp"))


def two_stage_counts(stages: DataFrame) -> DataFrame:
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g, s = F.col("side") == "gold", F.col("stage")
    return stages.agg(n(g & s.isin("stage1", "stage2")).alias("tp"), n(s == "fp").alias("fp"), n(s == "fn").alias("fn"), n(s == "extra").alias("extra"), n(g & (s == "stage1")).alias("stage1"), n(g & (s == "stage2")).alias("stage2"))


# --- classes ---

# The classes by id, and their groups at the three granularities.
CLASSES = ("general-url", "third-party-dataset", "author-provided-dataset", "third-party-software", "author-provided-software", "project")
GRANULARITIES = {
    "fine": CLASSES,
    "coarse": ("general-url", "dataset", "dataset", "software", "software", "project"),
    "binary": ("not-OADS", "OADS", "OADS", "OADS", "OADS", "OADS"),
}


def class_id(label: Column) -> Column:
    """The id of a label given as digits (also ``3.0``) or as a class's name; null for neither."""
    digits = F.nullif(F.regexp_extract(F.trim(label), r"^(\d+)(?:\..*)?$", 1), F.lit("")).cast("int")
    named = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.trim(label)).cast("int") - 1
    return F.coalesce(digits, F.when(named >= 0, named))


def group_of(id_: Column, granularity: str) -> Column:
    return F.try_element_at(F.array(*[F.lit(g) for g in GRANULARITIES[granularity]]), id_ + 1)


def majority(df: DataFrame, keys: list[str], label: str, ix: str) -> DataFrame:
    """The commonest label of each key; ties go to the one that came first."""
    per = df.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(ix).alias("_first"))
    return per.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col("_first"))).alias(label))


def class_counts(gold: DataFrame, pred: DataFrame, granularity: str = "fine", variant: int = 1) -> DataFrame:
    """``class, tp, fp, fn`` of all classes of a granularity.

    ``gold``: ``ix, paper_id, url, label``; ``pred``: ``ix, paper_id, url, pred_label, gold_label, match_rule`` with url the gold one, or the
    output's for genuine_fp. Variants 1 and 3 score keys (paper, address), 2 and 4 rows; stage2 matches are wrong in 1 and 2.
    """
    spark: SparkSession = gold.sparkSession
    stage2_wrong, keyed = variant in (1, 2), variant in (1, 3)
    g = gold.withColumn("c", class_id(F.col("label"))).filter("c is not null")
    p = pred.withColumn("pc", group_of(class_id(F.col("pred_label")), granularity)).filter("pc is not null")
    wrong_rule = (F.col("match_rule") == "genuine_fp") | (F.lit(stage2_wrong) & (F.col("match_rule") == "stage2"))
    p = p.withColumn("wrong", F.coalesce(wrong_rule, F.lit(False)))
    if keyed:
        gk = majority(g.select("ix", paper_ids.exact(F.col("paper_id")).alias("paper_id"), F.explode(url_set(F.col("url"))).alias("url"), "c"), ["paper_id", "url"], "c", "ix")
        gk = cut(gk.select("paper_id", "url", group_of(F.col("c"), granularity).alias("gc")), "class-gold")
        pk = cut(p.select("ix", paper_ids.exact(F.col("paper_id")).alias("paper_id"), F.explode(url_set(F.col("url"))).alias("url"), "pc", "wrong"), "class-pred")
        valid = majority(pk.filter("not wrong"), ["paper_id", "url"], "pc", "ix").withColumnRenamed("pc", "vc")
        # valid votes come before wrong ones, as ties go to what came first
        top = pk.agg(F.max("ix")).first()[0] or 0
        any_ = majority(pk.withColumn("ix", F.when(F.col("wrong"), F.col("ix") + F.lit(top + 1)).otherwise(F.col("ix"))), ["paper_id", "url"], "pc", "ix").withColumnRenamed("pc", "ac")
        both = gk.join(any_.join(valid, ["paper_id", "url"], "left"), ["paper_id", "url"], "full_outer")
        hit = F.col("gc").isNotNull() & F.coalesce(F.col("vc") == F.col("gc"), F.lit(False))
        tp, fp = both.filter(hit).select(F.col("gc").alias("class")), both.filter(~hit & F.col("ac").isNotNull()).select(F.col("ac").alias("class"))
        n = gk.select(F.col("gc").alias("class"))
    else:
        gc = group_of(class_id(F.col("gold_label")), granularity)
        hit = ~F.col("wrong") & F.coalesce(gc == F.col("pc"), F.lit(False))
        tp, fp = p.filter(hit).select(F.col("pc").alias("class")), p.filter(~hit).select(F.col("pc").alias("class"))
        n = g.select(group_of(F.col("c"), granularity).alias("class"))
    names = list(dict.fromkeys(GRANULARITIES[granularity]))
    all_ = tp.select("class", F.lit("tp").alias("k")).unionByName(fp.select("class", F.lit("fp").alias("k"))).unionByName(n.select("class", F.lit("n").alias("k")))
    count = lambda k: F.sum(F.when(F.col("k") == k, 1).otherwise(0))
    per = all_.groupBy("class").agg(count("tp").alias("tp"), count("fp").alias("fp"), count("n").alias("n"))
    every = spark.createDataFrame([(c,) for c in names], "class string").join(per, "class", "left")
    return every.select("class", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp")], (F.coalesce("n", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"))


def class_report(counts: DataFrame) -> DataFrame:
    """Per class, and MACRO (the unweighted mean of F1, empty classes included) and MICRO (from pooled counts)."""
    per = prf(counts)
    micro = prf(counts.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])).withColumn("class", F.lit("MICRO"))
    none = F.lit(None)
    macro = per.agg(F.avg("f1").alias("f1")).select(F.lit("MACRO").alias("class"), *[none.cast("long").alias(k) for k in ("tp", "fp", "fn")], *[none.cast("double").alias(k) for k in ("p", "r")], "f1")
    return per.unionByName(micro).unionByName(macro)


# --- sums ---


def corpus_counts(mentions: DataFrame, paper: str = "paper_id", url: str = "url") -> DataFrame:
    """``items, papers, urls``: rows, papers, and distinct addresses per paper summed over papers."""
    per = mentions.groupBy(paper).agg(F.count("*").alias("items"), F.count_distinct(url).alias("urls"))
    return per.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count("*").alias("papers"), F.coalesce(F.sum("urls"), F.lit(0)).alias("urls"))


def run_summary(items: DataFrame, papers: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Of a run over ``papers`` (``paper_id``): items and distinct addresses of every paper, those without any included, and the totals of the corpus."""
    per = papers.select("paper_id").distinct().join(items.groupBy("paper_id").agg(F.count("*").alias("items"), F.count_distinct(url).alias("urls")), "paper_id", "left")
    per = per.select("paper_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("urls", F.lit(0)).alias("urls"))
    totals = per.agg(F.count("*").alias("papers"), F.coalesce(F.sum((F.col("items") > 0).cast("long")), F.lit(0)).alias("papers_with_items"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("urls"), F.lit(0)).alias("urls"))
    return per, totals


def distinct_items(items: DataFrame, order: list[Column | str], sentence: str = "original_sentence", marker: str = "marker", urls: str = "urls", group: str = "pdf") -> DataFrame:
    """Items that two pages reported count once: the first of each pdf, sentence (as a key for matching), marker and set of addresses, whatever their case."""
    keys = [match_key(F.coalesce(F.col(sentence), F.lit(""))), F.lower(F.trim(F.coalesce(F.col(marker), F.lit("")))), F.array_sort(F.transform(F.coalesce(F.col(urls), F.array().cast("array<string>")), lambda u: F.lower(u)))]
    keyed = items.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    return first_by(keyed, [group, "_k0", "_k1", "_k2"], order).drop("_k0", "_k1", "_k2")


def first_by(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order: the reference's "first wins"."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
