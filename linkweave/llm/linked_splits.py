"""Train, validation and test splits that keep related records together.

Records are related if they share an entity (here a paper or a source file), directly or through others.
Method: a persisted table ``node, component, split, status, n`` (``n``: the rows that name the node first). A batch reads of it the components
its nodes belong to, contracts their graph by hooking every node to its smallest neighbour and pointer jumping,
and relabels: existing components keep their split, merges of components with different splits are
quarantined and stay so in all later batches until ``released``, new components fill the deficits of the whole corpus, all batches so far, against the
target shares. Components that a batch doesn't meet go on as they are.

Graph tables hold a row per distinct (paper, file), not per record; every round is written to the shared
folder. Nothing that grows with the data reaches the driver or a broadcast.

Defined results: a record without any entity is a component of its own; null and unknown splits don't count;
case and blanks of splits don't matter; an empty table gives empty tables; repeated rows count as rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import cut

SPLITS = ("train", "validation", "test")
#: Components of more than this share of the rows are dealt out one by one: there are at most 1 / BIG_SHARE of them.
BIG_SHARE = 0.001


def plain_paper_id(*columns: str) -> Column:
    """The id ``PMC`` and 8 digits, however spelled, in whichever of ``columns`` it stands; null if in none."""
    found = []
    for c in columns:
        s = F.upper(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", ""))
        found.append(F.when(s.rlike(r"^PMC[0-9]{8}$"), s))
    return F.coalesce(*found)


def plain_split(c: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    return F.when(s.isin(*SPLITS), s)


def _contract(edges: DataFrame) -> list[DataFrame]:
    """Maps ``node -> parent`` of each round; following them all leads every node to one node of its component."""
    maps: list[DataFrame] = []
    edges = cut(edges, "p2-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        hooked = cut(hooked, "p2-hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut(hooked.join(up, "parent").select("node", F.col("grand").alias("parent")), "p2-jumped")
        maps.append(parents)
        pa, pb = parents.select(F.col("node").alias("a"), F.col("parent").alias("x")), parents.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        left = edges.join(pa, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = cut(left, "p2-edges")
    return maps


def _follow(nodes: DataFrame, maps: Sequence[DataFrame]) -> DataFrame:
    """``node, component`` for the distinct ``node`` of ``nodes``, whose labels so far are in ``component``."""
    out = nodes
    for k, m in enumerate(maps):
        step = m.select(F.col("node").alias("component"), F.col("parent").alias(f"_p{k}"))
        out = out.join(step, "component", "left").select("node", F.coalesce(f"_p{k}", "component").alias("component"))
    return out


def entity_facts(rows: DataFrame, paper_cols: Sequence[str], file_col: str, split_col: str) -> DataFrame:
    """``paper, file, split, n``: the distinct facts about entities, counted before anything is shuffled by an entity."""
    return (
        rows.select(plain_paper_id(*paper_cols).alias("paper"), F.col(file_col).alias("file"), plain_split(F.col(split_col)).alias("split"))
        .groupBy("paper", "file", "split")
        .agg(F.count("*").alias("n"))
    )


def _paper_node() -> Column:
    return F.concat(F.lit("p:"), F.col("paper"))


def _file_node() -> Column:
    return F.concat(F.lit("f:"), F.col("file"))


def _nodes(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode(F.array_compact(F.array(_paper_node(), _file_node()))).alias("node")).distinct()


def components(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` of all entities of ``facts`` and of ``known`` (same columns), whose components are carried on and merged where ``facts`` link them."""
    nodes = _nodes(facts)
    if known is not None:
        nodes = nodes.join(known.select("node", "component"), "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    else:
        nodes = nodes.select("node", F.col("node").alias("component"))
    nodes = cut(nodes, "p2-nodes")
    edges = facts.filter("paper is not null and file is not null").select(_paper_node().alias("a"), _file_node().alias("b")).distinct()
    if known is not None:
        la, lb = nodes.select(F.col("node").alias("a"), F.col("component").alias("x")), nodes.select(F.col("node").alias("b"), F.col("component").alias("y"))
        edges = edges.join(la, "a").join(lb, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return cut(_follow(nodes, _contract(edges)), "p2-components")


def _of_component(facts: DataFrame, comps: DataFrame) -> DataFrame:
    node = F.coalesce(_paper_node(), _file_node())
    return facts.withColumn("node", node).join(comps.select("node", "component"), "node")


def torn_papers(facts: DataFrame, comps: DataFrame) -> DataFrame:
    """``paper_id`` of every paper whose component carries more than one split."""
    placed = cut(_of_component(facts, comps).select("component", "paper", "split").distinct(), "p2-placed")
    torn = placed.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("component")
    return placed.filter("paper is not null").join(torn, "component", "left_semi").select(F.col("paper").alias("paper_id")).distinct()


def component_splits(facts: DataFrame, comps: DataFrame, targets: DataFrame, known: DataFrame | None = None, settled: dict[str, int] | None = None) -> DataFrame:
    """``component, split, status`` with status kept, new or quarantined (split null).

    ``known`` holds the rows of the earlier table whose components the batch meets, ``settled`` the rows by split of all other components.
    New components take the splits whose rows are furthest below target: large ones one by one, the rest by where
    their rows fall in the running total over all new components, in hash order, against the deficits. The running
    total is taken over 4096 hash ranges, of which only the totals are gathered.
    """
    spark = facts.sparkSession
    own = _of_component(facts, comps).groupBy("component").agg(F.sum("n").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    if known is not None:
        prior = known.select("node", F.col("split").alias("was"), (F.col("status") == "quarantined").alias("held"), F.col("n").alias("had")).join(comps, "node")
        prior = prior.groupBy("component").agg(F.min("was").alias("plo"), F.max("was").alias("phi"), F.max("held").alias("held"), F.sum("had").alias("had"))
        own = own.join(prior, "component", "full_outer").select("component", (F.coalesce("n", F.lit(0)) + F.coalesce("had", F.lit(0))).alias("n"), F.least("lo", "plo").alias("lo"), F.greatest("hi", "phi").alias("hi"), F.coalesce("held", F.lit(False)).alias("held"))
    else:
        own = own.withColumn("held", F.lit(False))
    status = F.when(F.col("held"), "quarantined").when(F.col("lo").isNull(), "new").when(F.col("lo") == F.col("hi"), "kept").otherwise("quarantined")
    own = cut(own.withColumn("status", status), "p2-own")
    kept = own.filter("status <> 'new'").select("component", F.when(F.col("status") == "kept", F.col("lo")).alias("split"), "status")

    share = {r["split"]: r["target_share"] for r in targets.collect()}  # as many rows as splits
    counted = Counter(settled or {}) + Counter({r["lo"]: r["n"] for r in own.filter("status = 'kept'").groupBy("lo").agg(F.sum("n").alias("n")).collect()})
    total = sum(counted.values()) + (own.filter("status = 'new'").agg(F.sum("n")).first()[0] or 0)
    names = sorted(share, key=lambda s: (-share[s], s))
    lack = {s: max(0.0, share[s] * total - counted.get(s, 0)) for s in names}

    new = own.filter("status = 'new'").select("component", "n")
    least = max(1.0, BIG_SHARE * total)
    big = []
    for r in sorted(new.filter(F.col("n") > least).collect(), key=lambda r: (-r["n"], r["component"])):  # at most 1 / BIG_SHARE
        to = max(names, key=lambda s: (lack[s], share[s], s))
        lack[to] -= r["n"]
        big.append((r["component"], to, "new"))
    lack = {s: max(0.0, v) for s, v in lack.items()}
    if not sum(lack.values()):
        lack = dict(share)
    small = new.filter(F.col("n") <= least).withColumn("h", F.xxhash64("component")).withColumn("range", F.shiftrightunsigned("h", 52).cast("int"))
    totals = {r["range"]: r["n"] for r in small.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most 4096
    before, at = [], 0
    for k in sorted(totals):
        before.append((k, at))
        at += totals[k]
    start = spark.createDataFrame(before, "range int, before long")
    mid = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    placed = small.join(F.broadcast(start), "range").withColumn("mid", mid / F.lit(float(max(1, at))))
    to, cum = F.lit(names[-1]) if names else F.lit(None).cast("string"), sum(lack.values())
    for s in reversed(names[:-1]):
        cum -= lack[names[names.index(s) + 1]]
        to = F.when(F.col("mid") < cum / sum(lack.values()), s).otherwise(to)
    few = spark.createDataFrame(big, "component string, split string, status string")
    return kept.unionByName(placed.select("component", to.alias("split"), F.lit("new").alias("status"))).unionByName(few)


def released(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """The table with the components of ``decisions`` (``component, split``) out of quarantine, kept in the split decided on."""
    d = decisions.select("component", F.col("split").alias("_to"))
    held = (F.col("status") == "quarantined") & F.col("_to").isNotNull()
    return table.join(d, "component", "left").select("node", "component", F.when(held, F.col("_to")).otherwise(F.col("split")).alias("split"), F.when(held, "kept").otherwise(F.col("status")).alias("status"), "n")


def assign_splits(rows: DataFrame, id_col: str, targets: DataFrame, paper_cols: Sequence[str], file_col: str, split_col: str, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, component, split, status)`` of every row, and the component table to persist for the next batch.

    Rows without any entity are assigned alone, by the hash of their id, at the target shares.
    """
    facts = cut(entity_facts(rows, paper_cols, file_col, split_col).filter("paper is not null or file is not null"), "p2-facts")
    known = settled = rest = None
    if previous is not None:
        met = previous.join(_nodes(facts), "node", "left_semi").select("component").distinct()
        previous = previous.join(met.withColumn("_met", F.lit(True)), "component", "left")
        known = cut(previous.filter("_met").drop("_met"), "p2-known")
        rest = previous.filter("_met is null").select("node", "component", "split", "status", "n")
        settled = {r["split"]: r["n"] for r in rest.filter("split is not null").groupBy("split").agg(F.sum("n").alias("n")).collect()}  # as many as splits
    comps = components(facts, known)
    splits = cut(component_splits(facts, comps, targets, known, settled), "p2-splits")
    sizes = facts.groupBy(F.coalesce(_paper_node(), _file_node()).alias("node")).agg(F.sum("n").alias("n"))
    if known is not None:
        sizes = sizes.unionByName(known.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    table = comps.join(splits, "component").join(sizes, "node", "left").select("node", "component", "split", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    table = cut(table if rest is None else table.unionByName(rest), "p2-table")
    keyed = rows.select(F.col(id_col).alias("id"), plain_paper_id(*paper_cols).alias("paper"), F.col(file_col).alias("file"), plain_split(F.col(split_col)).alias("own"))
    keyed = keyed.withColumn("node", F.coalesce(_paper_node(), _file_node()))
    share = {r["split"]: r["target_share"] for r in targets.collect()}
    lone, cum = F.lit(None).cast("string"), 0.0
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    for s in sorted(share, key=lambda s: (-share[s], s)):
        lone = F.coalesce(lone, F.when(u < cum + share[s] + (1e-9 if cum + share[s] > 0.999999 else 0), s))
        cum += share[s]
    alone = keyed.filter("node is null").select("id", F.concat(F.lit("r:"), F.col("id").cast("string")).alias("component"), F.coalesce("own", lone).alias("split"), F.when(F.col("own").isNull(), "new").otherwise("kept").alias("status"))
    tied = keyed.filter("node is not null").join(table, "node").select("id", "component", "split", "status")
    return tied.unionByName(alone), table
