"""Pairing of predicted with gold records: collapsing, candidate edges, and maximum one-to-one assignment.

Records meet only where they share a paper and a canonical address (an equi-join); sentences are compared behind a bound
from their lengths. What must run in order runs in Python, a paper at a time; of a paper with more than SMALL rows or edges, a connected
component at a time, so that a paper with a third of all rows is as many tasks as it has components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.similarity import indel_ratio, ratio, ratio_bound
from linkweave.operators.graph import components
from linkweave.session import cut

THRESHOLD = 80.0
SKELETON_THRESHOLD = 97.0
#: Papers of up to that many rows, or edges, are one task.
SMALL = 1000


def collapse(rows: DataFrame, group: list[str], ix: str = "ix", firsts: tuple[str, ...] = (), filled: tuple[str, ...] = (), urls: str = "urls") -> DataFrame:
    """One row per ``group``: the union of ``urls``, the first row's ``firsts`` and the first non-empty ``filled``; ``ix`` the smallest."""
    aggs = [F.min(ix).alias(ix)]
    aggs += [F.min_by(c, ix).alias(c) for c in firsts]
    aggs += [F.coalesce(F.min_by(c, F.when(F.trim(c) != "", F.col(ix))), F.lit("")).alias(c) for c in filled]
    # addresses are made distinct before they are gathered: a group may be a third of all rows
    sets = rows.select(*group, F.explode(urls).alias("_u")).distinct().groupBy(*group).agg(F.array_sort(F.collect_list("_u")).alias(urls))
    none = F.array().cast("array<string>")
    return rows.groupBy(*group).agg(*aggs).join(sets, group, "left").withColumn(urls, F.coalesce(urls, none))


def _longest(length: Column, threshold: float) -> Column:
    """The length of the longest text whose ratio with one of ``length`` can reach the threshold."""
    return F.floor(length * (200.0 - threshold) / threshold + 1e-9).cast("int")


def near_texts(texts: DataFrame, group: str, text: str, threshold: float = SKELETON_THRESHOLD, marked: str | None = None) -> DataFrame:
    """``group, a, b``: all pairs of different texts of one group (``group, text``, distinct) whose indel ratio reaches the threshold; with ``marked``, those of which one at least is.

    A text of length n that takes at most d insertions and deletions to become another keeps one of d + 1 pieces whole, moved by as many places as
    characters came or went before it. Shorter texts are looked up by their pieces, longer ones by all places a piece may have moved to: an equi-join, exact.
    """
    part = 1.0 - threshold / 100.0
    mark = F.col(marked) if marked else F.lit(True)
    t = texts.select(F.col(group).alias("grp"), F.col(text).alias("t"), mark.alias("mark")).filter("t <> ''").withColumn("n", F.length("t"))
    most = lambda n: F.floor((n + _longest(n, threshold)) * part + 1e-9).cast("int")
    pieces = t.withColumn("k", most(F.col("n")) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    index = pieces.select("grp", "n", "i", F.xxhash64(F.expr("substring(t, cast(floor(i * n / k) as int) + 1, cast(floor((i + 1) * n / k) as int) - cast(floor(i * n / k) as int))")).alias("h"), F.col("t").alias("a"), "mark")
    probes = t.withColumnRenamed("n", "m").withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("m") * threshold / (200.0 - threshold) - 1e-9).cast("int")), F.col("m"))))
    probes = probes.withColumn("k", most(F.col("n")) + 1).withColumn("d", F.floor((F.col("m") + F.col("n")) * part + 1e-9).cast("int")).filter("m - n <= d")
    probes = probes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    probes = probes.withColumn("s", F.expr("cast(floor(i * n / k) as int)")).withColumn("z", F.expr("cast(floor((i + 1) * n / k) as int) - s"))
    probes = probes.withColumn("at", F.explode(F.expr("sequence(s - cast(floor((d - (m - n)) / 2) as int), s + cast(floor((d + m - n) / 2) as int))"))).filter("at >= 0 and at + z <= m")
    probes = probes.select("grp", "n", "i", F.xxhash64(F.expr("substring(t, at + 1, z)")).alias("h"), F.col("t").alias("b"), "mark")
    met = lambda x, y: x.drop("mark").join(y.drop("mark"), ["grp", "n", "i", "h"])
    both = met(index.filter("mark"), probes).unionByName(met(index.filter("not mark"), probes.filter("mark"))) if marked else met(index, probes)
    pairs = both.filter("a <> b").select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = cut(pairs.filter(ratio_bound(F.col("a"), F.col("b")) >= threshold), "near").withColumn("sim", indel_ratio(F.col("a"), F.col("b")))
    return near.filter(F.col("sim") >= threshold).select(F.col("grp").alias(group), "a", "b")


def _merge_blocks(large: DataFrame, threshold: float) -> DataFrame:
    """``large`` with ``block``, so that rows which the merge can bring together are in one.

    Two rows with addresses come together only where these hang together through rows of their paper, so that most blocks are such sets of addresses.
    Similarity is asked for only within sets of more than SMALL rows, and of rows without addresses, which may meet any row of their paper.
    """
    key = lambda u: F.xxhash64("paper_id", u)
    several = large.filter("size(urls) > 1").select(key(F.col("urls")[0]).alias("a"), "paper_id", F.explode(F.slice("urls", 2, F.size("urls") - 1)).alias("u"))
    linked = components(several.select("a", key(F.col("u")).alias("b")))
    sets = large.withColumn("node", F.when(F.size("urls") > 0, key(F.get("urls", F.lit(0))))).join(linked, "node", "left").withColumn("cell", F.coalesce("component", "node")).drop("node", "component")
    sets = cut(sets, "address-sets")
    many = sets.filter("cell is not null").groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > SMALL).select("cell", F.lit(True).alias("many"))
    bare = sets.filter("cell is null").select("paper_id").distinct()
    has_many, has_bare = not many.isEmpty(), not bare.isEmpty()
    if not has_many and not has_bare:
        return sets.withColumnRenamed("cell", "block")
    said = F.xxhash64(F.lit("said"), "paper_id", "skeleton")
    nodes = sets.join(many, "cell", "left").withColumn("node", F.when(F.col("cell").isNull(), said).when(F.col("many"), F.xxhash64("cell", "skeleton")).otherwise(F.col("cell")))
    nodes = cut(nodes, "nodes")
    edges = []
    if has_many:
        near = near_texts(nodes.filter("many").select("cell", "skeleton").distinct(), "cell", "skeleton", threshold)
        edges.append(near.select(F.xxhash64("cell", "a").alias("a"), F.xxhash64("cell", "b").alias("b")))
    if has_bare:
        texts = nodes.join(bare, "paper_id", "left_semi").groupBy("paper_id", "skeleton").agg(F.max(F.col("cell").isNull()).alias("bare"))
        near = cut(near_texts(texts, "paper_id", "skeleton", threshold, "bare"), "near-bare")
        met = near.select("paper_id", F.col("a").alias("skeleton")).unionByName(near.select("paper_id", F.col("b").alias("skeleton"))).unionByName(texts.filter("bare").select("paper_id", "skeleton")).distinct()
        edges.append(near.select(F.xxhash64(F.lit("said"), "paper_id", "a").alias("a"), F.xxhash64(F.lit("said"), "paper_id", "b").alias("b")))
        # a sentence that a row without addresses meets brings all rows that say it together
        edges.append(nodes.join(met, ["paper_id", "skeleton"]).select(said.alias("a"), F.col("node").alias("b")))
    all_ = edges[0]
    for e in edges[1:]:
        all_ = all_.unionByName(e)
    return nodes.join(components(all_), "node", "left").withColumn("block", F.coalesce("component", "node")).drop("node", "component", "cell", "many")


def skeleton_merge(rows: DataFrame, threshold: float = SKELETON_THRESHOLD) -> DataFrame:
    """Near-duplicate gold rows merged greedily, in the order of ``ix``: rows ``ix, paper_id, urls, target_raw, target_norm, skeleton``.

    A row absorbs later ones of its paper whose skeleton is as good as equal and whose addresses overlap those gathered
    so far, or are none. The fold is sequential, but only rows with near skeletons and addresses that hang together can meet: a paper of more
    than SMALL rows is folded by blocks of such rows. The representative has the most addresses, then the longest sentence, then comes first.
    """
    n = rows.groupBy("paper_id").agg((F.count("*") > SMALL).alias("_large"))
    sized = cut(rows.select("ix", "paper_id", "urls", "target_raw", "target_norm", "skeleton").join(n, "paper_id"), "to-merge")
    cols = ("block", "paper_id", "ix", "urls", "target_raw", "target_norm", "skeleton")
    blocks = sized.filter("not _large").withColumn("block", F.xxhash64("paper_id")).select(*cols).unionByName(_merge_blocks(sized.filter("_large"), threshold).select(*cols))
    kind = dict(rows.dtypes)["ix"]
    long = {"int": pa.int32(), "bigint": pa.int64()}[kind]
    schema = pa.schema([("ix", long), ("paper_id", pa.string()), ("urls", pa.list_(pa.string())), ("target_raw", pa.string()), ("target_norm", pa.string()), ("skeleton", pa.string()), ("merged", pa.list_(long))])

    def fold(recs: list[dict]) -> Iterator[tuple]:
        known: dict[tuple[str, str], bool] = {}

        def alike(a: str, b: str) -> bool:
            if a == b:
                return True
            if min(len(a), len(b)) * 200.0 < threshold * (len(a) + len(b)):
                return False
            key = (a, b)
            if key not in known:
                known[key] = ratio(a, b) >= threshold
            return known[key]

        for r in recs:
            r["set"] = set(r["urls"])
        left = recs
        while left:
            base, group, urls, rest = left[0], [left[0]], set(left[0]["set"]), []
            for r in left[1:]:
                if (not urls or not r["set"] or not urls.isdisjoint(r["set"])) and alike(base["skeleton"], r["skeleton"]):
                    group.append(r)
                    urls |= r["set"]
                else:
                    rest.append(r)
            rep = max(group, key=lambda r: (len(r["set"]), len(r["target_raw"])))
            yield (rep["ix"], rep["paper_id"], sorted(urls), rep["target_raw"], rep["target_norm"], rep["skeleton"], [g["ix"] for g in group])
            left = rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task block by block, as they are sorted; no more than a block and a batch is held."""
        out: list[tuple] = []
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, recs in groupby(rows, key=lambda r: (r["block"], r["paper_id"])):
            out.extend(fold(list(recs)))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = blocks.repartition("block").sortWithinPartitions("block", "paper_id", "ix")
    return ordered.mapInArrow(run, f"ix {kind}, paper_id string, urls array<string>, target_raw string, target_norm string, skeleton string, merged array<{kind}>")


def candidate_edges(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD, on: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """``on, g, p, shared, sim`` of all pairs that share an address and are similar enough. Both sides have ``ix, urls, target_norm``."""
    side = lambda d, ix, text, urls: d.select(*on, F.col("ix").alias(ix), F.col("target_norm").alias(text), F.array_compact(F.array_distinct("urls")).alias(urls)).withColumn("u", F.explode(urls))
    both = F.array_intersect("gu", "pu")
    # of the addresses that two rows share, the smallest pairs them: texts are shuffled once
    pairs = side(gold, "g", "gt", "gu").join(side(pred, "p", "pt", "pu"), [*on, "u"]).filter((F.col("u") == F.array_min(both)) & (ratio_bound(F.col("gt"), F.col("pt")) >= threshold))
    return cut(pairs.select(*on, "g", "p", F.size(both).cast("long").alias("shared"), indel_ratio(F.col("gt"), F.col("pt")).alias("sim")), "edges").filter(F.col("sim") >= threshold)


def maximum_matching(edges: list[tuple[int, int, int, float]], by_shared: bool = True) -> list[tuple[int, int]]:
    """A maximum one-to-one assignment of the edges ``gold, pred, shared, sim``, golds and edges taken in the evaluators' order."""
    near: dict[int, list[tuple]] = {}
    for g, p, shared, sim in edges:
        near.setdefault(g, []).append(((-shared, -sim, p) if by_shared else (-sim, p), p))
    for v in near.values():
        v.sort()
    best = {g: v[0][0] for g, v in near.items()}
    order = sorted(near, key=lambda g: (len(near[g]), *(best[g][:2] if by_shared else ()), g))
    of_gold: dict[int, int] = {}
    of_pred: dict[int, int] = {}
    for start in order:
        parent: dict[int, int] = {}
        stack = [(start, iter(near[start]))]
        end = None
        while stack and end is None:
            g, rest = stack[-1]
            for _, p in rest:
                if p in parent:
                    continue
                parent[p] = g
                if p in of_pred:
                    stack.append((of_pred[p], iter(near[of_pred[p]])))
                else:
                    end = p
                break
            else:
                stack.pop()
        while end is not None:  # flip the path
            g = parent[end]
            before = of_gold.get(g)
            of_gold[g], of_pred[end] = end, g
            end = before
    return sorted(of_gold.items())


def match_edges(edges: DataFrame, by_shared: bool = True, on: tuple[str, ...] = ("loc", "paper_id")) -> DataFrame:
    """``g, p`` of a maximum assignment of ``g, p, shared, sim`` (ids unique over all papers), by the groups ``on`` that the edges have."""
    keys = [c for c in on if c in edges.columns]
    e = cut(edges.select("g", "p", "shared", "sim", F.xxhash64(*keys).alias("grp") if keys else F.lit(0).cast("long").alias("grp")), "to-match")
    dg = e.groupBy("g").agg(F.count("*").alias("ng"))
    dp = e.groupBy("p").agg(F.count("*").alias("np"))
    d = cut(e.join(dg, "g").join(dp, "p"), "degrees")
    # an edge alone on both sides is matched; the rest goes by group, and in large groups by component
    sure = d.filter("ng = 1 and np = 1").select("g", "p")
    rest = d.filter("ng > 1 or np > 1").select("grp", "g", "p", "shared", "sim")
    large = rest.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > (SMALL if keys else 0)).select("grp", F.lit(True).alias("large"))
    rest = cut(rest.join(large, "grp", "left"), "rest")
    comp = components(rest.filter("large").select(F.concat(F.lit("g"), "g").alias("a"), F.concat(F.lit("p"), "p").alias("b")))
    placed = rest.filter("large").withColumn("node", F.concat(F.lit("g"), "g")).join(comp, "node").select(F.col("component").alias("block"), "g", "p", "shared", "sim")
    placed = placed.unionByName(rest.filter("large is null").select(F.col("grp").cast("string").alias("block"), "g", "p", "shared", "sim"))
    types = dict(e.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of a task block by block, as they are sorted."""
        got: list[tuple] = []
        kinds: list[pa.DataType] = []

        def each() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(c).type for c in ("g", "p")]
                yield from zip(*(batch.column(c).to_pylist() for c in ("block", "g", "p", "shared", "sim")))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kinds[i]) for i in (0, 1)], names=["g", "p"])

        for _, block in groupby(each(), key=lambda r: r[0]):
            got += maximum_matching([r[1:] for r in block], by_shared)
            if len(got) >= 5000:
                yield made()
                got = []
        if got:
            yield made()

    matched = placed.repartition("block").sortWithinPartitions("block").mapInArrow(run, f"g {types['g']}, p {types['p']}")
    return sure.unionByName(matched)
