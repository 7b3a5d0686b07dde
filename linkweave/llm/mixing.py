"""Mixing of sources to target shares of the total size, with capped repeats.

Method: pivotal dependent rounding. A source's rate is the target size over its own size, at most its cap; a text
is taken the whole number of times, and once more with the probability of the fraction. The fractions of a source are
rounded together: two of them meet, and mass moves at random from one to the other until one is integral, so that the
number of copies of a source hits its sum, and sizes are far closer to their targets than with independent draws.
Texts meet within blocks of bounded size (a hash of source and id); what a block leaves undecided, one text at most,
goes up a reduction tree of fan-in ``FAN_IN`` until a source's last text is decided. No task holds more than a block,
however large a source.

Sizes are tokens of a public tokenizer. The same text in several documents of a source is one text: only the document of
the smallest id is drawn, so that no text is used more than the cap. The mixture's size is the sum of all documents, so
a source is held back where the mixture has every text of it as often as it may and that isn't its target share, though all its documents be counted.

Defined results: null and empty texts have no tokens and are never drawn (0 copies); documents of a null or unknown
source have no target and get none; a target for a source without documents is reported with share 0; results are
the same in every run and on every cluster, for a given seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.encoding import VOCABULARY, count_tokens
from linkweave.session import cut

BLOCK = 20_000
FAN_IN = 32
TOLERANCE = 1e-9


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str = VOCABULARY) -> DataFrame:
    """``id, source, tokens, lead``, written: the size of every document, and whether it is the first of its text in its source."""
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(text_col).alias("same"), F.col(text_col).alias("text"))
    counted = cut(count_tokens(d, "id", "text", path, keep=("source", "same")), "p8-sizes")
    first = counted.filter("same is not null").groupBy("source", "same").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("lead"))
    return cut(counted.join(first, "id", "left").select("id", "source", "tokens", F.coalesce("lead", F.lit(False)).alias("lead")), "p8-leads")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).alias("distinct_tokens"), F.count("*").alias("n"))


def _total(by: DataFrame) -> int:
    return by.agg(F.sum("tokens")).first()[0] or 0


def _pivot(ids: np.ndarray, p: np.ndarray, seed: int, last: bool) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` in order; returns 0, 1 or -1 (undecided) for each, and the undecided index or -1."""
    out = np.full(len(p), -1, dtype=np.int8)
    draw = np.random.default_rng([seed, len(p), int(ids[0]) & 0xFFFFFFFF]).random(len(p) + 1)
    held, mass = -1, 0.0
    for i, q in enumerate(p):
        if q <= TOLERANCE or q >= 1 - TOLERANCE:
            out[i] = int(q > 0.5)
            continue
        if held < 0:
            held, mass = i, q
            continue
        total = mass + q
        if total < 1 - TOLERANCE:
            if draw[i] < q / total:
                out[held], held = 0, i
            else:
                out[i] = 0
            mass = total
        elif total > 1 + TOLERANCE:
            if draw[i] < (1 - q) / (2 - total):
                out[held], held = 1, i
            else:
                out[i] = 1
            mass = total - 1
        else:
            win = draw[i] < q
            out[held], out[i], held = int(not win), int(win), -1
    if held >= 0:
        p[held] = mass
        if last:
            out[held] = int(draw[-1] < mass)
            held = -1
    return out, held


def round_fractions(df: DataFrame, seed: int = 0) -> DataFrame:
    """``id, extra`` (0 or 1) for rows ``id long, grp string, p double, size long``: dependent rounding within every ``grp``.

    Rows meet in the order of their sizes, so that mass moves between rows of nearly the same size.
    """
    most = df.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = 1
    while blocks * BLOCK < most:
        blocks *= FAN_IN
    open_ = df.select("id", "grp", "p", "size", F.pmod(F.xxhash64("grp", "id", F.lit(seed)), F.lit(blocks)).cast("long").alias("block"))
    decided = []
    while True:
        last = blocks == 1

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "id"], kind="stable").reset_index(drop=True)
            p = pdf["p"].to_numpy(dtype=float).copy()
            out, _ = _pivot(pdf["id"].to_numpy(dtype=np.int64), p, seed, last)
            return pdf.assign(p=p, extra=out.astype(np.int32))

        done = cut(open_.groupBy("grp", "block").applyInPandas(settle, "id long, grp string, p double, size long, block long, extra int"), "p8-settled")
        decided.append(done.filter("extra >= 0").select("id", "extra"))
        if last:
            break
        blocks //= FAN_IN
        open_ = done.filter("extra < 0").select("id", "grp", "p", "size", (F.col("block") % blocks).alias("block"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``id, source, tokens, lead, copies`` of every document: how often the mixture has it, and whether it is the first of its text."""
    by = cut(source_sizes(sized), "p8-by-source")
    rates = targets.join(by, "source").select("source", F.least(F.col("target_share") * F.lit(float(_total(by))) / F.nullif("distinct_tokens", F.lit(0)), F.col("max_repeats").cast("double")).alias("rate"))
    rated = cut(sized.join(rates, "source", "left").withColumn("rate", F.when(F.col("lead") & (F.col("tokens") > 0), F.coalesce("rate", F.lit(0.0))).otherwise(0.0)), "p8-rated")
    whole = F.floor(F.col("rate") + TOLERANCE)
    extra = round_fractions(rated.filter(F.col("rate") > 0).select(F.col("id").cast("long").alias("id"), F.col("source").alias("grp"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), F.col("tokens").cast("long").alias("size")), seed)
    return rated.join(extra, "id", "left").select("id", "source", "tokens", "lead", (whole + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What the mixture really has of each source: ``source, target_share, reachable_share, actual_share, tokens_used, used_up, held_back``.

    A source is used up where every text of it stands in the mixture as often as it may and its target share isn't reached.
    It is held back by its cap if this would be so even with all copies of its texts counted; otherwise it is short because its texts repeat.
    ``reachable_share`` is what the caps leave of the target share. Shares but the actual one are of the tokens of all documents.
    """
    tokens, copies, drawn = F.col("tokens"), F.col("copies"), F.col("lead") & (F.col("tokens") > 0)
    used = mixed.groupBy("source").agg(F.sum(copies * tokens).alias("used"), F.sum("tokens").alias("own"), F.sum(F.when(drawn, tokens).otherwise(0)).alias("distinct"), F.min(F.when(drawn, copies)).alias("least"))
    used = cut(used, "p8-used")
    total = used.agg(F.sum("used"), F.sum("own")).first()
    all_used, all_own = float(total[0] or 0), float(total[1] or 0)
    t = targets.join(used, "source", "left").fillna(0, ["used", "own", "distinct"])
    wanted = F.col("target_share") * F.lit(all_own)
    used_up = (F.col("used") < wanted) & (F.col("least").isNull() | (F.col("least") >= F.col("max_repeats")))
    return t.select(
        "source",
        "target_share",
        (F.least(wanted, F.col("max_repeats") * F.col("distinct").cast("double")) / F.lit(max(1.0, all_own))).alias("reachable_share"),
        (F.col("used") / F.lit(max(1.0, all_used))).alias("actual_share"),
        F.col("used").alias("tokens_used"),
        used_up.alias("used_up"),
        (used_up & (wanted > F.col("max_repeats") * F.col("own"))).alias("held_back"),
    )
