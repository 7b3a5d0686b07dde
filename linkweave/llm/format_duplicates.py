"""Records that are the same but for white space, letter case, punctuation and field order.

Method: every record gets a 64-bit hash of its canonical form. The space of hashes is cut into ranges of at most ``RANGE_ROWS`` rows on
average. Each partition of the rows gives each range its Bloom filters of hashes seen once and seen repeatedly, as the list of the bits
set (8 bytes a distinct hash; no record is shuffled); in each range filters merge by ``repeated = r1 | r2 | (s1 & s2)`` and ``seen = s1 | s2``,
so that a hash that occurs twice has all its bits in the merged repeated filter. Whatever misses it is a singleton.

The possible repeats that the ranges report fill the filters that rows are held against. These are broadcast, of at most ``MAX_BITS`` bits
(64 MB) each, with ``BITS_A_HASH`` bits or more for every possible repeat: where the repeats need more than one, the rows are read once for each,
and every row is decided by the one its hash belongs to. So the filters are ample at every size. Singletons are emitted without a shuffle;
only the possible repeats are shuffled and grouped exactly, on the canonical values themselves.

Defined results: nulls are equal to nulls and to nothing else (an empty text isn't a null); texts of
punctuation only are equal to the empty text; wholly identical rows are copies; an empty table gives an empty
result; columns that aren't named don't count, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut

MAX_BITS = 1 << 29
SEGMENT_BITS = 1 << 19
BITS_A_HASH = 16
RANGE_ROWS = 4_000_000
LEAST_RANGES = 16
HOT = 512
#: Rows of one group that meet it in one task, and the least share of all rows of a group that is dealt out: there are at most 1 / HOT_SHARE of them.
TASK_ROWS = 200_000
HOT_SHARE = 0.001

#: White space, punctuation and symbols of all scripts.
IGNORED = r"[\p{Z}\p{P}\p{S}\t\n\x0B\f\r\x1C-\x1F\x85]+"


def canonical(c: Column) -> Column:
    """``c`` without white space, punctuation and letter case; null stays null."""
    return F.lower(F.regexp_replace(c, IGNORED, ""))


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u & np.uint64(bits - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _hit(h: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for p in _positions(h, bits):
        out &= (packed[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _power(n: float) -> int:
    """The least power of two from ``n`` on."""
    return 1 << max(0, int(np.ceil(n)) - 1).bit_length()


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(20)) & np.uint64(ranges - 1)).astype(np.int32)


_SPARSE = pa.schema([("range", pa.int32()), ("hashes", pa.binary()), ("often", pa.binary())])


def _filters_of_partition(ranges: int):
    """The filters of a partition, in sparse form: what sets their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not parts:
            return
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        at = _range(h, ranges)
        order = np.argsort(at, kind="stable")
        h, often, at = h[order], n[order] > 1, at[order]
        ends = np.searchsorted(at, np.arange(ranges + 1))
        for k in range(ranges):
            a, b = ends[k], ends[k + 1]
            if b > a:
                yield pa.RecordBatch.from_pydict({"range": [k], "hashes": [h[a:b].tobytes()], "often": [np.packbits(often[a:b], bitorder="little").tobytes()]}, schema=_SPARSE)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The possible repeats of a range by its merged filters."""
    parts = [np.frombuffer(x, np.int64) for x in pdf["hashes"]]
    bits = _power(max(1 << 10, BITS_A_HASH * sum(map(len, parts))))
    seen, repeated = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
    for h, o in zip(parts, pdf["often"]):
        often = np.unpackbits(np.frombuffer(o, np.uint8), count=len(h), bitorder="little").astype(bool)
        places = _positions(h, bits)
        for p in places:
            repeated[p[often]] = True
        here = np.unique(np.concatenate(places))
        repeated[here[seen[here]]] = True
        seen[here] = True
    packed = np.packbits(repeated, bitorder="little")
    found = [h[_hit(h, packed, bits)] for h in parts]
    return pd.DataFrame({"h": np.unique(np.concatenate(found))})


def possible_hashes(hashes: DataFrame, rows: int) -> DataFrame:
    """``h``, written: the hashes in the one bigint column of ``hashes`` that may occur more than once."""
    ranges = _power(max(LEAST_RANGES, rows / RANGE_ROWS))
    sparse = hashes.mapInArrow(_filters_of_partition(ranges), "range int, hashes binary, often binary")
    return cut(sparse.groupBy("range").applyInPandas(_merge, "h long"), "p1-repeats")


def repeated_filters(hashes: DataFrame, rows: int, max_bits: int = MAX_BITS) -> list[tuple[bytes, int]]:
    """The filters of the possible repeats among ``hashes``."""
    return hash_filters(possible_hashes(hashes, rows), max_bits)


def hash_filters(found: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[bytes, int]]:
    """Bloom filters of the bigint column of ``found``, with their bits; hash ``h`` belongs to that of number ``lane_of(h, len(filters))``."""
    n = found.count()
    lanes = _power(n * BITS_A_HASH / max_bits)
    bits = min(max_bits, _power(max(1 << 13, BITS_A_HASH * n / lanes)))
    size = min(bits, SEGMENT_BITS) // 8

    def fill(lane: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mask = np.zeros(bits, dtype=bool)
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False)
                for p in _positions(h[lane_of(h, lanes) == lane], bits):
                    mask[p] = True
            packed = np.packbits(mask, bitorder="little")
            for k in range(0, len(packed), size):
                if packed[k : k + size].any():
                    yield pa.RecordBatch.from_pydict({"segment": [k // size], "bitmap": [packed[k : k + size].tobytes()]}, schema=_SEGMENT)

        return run

    tasks = max(1, min(64, n // 1_000_000))
    out = []
    for lane in range(lanes):
        merged = found.coalesce(tasks).mapInArrow(fill(lane), "segment int, bitmap binary").groupBy("segment").applyInPandas(_or, "segment int, bitmap binary")
        bitmap = bytearray(bits // 8)
        for r in merged.collect():  # at most max_bits in all
            bitmap[r["segment"] * size : r["segment"] * size + len(r["bitmap"])] = r["bitmap"]
        out.append((bytes(bitmap), bits))
    return out


_SEGMENT = pa.schema([("segment", pa.int32()), ("bitmap", pa.binary())])


def _or(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bitmap"]])
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "bitmap": [out.tobytes()]})


def lane_of(h: np.ndarray, lanes: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(52)) & np.uint64(lanes - 1)


def _with_keys(df: DataFrame, id_col: str, unordered: Sequence[str], exact: Sequence[str]) -> DataFrame:
    forms = F.array_sort(F.array(*[F.coalesce(canonical(F.col(c).cast("string")), F.lit("\u0000")) for c in unordered])) if unordered else F.array().cast("array<string>")
    kept = df.select(F.col(id_col).alias("_id"), forms.alias("_forms"), *[F.col(c).alias(f"_x{k}") for k, c in enumerate(exact)])
    keys = ["_forms", *[f"_x{k}" for k in range(len(exact))]]
    return kept.withColumn("_h", F.xxhash64(*keys))


def _against(held, bits: int):
    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(_hit(h.to_numpy(np.int64), np.frombuffer(held.value, np.uint8), bits))

    return maybe


def held_against(df: DataFrame, hash_col: str, filters: list[tuple[bytes, int]], flag: str = "_maybe") -> DataFrame:
    """All rows with ``flag``: false where the row's hash is surely in none of the filters."""
    lanes = len(filters)
    parts = []
    for k, (bitmap, bits) in enumerate(filters):
        held = df.sparkSession.sparkContext.broadcast(bitmap)
        mine = df if lanes == 1 else df.filter(F.shiftrightunsigned(hash_col, 52).bitwiseAND(lanes - 1) == k)
        parts.append(mine.withColumn(flag, _against(held, bits)(hash_col)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def possible_repeats(df: DataFrame, id_col: str, unordered: Sequence[str], exact: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """All rows with their canonical keys and ``_maybe``: false where the row is surely a singleton."""
    keyed = _with_keys(df, id_col, unordered, exact)
    return held_against(keyed, "_h", repeated_filters(keyed.select("_h"), df.count(), max_bits))


def copy_groups(df: DataFrame, id_col: str, unordered: Sequence[str], exact: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """``id, group_id, n_copies`` of every row that has copies; ``group_id`` is the smallest id of the group.

    The rows of a group of more than HOT_SHARE of all rows meet it in as many places as it takes for TASK_ROWS in each.
    """
    keys = ["_forms", *[f"_x{k}" for k in range(len(exact))]]
    maybe = cut(possible_repeats(df, id_col, unordered, exact, max_bits).filter("_maybe").drop("_maybe"), "p1-maybe")
    groups = cut(maybe.groupBy("_h", *keys).agg(F.min("_id").alias("group_id"), F.count("*").alias("n_copies")).filter("n_copies > 1"), "p1-counted")
    least = max(TASK_ROWS, int(maybe.count() * HOT_SHARE))
    salts = F.ceil(F.col("n_copies") / F.lit(TASK_ROWS)).cast("int")
    hot = F.broadcast(groups.filter(F.col("n_copies") > least).groupBy("_h").agg(F.max(salts).alias("_salts")))  # at most 1 / HOT_SHARE rows
    salted = maybe.join(hot, "_h", "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = groups.join(hot, "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    a, b = salted.alias("a"), spread.alias("b")
    same = (F.col("a._h") == F.col("b._h")) & (F.col("a._salt") == F.col("b._salt"))
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(F.col("a._id").alias("id"), "group_id", "n_copies")


def copy_pairs(df: DataFrame, id_col: str, unordered: Sequence[str], exact: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of all pairs of copies. Use it only where all pairs are wanted.

    The rows of a group of more than HOT copies are dealt into blocks; every block meets the whole group in a task of its own.
    """
    g = cut(copy_groups(df, id_col, unordered, exact, max_bits), "p1-groups")
    blocks = F.ceil(F.col("n_copies") / F.lit(HOT)).cast("int")
    a = g.select(F.col("id").alias("id_a"), "group_id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    b = g.select(F.col("id").alias("id_b"), "group_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return a.join(b, ["group_id", "block"]).filter("id_a < id_b").select("id_a", "id_b")


def collapse(df: DataFrame, id_col: str, unordered: Sequence[str], exact: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """One row per record: ``id`` (the smallest of its copies) and ``n_copies``; singletons aren't shuffled."""
    keys = ["_forms", *[f"_x{k}" for k in range(len(exact))]]
    flagged = possible_repeats(df, id_col, unordered, exact, max_bits)
    single = flagged.filter(~F.col("_maybe")).select(F.col("_id").alias("id"), F.lit(1).cast("long").alias("n_copies"))
    grouped = flagged.filter("_maybe").groupBy("_h", *keys).agg(F.min("_id").alias("id"), F.count("*").alias("n_copies")).select("id", "n_copies")
    return single.unionByName(grouped)
