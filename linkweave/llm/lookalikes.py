"""One form for texts that look the same but hold different characters.

Method: the confusables skeleton. A text is decomposed, every character is replaced by the prototype of its
look-alikes, and the result is decomposed again; texts with equal skeletons read the same by eye. What the eye
can see stays: accents, raised and lowered digits, letter case, punctuation and ordinary white space.

The table is the public one of confusable characters, some 6,000 entries with their sequences, as the Unicode library that Spark brings along holds it.
Before it come rules from the Unicode database: characters that Unicode itself gives as another form of the same sign (full and half
width, mathematical fonts, ligatures, Roman numerals, special spaces and hyphens) follow from the
decomposition tags, invisible ones from their categories; and a list of letters, as the public table makes no difference between I, l and 1 or O and 0, and the eye
does. ASCII characters are their own prototypes. Of the table's punctuation only signs drawn the same count (slashes, colons, points and the like): dashes, quotation marks, dots in the middle and the ellipsis can be told apart.

Defined results: null stays null; the empty text is its own skeleton; texts of any length are taken whole; a
text of ASCII characters only is its own skeleton and never leaves the JVM. Pairs with equal values are no
case, whatever their number; an empty table gives no pairs.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkweave.llm.format_duplicates import hash_filters, held_against
from linkweave.session import cut

#: Rows of one form that are paired in one task.
HOT = 512

# Letters of other scripts that look like a Latin letter, by the letter they look like.
LOOK_ALIKES = {
    "A": "ΑАᎪᗅ", "B": "ΒВᏴᗷ", "C": "СϹᏟ", "D": "Ꭰᗞ", "E": "ΕЕᎬ", "F": "ϜᖴҒ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀᏆ", "J": "ЈᎫͿ",
    "K": "ΚКᏦ", "L": "ᏞᒪԼ", "M": "ΜМᎷϺ", "N": "ΝⲚ", "O": "ΟОՕⲞ", "P": "ΡРᏢ", "Q": "Ԛⵕ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ΤТᎢ",
    "U": "Սሀ", "V": "ѴᏙⴸ", "W": "ԜᎳ", "X": "ΧХⲬ", "Y": "ΥҮᎩ", "Z": "ΖᏃ",
    "a": "аɑα", "b": "ƄЬᖯ", "c": "сϲⲥ", "d": "ԁᏧɗ", "e": "еҽ", "f": "ꬵẝ", "g": "ɡᶃց", "h": "һհᏂ", "i": "іɩıι", "j": "јϳ",
    "k": "κкᴋ", "l": "ӏⲓǀ", "n": "ոռ", "o": "οоօσⲟᴏ", "p": "рρϱⲣ", "q": "ԛգզ", "r": "гᴦⲅ", "s": "ѕꜱƽ", "t": "τ", "u": "υսᴜʋ", "v": "νѵᴠ",
    "w": "ԝաᴡɯ", "x": "хᕁᕽ", "y": "уүɣᶌγ", "z": "ᴢ",
}
# Hyphens that look like the ordinary one.
HYPHENS = "‐‑⁃˗"
_KEPT_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>")


def _prototype(ch: str) -> str | None:
    """What replaces ``ch``, or None where it is its own prototype. ``ch`` is fully decomposed."""
    category = unicodedata.category(ch)
    if category == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️":
        return ""
    if category == "Zs":
        return " " if ch != " " else None
    if ch in HYPHENS:
        return "-"
    form = unicodedata.decomposition(ch)
    if form.startswith("<") and not form.startswith(_KEPT_TAGS):
        tag, _, codes = form.partition("> ")
        out = "".join(chr(int(x, 16)) for x in codes.split())
        # a compatibility form counts where it is drawn alike: width, font, presentation and ligature forms of letters and spaces
        if tag in ("<wide", "<narrow", "<font", "<initial", "<medial", "<final", "<isolated", "<noBreak"):
            return unicodedata.normalize("NFKD", out)
        if tag == "<compat" and category in ("Ll", "Lu", "Nl") and out.isalpha():
            return out
    return None


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """The table, closed under itself: no prototype holds a character that has another one."""
    by = {ord(c): latin for latin, all_ in LOOK_ALIKES.items() for c in all_}
    for code in range(0x80, sys.maxunicode + 1):
        if code in by or 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        p = _prototype(chr(code))
        if p is not None:
            by[code] = p
    return {k: v.translate(by) for k, v in by.items()}


# Signs of which others are drawn in the same way.
SAME_SIGNS = frozenset("/:.,;|*~+=<>\\_!?&#@%^")


def _from_table(ch: str, proto: str) -> str | None:
    """What the public table's prototype of ``ch`` means here, or None where it doesn't count."""
    category = unicodedata.category(ch)
    if ch.isascii() or ch == "…" or not proto or unicodedata.decomposition(ch).startswith(_KEPT_TAGS):
        return None
    if category == "Nd":
        value = unicodedata.digit(ch)
        return {"O": "0", "o": "0", "l": "1"}.get(proto, proto) if value < 2 else proto
    if category in ("Lu", "Nl", "Lt"):
        return {"l": "I", "rn": "m"}.get(proto, proto)
    if category in ("Ll", "Lo"):
        return "m" if proto == "rn" else proto
    return proto if category[0] in "PS" and all(c in SAME_SIGNS for c in proto) else None


@lru_cache(maxsize=1)
def _codes() -> str:
    """All assigned characters that have entries of their own, between line feeds."""
    return "\n".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0x20000 <= c <= 0x3FFFF) and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs", "Cc"))


@lru_cache(maxsize=4)
def _public(found: str) -> dict[int, str]:
    by = dict(prototypes())
    for ch, proto in zip(_codes().split("\n"), found.split("\n")):
        if ord(ch) not in by and proto != unicodedata.normalize("NFD", ch) and len(unicodedata.normalize("NFD", ch)) == 1:
            p = _from_table(ch, proto)
            if p is not None and p != ch:
                by[ord(ch)] = p
    for _ in range(4):  # closed under itself
        by = {k: unicodedata.normalize("NFD", v).translate(by) for k, v in by.items()}
    return by


def public_prototypes(spark: SparkSession) -> dict[int, str]:
    """The whole table: the rules and the list, and the public table of the Unicode library in Spark's own process."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return _public(checker.getSkeleton(_codes()))


def skeleton_of(text: str, table: Mapping[int, str] | None = None) -> str:
    """Decompose, replace by prototypes, decompose again."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table))


def clean_of(text: str, table: Mapping[int, str] | None = None) -> str:
    """The readable consistent form: the skeleton, composed again."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton_of(text, table))


def _by_table(spark: SparkSession, of):
    held = spark.sparkContext.broadcast(public_prototypes(spark))

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: of(t, held.value), na_action="ignore")

    # only texts with characters beyond ASCII are sent to Python
    return lambda c: F.coalesce(run(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def skeleton(spark: SparkSession):
    """A function of columns: the skeleton."""
    return _by_table(spark, skeleton_of)


def consistent(spark: SparkSession):
    """A function of columns: the one consistent, composed form."""
    return _by_table(spark, clean_of)


def look_alike_pairs(df: DataFrame, id_col: str, group_col: str, text_cols: Sequence[str]) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of rows of one group of which a text column reads the same but differs in characters.

    The values that aren't their own skeleton are few; of the others only those pass that a Bloom filter of the few's (group, skeleton) lets
    through, so that the rest of the table isn't shuffled. Distinct forms are paired, and rows are joined to the pairs of forms in
    blocks of HOT rows of either form. Rows with equal values are never compared.
    """
    of = skeleton(df.sparkSession)
    every = []
    for k, c in enumerate(text_cols):
        t = df.filter(F.col(group_col).isNotNull() & F.col(c).isNotNull()).select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.lit(k).alias("field"), F.col(c).alias("form"))
        every.append(t)
    odd = [t.filter(F.col("form").rlike(r"[^\x00-\x7F]")).withColumn("skel", of(F.col("form"))) for t in every]
    odd = [t.filter("skel <> form") for t in odd]
    odd = cut(_union(odd).withColumn("kh", F.xxhash64("grp", "field", "skel")), "p4-odd")
    filters = hash_filters(odd.select("kh").distinct())
    # what is its own skeleton, in ASCII or not, is looked up by itself; odd values fall out by their texts
    plain = [held_against(t.withColumn("skel", F.col("form")).withColumn("kh", F.xxhash64("grp", "field", "skel")), "kh", filters).filter("_maybe").drop("_maybe") for t in every]
    near = cut(odd.unionByName(_union(plain)), "p4-near")
    forms = cut(near.groupBy("grp", "field", "skel", "form").agg(F.count("*").alias("n")), "p4-forms")
    sides = ((F.col("form").alias("form_a"), F.col("n").alias("na")), (F.col("form").alias("form_b"), F.col("n").alias("nb")))
    fa, fb = (forms.select("grp", "field", "skel", *side) for side in sides)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / HOT).cast("int")))
    unlike = fa.join(fb, ["grp", "field", "skel"]).filter("form_a < form_b").withColumn("block_a", spread("na")).withColumn("block_b", spread("nb"))
    sized = near.join(forms, ["grp", "field", "skel", "form"]).withColumn("block", F.pmod(F.xxhash64("id"), F.floor((F.col("n") - 1) / HOT) + 1).cast("int"))
    sized = cut(sized.select("id", "grp", "field", "skel", "form", "block"), "p4-rows")
    ra, rb = (sized.select(F.col("id").alias(f"id_{x}"), "grp", "field", "skel", F.col("form").alias(f"form_{x}"), F.col("block").alias(f"block_{x}")) for x in "ab")
    pairs = ra.join(unlike, ["grp", "field", "skel", "form_a", "block_a"]).join(rb, ["grp", "field", "skel", "form_b", "block_b"])
    return pairs.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def consistent_table(df: DataFrame, id_col: str, text_cols: Sequence[str]) -> DataFrame:
    """``id`` and every text column in its consistent form."""
    of = consistent(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), *[of(F.col(c)).alias(c) for c in text_cols])
