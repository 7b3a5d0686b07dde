"""Repair of text from scanned pages: divided words, misread characters, running headers and page numbers.

Method: all texts are counted once: words, hyphenated compounds and, in hashed buckets, pairs of neighbouring
words. The words that occur often enough are the vocabulary, kept as a trie; Levenshtein automata of distance 2
run against it give every word that isn't well known its complete candidates, with one edit or two. How likely a character is to be
misread as another is learned from the words with a single candidate, over a prior of known confusions; candidates
are ranked by that, by frequency, and by the neighbouring words where several remain. Page furniture is then
removed, divided words are joined (where the joined word is better attested than the compound), and lines are
filled into paragraphs.

Bounds of what is gathered and broadcast. The vocabulary: words that make up ``VOCABULARY_SHARE`` of the text or more, at every size, so 250,000 at
most. Counts of words and compounds that occur twice: up to ``WORDS`` of each, all or the commonest, and up to ``CORRECTIONS`` corrections. Beyond
these every text is given the exact counts of its own words, and their corrections, by a join: the results are the same. Pair counts: ``PAIRS`` buckets, each less
the count that chance gives a bucket, so that pairs rarer than one in PAIRS tell nothing, at every size.

Defined results: null, empty and blank texts have no noise and stay as they are; a text without line feeds has no
furniture; copies of a record (rows delivered twice) give one result; texts are taken whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.automata import Levenshtein, Trie
from linkweave.llm.page_lines import BREAKS, CONFUSIONS, Page, divided
from linkweave.session import cut, filled

VOCABULARY_SHARE = 4e-6
WORDS = 500_000
PAIRS = 1 << 18
CORRECTIONS = 500_000
#: A word is misread only if the right word is that many times as frequent; twice misread, if that many times again.
RATIO = 20.0
#: Least counts of the words in each trie that is searched.
TIERS = (0, 20, 60, 200, 1000, 5000)
#: The share of all learned confusions a confusion needs.
LEAST_SHARE = 0.002

_MASK = re.compile(
    r"(?:https?|ftp)://[^\s<>\]})]+|www\.[^\s<>\]})]+|[\w.+-]+@[\w.-]+|`[^`\n]*`|\$[^$\n]{1,300}\$|\\\(.*?\\\)|<(code|math|pre)\b[^>]*>.*?</\1>|</?[A-Za-z][^<>\n]{0,300}>|&#?\w+;|\\[A-Za-z]+\*?|\w*_\w+|!?\[\[[^\]\n]*\]\]",
    re.I | re.S,
)
#: A word, also with a bar in the place of a letter.
_TOKEN = re.compile(r"(?:\|(?=[^\W\d_]))?[^\W_]+(?:\|[^\W_]+)*(?:(?<=[^\W\d_])\|(?![\w|]))?")
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+(?:[-‐][^\W\d_]+)+(?![\w-])")


_JUNK = re.compile(r"://|^www\.|@|[$_=\\`]|&\w+;")
_TAG = re.compile(r"</?[A-Za-z][\w-]*/?>")


def words_of(token: str) -> list[str]:
    """The words in a blank-separated token; none in addresses, formulas, markup and names of variables."""
    if token.isalpha():
        return [token]
    if "<" in token:
        token = _TAG.sub(" ", token)
    return [] if _JUNK.search(token) else _TOKEN.findall(token)


def _pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(2654435761) + b.astype(np.uint64)) >> np.uint64(7) & np.uint64(PAIRS - 1)


def pair_bucket(a: str, b: str) -> int:
    return int(_pair_bucket(np.array([crc32(a.lower().encode())]), np.array([crc32(b.lower().encode())]))[0])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words (w), compounds (h) and pairs (p) of a partition, counted.

    Blank-separated tokens are counted first, by number; what each distinct token holds is worked out once.
    """
    index: dict[str, int] = {"": 0}
    counts = np.zeros(1, dtype=np.int64)
    pairs = np.zeros(PAIRS, dtype=np.int64)
    first, last = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64)
    breaks = tuple(BREAKS)
    for b in batches:
        ids: list[int] = []
        number = index.setdefault
        for text in b["text"]:
            if text:
                ids += [number(t, len(index)) for t in text.split()]
                ids.append(0)
        if not ids:
            continue
        new = list(index)[len(first) :]
        if new:
            inner = [words_of(t) for t in new]
            first = np.concatenate([first, np.array([crc32(w[0].lower().encode()) if w else 0 for w in inner], dtype=np.uint64)])
            last = np.concatenate([last, np.array([crc32(w[-1].lower().encode()) if w and not t.endswith(breaks) else 0 for t, w in zip(new, inner)], dtype=np.uint64)])
        a = np.array(ids, dtype=np.int64)
        # a word torn at a hyphen and what follows it are no words
        torn = np.array([False, *(t.endswith(breaks) for t in new)]) if len(first) == len(new) + 1 else np.concatenate([torn, np.array([t.endswith(breaks) for t in new], dtype=bool)])
        after = torn[a]
        whole = ~(after | np.concatenate([[False], after[:-1]]))
        got = np.bincount(a[whole], minlength=len(first))
        got[: len(counts)] += counts
        counts = got
        l, f = last[a[:-1]], first[a[1:]]
        both = (l > 0) & (f > 0) & whole[:-1] & whole[1:]
        pairs += np.bincount(_pair_bucket(l[both], f[both]).astype(np.int64), minlength=PAIRS)
    words: Counter = Counter()
    compounds: Counter = Counter()
    for t, n in zip(index, counts.tolist()):
        if n:
            if t.isalpha():
                words[t] += n
                continue
            for w in words_of(t):
                words[w] += n
            if "-" in t or "‐" in t:
                for w in () if _JUNK.search(t) else _COMPOUND.findall(t):
                    compounds[w.lower().replace("‐", "-")] += n
    at = np.nonzero(pairs)[0]
    yield pd.DataFrame({"t": ["w"] * len(words) + ["h"] * len(compounds) + ["p"] * len(at), "s": list(words) + list(compounds) + at.astype(str).tolist(), "n": list(words.values()) + list(compounds.values()) + pairs[at].tolist()})


def corpus_counts(records: DataFrame) -> DataFrame:
    """``t, s, n``: counts over all texts, written."""
    return cut(records.select("text").filter("text is not null").mapInPandas(filled(_count), "t string, s string, n long").groupBy("t", "s").agg(F.sum("n").alias("n")), "p5-counts")


def folded_words(counts: DataFrame) -> DataFrame:
    """``s, n, low``: words in lower case, and how often they stand so."""
    return counts.filter("t = 'w'").groupBy(F.lower("s").alias("s")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("s") == F.lower("s"), F.col("n")).otherwise(0)).alias("low"))


def commonest(counted: DataFrame, limit: int) -> tuple[list, bool]:
    """The rows with ``n`` of two or more, and True; where they are more than ``limit``, those from the least count on that fits, and False."""
    sizes = counted.filter("n >= 2").groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("size")).orderBy(F.desc("k")).collect()  # at most 64
    least, room = 1 << 62, limit
    for r in sizes:
        room -= r["size"]
        if room < 0:
            return counted.filter(F.col("n") >= least).collect(), False
        least = 1 << r["k"]
    return counted.filter("n >= 2").collect(), True


class Language:
    """What is broadcast: counts of folded words, of compounds and of pairs. Where ``complete`` is false, rarer words and compounds are left to joins."""

    def __init__(self, counts: DataFrame, limit: int = WORDS) -> None:
        words = folded_words(counts)
        got, all_words = commonest(words, limit)
        self.words = {r["s"]: r["n"] for r in got}
        self.low = {r["s"]: r["low"] for r in got if r["low"]}
        got, all_compounds = commonest(counts.filter("t = 'h'"), limit)
        self.compounds = {r["s"]: r["n"] for r in got}
        self.complete = all_words and all_compounds
        self.pairs = np.zeros(PAIRS, dtype=np.float64)
        for r in counts.filter("t = 'p'").collect():  # at most PAIRS
            self.pairs[int(r["s"])] = r["n"]
        self.pairs = np.maximum(0.0, self.pairs - self.pairs.sum() / PAIRS)
        whole = words.agg(F.sum("n"), F.max("n")).first()
        self.total, self.top = whole[0] or 0, whole[1] or 0

    def vocabulary(self) -> dict[str, int]:
        """The words that a misread one may have been, in whatever case they stand: letters only, not rare."""
        least = max(3, VOCABULARY_SHARE * self.total)
        return {w: n for w, n in self.words.items() if n >= least and w.isalpha() and len(w) > 1}

    def lowered(self) -> set[str]:
        """The words of the vocabulary that stand in lower case at least now and then, or are common: no names."""
        common = 0.0005 * self.total
        return {w for w, n in self.vocabulary().items() if self.low.get(w, 0) >= max(2, 0.02 * n) or n >= common}


def edit(read: str, right: str) -> tuple[str, str]:
    """What ``right`` and ``read`` have between their common beginning and end."""
    a, m = 0, min(len(read), len(right))
    while a < m and read[a] == right[a]:
        a += 1
    b = 0
    while b < m - a and read[-1 - b] == right[-1 - b]:
        b += 1
    return right[a : len(right) - b], read[a : len(read) - b]


def edits(read: str, right: str) -> list[tuple[str, str]]:
    """The one confusion that makes ``right`` into ``read``, or the two; none where it takes other edits."""
    was, became = edit(read, right)
    small = lambda x, y: 1 <= len(x) <= 2 and 1 <= len(y) <= 2 and len(x) + len(y) < 4
    if small(was, became):
        return [(was, became)]
    if len(was) > 2 and len(was) == len(became):  # two letters, each taken for another
        apart = [(x, y) for x, y in zip(was, became) if x != y]
        if len(apart) == 2:
            return apart
    return []


def _plausible_word(w: str) -> bool:
    return 1 < len(w) < 40 and any(c.isalpha() for c in w)


def needed(w: str, n: int) -> float:
    """How often a word must occur to be the right one of ``w``, which occurs ``n`` times."""
    return n * (RATIO if w.isalpha() else 3.0)


def candidates(counts: DataFrame, language: Language) -> DataFrame:
    """``w, n, low, right, was, became, was2, became2``: of each folded word that isn't well known, all vocabulary words within distance 2
    that occur often enough to be the right one, with their edits. Rarer words are left out of the tries, not of the search."""
    held = counts.sparkSession.sparkContext.broadcast(language.vocabulary())

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = held.value
        two = Levenshtein(2)
        tries = [(least, Trie(w for w, n in vocab.items() if n >= least)) for least in TIERS]
        for b in batches:
            out: list[tuple] = []
            for w, n, low in zip(b["s"], b["n"], b["low"]):
                if not _plausible_word(w):
                    continue
                need = needed(w, n)
                trie = next((t for least, t in reversed(tries) if least <= need))
                for right, _ in two.search(w, trie):
                    if right == w or vocab[right] < need:
                        continue
                    found = edits(w, right)
                    if len(found) == 1:
                        out.append((w, n, low, right, *found[0], None, None))
                    elif found and vocab[right] >= need * RATIO:
                        out.append((w, n, low, right, *found[0], *found[1]))
            yield pd.DataFrame(out, columns=["w", "n", "low", "right", "was", "became", "was2", "became2"])

    unknown = folded_words(counts).select("s", "n", (F.col("low") > 0).alias("low")).filter((F.col("n") * 3 <= language.top) & F.col("s").rlike(r"\p{L}"))
    # a fixed number of tasks: a search takes a millisecond, so that few bytes are much work
    unknown = unknown.repartition(max(counts.sparkSession.sparkContext.defaultParallelism, unknown.count() // 2000), F.col("s"))
    return unknown.mapInPandas(filled(look_up), "w string, n long, low boolean, right string, was string, became string, was2 string, became2 string")


def confusion_shares(found: DataFrame, lowered: set[str]) -> dict[tuple[str, str], float]:
    """How large a share of misreadings each (right, read) has; learned from words in lower case with a single candidate.

    Names and words of two characters teach nothing: they have a neighbour by chance.
    """
    held = found.sparkSession.sparkContext.broadcast(lowered)
    known = F.pandas_udf(lambda r: r.isin(held.value), "boolean")
    single = found.filter(F.col("low") & (F.length("w") > 2) & F.col("was2").isNull()).filter(known("right")).groupBy("w").agg(F.count("*").alias("k"), F.first("was").alias("was"), F.first("became").alias("became")).filter("k = 1")
    learned = single.groupBy("was", "became").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "was", "became").limit(2000).collect()
    got: dict[tuple[str, str], float] = defaultdict(float)
    for a, b in CONFUSIONS:
        got[(a, b)] += 3.0
    for r in learned:
        got[(r["was"], r["became"])] += r["n"]
    total = sum(got.values())
    return {k: v / total for k, v in got.items() if v / total >= LEAST_SHARE}


def corrections(counts: DataFrame, language: Language) -> DataFrame:
    """``w, rights, scores``: the plausible right words of each misread one (folded), best first by confusion and frequency."""
    found = cut(candidates(counts, language), "p5-candidates")
    shares = confusion_shares(found, language.lowered())
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast((shares, language.vocabulary()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares, vocab = held.value
        for b in batches:
            keep, scores = [], []
            for right, was, became, was2, became2 in zip(b["right"], b["was"], b["became"], b["was2"], b["became2"]):
                p = shares.get((was, became), 0.0) * (1.0 if was2 is None else shares.get((was2, became2), 0.0) / RATIO)
                keep.append(p > 0)
                scores.append(math.log(p) + math.log(vocab[right]) if p > 0 else 0.0)
            yield b.assign(score=scores)[keep][["w", "right", "score"]]

    scored = found.mapInPandas(filled(score), "w string, right string, score double")
    ranked = scored.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("score", "right")), asc=False).alias("r"))
    return cut(ranked.select("w", F.col("r.right").alias("rights"), F.col("r.score").alias("scores")), "p5-corrections")


def choose(rights: list[str], scores: list[float], before: str, after: str, pairs: np.ndarray) -> str:
    """The right word among several, by confusion, frequency and the pairs with its neighbours."""
    if len(rights) == 1:
        return rights[0]
    best, top = rights[0], -math.inf
    for r, s in zip(rights, scores):
        for a, b in ((before, r), (r, after)):
            if a and b:
                s += math.log(pairs[pair_bucket(a, b)] + 0.5)
        if s > top:
            best, top = r, s
    return best


# Conjunctions before which a hyphen hangs, as in "pre- and post-test".
HANGING = frozenset("and or to but nor und oder bis et ou y e o u".split())


def join_word(head: str, hyphen: str, rest: str, by_line: bool, language: Language) -> bool:
    """Whether a word divided as ``head`` and ``rest`` is one word, and not a compound divided at its own hyphen."""
    whole, compound = (head + rest).lower(), f"{head}-{rest}".lower()
    joined, hyphened = language.words.get(whole, 0), language.compounds.get(compound, 0)
    if hyphened > joined:
        return False
    if joined:
        return True
    after = language.words.get(rest.lower(), 0)
    if rest in HANGING or after >= 0.002 * language.total:
        return False
    if head[:1].isupper() and rest.islower():  # a name; the parts of a double name have capitals
        return True
    known = after >= 3
    if rest[:1].isupper() and not head.isupper():
        return False
    if not by_line:
        return not known if hyphen in "-‐" else True
    return not (known and language.words.get(head.lower(), 0) >= 3 and len(rest) > 3 and len(head) > 2)


Fixes = Mapping[str, tuple[list[str], list[float]]]


class Suspects(dict):
    """Whether a blank-separated token holds a word with a correction; remembers every token asked for."""

    def __init__(self, fixes: Fixes) -> None:
        super().__init__()
        self.fixes = fixes

    def word(self, w: str) -> bool:
        return w.lower() in self.fixes

    def __missing__(self, token: str) -> bool:
        hit = any(self.word(w) for w in words_of(token))
        if len(self) < 2_000_000:
            self[token] = hit
        return hit


def noise_of(text: str, language: Language, suspects: Suspects) -> list[tuple[str, str]]:
    """``(noise, detail)`` of a text."""
    if not text or text.isspace():
        return []
    page = Page(text)
    out = [(kind, str(i + 1)) for i, kind, _, strength in page.found if strength > 1]
    for head, hyphen, rest, by_line in divided(page):
        if join_word(head, hyphen, rest, by_line, language):
            out.append(("broken_word", (head + rest).lower()))
    if len(out) == 0 and not any([suspects[t] for t in text.split()]):  # a divided word may be misread as a whole only
        return out
    for parts in paragraphs(page, language):
        for code, part in parts:
            if code or not any([suspects[t] for t in part.split()]):
                continue
            for _, t, before, after in in_context(part):
                if suspects.word(t):
                    out.append(("misread_word", choose(*suspects.fixes[t.lower()], before, after, language.pairs)))
    return out


def asked_of(text: str, language: Language) -> set[tuple[str, str]]:
    """``(t, s)`` of the counts and corrections that the repair of a text may need and that may not be in what is broadcast."""
    out: set[tuple[str, str]] = set()
    if not text or text.isspace():
        return out
    for token in set(text.split()):
        out.update(("w", w.lower()) for w in words_of(token))
    page = Page(text)
    pairs = [(a, b) for a, _, b, _ in divided(page)]
    for line in page.lines:
        pairs += [(m.group(1), m.group(3)) for m in _GAPPED.finditer(line)]
    for i, line in enumerate(page.lines):
        if m := _HEAD.search(line.rstrip()):
            for j in range(i + 1, len(page.lines)):
                if page.kinds[j] == "text" and (r := _REST_OF.match(page.lines[j])):
                    pairs.append((m.group(1), r.group(1)))
                if page.kinds[j] != "blank" and j not in page.skip:
                    break
    for a, b in pairs:
        out |= {("w", (a + b).lower()), ("w", a.lower()), ("w", b.lower()), ("h", f"{a}-{b}".lower())}
    return out


class Overlay:
    """A language with the exact counts that one text asked for over those that are broadcast."""

    def __init__(self, language: Language, words: dict[str, int], compounds: dict[str, int]) -> None:
        self.words, self.compounds = ChainMap(words, language.words), ChainMap(compounds, language.compounds)
        self.pairs, self.total, self.top = language.pairs, language.total, language.top


class Repair:
    """What is learned from all records, applied to records: by what is broadcast alone, or with what each text asked for."""

    def __init__(self, records: DataFrame, limit: int = CORRECTIONS, words: int = WORDS) -> None:
        counts = corpus_counts(records)
        self.language = Language(counts, words)
        self.table = corrections(counts, self.language)
        few = self.table.count() <= limit
        self.exact = not few or not self.language.complete  # whether texts must ask
        self.counts = counts
        fixes = {r["w"]: (list(r["rights"]), list(r["scores"])) for r in self.table.collect()} if few else {}
        self.held = records.sparkSession.sparkContext.broadcast((self.language, fixes))

    def run(self, records: DataFrame, use: Callable, schema: str) -> DataFrame:
        """``use(rows, language, suspects)`` over ``kind, id, text``; ``rows`` is a list of (kind, id, text)."""
        held, exact = self.held, self.exact

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            language, fixes = held.value
            suspects = Suspects(fixes)
            for b in batches:
                out: list[tuple] = []
                if not exact:
                    for row in zip(b["kind"], b["id"], b["text"]):
                        out += use(row, language, suspects)
                else:
                    for kind, i, text, got in zip(b["kind"], b["id"], b["text"], b["got"]):
                        got = [] if got is None else got
                        words = {x["s"]: x["n"] for x in got if x["t"] == "w"}
                        compounds = {x["s"]: x["n"] for x in got if x["t"] == "h"}
                        own = {x["s"]: (list(x["rights"]), list(x["scores"])) for x in got if x["rights"] is not None}
                        out += use((kind, i, text), Overlay(language, words, compounds), Suspects(ChainMap(own, fixes)))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

        return (self.asked(records) if exact else records.select("kind", "id", "text")).mapInPandas(filled(apply), schema)

    def asked(self, records: DataFrame) -> DataFrame:
        """``kind, id, text, got``: every text with the counts of two or more, and the corrections, of what it asks for: one row per copy of it."""
        held = self.held

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            language, _ = held.value
            for b in batches:
                out = [(k, t, s) for k, text in zip(b["key"], b["text"]) for t, s in asked_of(text, language)]
                yield pd.DataFrame(out, columns=["key", "t", "s"])

        keyed = cut(records.select("kind", "id", "text", F.sha2("text", 256).alias("key")), "p5-keyed")
        needs = keyed.filter("text is not null").select("key", "text").distinct().mapInPandas(filled(ask), "key string, t string, s string")
        known = folded_words(self.counts).select(F.lit("w").alias("t"), "s", "n").unionByName(self.counts.filter("t = 'h'").select("t", "s", "n")).filter("n >= 2")
        fixes = self.table.select(F.lit("w").alias("t"), F.col("w").alias("s"), "rights", "scores")
        answers = known.join(fixes, ["t", "s"], "full_outer")
        got = needs.join(answers, ["t", "s"]).groupBy("key").agg(F.collect_list(F.struct("t", "s", F.coalesce("n", F.lit(1)).alias("n"), "rights", "scores")).alias("got"))
        return keyed.join(got, "key", "left").select("kind", "id", "text", "got")


def page_noise(records: DataFrame, limit: int = CORRECTIONS, words: int = WORDS) -> DataFrame:
    """``record_kind, record_id, noise, detail``, without repeats, of records ``kind, id, text``."""

    def find(row: tuple, language: Language, suspects: Suspects) -> list[tuple]:
        kind, i, text = row
        return [(kind, i, n, d) for n, d in dict.fromkeys(noise_of(text, language, suspects))]

    found = Repair(records, limit, words).run(records.filter("text is not null"), find, "record_kind string, record_id long, noise string, detail string")
    return found.distinct()


_HEAD = re.compile(rf"([^\W\d_]+)([{BREAKS}])$")
_REST_OF = re.compile(r"\s*([^\W\d_]+)")
_ENDS = frozenset(BREAKS)
_GAPS = tuple(h + blank for h in BREAKS for blank in " \t")
_GAPPED = re.compile(rf"([^\W\d_]+)([{BREAKS}])[ \t]+([^\W\d_]+)")


def paragraphs(page: Page, language: Language) -> list[list[tuple[bool, str]]]:
    """The paragraphs of a page without furniture, words divided between lines made whole; each as parts ``(code, text)``.

    The line feeds in a part of text are those of the page.
    """
    skip, raw, kinds = page.skip, page.lines, page.kinds
    blocks: list[list[tuple[bool, str]]] = []
    open_ = False
    gap = False  # a blank line since the last text, not due to furniture
    for i, line in enumerate(raw):
        if i in skip:
            continue
        near = i - 1 in skip or i + 1 in skip
        if kinds[i] == "blank":
            gap = gap or not near
            continue
        if kinds[i] == "text":
            last = blocks[-1][-1][1] if blocks else ""
            m = _HEAD.search(last[max(last.rfind(" "), last.rfind("\n")) + 1 :]) if open_ and last[-1:] in _ENDS else None
            r = _REST_OF.match(line)
            if open_ and not gap and m and r:
                glue = "" if join_word(m.group(1), m.group(2), r.group(1), True, language) else "-"
                blocks[-1] = [(False, last[:-1] + glue + line.strip())]
            elif open_ and not gap:
                blocks[-1] = [(False, f"{last}\n{line.strip()}")]
            else:
                blocks.append([(False, line.strip())])
            open_ = True
        else:
            part = (kinds[i] == "code", line)
            if blocks and not gap and part[0] and not open_:
                blocks[-1].append(part)
            else:
                blocks.append([part])
            open_ = False
        gap = False

    def blank(m: re.Match) -> str:
        return m.group(1) + m.group(3) if join_word(m.group(1), m.group(2), m.group(3), False, language) else m.group()

    def filled_(part: str) -> str:
        return _GAPPED.sub(blank, part) if any(h in part for h in _GAPS) else part

    return [[(code, part if code else filled_(part)) for code, part in parts] for parts in blocks]


def in_context(part: str) -> Iterator[tuple[int, str, str, str]]:
    """``(begin, word, word before, word after)`` of every word outside of addresses, formulas and markup."""
    found = list(_TOKEN.finditer(_MASK.sub(lambda m: " " * len(m.group()), part)))
    words = ["", *(m.group() for m in found), ""]
    for k, m in enumerate(found):
        yield m.start(), m.group(), words[k], words[k + 2]


def repaired(text: str, language: Language, suspects: Suspects) -> str:
    """The text in filled paragraphs of whole words, without furniture. Code, markup lines and addresses keep their form."""
    if not text or text.isspace():
        return text

    fixes = suspects.fixes

    def fix(part: str) -> str:
        if not any([suspects[t] for t in part.split()]):
            return part.replace("\n", " ")
        out, at = [], 0
        for begin, t, before, after in in_context(part):
            if t.lower() in fixes:
                right = choose(*fixes[t.lower()], before, after, language.pairs)
                if t.isupper() and sum(c.isalpha() for c in t) > 1:
                    right = right.upper()
                elif t[0].isupper():
                    right = right.capitalize()
                out += [part[at:begin], right]
                at = begin + len(t)
        return "".join([*out, part[at:]]).replace("\n", " ")

    return "\n\n".join("\n".join(part if code else fix(part) for code, part in parts) for parts in paragraphs(Page(text), language))


def repair(records: DataFrame, limit: int = CORRECTIONS, words: int = WORDS) -> DataFrame:
    """``kind, id, text``: the records with their texts repaired; rows stay rows."""

    def fix(row: tuple, language: Language, suspects: Suspects) -> list[tuple]:
        kind, i, text = row
        return [(kind, i, text if text is None else repaired(text, language, suspects))]

    return Repair(records, limit, words).run(records, fix, "kind string, id long, text string")
