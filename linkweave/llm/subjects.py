"""Subject areas of documents by class-association rules.

Method: sentences are transactions of words; sentences of labelled documents carry the label as their class. Parallel
frequent-pattern growth counts the frequent sets: every partition grows a prefix tree of its transactions, frequent words first, with
the counts of the classes at its nodes; the conditional pattern bases of a node are its ancestors, and growth ends at two words, as no rule
has more. The partitions' counts are summed, so that the counts are exact. Sets with a class give rules *words -> subject* with their
confidence. A rule is redundant if one with fewer of its words is as confident. A sentence's evidence for each subject is the sum of
the logarithms of confidence over share of its matching rules, turned into a probability at the temperature that
fits labelled documents best which no rule was mined from. As labels are few, incomplete and partly wrong, mining is repeated: sentences of all
documents with clear evidence, which others of their document share, become the labelled transactions of the next round.
Words in more than ``COMMON`` of a language's documents are of its grammar or of set phrases and make no rules, unless they
are nearly always with one subject; what is frequent with a subject is measured within each language, given or, where it is null, told by its commonest words.

A document has the subjects of at least a quarter of its sentences, two at most; sentences whose words fit several
subjects lean to those of the rest of their document.

Bounds: hand labels are taken of up to ``LABELLED`` documents (by the hash of their ids), a quarter of which only calibrates. A rule's support is
``SUPPORT`` of the labelled sentences or more, at every size: so there are at most 1 / SUPPORT times the mean length of a sentence in words
of rules of one word, and of two words 1 / SUPPORT times the mean number of pairs. A sentence of more than ``WINDOW`` topical words counts as several
transactions. Counting, mining and scoring cover every document.

Defined results: null, empty and blank texts, and texts without any known word, have no subject; labels of unknown
documents or subjects are ignored; without any usable label no document has a subject; repeated texts are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import cut, filled

LABELLED = 20_000
SUPPORT = 2e-5
ROUNDS = 2
COMMON = 0.25
PROFILE = 60
SHARE = 0.25
WINDOW = 64
#: A tree is counted and begun anew when the depths of its nodes sum to this.
TREE = 3_000_000

_LINK = re.compile(r"[\[(]?(?:(?:https?|ftp)://|www\.)[^\s()\]]+(?:\([^\s()]*\)[^\s()\]]*)*[\])]?", re.I)
_END = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+(?=[\"“«¿¡(]?[A-ZÀ-ÖØ-ÞΑ-ΩА-Я])|(?<=[。！？])|(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*")
_SHORT = re.compile(r"(?:\bal|\b[A-Z]|\bDr|\bProf|\bMr|\bMrs|\bNo|\bNr|\bFig|\bTab|\bvs|\bcf|\be\.g|\bi\.e|\bca|\bpp?)\.$")
_WORD = re.compile(r"[^\W\d_]{3,}(?:-[^\W\d_]{2,})*")


def sentences(text: str) -> list[str]:
    """The sentences of a text; addresses are cut out, so that their points end none."""
    if not text:
        return []
    out: list[str] = []
    for s in _END.split(_LINK.sub(" ", text)):
        s = " ".join(s.split())
        if not s:
            continue
        if out and out[-1][-1] == "." and _SHORT.search(out[-1]):
            out[-1] += " " + s
        else:
            out.append(s)
    return [s for s in out if any(c.isalpha() for c in s)]


def words(sentence: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(sentence.lower())))


def _language(words_: set[str], profiles: dict[str, set[str]]) -> str:
    return max(sorted(profiles), key=lambda k: len(words_ & profiles[k]), default="")


def bodies(docs: DataFrame) -> DataFrame:
    """``id, lang, body`` of documents ``id, text, lang``, written: words between blanks, sentences between line feeds. Texts without sentences are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            body = ["\n".join(" ".join(words(s)) for s in sentences(t)) if t else None for t in b["text"]]
            has = [t is not None and any(c.isalpha() for c in t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "body": body})[has]

    return cut(docs.filter("text is not null").select("id", "text", "lang").mapInPandas(filled(run), "id long, lang string, body string"), "p9-bodies")


def language_words(docs: DataFrame) -> tuple[dict[str, set[str]], set[tuple[str, str]]]:
    """The PROFILE commonest words of every language given, and ``(lang, word)`` in more than COMMON of a language's documents.

    There are at most 1 / COMMON times as many common words as a document has words on average.
    """
    d = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.array_distinct(F.split("body", "[ \n]")).alias("w"))
    size = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages
    if not size:
        return {}, set()
    n = F.element_at(F.create_map(*[x for k, v in size.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    counted = d.select("lang", F.explode("w").alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w")))
    few = ranked.filter((F.col("r") <= PROFILE) | ((n >= 20) & (F.col("n") > COMMON * n)))
    profiles: dict[str, set[str]] = defaultdict(set)
    common = set()
    for r in few.collect():
        if r["r"] <= PROFILE and r["lang"]:
            profiles[r["lang"]].add(r["w"])
        if size[r["lang"]] >= 20 and r["n"] > COMMON * size[r["lang"]]:
            common.add((r["lang"], r["w"]))
    return dict(profiles), common


Labeller = Callable[[list[list[str]], int], list[int]]


def labelled_sentences(docs: DataFrame, profiles: dict[str, set[str]], label: Labeller) -> DataFrame:
    """Of documents ``lang, body, hint``, written: their labelled sentences (t = 's': words and class), and counted by partition how often
    each word stands in such a sentence (t = 'w') and how many there are (t = 'n') by language and class."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[tuple[str, int], Counter] = defaultdict(Counter)
        total: Counter = Counter()
        columns = ["t", "lang", "s", "c", "n"]
        for b in batches:
            rows: Counter = Counter()
            for lang, body, hint in zip(b["lang"], b["body"], b["hint"]):
                lines = body.split("\n")
                sents = [x.split() for x in lines]
                lang = lang or _language({w for x in sents for w in x}, held.value)
                for line, ws, c in zip(lines, sents, label(sents, int(hint))):
                    if c >= 0:
                        rows[(line, c)] += 1
                        by[(lang, c)].update(ws)
                        total[(lang, c)] += 1
            yield pd.DataFrame([("s", "", line, c, n) for (line, c), n in rows.items()], columns=columns)
            if sum(map(len, by.values())) > 1_000_000:
                yield pd.DataFrame([("w", lang, w, c, n) for (lang, c), ws in by.items() for w, n in ws.items()], columns=columns)
                by.clear()
        yield pd.DataFrame([("w", lang, w, c, n) for (lang, c), ws in by.items() for w, n in ws.items()], columns=columns)
        yield pd.DataFrame([("n", lang, "", c, n) for (lang, c), n in total.items()], columns=columns)

    return cut(docs.select("lang", "body", "hint").mapInPandas(filled(run), "t string, lang string, s string, c int, n long"), "p9-labelled")


def topical_words(labelled: DataFrame, share: dict[tuple[str, int], int], n_subjects: int, least: float, lift: float, common: set[tuple[str, str]]) -> list[str]:
    """Words that are far more frequent with one subject than with all of their language, frequent ones first."""
    langs = {lang for lang, _ in share}
    whole = {lang: sum(share.get((lang, c), 0) for c in range(n_subjects)) for lang in langs}
    odds = [(lang, c, (share.get((lang, c), 0) + 0.5) / (whole[lang] + 0.5 * n_subjects)) for lang in langs for c in range(n_subjects)]
    if not odds:
        return []
    by = labelled.filter("t = 'w'").groupBy(F.col("s").alias("w"), "lang", "c").agg(F.sum("n").alias("n"))
    base = labelled.sparkSession.createDataFrame(odds, "lang string, c int, base double")  # languages by subjects
    best = by.join(F.broadcast(base), ["lang", "c"]).groupBy("w", "lang").agg(F.sum("n").alias("all"), F.max(F.struct(F.col("n").alias("n"), F.col("base").alias("base"))).alias("top"))
    rate = F.col("top.n") / F.col("all")
    # half of the uses with one subject, and more of them than chance gives by three standard errors
    sure = (rate - F.col("top.base")) / F.sqrt(F.col("top.base") * (1 - F.col("top.base")) / F.col("all")) > 3.0
    kept = best.filter((F.col("all") >= least) & (rate >= 0.45) & (rate / F.col("top.base") >= lift) & sure)
    got: Counter = Counter()
    for r in kept.select("w", "lang", "all", rate.alias("rate")).collect():  # bounded by the support
        if (r["lang"], r["w"]) not in common or r["rate"] >= 0.75 and r["all"] >= 10:
            got[r["w"]] += r["all"]
    return sorted(got, key=lambda w: (-got[w], w))


class PatternTree:
    """A prefix tree of transactions of item numbers (0 is the most frequent), with the counts of classes at its nodes."""

    def __init__(self, n_items: int, n_classes: int) -> None:
        self.width, self.classes = n_items, n_classes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.item, self.parent, self.depth = [-1], [-1], [0]
        self.own: Counter = Counter()
        self.load = 0

    def add(self, items: list[int], c: int, n: int) -> None:
        node, child, width = 0, self.child, self.width
        for x in items:
            key = node * width + x
            to = child.get(key)
            if to is None:
                to = child[key] = len(self.item)
                self.item.append(x)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.load += self.depth[to]
            node = to
        self.own[node * self.classes + c] += n

    def patterns(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(a, b, counts by class)`` of all sets of one item (b = -1) and of two."""
        n = len(self.item)
        if n == 1:
            return
        item, parent, depth = np.array(self.item), np.array(self.parent), np.array(self.depth)
        at, counts = np.fromiter(self.own.keys(), dtype=np.int64), np.fromiter(self.own.values(), dtype=np.int64)
        total = np.bincount(at, weights=counts, minlength=n * self.classes).astype(np.int64).reshape(n, self.classes)
        for d in range(depth.max(), 1, -1):  # what ends below a node passes through it
            low = np.nonzero(depth == d)[0]
            np.add.at(total, parent[low], total[low])

        def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(keys, return_inverse=True)
            out = np.zeros((len(k), self.classes), dtype=np.int64)
            np.add.at(out, inverse, rows)
            return k, out

        one, got = summed(item[1:], total[1:])
        yield one, np.full(len(one), -1), got
        low = np.arange(1, n)
        up = parent[1:]
        while True:
            inner = up > 0
            low, up = low[inner], up[inner]
            if not len(low):
                return
            two, got = summed(item[up] * self.width + item[low], total[low])
            yield two // self.width, two % self.width, got
            up = parent[up]


def frequent_sets(labelled: DataFrame, topical: list[str], n_subjects: int) -> DataFrame:
    """``a, b, c, n``: how many labelled sentences of class ``c`` hold word ``a``, or words ``a`` and ``b``; sums of all partitions' trees, written."""
    held = labelled.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(topical)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = held.value
        names = np.array([*rank, ""], dtype=object)  # -1 is the empty one
        tree = PatternTree(len(rank), n_subjects)

        def counted() -> Iterator[pd.DataFrame]:
            for a, b, counts in tree.patterns():
                r, c = np.nonzero(counts)
                yield pd.DataFrame({"a": names[a[r]], "b": names[b[r]], "c": c.astype(np.int32), "n": counts[r, c]})
            tree.clear()

        for b in batches:
            for line, c, n in zip(b["s"], b["c"], b["n"]):
                items = [rank[w] for w in line.split() if w in rank]
                for k in range(0, len(items), WINDOW):
                    tree.add(sorted(items[k : k + WINDOW]), c, n)
            if tree.load > TREE:
                yield from counted()
        yield from counted()

    sentences_ = labelled.filter("t = 's'").select("s", "c", "n")
    return cut(sentences_.mapInPandas(filled(run), "a string, b string, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")), "p9-sets")


class Rules:
    """Rules of one or two words with their evidence for each subject, and the temperature of the evidence."""

    def __init__(self, subjects: list[str]) -> None:
        self.subjects = subjects
        self.one: dict[str, np.ndarray] = {}
        self.two: dict[tuple[str, str], np.ndarray] = {}
        self.partners: dict[str, set[str]] = defaultdict(set)
        self.temperature = 1.0
        self.seen: dict[tuple[str, ...], np.ndarray] = {}

    def evidence(self, items: list[str]) -> np.ndarray | None:
        """The summed evidence of the matching rules; a rule of two words stands for those of its words."""
        found = [w for w in items if w in self.one]
        return self._summed(found) if found else None

    def _summed(self, found: list[str]) -> np.ndarray:
        total = np.zeros(len(self.subjects))
        used: set[str] = set()
        if len(found) > 1:
            for i, a in enumerate(found):
                if a in self.partners and a not in used:
                    for b in found[i + 1 :]:
                        key = (a, b) if a < b else (b, a)
                        if b not in used and key in self.two:
                            total += self.two[key]
                            used |= {a, b}
                            break
        for w in found:
            if w not in used:
                total += self.one[w]
        return total

    def probabilities(self, items: list[str]) -> np.ndarray | None:
        """How likely each subject is; remembered by the words that matter."""
        found = tuple([w for w in items if w in self.one])
        if not found:
            return None
        p = self.seen.get(found)
        if p is None:
            e = self._summed(list(found))
            p = np.exp((e - e.max()) / self.temperature)
            p /= p.sum()
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[found] = p
        return p

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


def mine(labelled: DataFrame, subjects: list[str], least: int, lift: float, common: set[tuple[str, str]]) -> Rules:
    """Class-association rules of the labelled sentences."""
    rules = Rules(subjects)
    k = len(subjects)
    share = {(r["lang"], r["c"]): r["n"] for r in labelled.filter("t = 'n'").groupBy("lang", "c").agg(F.sum("n").alias("n")).collect()}  # languages by subjects
    total = sum(share.values())
    support = max(least, SUPPORT * total)
    topical = topical_words(labelled, share, k, support, lift, common)
    if not topical:
        return rules
    sets = frequent_sets(labelled, topical, k)
    whole = sets.groupBy("a", "b").agg(F.sum("n").alias("all"))
    class_ = sets.filter(F.col("n") >= support).join(whole, ["a", "b"]).withColumn("confidence", F.col("n") / F.col("all"))
    single = class_.filter("b = ''")
    sub = lambda side: single.select(F.col("a").alias(side), "c", F.col("confidence").alias(f"c{side}"))
    pairs = class_.filter("b <> ''").join(sub("a"), ["a", "c"], "left").join(sub("b"), ["b", "c"], "left")
    # a pair as confident as one of its words is redundant
    least_of = F.greatest(F.coalesce("ca", F.lit(0.0)), F.coalesce("cb", F.lit(0.0))) + 0.05
    better = pairs.groupBy("a", "b").agg(F.collect_list(F.struct("c", "n")).alias("by"), F.max((F.col("confidence") > least_of) & (F.col("confidence") >= 0.5)).alias("better")).filter("better")
    by_class = Counter()
    for (_, c), n in share.items():
        by_class[c] += n
    prior = np.array([(by_class[c] + 1.0) / (total + k) for c in range(k)])
    kept = single.groupBy("a", "b").agg(F.collect_list(F.struct("c", "n")).alias("by")).unionByName(better.select("a", "b", "by"))
    for r in kept.collect():  # bounded by the support
        counts = np.zeros(k)
        for x in r["by"]:
            counts[x["c"]] = x["n"]
        e = np.log((counts + 0.5 * prior * k) / (counts.sum() + 0.5 * k) / prior)
        if not r["b"]:
            rules.one[r["a"]] = e
        else:
            a, b = sorted((r["a"], r["b"]))
            rules.two[(a, b)] = e
            rules.partners[a].add(b)
            rules.partners[b].add(a)
    return rules


def document_shares(sents: list[list[str]], rules: Rules) -> np.ndarray:
    """The share of the sentences of a document that treat each subject; unclear ones lean to the document's others."""
    k = len(rules.subjects)
    found = [rules.probabilities(s) for s in sents]
    clear = [p for p in found if p is not None and p.max() >= 0.9]
    lean = (sum((p for p in clear), np.zeros(k)) + 0.05 * np.ones(k)) / (len(clear) + 0.05 * k)
    out = np.zeros(k)
    for p in found:
        if p is None:
            continue
        if p.max() < 0.9:
            p = p * lean
            p = p / p.sum()
        if p.max() >= 0.5:
            out[int(p.argmax())] += 1
    return out / max(1, len(sents))


def calibrate(rules: Rules, labelled: list[tuple[list[list[str]], set[str]]]) -> None:
    """The temperature at which the sentences of labelled documents have the likeliest labels."""
    best, top = rules.temperature, -math.inf
    evidence = [(rules.evidence(s), [rules.subjects.index(x) for x in subj]) for sents, subj in labelled for s in sents]
    evidence = [(e, y) for e, y in evidence if e is not None and y]
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
        total = 0.0
        for e, y in evidence:
            p = np.exp((e - e.max()) / t)
            total += math.log(max(0.1, p[y].sum() / p.sum()))  # labels may be wrong
        if total > top:
            best, top = t, total
    rules.temperature = best
    rules.seen.clear()


def _by_hint(sents: list[list[str]], hint: int) -> list[int]:
    return [hint] * len(sents)


def _by_rules(rules: Rules) -> Labeller:
    """Labels of the sentences with clear evidence that others of their document share; -1 for the rest."""

    def label(sents: list[list[str]], _: int) -> list[int]:
        clear = [int(p.argmax()) if (p := rules.probabilities(x)) is not None and p.max() >= 0.8 else -1 for x in sents]
        often = Counter(c for c in clear if c >= 0)
        good = {c for c, n in often.items() if n >= max(2, SHARE * len(sents))}
        # a document with one clear subject lends it to the sentences that no rule matches
        only = next(iter(good)) if len(good) == len(often) == 1 and often[next(iter(good))] >= 0.5 * len(sents) else -1
        return [only if c < 0 else c if c in good else -1 for c in clear]

    return label


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> Rules:
    """Rules from ``id, lang, body`` and hand labels ``id, subject``, mined in rounds."""
    n = len(subjects)
    known = labels.filter(F.col("subject").isin(subjects)).select("id", "subject").distinct()
    per = known.groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)  # a document has few labels
    labelled = cut(docs.join(per, "id").select("id", "lang", "body", "subjects", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("held")), "p9-hand")
    held_out = [([x.split() for x in r["body"].split("\n")], set(r["subjects"])) for r in labelled.filter("held").collect()]  # a quarter of LABELLED documents
    profiles, common = language_words(docs)
    number = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subjects")[0]).cast("int") - 1
    first = labelled.filter("not held and size(subjects) = 1").select("lang", "body", number.alias("hint"))
    rules = mine(labelled_sentences(first, profiles, _by_hint), subjects, 2, 2.0, common)
    calibrate(rules, held_out)
    every = docs.select("lang", "body", F.lit(-1).alias("hint"))
    for _ in range(ROUNDS):
        if not rules.one:
            break
        rules = mine(labelled_sentences(every, profiles, _by_rules(rules)), subjects, 3, 2.5, common)
        calibrate(rules, held_out)
    return rules


def subjects_of(docs: DataFrame, labels: DataFrame, areas: list[str]) -> DataFrame:
    """``id, subject, share`` of the subjects that each of the documents ``id, text, lang`` treats."""
    read = bodies(docs)
    held = docs.sparkSession.sparkContext.broadcast(fit(read, labels, sorted(areas)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = held.value
        for b in batches:
            rows = []
            for i, body in zip(b["id"], b["body"]):
                share = document_shares([x.split() for x in body.split("\n")], rules)
                for c in np.argsort(-share, kind="stable")[:2]:
                    if share[c] >= SHARE - 1e-9:
                        rows.append((i, rules.subjects[c], float(share[c])))
            yield pd.DataFrame(rows, columns=["id", "subject", "share"])

    return read.select("id", "body").mapInPandas(filled(run), "id long, subject string, share double")
