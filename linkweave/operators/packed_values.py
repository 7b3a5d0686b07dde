"""Several values packed in one field: one value per row, with its position.

Method: a cell is cut into chunks at everything that may be a delimiter; quoted and angle-bracketed spans are
atomic. Between two chunks a lattice has two edges, *split* and *join*, whatever the chunks are. A unigram model gives every segment a
probability: that of its form (how it starts, what was joined to it), and, as its value starts with an address, that of the address's host, by how often values of the
whole column start with it. An address joined into a value is no value of its own and is paid for letter by letter, with ``LETTER`` for each of its first
``SPELLED`` characters: that is the prior on the length of values, and keeps expectation-maximisation from merging lists into long values. Every delimiter has a probability of separating and one
of being part of a value. Expectation-maximisation
learns forms and delimiters from the whole column, by forward and backward sums over the lattices of all distinct
chunk patterns, weighted with their counts; Viterbi then gives each cell its likeliest split. A host without a scheme starts a value where values with one have told it.

What grows with the data stays distributed: the patterns are counted and scored by partition, and only the
parameters are gathered and broadcast: ``HOSTS`` host counts (hashed; a host counts as known if it has more than twice what chance gives a bucket), and the delimiters that
make up ``DELIMITER_SHARE`` of all, so 1 / DELIMITER_SHARE at most; rarer ones share one class.

Defined results: null and empty cells give no row; a cell with one value gives none unless ``singles`` is set; a
value given twice is listed twice; values come out as written, without what separates, quotes, brackets, numbers
or labels them; an unclosed quote doesn't bind; cells of any length are taken whole (time is linear in length).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut, filled

HOSTS = 1 << 16
DELIMITER_SHARE = 1e-4
ROUNDS = 4
#: The probability of a letter where it must be spelled, and of how many letters of an address.
LETTER, SPELLED = 1 / 40, 8
#: Hosts that start that share of the column's values are common.
COMMON = 1e-3

_START = r"(?:(?:https?|ftps?|sftp)(?::|(?=//))/{1,}[^\s/]|www\.[^\s])"
HOST_SQL = r"(?i)^[^A-Za-z0-9]*(?:(?:https?|ftps?|sftp)://)?(?:www\.)?([A-Za-z0-9.-]+)"

_TOKEN = re.compile(
    r"(?P<quoted>\"(?:[^\"\n]|\n(?!\"))*\"|“[^”]*”|(?<!\w)'[^']*'(?!\w)|‘[^’]*’|<[^<>\s]*>)"
    r"|(?P<delim>(?:\s|[,;|•·])+(?:(?:and|or|&|\+|/|AND|OR|et|und|y)(?:\s|[,;|•·])+)?)"
    r"|(?P<text>[^\s,;|•·\"“‘<]+|.)",
    re.S,
)
_OPEN, _CLOSE = "([{<\"'“‘*•-", ")]}>\"'”’"
_ADDRESS = re.compile(rf"[\[({{<\"'“‘*•\-\s]*{_START}", re.I)
#: What is torn off the start of an address: a scheme, ``www``, or the signs behind them.
_TORN = re.compile(r"[\[({<\"'“‘*•\-\s]*(?:(?:https?|ftps?|sftp)\W*(?:[a-z0-9-]+\W*)?|www\W*|[:/.]+)$", re.I)
_NUMBER = re.compile(r"[(\[]?\d{1,4}[.)\]:]*$")
_LABEL = re.compile(r"[\[({]*[^\W\d][\w -]*:$|[\[(]+[^\W\d]\w*$|[*•–-]+$")
_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}

Chunk = tuple[str, int, int]  # kind, begin, end in the cell


_HOST = re.compile(r"(?i)(?:(?:https?|ftps?|sftp):?/+)?(?:www\.)?([a-z0-9.-]+)")
_BARE_HOST = re.compile(r"(?i)[\[({<\"'“‘*•\-]*((?:[a-z0-9-]+\.)+[a-z]{2,})(?=[/:?#\])}>\"'”’.,;]|$)")


def _kind(text: str, quoted: bool, hosts: np.ndarray | None) -> str:
    """The kind of a chunk: A, E, a an address whose host is common, known or unknown, D a known host without scheme (Q before them: quoted),
    q quoted text, s what is torn off the start of an address, n a number, l a label, w anything else."""
    if not quoted and _TORN.match(text):
        return "s"
    if _ADDRESS.match(text):
        m = _HOST.search(text)
        n = hosts[host_bucket(m.group(1))] if hosts is not None and m is not None else 0
        return ("Q" if quoted else "") + ("A" if n >= 2 else "E" if n >= 1 else "a")
    if "." in text and hosts is not None and (bare := _BARE_HOST.match(text)) and hosts[host_bucket(bare.group(1))] >= 1:
        return "QD" if quoted else "D"
    if quoted:
        return "q"
    if _NUMBER.match(text):
        return "n"
    if _LABEL.match(text):
        return "l"
    return "w"


def host_bucket(host: str) -> int:
    h = 0
    for b in host.lower().encode():
        h = (h * 31 + b) & 0x7FFFFFFF
    return h % HOSTS


def lattice(cell: str, hosts: np.ndarray | None = None) -> tuple[list[Chunk], list[str]]:
    """The chunks of a cell and the delimiters between them (one less)."""
    chunks: list[Chunk] = []
    delims: list[str] = []
    pending = ""
    run: list[int] | None = None

    def close() -> None:
        nonlocal run
        if run is not None:
            chunks.append((_kind(cell[run[0] : run[1]], False, hosts), run[0], run[1]))
            run = None

    for m in _TOKEN.finditer(cell):
        if m.lastgroup == "delim":
            close()
            pending += m.group()
            continue
        atomic = m.lastgroup == "quoted" and _kind(m.group()[1:-1], False, hosts) in STARTS
        if run is not None and not atomic:
            run[1] = m.end()
            continue
        if run is not None:  # a quoted value glued to what stands before it
            close()
        if chunks:
            delims.append(re.sub(r"\s+", " ", re.sub(r"([,;|•·])\1+", r"\1", pending)))
        pending = ""
        if atomic:
            chunks.append((_kind(m.group(), True, hosts), m.start(), m.end()))
        else:
            run = [m.start(), m.end()]
    close()
    return chunks, delims


def pattern(cell: str, hosts: np.ndarray | None = None) -> str:
    """The lattice without its texts: what the model sees."""
    chunks, delims = lattice(cell, hosts)
    return "\x1f".join(x for k, c in enumerate(chunks) for x in ([c[0]] if k == 0 else [delims[k - 1], c[0]]))


#: Kinds that start a value, and the share of the column's values that start with such a host.
STARTS = {"A": 1e-2, "E": 1e-5, "a": 1e-7, "D": 1e-6}
STARTS |= {f"Q{k}": v for k, v in STARTS.items()}
_SHARE = {k: math.log(v) for k, v in STARTS.items()}
#: Before any cell is seen.
PRIOR = {"A": 0.2, "E": 0.2, "a": 0.1, "D": 0.02, "QA": 0.1, "QE": 0.1, "Qa": 0.1, "QD": 0.02, "q": 0.01, "s": 0.05, "n": 0.06, "l": 0.06, "w": 0.02}
#: What else may be joined to the start of a value: words, numbers, labels, addresses.
_INNER_PRIOR = {"": 1.0, "w": 0.1, "n": 0.03, "l": 0.001, "a": 0.1}
_SPELL = SPELLED * math.log(LETTER)


class Model:
    """Frequencies of value forms and of delimiters that separate (``s``) or belong to a value (``j``)."""

    def __init__(self, counts: dict[str, float] | None = None, delims: frozenset[str] | None = None) -> None:
        forms = {f"v:{k}:{i}": 20 * p * q for k, p in PRIOR.items() for i, q in _INNER_PRIOR.items()}
        got = counts or {}
        total = sum(forms.values()) + sum(v for k, v in got.items() if k.startswith("v:"))
        self.form = {k: math.log((v + got.get(k, 0.0)) / total) + _SHARE.get(k.split(":")[1], 0.0) for k, v in forms.items()}
        self.got, self.delims = got, delims

    def edge(self, delim: str, nxt: str) -> tuple[float, float]:
        """Log probabilities to split and to join at a delimiter before a chunk of kind ``nxt``."""
        d = self.delim_class(delim, nxt)
        s, j = self.got.get(f"s:{d}", 0.0) + 0.5, self.got.get(f"j:{d}", 0.0) + 0.5
        return math.log(s / (s + j)), math.log(j / (s + j))

    def delim_class(self, delim: str, nxt: str) -> str:
        d = delim_key(delim, nxt)
        return d if self.delims is None or d in self.delims else delim_key("other", nxt)


def delim_key(delim: str, nxt: str) -> str:
    return f"{delim}\x1f{'a' if nxt in STARTS else nxt}"


def _steps(pat: str) -> tuple[list[str], list[str]]:
    x = pat.split("\x1f")
    return x[0::2], x[1::2]


_RANK = {"": 0, "w": 1, "n": 2, "l": 3, "a": 4}


def _join(state: tuple[str, str], nxt: str) -> tuple[tuple[str, str], float]:
    """The state after joining a chunk of kind ``nxt``, and what it costs beside the delimiter."""
    if state[0] == "s" and state[1] in ("", "w") and (nxt == "s" or nxt in STARTS):  # what continues an address that is torn
        return (nxt, state[1] if nxt == "s" else ""), 0.0
    if nxt in STARTS:
        return (state[0], "a"), _SPELL
    return (state[0], max(state[1], nxt if nxt in "nl" else "w", key=_RANK.get)), 0.0


def _add(a: float | None, b: float) -> float:
    if a is None:
        return b
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def expected(pat: str, model: Model, weight: float, out: Counter) -> None:
    """Add the expected counts of one pattern, by forward and backward sums over its lattice."""
    kinds, delims = _steps(pat)
    fwd: list[dict[tuple[str, str], float]] = [{(kinds[0], ""): 0.0}]
    for k, d in enumerate(delims):
        split, join = model.edge(d, kinds[k + 1])
        nxt: dict[tuple[str, str], float] = {}
        for s, p in fwd[-1].items():
            t, cost = _join(s, kinds[k + 1])
            for to, q in (((kinds[k + 1], ""), p + model.form[f"v:{s[0]}:{s[1]}"] + split), (t, p + join + cost)):
                nxt[to] = _add(nxt.get(to), q)
        fwd.append(nxt)
    back: list[dict[tuple[str, str], float]] = [{} for _ in kinds]
    back[-1] = {s: model.form[f"v:{s[0]}:{s[1]}"] for s in fwd[-1]}
    for k in range(len(kinds) - 2, -1, -1):
        split, join = model.edge(delims[k], kinds[k + 1])
        for s in fwd[k]:
            t, cost = _join(s, kinds[k + 1])
            back[k][s] = _add(model.form[f"v:{s[0]}:{s[1]}"] + split + back[k + 1][(kinds[k + 1], "")], join + cost + back[k + 1][t])
    total = None
    for s, p in fwd[-1].items():
        total = _add(total, p + back[-1][s])
    for s, p in fwd[-1].items():
        out[f"v:{s[0]}:{s[1]}"] += weight * math.exp(p + back[-1][s] - total)
    for k, d in enumerate(delims):
        split, join = model.edge(d, kinds[k + 1])
        c = model.delim_class(d, kinds[k + 1])
        for s, p in fwd[k].items():
            a = math.exp(p + model.form[f"v:{s[0]}:{s[1]}"] + split + back[k + 1][(kinds[k + 1], "")] - total)
            t, cost = _join(s, kinds[k + 1])
            b = math.exp(p + join + cost + back[k + 1][t] - total)
            out[f"v:{s[0]}:{s[1]}"] += weight * a
            out[f"s:{c}"] += weight * a
            out[f"j:{c}"] += weight * b


def viterbi(pat: str, model: Model) -> list[bool]:
    """For each delimiter of the pattern, whether the likeliest segmentation splits there."""
    kinds, delims = _steps(pat)
    best: dict[tuple[str, str], float] = {(kinds[0], ""): 0.0}
    trail: list[dict[tuple[str, str], tuple[tuple[str, str], bool]]] = []
    for k, d in enumerate(delims):
        split, join = model.edge(d, kinds[k + 1])
        nxt: dict[tuple[str, str], float] = {}
        frm: dict[tuple[str, str], tuple[tuple[str, str], bool]] = {}
        for s, p in best.items():
            to, cost = _join(s, kinds[k + 1])
            for t, q, cut_here in (((kinds[k + 1], ""), p + model.form[f"v:{s[0]}:{s[1]}"] + split, True), (to, p + join + cost, False)):
                if t not in nxt or q > nxt[t]:
                    nxt[t], frm[t] = q, (s, cut_here)
        best = nxt
        trail.append(frm)
    state = max(best, key=lambda s: best[s] + model.form[f"v:{s[0]}:{s[1]}"])
    out = []
    for frm in reversed(trail):
        state, cut_here = frm[state]
        out.append(cut_here)
    return out[::-1]


def bare(text: str) -> str:
    """A value without separators, quotes and brackets around it."""
    was = None
    while was != text:
        was = text
        text = text.strip().strip(",;|•·").strip()
        if text[:1] and text[0] in _OPEN and not text.startswith("-"):
            text = text[1:]
        text = re.sub(r"^[-–]\s+", "", text)
        if text[-1:] and text[-1] in _CLOSE:
            o = _PAIRS.get(text[-1])
            if o is None or text.count(text[-1]) > text.count(o):
                text = text[:-1]
    return text


def split_cell(cell: str, model: Model, hosts: np.ndarray | None = None, decide=None) -> list[str]:
    """The values of a cell, in order."""
    chunks, delims = lattice(cell, hosts)
    if not chunks:
        return []
    pat = "\x1f".join(x for k, c in enumerate(chunks) for x in ([c[0]] if k == 0 else [delims[k - 1], c[0]]))
    cuts = (decide or (lambda p: viterbi(p, model)))(pat)
    out, begin = [], 0
    for k in range(len(chunks)):
        if k == len(chunks) - 1 or cuts[k]:
            first = chunks[begin]
            if first[0] in STARTS or first[0] == "s" and any(c[0] in STARTS or c[0] == "w" and "." in cell[c[1] : c[2]] for c in chunks[begin : k + 1]):
                text = cell[first[1] : chunks[k][2]]
                if first[0][0] == "Q":
                    inner = text[1 : first[2] - first[1] - 1]
                    out.append(inner.strip())
                else:
                    out.append(bare(text))
            begin = k + 1
    return [x for x in out if x]


def host_counts(df: DataFrame, col: str) -> np.ndarray:
    """By HOSTS buckets (the bound of what is gathered): 2 where hosts that fall there start COMMON of the column's values, 1 where more than twice
    as many as chance gives a bucket, and 0."""

    @F.pandas_udf("int")
    def bucket(h: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return h.map(lambda x: known.get(x) or known.setdefault(x, host_bucket(x)))

    hosts = df.select(F.lower(F.regexp_extract(F.col(col), HOST_SQL, 1)).alias("h")).filter("h <> ''").groupBy("h").agg(F.count("*").alias("n"))
    out = np.zeros(HOSTS, dtype=np.int64)
    for r in hosts.groupBy(bucket("h").alias("b")).agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    total = max(1, int(out.sum()))
    return ((out > max(1.0, 2.0 * total / HOSTS)).astype(np.int8) + ((out > 1) & (out >= COMMON * total))).astype(np.int8)


def split_packed(df: DataFrame, id_col: str, col: str, singles: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """``id, pos, value``: one row per value of the cells of ``col``, with its position from 1."""
    spark = df.sparkSession
    cells = df.select(F.col(id_col).alias("id"), F.col(col).alias("cell")).filter("cell is not null")
    hosts = spark.sparkContext.broadcast(host_counts(cells, "cell"))

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pats = [pattern(x, hosts.value) for x in b["cell"]]
            yield pd.DataFrame({"id": b["id"], "cell": b["cell"], "starts": [sum(k == "s" or k in STARTS for k in p.split("\x1f")[0::2]) for p in pats], "pat": pats})

    schema = f"id {dict(cells.dtypes)['id']}, cell string, starts int, pat string"
    seen = cut(cells.mapInPandas(filled(patterns), schema), "packed")
    counted = cut(seen.filter("pat <> ''").groupBy("pat").agg(F.count("*").alias("n")), "packed-patterns")

    def delims_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        for b in batches:
            for p, n in zip(b["pat"], b["n"]):
                kinds, delims = _steps(p)
                for k, d in enumerate(delims):
                    out[delim_key(d, kinds[k + 1])] += n
        yield pd.DataFrame({"d": list(out.keys()), "n": list(out.values())})

    found = cut(counted.mapInPandas(filled(delims_of), "d string, n long").groupBy("d").agg(F.sum("n").alias("n")), "packed-delimiters")
    all_ = found.agg(F.sum("n")).first()[0] or 0
    known = frozenset(r["d"] for r in found.filter(F.col("n") >= DELIMITER_SHARE * all_).collect())  # at most 1 / DELIMITER_SHARE

    counts: dict[str, float] = {}
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(counts)

        def e_step(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            model, out = Model(held.value, known), Counter()
            for b in batches:
                for p, n in zip(b["pat"], b["n"]):
                    expected(p, model, float(n), out)
            yield pd.DataFrame({"k": list(out.keys()), "v": list(out.values())})

        got = counted.mapInPandas(filled(e_step), "k string, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # forms, and two for each known delimiter
        counts = {r["k"]: r["v"] for r in got}
    final = spark.sparkContext.broadcast(counts)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(final.value, known)
        decide = lru_cache(maxsize=1 << 16)(lambda p: viterbi(p, model))
        for b in batches:
            ids, pos, values = [], [], []
            for i, c in zip(b["id"], b["cell"]):
                found = split_cell(c, model, hosts.value, decide)
                if len(found) > 1 or singles:
                    for k, v in enumerate(found, 1):
                        ids.append(i), pos.append(k), values.append(v)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "pos": pd.Series(pos, dtype="int64"), "value": pd.Series(values, dtype="object")})

    # every value starts with a chunk of its own that is an address or its torn beginning
    todo = seen if singles else seen.filter("starts > 1")
    return todo.select("id", "cell").mapInPandas(filled(decode), f"id {dict(cells.dtypes)['id']}, pos long, value string")
