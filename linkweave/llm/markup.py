"""Clean text from HTML, Markdown, wiki and LaTeX markup, keeping headings, list items, code blocks and formulas.

Method: a text becomes a tree of nodes; gradient-boosted trees over the nodes' features
(subtree density, attribute tokens, depth, statistics of siblings, what stands above, form of the content) give each node probabilities of all five
kinds; decoding is hierarchical: of all choices for the tree without contradictions (nothing within code or a formula, formulas alone within a
heading, no heading within an item) the likeliest is found from the leaves up, and of formulas that share a sign the likelier stays.

The trees are fitted here, on the nodes of at most ``SAMPLE`` documents (the first by the hash of their id; a
parameter): paired tags, environments and commands label what they enclose, numbered lines are labelled by their
neighbours, dollar signs by what stands between them; what is ambiguous has no label, and the kind of markup is hidden in a third of the rows, so that
the other features count. The model is a few thousand numbers; every document is parsed and decoded with it. Fields with an address go the same way: what
stands within each layer of markup is a node, and of the nodes of a field the likeliest is the address (``FIELDS`` fields are the sample).

Defined results: null, empty and blank texts have no pieces, and come out as they are; a block that isn't closed goes
to the end of the text; pieces without content are none; repeats within a record come once in ``pieces``; texts
are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkweave.llm.boosted_trees import BoostedTrees
from linkweave.llm.markup_tree import CODES, FAMILIES, KINDS, Node, clean, features, parse, piece
from linkweave.session import filled

SAMPLE = 1500
FIELDS = 5000
SEED = 7

_HEADINGS = ("hash", "underlined", "equals", "h", "section")
_SURE_FORMULAS = ("dollars", "bracket", "paren", "equation", "math")
_COMMAND = re.compile(r"\\[A-Za-z]+|[=^_<>]")


def label(x: Node, nodes: list[Node]) -> int | None:
    """The kind that the markup of a node gives it, or None where it doesn't tell."""
    if x.coded:
        return 0 if nodes[x.parent].facts.get("closed", 1) else None
    words = len(re.findall(r"[^\W\d_]{3,}", x.content))
    if x.family == "text":
        return 0
    if x.family in _HEADINGS:
        return 1 if words < 16 and not x.content.rstrip().endswith((".", ";", ",")) else None
    if x.family in ("li", "latexitem"):
        return 2
    if x.family in ("bullet", "stars"):
        return 2 if (x.mates or x.below) and not x.facts.get("glued") else None
    if x.family == "ordered":
        return 2 if x.follows else 0 if not x.mates and (x.facts.get("glued") or x.number != 1) else None
    if x.family in CODES:
        return 3
    if x.family in _SURE_FORMULAS:
        return 4
    if x.family == "dollar":
        c = x.content
        if c[:1].isspace() or c[-1:].isspace() and not _COMMAND.search(c) or re.match(r"\d[\d.,]*\s+(?:[a-z`*<(_']|\\emph|\\textbf|\{\\)", c):
            return 0
        return 4 if _COMMAND.search(c) and c == c.strip() else None
    return None


def fit(texts: list[str], seed: int = SEED) -> BoostedTrees:
    """Trees fitted to the labelled nodes. The features of the family are blanked in a third of the rows, so that the others count."""
    rows, kinds = [], []
    for t in texts:
        nodes = parse(t)
        for x in nodes:
            if x.family in _PLAIN:
                continue
            y = label(x, nodes)
            if y is not None:
                rows.append(features(x, nodes))
                kinds.append(y)
    model = BoostedTrees(len(KINDS), rounds=24, depth=4, hot=len(FAMILIES))
    if not rows:
        return model
    x, y = np.array(rows, dtype=np.uint8), np.array(kinds)
    x[np.random.default_rng(seed).random(len(x)) < 1 / 3, : len(FAMILIES)] = 0
    return model.fit(x, y)


_NONE, _HEADING, _ITEM, _CODE, _FORMULA = range(len(KINDS))
#: Running text, containers and rows of tables aren't pieces of any kind.
_PLAIN = ("text", "box", "row")
_PLAIN_SCORE = [0.0, *[-np.inf] * (len(KINDS) - 1)]
#: By context (free, in a heading, in an item, in code or a formula): the kinds a node may be, and the context below it for each.
_MAY = ((_NONE, _HEADING, _ITEM, _CODE, _FORMULA), (_NONE, _FORMULA), (_NONE, _ITEM, _CODE, _FORMULA), (_NONE,))
_BELOW = {_NONE: None, _HEADING: 1, _ITEM: 2, _CODE: 3, _FORMULA: 3}


def decode(nodes: list[Node], logp: list[list[float]]) -> list[int]:
    """The kind of every node: of all choices for the tree without contradiction, the likeliest."""
    n = len(nodes)
    below = [[0.0] * len(_MAY) for _ in range(n)]  # by context: the best of what is below a node
    pick = [[0] * len(_MAY) for _ in range(n)]
    for i in range(n - 1, -1, -1):  # parents stand before what is below them
        p, acc = logp[i], below[i]
        up = below[nodes[i].parent] if nodes[i].parent >= 0 else None
        for ctx, may in enumerate(_MAY):
            best, top = 0, -np.inf
            for k in may:
                s = p[k] + acc[ctx if k == _NONE else _BELOW[k]]
                if s > top:
                    best, top = k, s
            pick[i][ctx] = best
            if up is not None:
                up[ctx] += top
    out, context = [0] * n, [0] * n
    for i, x in enumerate(nodes):
        ctx = context[x.parent] if x.parent >= 0 else 0
        out[i] = pick[i][ctx]
        context[i] = ctx if out[i] == _NONE else _BELOW[out[i]]
    last: int | None = None
    for i, x in enumerate(nodes):  # signs are shared by neighbouring spans
        if x.span is None or out[i] != _FORMULA:
            continue
        if last is not None and nodes[last].parent == x.parent and nodes[last].span[1] > x.span[0]:
            if logp[last][_FORMULA] >= logp[i][_FORMULA]:
                out[i] = _NONE
                continue
            out[last] = _NONE
        last = i
    return out


#: Texts whose nodes are scored together.
CHUNK = 256


class Decoder:
    """Applies a model to texts; nodes with equal features are scored once, new ones of many texts together."""

    def __init__(self, model: BoostedTrees) -> None:
        self.model = model
        self.known: dict[bytes, list[float]] = {b"": _PLAIN_SCORE}

    def each(self, texts: Sequence[str]) -> Iterator[tuple[list[int], list[Node]]]:
        """The kinds of the nodes of each text, and the nodes."""
        for k in range(0, len(texts), CHUNK):
            parsed = [parse(t) for t in texts[k : k + CHUNK]]
            keys = [[b"" if x.family in _PLAIN else bytes(features(x, nodes)) for x in nodes] for nodes in parsed]
            if len(self.known) > 500_000:
                self.known = {b"": _PLAIN_SCORE}
            new = list({x for ks in keys for x in ks if x not in self.known})
            if new:
                got = self.model.log_probabilities(np.frombuffer(b"".join(new), dtype=np.uint8).reshape(len(new), -1))
                self.known.update(zip(new, got.tolist()))
            for nodes, ks in zip(parsed, keys):
                yield decode(nodes, [self.known[x] for x in ks]), nodes

    def __call__(self, text: str) -> tuple[list[int], list[Node]]:
        return next(self.each([text]))


def sample_texts(docs: DataFrame, limit: int = SAMPLE) -> list[str]:
    """The texts of the documents with the smallest hashes of their ids: the bounded sample that is labelled."""
    hashed = docs.filter("text is not null").withColumn("_h", F.xxhash64("id"))
    last = hashed.select("_h").orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]  # hashes only: no text but the sample's reaches the driver
    if last is None:
        return []
    return [r["text"] for r in hashed.filter(F.col("_h") <= F.lit(last)).select("_h", "text").orderBy("_h", "text").limit(limit).collect()]


def pieces(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``id, piece, content`` of all headings, items, code blocks and formulas of documents ``id, text``, without repeats."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample_texts(docs, limit)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(held.value)
        for b in batches:
            rows: dict[tuple, None] = {}
            held_ = [(i, t) for i, t in zip(b["id"], b["text"]) if t and not t.isspace()]
            for (i, _), found in zip(held_, decoder.each([t for _, t in held_])):
                for k, x in zip(*found):
                    if k and (c := piece(KINDS[k], x)):
                        rows[(i, KINDS[k], c)] = None
            yield pd.DataFrame(list(rows), columns=["id", "piece", "content"])

    return docs.filter("text is not null").select("id", "text").mapInPandas(filled(run), "id long, piece string, content string").distinct()


def cleaned(kinds: list[int], nodes: list[Node]) -> str:
    """A decoded text in plain form: a line for a heading, dashes before items, code between fences, formulas between dollar signs. No text is left out."""
    spans: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        if x.span is not None and kinds[i] == _FORMULA:
            spans.setdefault(x.parent, []).append(i)

    def running(i: int) -> str:
        """The content of a node, cleaned around its formulas."""
        content = nodes[i].content
        kept, out, at = [], [], 0
        for j in spans.get(i, ()):
            a, b = nodes[j].span
            out += [content[at:a], f"\ue000{len(kept)}\ue001"]
            sign = "$" if nodes[j].family in ("dollar", "paren", "math") else "$$"
            kept.append(f"{sign}{piece('formula', nodes[j])}{sign}")
            at = b
        t = clean("".join([*out, content[at:]]))
        return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else m.group(), t)

    out: list[str] = []
    before = ""
    for i, (k, x) in enumerate(zip(kinds, nodes)):
        if x.span is not None or x.family == "box" or x.coded and any(kinds[p] == _CODE for p in _above(nodes, i)):
            continue
        kind = "item" if k == _ITEM else "row" if x.family == "row" else KINDS[k]
        if k == _CODE:
            body = unescape(x.content) if x.family == "pre" else x.content
            t = f"```\n{body}\n```"
        elif k == _FORMULA:
            t = f"$${piece('formula', x)}$$"
        elif k == _NONE and x.family == "ordered" and x.facts.get("glued"):
            continue  # its line is kept in its paragraph
        elif k == _NONE and x.family in CODES and x.facts.get("closed", 1) == 0:
            t = "\n".join(x.content.split("\n"))
        else:
            t = running(i)
            if k == _ITEM and t:
                t = "  " * sum(kinds[p] == _ITEM for p in _above(nodes, i)) + "- " + t
        if t:
            if out and kind == before and kind in ("item", "row"):
                out[-1] += "\n" + t
            else:
                out.append(t)
        before = kind
    return "\n\n".join(out)


def _above(nodes: list[Node], i: int) -> Iterator[int]:
    while (i := nodes[i].parent) >= 0:
        yield i


def clean_texts(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``id, text``: every document as clean text."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample_texts(docs, limit)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(held.value)
        for b in batches:
            full = [t for t in b["text"] if t and not t.isspace()]
            done = iter([cleaned(*found) for found in decoder.each(full)])
            yield b.assign(text=[next(done) if t and not t.isspace() else t for t in b["text"]])

    return docs.select("id", "text").mapInPandas(filled(run), "id long, text string")


# --- addresses with remains of markup ---

_ADDRESS = re.compile(r"(?:(?:https?|ftps?|sftp)://|www\.)[^\s<>\"{}|\\^`]+$", re.I)
_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|nbsp|#\d{1,6}|#x[0-9a-fA-F]{1,6});")
_TEX = [(re.compile(r"\\textasciitilde\s*(?:\{\})?|\\~(?:\{\})?|\$\\sim\$|\\sim\b"), "~"), (re.compile(r"\\([_&%#$~{}])"), r"\1")]
#: Layers of markup by family, each with what stands within it.
LAYERS = [
    ("template", re.compile(r"^\{\{.*?\burl\s*=\s*([^|}\s]+).*\}\}$", re.S)),
    ("anchor", re.compile(r"^<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>.*$", re.I | re.S)),
    ("link", re.compile(r"^!?\[[^\]]*\]\(\s*<?(.*?)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)$", re.S)),
    ("link", re.compile(r"^\]\(\s*(.*?)\s*\)?$", re.S)),
    ("definition", re.compile(r"^\[[^\]]*\]:\s*<?(\S+?)>?(?:\s.*)?$", re.S)),
    ("bracket", re.compile(r"^\[((?:https?|ftp)://\S+|www\.\S+)(?:\s[^\]]*)?\]$", re.I)),
    ("command", re.compile(r"^\(?\\footnote\{(.*)\}\)?$", re.S)),
    ("command", re.compile(r"^\\href\s*\{((?:[^{}]|\{[^{}]*\})*)\}\s*(?:\{.*\})?$", re.S)),
    ("command", re.compile(r"^\\(?:url|texttt|path|nolinkurl|emph|textit|textbf)\s*\{(.*)\}$", re.S)),
    ("command", re.compile(r"^\{\\\w+\s+(.*)\}$", re.S)),
    ("element", re.compile(r"^<(ref|code|p|b|i|em|strong|span|tt|li|td|u|cite|q|sup|sub)\b[^>]*>(.*?)</\1>$", re.I | re.S)),
    ("angle", re.compile(r"^<((?:https?|ftp)://[^<>]*|www\.[^<>]*)>$", re.I)),
    ("tags", re.compile(r"^(.*?)(?:</?[A-Za-z][^<>]*>)+$", re.S)),
    ("tags", re.compile(r"^(?:</?[A-Za-z][^<>]*>)+(.*)$", re.S)),
    ("quotes", re.compile(r"^'{2,5}(.*?)'{2,5}$", re.S)),
    ("stars", re.compile(r"^(\*{1,3})(.*)\1$", re.S)),
    ("strokes", re.compile(r"^(_{1,2})(.*)\1$", re.S)),
    ("ticks", re.compile(r"^`+(.*?)`+$", re.S)),
]
_LAYER = {f: k for k, f in enumerate(dict.fromkeys(["field", "escapes", *[f for f, _ in LAYERS]]))}


def layers(field: str) -> list[tuple[str, str]]:
    """The nodes of a field from the outermost: ``(family, what stands within)``. Every layer takes something off, so that there are no more than characters."""
    s = field.strip()
    out = [("field", s)]
    while True:
        t = _ENTITY.sub(lambda m: unescape(m.group()), s).strip() if "&" in s else s
        for p, r in _TEX if "\\" in t or "$" in t else ():
            t = p.sub(r, t)
        if t != s:
            out.append(("escapes", t))
            s = t
            continue
        for family, p in LAYERS:
            m = p.match(s)
            if m:
                inner = next(g for g in reversed(m.groups()) if g is not None).strip()
                if len(inner) < len(s):
                    out.append((family, inner))
                    s = inner
                    break
        else:
            return out


def layer_features(chain: list[tuple[str, str]], i: int) -> list[int]:
    """Small integers: the layer above and the one below, depth, how much of the field is left, and the form of what is."""
    s = chain[i][1]
    n = max(1, len(s))
    below = chain[i + 1] if i + 1 < len(chain) else None
    return [
        _LAYER[chain[i][0]],
        _LAYER[below[0]] + 1 if below else 0,
        min(15, i),
        min(15, len(chain) - 1 - i),
        min(15, 16 * n // max(1, len(chain[0][1]))),
        0 if below is None else 1 + min(14, 15 * len(below[1]) // n),
        int(_ADDRESS.match(s) is not None),
        0 if below is None else 1 + int(_ADDRESS.match(below[1]) is not None),
        int(s[:1].isalnum()),
        int(s[-1:].isalnum() or s[-1:] == "/"),
        min(15, sum(c in "<>{}\\`|^" for c in s)),
        min(15, sum(c in "[]()*_'" for c in s)),
        min(15, sum(c.isspace() for c in s)),
        min(15, s.count("://") + s.lower().count("www.")),
        int(_ENTITY.search(s) is not None),
        min(15, n // 8),
    ]


def layer_label(chain: list[tuple[str, str]]) -> int | None:
    """Which node of a field is surely the address: the innermost, where nothing but an address is left."""
    return len(chain) - 1 if _ADDRESS.match(chain[-1][1]) else None


def fit_layers(fields: list[str]) -> BoostedTrees:
    """Trees that tell the address among the nodes of a field."""
    rows, kinds = [], []
    for f in fields:
        chain = layers(f)
        y = layer_label(chain)
        if y is not None:
            for i in range(len(chain)):
                rows.append(layer_features(chain, i))
                kinds.append(int(i == y))
    model = BoostedTrees(2)
    return model.fit(np.array(rows, dtype=np.uint8), np.array(kinds)) if rows else model


def bare_addresses(fields: Sequence[str], model: BoostedTrees) -> list[str]:
    """The address in each field without markup around it and escapes in it: the node the model holds likeliest, one of a path; the innermost of equals."""
    chains = [layers(f) for f in fields]
    keys = [[bytes(layer_features(chain, i)) for i in range(len(chain))] if len(chain) > 1 else [] for chain in chains]
    new = list({k for ks in keys for k in ks})
    score = {}
    if new:
        got = model.log_probabilities(np.frombuffer(b"".join(new), dtype=np.uint8).reshape(len(new), -1))
        score = dict(zip(new, (got[:, 1] - got[:, 0]).tolist()))
    return [chain[max(range(len(ks)), key=lambda i: (score[ks[i]], i)) if ks else 0][1] for chain, ks in zip(chains, keys)]


def marked_addresses(df: DataFrame, id_col: str, col: str, limit: int = FIELDS) -> DataFrame:
    """``id, content``: the bare address of every row whose field holds remains of markup, without repeats."""
    suspicious = F.col(col).rlike(r"[<>`\\{}*_'\[\]]|&[a-zA-Z#]")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("text")).filter(F.col("text").isNotNull() & suspicious).distinct()
    held = df.sparkSession.sparkContext.broadcast(fit_layers(sample_texts(rows, limit)))

    @F.pandas_udf(StringType())
    def bare(s: pd.Series) -> pd.Series:
        return pd.Series(bare_addresses(list(s), held.value), dtype="object")

    return rows.withColumn("content", bare("text")).filter((F.col("content") != F.trim("text")) & (F.col("content") != "")).select("id", "content").distinct()
