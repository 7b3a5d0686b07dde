"""Addresses: the grammars that find them, cleaning, and the canonical forms that evaluation joins on.

Everything is a column expression on Java regular expressions, so it stays in generated code. ``parse_url`` isn't used: it
fails on what these fields hold. Inputs are text in NFKC where a function says ``plain``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.text import TILDES, fold, fold_rare, nfkc

# The ends of host names that are read without a scheme, and what blanks in broken addresses stand before.
_TLD = "com|org|net|edu|gov|info|io|ai|uk|de|fr|jp|cn|au|ca|nl|es|it|se|ch|eu|int|mil"
# The grammars of addresses in the reference's fields and texts, each with one capturing group.
GRAMMARS = {
    "field": r"""(?i)\b((?:https?|s?ftps?|sftp|s3|gs|az)://[^\s\]\[<>"']+|www\.[^\s\]\[<>"']+|doi:\s*[^\s\]\[<>"'(),;|]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,10}(?::\d+)?(?:/[^\s\]\[<>"'|]*)?|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/[^\s\]\[<>"'|]*)?)""",
    "field_mllm": r"""(?i)\b(https?://[^\s\]\[<>"']+|www\.[^\s\]\[<>"']+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::\d+)?(?:/[^\s\]\[<>"']*)?|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/[^\s\]\[<>"']*)?)""",
    "explicit": r"""(?i)\b(https?://[^\s\]\[<>"']+|www\.[^\s\]\[<>"']+)""",
    "tei": r"""(?i)(\b(?:https?://|ftp://|www\.)[^\s<>()\[\]{}"'`]+|(?:\bdoi\s*:\s*)?\b10\.\d{4,9}/[^\s<>()\[\]{}"'`]+)""",
    "note": r"""(?i)(https?://[^\s<>\[\](){}"'`,;]+|ftp://[^\s<>\[\](){}"'`,;]+|(?<![A-Za-z0-9])www\.[^\s<>\[\](){}"'`,;]+|(?<![A-Za-z])doi:\s?10\.\d+/[^\s<>\[\](){}"'`,;]+|(?<![A-Za-z])arxiv:\s?\d{4}\.\d{4,5}(?:v\d+)?|(?<![A-Za-z/.])(?:github\.com|gitlab\.com|bitbucket\.org)/[^\s<>\[\](){}"'`,;]+)""",
    "layout": r"""(?i)((?:https?|ftps?|sftp|s3|gs|az)\s*:?\s*//[^\s<>"')\]}]+|(?:doi:|(?:https?://)?(?:dx\.)?doi\.org/)10\.\d{3,}/[^\s<>"')\]}]+|www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>"')\]}]*)?|(?<![A-Za-z0-9])10\.\d{4,}/[^\s<>"')\]}]{3,})""",
    "markdown": rf"""(?i)(?<![\w@])((?:https?|ftp|ftps|sftp|s3|gs|az)\s*:?\s*/\s*/\s*[^\s<>{{}}\[\]"'`]+|www\.[^\s<>{{}}\[\]"'`]+|doi\s*:\s*10\.\d{{4,9}}/[^\s<>{{}}\[\]"'`]+|10\.\d{{4,9}}/[^\s<>{{}}\[\]"'`]+|(?:(?:github|gitlab|bitbucket)\.com|arxiv\.org|doi\.org)/[^\s<>{{}}\[\]"'`]+|(?:[A-Za-z0-9][A-Za-z0-9-]{{0,62}}\.)+(?:{_TLD})\b(?:/[^\s<>{{}}\[\]"'`]*)?)""",
    "reference": r"""(?i)(https?://[^\s\]\[<>"']+|doi\.org/[^\s\]\[<>"']+|doi:\s*10\.\d{4,}/[^\s\]\[<>"']+)""",
}
# What a new address begins with, after a comma in a field.
_NEXT = r"(?:https?://|s?ftp://|sftp://|s3://|gs://|az://|www\.|doi:|DOI:|10\.\d{4,9}/|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,10}|\d{1,3}(?:\.\d{1,3}){3})"
_NEXT_MLLM = r"(?:https?://|www\.|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|\d{1,3}(?:\.\d{1,3}){3})"
# Hosts that gold doesn't count, and the boilerplate of page footers.
BOILERPLATE_HOST = r"(?i)(orcid\.org|creativecommons\.org|crossmark|/?mailto:|(?:^|[^a-z])tel:|javascript:)"
BOILERPLATE_LAYOUT = r"(?i)^(?:https?://creativecommons\.org/licenses/?\S*|(?:https?://)?(?:www\.)?springerlink\.com/?|https?://link\.springer\.com/?|https?://(?:www\.)?(?:ieee|acm|arxiv|w3)\.org/?|(?:doi:|https?://(?:dx\.)?doi\.org/|https?://doi\.acm\.org/)?10\.1145/0+\.0+|https?://(?:www\.)?example\.(?:com|org|net)(?:/\S*)?)$"
BAD_REFERENCE = r"(?i)creativecommons\.org|crossmark\.crossref\.org|orcid\.org|crossref\.org/dialog|biomedcentral\.com/\d{4}-\d+/\d+/\d+$|springer\.com/article/.*$|journals\.plos\.org/.*article/asset"
_GAP = r"(?U)(?<=\w)\s+(?=[/?#&=:%._~\-])"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: expressions of regular expressions multiply otherwise."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def at_once(value: Column, use) -> Column:
    """``use(value)`` as it stands: outside of lambdas generated code finds what is common, and Python functions may be anywhere."""
    return use(value)


def find_all(c: Column, grammar: str) -> Column:
    """The matches of a grammar, in order."""
    return F.regexp_extract_all(c, F.lit(GRAMMARS[grammar]), F.lit(1))


def repair_spacing(plain: Column, mllm: bool = False) -> Column:
    """Blanks that conversion put into addresses taken out; TeX tildes resolved (not for ``mllm``)."""
    s = plain
    if not mllm:
        for p in (r"\$\s*\\sim\s*\$", r"\{\s*\\sim\s*\}", r"\\sim(?![A-Za-z])", r"\\~", f"[{TILDES}]"):
            s = F.regexp_replace(s, p, "~")
    s = F.regexp_replace(s, r"(?i)\b(https?)\s*:\s*/\s*/", "$1://")
    if not mllm:
        s = F.regexp_replace(s, r"(?i)\b(s?ftps?|sftp|s3|gs|az)\s*:\s*/\s*/", "$1://")
    s = F.regexp_replace(s, r"(?i)\bwww\.\s+", "www.")
    if not mllm:
        s = F.regexp_replace(s, r"(?i)\bdoi:\s+", "doi:")
    for p in (_GAP, r"(?U)(?<=[/?#&=:%._~\-])\s+(?=\w)", r"(?U)(?<=\.)\s+(?=\w)", r"(?U)(?<=\w)\s+(?=\.)"):
        s = F.regexp_replace(s, p, "")
    return s


_WRAPPED = r"(?s)^\s*(?:\[(.*)\]|\((.*)\)|\{(.*)\}|<(.*)>|\"(.*)\"|'(.*)'|`(.*)`)\s*$"


def _unwrapped(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WRAPPED, "$1$2$3$4$5$6$7"))


def strip_wrappers(c: Column, depth: int | None = None) -> Column:
    """Pairs of brackets or quotes around the whole taken off, up to ``depth`` of them, or all."""
    if depth is not None:
        for _ in range(depth):
            c = _unwrapped(c)
        return c
    # there are no more pairs than characters that may open one
    opened = F.length(F.regexp_extract(c, r"^([\s\[({<\"'`]*)", 1))
    return F.when(opened > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), c, lambda acc, _: _unwrapped(acc))).otherwise(F.trim(c))


_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_NUMERIC_HOST = r"^(?:[^@]*@)?\[[0-9A-Fa-f:.]+\](?::\d*)?$"


def _canonical_parts(u: Column, scheme: str, bind) -> Column:
    """``host/path?query`` in lower case: no scheme, fragment, www., doubled or final slash. Port and user stay."""

    def of(full: Column) -> Column:
        path = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(full, _PARTS, 2), "/{2,}", "/"), "/+$", ""))

        def join(p: Column) -> Column:
            query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
            whole = F.regexp_replace(F.concat(F.regexp_replace(F.lower(p["host"]), r"^www\.", ""), p["path"], query), "^/+", "")
            # brackets in a host are for numeric addresses only; anything else can't be taken apart
            return F.when(p["host"].rlike(r"[\[\]]") & ~p["host"].rlike(_NUMERIC_HOST), F.regexp_replace(F.lower(u), "/+$", "")).otherwise(whole)

        return bind(F.struct(F.regexp_extract(full, _PARTS, 1).alias("host"), path.alias("path"), F.lower(F.regexp_extract(full, _PARTS, 3)).alias("query")), join)

    return bind(F.when(u.rlike(scheme), u).otherwise(F.concat(F.lit("http://"), u)), of)


def canonical_plain(plain: Column, bind=let) -> Column:
    """The canonical form of the exact evaluators, of text in NFKC; empty for what holds nothing."""
    u = strip_wrappers(fold(repair_spacing(fold(plain))))
    u = F.trim(F.regexp_replace(F.trim(F.regexp_replace(u, r"^[,; ]+|[,; ]+$", "")), r"^['\"]+|['\"]+$", ""))
    u = F.trim(F.regexp_replace(u, r"(?:[.,;:)\]}>\"'`]\s*)+$", ""))
    u = F.regexp_replace(u, r"(?i)^doi:\s*https?://(?:dx\.)?doi\.org/", "doi:")
    u = F.regexp_replace(u, r"(?i)^https?://(?:dx\.)?doi\.org/", "doi:")
    u = F.regexp_replace(u, r"(?U)\s+", "")
    doi = lambda x: F.concat(F.lit("doi:"), F.regexp_replace(F.lower(F.regexp_replace(x, r"(?i)^doi:", "")), "/+$", ""))
    return bind(u, lambda x: F.when(x == "", x).when(x.rlike(r"(?i)^(?:doi:|10\.\d{4,9}/)"), doi(x)).otherwise(_canonical_parts(x, r"(?i)^[a-z][a-z0-9+.\-]*://", bind)))


def canonical_mllm_plain(plain: Column, bind=let) -> Column:
    """The canonical form of the evaluator of model output: no DOI folding, only http(s) is a scheme."""
    # without blanks there is no spacing to repair
    u = bind(fold_rare(plain, tildes=True), lambda x: F.when(x.rlike(r"(?U)\s"), repair_spacing(x, mllm=True)).otherwise(x))
    u = F.trim(F.regexp_replace(u, r"(?i)\[last visit:[^\]]*$", ""))
    u = F.regexp_replace(F.regexp_replace(u, r"^[\[\](){}<>\"'`]+|[\[\](){}<>\"'`]+$", ""), r"[.,;:)\]}>]+$", "")
    u = F.regexp_replace(u, r"(?U)\s+", "")
    return bind(u, lambda x: F.when(x == "", x).otherwise(_canonical_parts(x, r"(?i)^https?://", bind)))


def canonical_url(c: Column, variant: str = "exact") -> Column:
    """The canonical form of one address; null becomes empty."""
    plain = nfkc(F.coalesce(c.cast("string"), F.lit("")))
    return canonical_plain(plain, at_once) if variant == "exact" else canonical_mllm_plain(plain, at_once)


def split_field_plain(plain: Column) -> Column:
    """The chunks of a field: between bars, and at commas before what begins an address."""
    raw = F.trim(repair_spacing(fold(plain)))
    raw = let(raw, lambda r: F.when(r.rlike(r"(?s)^\[.*\]$"), F.trim(F.substring(r, F.lit(2), F.length(r) - 2))).otherwise(r))
    chunks = F.flatten(F.transform(F.split(raw, r"\|"), lambda p: F.split(p, r",\s*(?=" + _NEXT + ")")))
    return F.filter(F.transform(chunks, lambda x: F.trim(x)), lambda x: x != "")


def split_field_mllm_plain(plain: Column, side: str) -> Column:
    raw = repair_spacing(fold_rare(plain, tildes=True), mllm=True)
    chunks = F.split(raw, r"\|") if side == "pred" else F.split(raw, r",\s*(?=" + _NEXT_MLLM + ")")
    return F.filter(F.transform(chunks, lambda x: F.trim(x)) if side == "pred" else chunks, lambda x: x != "")


def _found_or_whole(chunks: Column, grammar: str, canonical) -> Column:
    def of(chunk: Column) -> Column:
        found = F.filter(F.transform(find_all(chunk, grammar), lambda x: canonical(x)), lambda x: x != "")
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(F.array(canonical(chunk)), lambda x: x != "")))

    return F.array_distinct(F.flatten(F.transform(chunks, of)))


def url_set(c: Column) -> Column:
    """The distinct canonical addresses of a field (exact evaluators), sorted."""
    plain = nfkc(F.coalesce(c.cast("string"), F.lit("")))
    return F.array_sort(_found_or_whole(split_field_plain(plain), "field", canonical_plain))


def url_list_mllm(c: Column, side: str, target: Column | None = None) -> Column:
    """The distinct canonical addresses of a field and, where given, those printed in the sentence ``target``; in order."""
    plain = nfkc(F.coalesce(c.cast("string"), F.lit("")))
    out = _found_or_whole(split_field_mllm_plain(plain, side), "field_mllm", canonical_mllm_plain)
    if target is not None:
        text = repair_spacing(fold_rare(nfkc(F.coalesce(target, F.lit(""))), tildes=True), mllm=True)
        out = F.concat(out, F.filter(F.transform(find_all(text, "explicit"), lambda x: canonical_mllm_plain(x)), lambda x: x != ""))
    return F.array_distinct(out)


def compare_key(c: Column) -> Column:
    """A light key: wrappers and final punctuation off, blanks out, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[<\[({\"']+|[>\])}\"']+$", ""), r"[.,;:]+$", ""), r"(?U)\s+|%29$", ""))


def repair_scheme(c: Column) -> Column:
    """``HTTP : //x`` becomes ``http://x`` for known schemes."""
    p = r"(?i)^\s*(https?|ftps?|sftp|s3|gs|az)\s*:?\s*/\s*/\s*"
    return let(c, lambda x: F.when(x.rlike(p), F.concat(F.lower(F.regexp_extract(x, p, 1)), F.lit("://"), F.regexp_replace(x, p, ""))).otherwise(x))


def _balanced(u: Column) -> Column:
    """Final closing parentheses off while there are more than opening ones."""
    count = lambda x, p: F.length(F.regexp_replace(x, p, ""))
    for _ in range(3):
        u = let(u, lambda x: F.when(x.endswith(")") & (count(x, r"[^)]") > count(x, r"[^(]")), F.regexp_replace(x, r"\)$", "")).otherwise(x))
    return u


def clean_url(c: Column, dialect: str = "markdown") -> Column:
    """The printed address of a dialect, without wrappers and final punctuation."""
    u = F.trim(F.coalesce(c, F.lit("")))
    if dialect == "markdown":
        u = F.regexp_replace(repair_scheme(u), r"(?i)^doi\s*:\s*", "doi:")
        u = F.regexp_replace(u, r"^[<>\[\]{}\"'`]+|[<>\[\]{}\"'`]+$", "")
        return _balanced(F.regexp_replace(u, r"[.,;:!?'\"”’]+$", ""))
    if dialect == "tei":
        u = F.regexp_replace(F.regexp_replace(u, r"^[<\[{\"']+|[>\]}\"']+$", ""), r"[.,;:]+$", "")
        return F.when(u.endswith(")") & ~u.contains("("), F.regexp_replace(u, r"\)$", "")).otherwise(u)
    if dialect == "note":
        u = F.regexp_replace(strip_wrappers(u, 1), r"[.,;:]+$", "")
        return F.when(~u.contains("("), F.regexp_replace(u, r"\)+$", "")).otherwise(u)
    if dialect == "layout":
        return F.regexp_replace(repair_scheme(u), r"[.,;:)\]}>\"'!?’”]+$", "")
    if dialect == "reference":
        return F.regexp_replace(F.regexp_replace(u, r"(?i)\.\s*Accessed\b.*$", ""), r"[.,;:)\]}>\"']+$", "")
    if dialect == "mllm":
        inner = strip_wrappers(u, 2)
        return F.regexp_replace(F.when(looks_like_url(inner), inner).otherwise(u), r"[.,;:]+$", "")
    raise ValueError(dialect)


def looks_like_url(c: Column) -> Column:
    return c.rlike(r"^\S+$") & (c.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://") | c.contains("."))


def is_web_url(c: Column) -> Column:
    """Whether a reference's address is one of the web: no identifiers such as arxiv: or doi:."""
    return c.rlike(rf"(?i)^(?:(?:https?|ftp)://\S+|www\.\S+|(?:github|gitlab|bitbucket)\.(?:com|org)/\S+|(?:arxiv|doi)\.org/\S+|(?:[a-z0-9-]+\.)+(?:{_TLD})(?:/\S*)?)$") & ~c.rlike(r"(?i)^(?:arxiv:|doi:|astro-ph/)")


def distinct_web_urls(urls: Column) -> Column:
    """The web addresses of an array, distinct whatever their case, in order of appearance."""
    kept = F.filter(F.transform(urls, lambda u: clean_url(u, "markdown")), is_web_url)
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, u: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(u)), acc).otherwise(F.concat(acc, F.array(u))))


def urls_in_text(c: Column, grammar: str = "markdown", dialect: str = "markdown") -> Column:
    """Cleaned distinct addresses printed in a text, without mail and script schemes and without hosts of e-mail addresses."""
    text = F.when(c.contains("@"), F.regexp_replace(c, r"[\w.+-]+@[\w.-]+", " ")).otherwise(c)
    found = F.transform(find_all(text, grammar), lambda u: clean_url(u, dialect))
    kept = F.filter(found, lambda u: (u != "") & ~u.rlike(r"(?i)^(?:mailto|tel|javascript|data|file):"))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, u: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(u)), acc).otherwise(F.concat(acc, F.array(u))))


def prefer_longer(urls: Column) -> Column:
    """Without addresses that another one contains and exceeds by three characters or more."""
    return F.filter(urls, lambda a: ~F.exists(urls, lambda b: b.contains(a) & (F.length(b) >= F.length(a) + 3)))


def best_url(urls: Column) -> Column:
    """A DOI address before one of a literature database before the first; null for none."""
    first = lambda p: F.try_element_at(F.filter(urls, lambda u: u.rlike(p)), F.lit(1))
    return F.coalesce(first(r"(?i)doi\.org"), first(r"(?i)ncbi|pubmed"), F.try_element_at(urls, F.lit(1)))


def recover_wrapped(c: Column, passes: int = 5) -> Column:
    """Addresses broken at the end of a line after one of ``/-~=?&%_.,`` put together again."""
    for _ in range(passes):
        c = F.regexp_replace(c, r"(?i)((?:https?://|www\.)[^\s]*[/\-~=?&%_.,])\n[ \t]*(?=[^\s])", "$1")
    return c


def is_truncated(c: Column) -> Column:
    """A scheme alone, ``http://ww.``, or a host of fewer than three letters and digits."""
    host = F.regexp_extract(c, r"(?i)^(?:https?|ftps?|sftp)://([^/?#]+)", 1)
    return c.rlike(r"(?i)^(?:https?|ftps?|sftp|s3|gs|az)://(?:www\.?)?$|^https?://w{2,3}\.?$") | ((host != "") & (F.length(F.regexp_replace(host, "[.-]", "")) < 3))


def in_page(url: Column, page: Column) -> Column:
    """Whether a page's text holds an address, by letters and digits alone (8 at least)."""
    from linkweave.functions.text import squash

    return (F.length(squash(url)) >= 8) & squash(page).contains(squash(url))


def boilerplate_of_set(url: Column) -> Column:
    """Whether a canonical address is of a host that gold doesn't count."""
    return F.coalesce(url.rlike(BOILERPLATE_HOST), F.lit(False))
