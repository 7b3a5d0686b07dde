"""Queries that apply one operator on columns to a whole table, each with SQL that gives the same rows.

DuckDB's regular expressions know no lookaround and no Unicode classes by flag; where a pattern of an operator has neither, the SQL takes it from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import paper_ids, text, urls
from linkweave.operators import citations as cite
from linkweave.operators import predicates as is_
from linkweave.operators import regions
from linkweave.plans.oracle import _REFERENCE, _S, _parts, _q, _rows, nfkc, repair, ws
from linkweave.plans.oracle import fold as fold_sql
from linkweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sub(c: str, p: str, to: str = "") -> str:
    return f"regexp_replace({c}, {_q(p)}, {_q(to)}, 'g')"


def _is(c: str, p: str) -> str:
    return f"regexp_matches({c}, {_q(p)})"


def _count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, {_q(p)}))"


def form(name: str, source: str, key: str, column: str, spark_columns: dict[str, Callable[[Column], Column]], sql_columns: dict[str, str], where: str = "") -> None:
    """Register query ``name``: the columns over ``column`` (``c`` in the SQL) of every distinct row of a table."""
    where = where or f"{column} is not null"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = table(spark, sf, source).filter(where)
        return d.select(key, *[f(F.col(column)).alias(a) for a, f in spark_columns.items()]).distinct()

    QUERIES[name] = run
    ORACLE_SQL[name] = f"select distinct {key}, {', '.join(f'{sql} as {a}' for a, sql in sql_columns.items())} from (select {key}, {column} as c from {source} where {where})"


# --- text ---


def _ligatures(c: str) -> str:
    for a, b in text.LIGATURES:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return _sub(_sub(c, f"[{text.INVISIBLE}]"), f"[{text.BLANKS}]", " ")


def _entities(c: str) -> str:
    """The entities that the tables hold, the ampersand's last."""
    for name, to in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        c = f"replace({c}, '&{name};', {_q(to)})"
    return c


_TIDY = f"array_to_string(list_transform(string_split(c, chr(10)), lambda x: regexp_extract(x, '^([ \\t]*)', 1) || {ws('x')}), chr(10))"
_UNFENCED = "array_to_string(list_transform(string_split(c, chr(10)), lambda x, i: case when starts_with(x, '```') or len(list_filter(string_split(c, chr(10))[:i - 1], lambda y: starts_with(y, '```'))) % 2 = 1 then '' else x end), chr(10))"
_IMAGES = r"!\[[^\]\n]{0,300}\]\([^)\s]+(?:\)[^\s.,;:]*)?\)"


def _rejoined(hyphen: str) -> str:
    return f"""list_reduce(list_prepend('', list_transform(string_split(c, chr(10)), lambda x: trim(x))),
      lambda acc, x: case when x = '' then acc when acc = '' then x when {hyphen} then acc[:-2] || x else acc || ' ' || x end)"""


form("text_plain_chars", "documents", "doc_id", "text", {"plain": lambda c: text.normalize_chars(c, dashes=True)}, {"plain": _sub(_entities(_sub(_ligatures("c"), f"[{text.DASHES}]", "-")), r"\r\n?", "\n")})
form("text_match_key", "documents", "doc_id", "text", {"key": text.match_key}, {"key": f"lower({ws(_sub(_ligatures('c'), '[' + text.DASHES + ']', '-'))})"})
form("text_without_controls", "documents", "doc_id", "text", {"plain": text.strip_control}, {"plain": _sub("c", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200D}\x{2060}\x{FEFF}]")})
form("text_tidy_lines", "md_file", "md_id", "text", {"tidy": text.squash_keep_lines}, {"tidy": _sub(_TIDY, r"\n(?:[ \t]*\n){2,}", "\n\n")})
form("text_squashed", "documents", "doc_id", "text", {"squashed": text.squash}, {"squashed": _sub("lower(c)", "[^a-z0-9]")})
form("text_raised_digits", "footnote", "footnote_id", "marker", {"raised": text.raised_digits, "plain": text.plain_digits}, {"raised": f"translate(c, '{text.DIGITS}', '{text.SUPERSCRIPTS}')", "plain": f"translate(c, '{text.SUPERSCRIPTS}', '{text.DIGITS}')"})
form("text_untagged", "documents", "doc_id", "text", {"untagged": lambda c: text.strip_tags(F.regexp_replace(c, r"\[(\d+)\]", "[CITE:b$1]"))}, {"untagged": ws(_sub(_sub("c", r"\[(\d+)\]", r"[CITE:b\1]"), r"\[CITE:[^\]]*\]", " "))})
form("text_unlinked", "md_file", "md_id", "text", {"unlinked": text.unwrap_links}, {"unlinked": _sub(_sub("c", _IMAGES), text.MD_LINK, r"\1")})
form("text_unfenced", "md_file", "md_id", "text", {"unfenced": text.strip_fences}, {"unfenced": _UNFENCED})
form(
    "text_rejoined", "md_file", "md_id", "text",
    {"plain": lambda c: text.rejoin_lines(F.split(c, "\n")), "guarded": lambda c: text.rejoin_lines(F.split(c, "\n"), guarded=True)},
    {"plain": _rejoined("ends_with(acc, '-')"), "guarded": _rejoined(r"regexp_matches(acc, '\p{L}-$') and regexp_matches(x, '^\p{Ll}')")},
)


def text_first_filled(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "pmc_footnote_gold")
    return g.select("row_id", text.first_filled(F.col("label"), F.col("split"), F.col("location")).alias("first"), text.pick_column(["uri", "url", "file"], g.columns).alias("picked"))


QUERIES["text_first_filled"] = text_first_filled
ORACLE_SQL["text_first_filled"] = "select row_id, coalesce(nullif(trim(label), ''), nullif(trim(split), ''), nullif(trim(location), ''), '') as first, coalesce(url, '') as picked from pmc_footnote_gold"
_PIPED = "list_concat(string_split(concat_ws('|', location, split), '|'), string_split(coalesce(split, ''), '|'))"
ORACLE_SQL["piped_contexts"] = f"select row_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' | ') as merged from (select row_id, list_filter(list_transform({_PIPED}, lambda x: trim(x)), lambda x: x <> '') as l from pmc_footnote_gold)"

# --- addresses ---

_SCHEME = r"(?i)^\s*(https?|ftps?|sftp|s3|gs|az)\s*:?\s*/\s*/\s*"
_WRAPPED = r"""(?s)^\s*(?:\[(.*)\]|\((.*)\)|\{(.*)\}|<(.*)>|"(.*)"|'(.*)'|`(.*)`)\s*$"""


def _schemed(c: str) -> str:
    return f"case when {_is(c, _SCHEME)} then lower(regexp_extract({c}, {_q(_SCHEME)}, 1)) || '://' || {_sub(c, _SCHEME)} else {c} end"


def _unwrapped(c: str) -> str:
    return f"trim({_sub(c, _WRAPPED, chr(92) + '1' + ''.join(chr(92) + str(k) for k in range(2, 8)))})"


_OFF = "case when ends_with(acc, ')') and length(replace(acc, ')', '')) < length(replace(acc, '(', '')) then acc[:-2] else acc end"
_BY_DIALECT = {
    "markdown": f"list_reduce([{_sub(_sub(_sub(_schemed('trim(c)'), r'(?i)^doi\s*:\s*', 'doi:'), '^[<>\\[\\]{}\"' + chr(39) + '`]+|[<>\\[\\]{}\"' + chr(39) + '`]+$'), '[.,;:!?' + chr(39) + '\"”’]+$')}, '', '', ''], lambda acc, x: {_OFF})",
    "tei": "case when ends_with(t, ')') and not contains(t, '(') then t[:-2] else t end",
    "note": "case when contains(n, '(') then n else regexp_replace(n, '\\)+$', '') end",
    "layout": _sub(_schemed("trim(c)"), "[.,;:)\\]}>\"'!?’”]+$"),
    "reference": _sub(_sub("trim(c)", r"(?i)\.\s*Accessed\b.*$"), "[.,;:)\\]}>\"']+$"),
}
_TEI = _sub(_sub("trim(c)", "^[<\\[{\"']+|[>\\]}\"']+$"), "[.,;:]+$")
_NOTE = _sub(_unwrapped("trim(c)"), "[.,;:]+$")
for _name, _sql in _BY_DIALECT.items():
    form(f"urls_clean_{_name}", "url_candidate", "cand_id", "url", {"clean": lambda c, d=_name: urls.clean_url(c, d)}, {"clean": _sql.replace("(t,", f"({_TEI},").replace("else t end", f"else {_TEI} end").replace("then t[", f"then ({_TEI})[") if _name == "tei" else f"(select {_sql} from (select {_NOTE} as n))" if _name == "note" else _sql})
form("urls_scheme", "url_candidate", "cand_id", "url", {"schemed": urls.repair_scheme}, {"schemed": _schemed("c")})
form("urls_compare_key", "url_candidate", "cand_id", "url", {"key": urls.compare_key}, {"key": f"lower({_sub(_sub(_sub('trim(c)', '^[<' + chr(92) + '[({' + chr(34) + chr(39) + ']+|[>' + chr(92) + '])}' + chr(34) + chr(39) + ']+$'), '[.,;:]+$'), _S + '+|%29$')})"})
form("urls_shape", "url_candidate", "cand_id", "url", {"shaped": urls.looks_like_url}, {"shaped": f"{_is('c', r'^\S+$')} and ({_is('c', r'(?i)^[a-z][a-z0-9+.\-]*://')} or contains(c, '.'))"})
form(
    "urls_of_web", "url_candidate", "cand_id", "url", {"web": urls.is_web_url},
    {"web": _is("c", rf"(?i)^(?:(?:https?|ftp)://\S+|www\.\S+|(?:github|gitlab|bitbucket)\.(?:com|org)/\S+|(?:arxiv|doi)\.org/\S+|(?:[a-z0-9-]+\.)+(?:{urls._TLD})(?:/\S*)?)$") + " and not " + _is("c", "(?i)^(?:arxiv:|doi:|astro-ph/)")},
)
_HOST = r"regexp_extract(c, '(?i)^(?:https?|ftps?|sftp)://([^/?#]+)', 1)"
form(
    "urls_truncated", "url_candidate", "cand_id", "url", {"truncated": urls.is_truncated},
    {"truncated": _is("c", r"(?i)^(?:https?|ftps?|sftp|s3|gs|az)://(?:www\.?)?$|^https?://w{2,3}\.?$") + f" or ({_HOST} <> '' and length({_sub(_HOST, '[.-]')}) < 3)"},
)
form("urls_excluded", "url_candidate", "cand_id", "url", {"reference": is_.bad_reference_url, "layout": is_.boilerplate_layout, "host": is_.boilerplate_host}, {"reference": _is("c", urls.BAD_REFERENCE) + " or c = ''", "layout": _is("c", urls.BOILERPLATE_LAYOUT), "host": _is("c", urls.BOILERPLATE_HOST)})
form("urls_unwrapped_all", "pmc_footnote_gold", "row_id", "url", {"bare": lambda c: urls.strip_wrappers(F.concat(F.lit("<{[('"), c, F.lit("')]}>")))}, {"bare": f"list_reduce(list_prepend(concat('<{{[(''', c, ''')]}}>'), list_transform(range(0, length(c) + 6), lambda i: '')), lambda acc, x: {_unwrapped('acc')})"})
for _grammar, _source, _key, _column in (("explicit", "documents", "doc_id", "text"), ("tei", "footnote", "footnote_id", "footnote_text"), ("reference", "reference_entry", "entry_id", "full_text"), ("field_mllm", "footnote", "footnote_id", "footnote_text")):
    form(f"urls_by_{_grammar}", _source, _key, _column, {"found": lambda c, g=_grammar: F.array_join(urls.find_all(c, g), "\n")}, {"found": f"array_to_string(regexp_extract_all(c, {_q(urls.GRAMMARS[_grammar])}, 1), chr(10))"})
form("paper_id_of_file", "md_file", "md_id", "file", {"id": paper_ids.from_file}, {"id": _sub(r"regexp_extract(c, '([^/\\]+)$', 1)", r"(?i)(?:\.tei)?\.(?:xml|json|md|txt|pdf)$")})


def urls_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the candidates of a paper stand in its texts, by letters and digits."""
    c = table(spark, sf, "url_candidate").filter("url is not null").select("cand_id", "paper_id", "url").distinct()
    m = table(spark, sf, "md_file").filter("text is not null").select("md_id", "paper_id", "text")
    return c.join(m, "paper_id").select("cand_id", "md_id", urls.in_page(F.col("url"), F.col("text")).alias("there"))


QUERIES["urls_on_page"] = urls_on_page
_SQUASH = lambda c: _sub(f"lower({c})", "[^a-z0-9]")
ORACLE_SQL["urls_on_page"] = f"select cand_id, md_id, length(k) >= 8 and contains({_SQUASH('text')}, k) as there from (select distinct cand_id, paper_id, {_SQUASH('url')} as k, url from url_candidate where url is not null) join (select md_id, paper_id, text from md_file where text is not null) using (paper_id)"


# --- lines and sentences ---

_MAIL, _NOTE_START = is_._EMAIL, rf"(?i)^\s*{is_._MARKER}\s*[:.)\-]?\s*"
_BIBLIOGRAPHIC = f"({_is('c', r'^\s*\d{1,4}[.)]\s+[A-Z][A-Za-z' + chr(39) + r'’`-]+\s+[A-Z]')} or {_is('c', r'\b(?:19|20)\d{2}[a-z]?\b')} and {_is('c', is_.VENUES)})"
_INITIALS = r"\b(?:[A-Z]\.\s?){1,3}[A-Z][a-zA-Z\-]+\b|\b[A-Z][a-zA-Z\-]+,\s?(?:[A-Z]\.\s?){1,3}"
FLAGS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "footer": (is_.publisher_footer, f"{ws('c')} = '' or {_is(ws('c'), is_.FOOTERS)} or ({_count(ws('c'), chr(92) + '|')} >= 2 and {_is(ws('c'), r'(?i)doi\.org|10\.\d{4,9}/|www\.')})"),
    "machine": (is_.machine_text, f"{ws('c')} = '' or {_is(ws('c'), is_.MACHINE)} or ({_count(ws('c'), '[A-Za-z]{3,}')} <= 2 and {_is(ws('c'), '[=;{}<>]')})"),
    "bibliographic": (is_.bibliographic_line, _BIBLIOGRAPHIC),
    "bibliographic_note": (is_.bibliographic_note, f"{_is('c', r'\b(?:19|20)\d{2}\b')} and ({_is('c', _INITIALS)} or {_is('c', is_.any_of(is_.NOTE_VENUES))})"),
    "entry": (is_.reference_entry_paragraph, f"{_is('c', r'^[ \t]*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.\s+[A-Z])')} and {_is('c', r'\b(?:19|20)\d{2}\b')}"),
    "layout_note": (is_.layout_footnote_line, _is("c", r"^[ \t]*(?:>\s*(?:\d{1,3}|[∗†‡*§¶])|\d{1,3}\s+(?:https?://|www\.|doi:))")),
    "layout_note_paragraph": (is_.layout_footnote_paragraph, _is("c", r"^(?:>\s*)?(?:\d{1,3}|[∗†‡*§¶])\s*(?:https?://|www\.|doi:|10\.\d)\S+\s*\.?\s*$")),
    "note": (is_.markdown_footnote_line, _is("c", _NOTE_START + is_._URL_START)),
    "note_with_url": (is_.footnote_line_with_url, _is("c", rf"{_NOTE_START}(?:.*\s)?{is_._URL_START}") + f" and not {_BIBLIOGRAPHIC}"),
    "affiliation": (is_.affiliation_line, f"{_is('c', is_.AFFILIATION)} or {_count('c', _MAIL)} > {_is('rtrim(c)', '[.!?]$')}::int"),
    "caption": (is_.caption_or_table, f"{_is('trim(c)', r'(?i)^(?:fig\.?|figure|table|algorithm|listing)\s*\d*\b')} or {_is('trim(c)', r'(?is)^<.*</?(?:table|tr|td|th|tbody|thead)\b')}"),
    "licence": (is_.licence_text, _is("c", is_.any_of(is_.LICENCES, "(?i)"))),
    "symbol": (is_.symbol_marker, _is("c", "^[*†‡§¶‖∗⋆★☆]+$")),
    "usable": (is_.text_layer_usable, f"length(c) < 20 or ({_count('c', '�')} / length(c) <= 0.02 and {_count('c', r'[\p{L}\p{N}]')} / length(c) >= 0.5)"),
    "open": (is_.paren_balance, f"({_count('c', chr(92) + '(')} - {_count('c', chr(92) + ')')})::int"),
}
_LINES = {"documents": ("doc_id", "text"), "md_file": ("md_id", "text"), "footnote": ("footnote_id", "footnote_text")}


def _lines(spark: SparkSession, sf: str, source: str) -> DataFrame:
    key, column = _LINES[source]
    return table(spark, sf, source).filter(f"{column} is not null").select(key, F.posexplode(F.split(column, "\n")).alias("line", "c")).distinct()


def _flag_query(name: str, source: str) -> None:
    of, sql = FLAGS[name]
    key, column = _LINES[source]
    QUERIES[f"lines_{name}"] = lambda spark, sf: _lines(spark, sf, source).select(key, "line", of(F.col("c")).alias("flag"))
    ORACLE_SQL[f"lines_{name}"] = f"select {key}, line, {sql} as flag from (select distinct {key}, unnest(l) as c, (generate_subscripts(l, 1) - 1)::int as line from (select {key}, string_split({column}, chr(10)) as l from {source} where {column} is not null))"


for _name in FLAGS:
    _flag_query(_name, "footnote" if _name in ("note", "note_with_url", "bibliographic_note", "entry") else "documents" if _name in ("usable", "open", "machine") else "md_file")
QUERIES["lines_symbol"] = lambda spark, sf: table(spark, sf, "footnote").filter("marker is not null").select("footnote_id", is_.symbol_marker(F.col("marker")).alias("flag")).distinct()
ORACLE_SQL["lines_symbol"] = f"select distinct footnote_id, {FLAGS['symbol'][1].replace('(c,', '(marker,')} as flag from footnote where marker is not null"


# --- regions ---

_HEADING = lambda c: f"lower(trim({_sub(_sub(f'trim({c})', r'^#{1,6}\s*'), r'[:.\-–,\s]+$')}))"
_LAST_LINES = "list_filter(l, lambda x: trim(x) <> '')"


def _with_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, each with a list of references after two thirds of its length, and an acknowledgement before; the tables have none."""
    d = table(spark, sf, "md_file").filter("text is not null")
    tail = F.when(F.col("md_id") % 3 == 0, "\n\n## References\n\n[1] A. One. 2001.\n\n[2] B. Two. 2002.\n\nData availability\n\nOn request.").when(F.col("md_id") % 3 == 1, "\n\nAcknowledgements\n\nWe thank all.").otherwise("")
    return d.select("md_id", F.concat("text", tail).alias("text"))


_HEADED = """(select md_id, text || case when md_id % 3 = 0 then chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '[1] A. One. 2001.' || chr(10) || chr(10) || '[2] B. Two. 2002.' || chr(10) || chr(10) || 'Data availability' || chr(10) || chr(10) || 'On request.'
  when md_id % 3 = 1 then chr(10) || chr(10) || 'Acknowledgements' || chr(10) || chr(10) || 'We thank all.' else '' end as text from md_file where text is not null)"""
_OFFSETS = f"""(select md_id, text, x, o from (select md_id, text, unnest(l) as x, unnest(list_transform(l, lambda x, i: coalesce(list_sum(list_transform(l[:i - 1], lambda y: length(y) + 1)), 0))) as o
  from (select md_id, text, string_split(text, chr(10)) as l from {_HEADED})))"""
_KEYS = ", ".join(_q(x) for x in regions.REFERENCE_HEADINGS)
_REF_START = f"select md_id, coalesce(min(o) filter (where o >= floor(length(text) * 0.35)), max(o))::int as pos from {_OFFSETS} where {_HEADING('x')} in ({_KEYS}) group by md_id"

QUERIES["region_heading_keys"] = lambda spark, sf: _lines(spark, sf, "md_file").select("md_id", "line", regions.heading_key(F.col("c")).alias("key"))
ORACLE_SQL["region_heading_keys"] = f"select md_id, line, {_HEADING('c')} as key from (select md_id, unnest(l) as c, (generate_subscripts(l, 1) - 1)::int as line from (select md_id, string_split(text, chr(10)) as l from md_file where text is not null))"
QUERIES["region_reference_start"] = lambda spark, sf: _with_headings(spark, sf).select("md_id", regions.reference_start(F.col("text")).alias("pos")).filter("pos is not null")
ORACLE_SQL["region_reference_start"] = _REF_START
QUERIES["region_layout_end"] = lambda spark, sf: _with_headings(spark, sf).select("md_id", regions.layout_body_end(F.col("text")).cast("int").alias("pos")).filter("pos is not null")
_FIRST = lambda c, p: f"case when {_is(c, p)} then length(regexp_extract({c}, {_q('(?s)^(.*?)(?:' + p + ')')}, 1)) end"
_FLOOR = "floor(length(text) * 0.65)::int"
ORACLE_SQL["region_layout_end"] = f"select md_id, pos::int as pos from (select md_id, least({_FIRST('text', regions._LAYOUT_REFERENCES)}, {_FIRST(f'text[{_FLOOR} + 1:]', regions._LAYOUT_ACKNOWLEDGEMENTS)} + {_FLOOR}) as pos from {_HEADED}) where pos is not null"


def region_split(spark: SparkSession, sf: str) -> DataFrame:
    body, refs = regions.split_references(F.col("text"))
    return _with_headings(spark, sf).filter("text not like '%```%'").select("md_id", body.alias("body"), refs.alias("refs"))


QUERIES["region_split"] = region_split
_AFTER = ", ".join(_q(x) for x in regions.AFTER_REFERENCES)
ORACLE_SQL["region_split"] = f"""with s as ({_REF_START}), t as (select md_id, text, pos from {_HEADED} left join s using (md_id) where text not like '%```%'),
r as (select md_id, text, pos, regexp_replace(text[pos + 1:], '^[^\\n]*\\n?', '') as rest from t),
o as (select md_id, unnest(l) as x, unnest(list_transform(l, lambda x, i: coalesce(list_sum(list_transform(l[:i - 1], lambda y: length(y) + 1)), 0))) as o from (select md_id, string_split(rest, chr(10)) as l from r where pos is not null)),
e as (select md_id, min(o)::int as stop from o where o > 200 and ({_HEADING('x')} in ({_AFTER}) or regexp_matches(x, '(?i)^\\s*E-?mail address\\s*:')) group by md_id)
select md_id, case when pos is null then text else text[:pos] end as body, case when pos is null then '' when stop is null then rest else rest[:stop] end as refs from r left join e using (md_id)"""

# --- citations ---


_INDEX_OFF = r"^[\[(]+|[\]).]+$"
form("marker_clean", "footnote", "footnote_id", "marker", {"clean": cite.clean_marker, "key": cite.marker_key}, {"clean": _sub("trim(c)", r"^[\[\]().,;\s]+|[\[\]().,;\s]+$"), "key": r"nullif(regexp_extract(trim(c), '^\[?(\d+|[*†‡§¶‖∗⋆★☆]+)(?:\]|\.)?', 1), '')"})
_NORM = "translate(regexp_replace(trim(c), '^[\\[\\]()^:.]+|[\\[\\]()^:.]+$', '', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
form("marker_surfaces", "footnote", "footnote_id", "marker", {"surfaces": lambda c: F.array_join(cite.marker_variants(c), " ")}, {"surfaces": f"array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter([c, {_NORM}, case when regexp_matches({_NORM}, '^\\d+$') then translate({_NORM}, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') end], lambda x: x is not null and x <> '')), lambda x: {{l: -length(x), v: x}})), lambda s: s.v), ' ')"})
form("entry_without_label", "reference_entry", "entry_id", "full_text", {"bare": cite.strip_label}, {"bare": "case " + " ".join(f"when {_is('c', p)} then {_sub('c', p.replace('(?=[A-Z])', ''))}" for p in (r"^\s*\[[^\]]{1,12}\]\s*", r"^\s*\(\d{1,4}\)\s*", r"^\s*\d{1,4}[.)]\s+")) + r" when regexp_matches(c, '^\s*\d{1,4}\s+[A-Z]') then regexp_replace(c, '^\s*\d{1,4}\s+', '') else c end"})
form("citation_groups_layout", "documents", "doc_id", "text", {"numbers": lambda c: F.array_join(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,4}(?:\s*[,;\-–]\s*\d{1,4})*)\]"), F.lit(1)), lambda x: cite.expand_numeric(x, "layout"))).cast("array<string>"), " ")}, {"numbers": r"array_to_string(flatten(list_transform(flatten(list_transform(regexp_extract_all(c, '\[(\d{1,4}(?:\s*[,;\-–]\s*\d{1,4})*)\]', 1), lambda g: list_filter(regexp_split_to_array(trim(g), '[,;\s]+'), lambda x: x <> ''))), lambda p: case when regexp_full_match(p, '\d+[–\-]\d+') then case when regexp_extract(p, '^(\d+)', 1)::int <= regexp_extract(p, '(\d+)$', 1)::int then range(regexp_extract(p, '^(\d+)', 1)::int, regexp_extract(p, '(\d+)$', 1)::int + 1)::int[] else []::int[] end when regexp_full_match(p, '\d+') then [p::int] else []::int[] end)), ' ')"})


def citation_spliced(spark: SparkSession, sf: str) -> DataFrame:
    """The first numbered mark of every text replaced by its offsets, and by a tag."""
    d = table(spark, sf, "documents").filter(F.col("text").rlike(r"\[\d+\]"))
    mark = F.regexp_extract("text", r"(\[\d+\])", 1)
    at = F.position(mark, F.col("text")) - 1
    tagged = F.replace(F.col("text"), mark, F.concat(F.lit("[CITE:"), mark, F.lit("]")))
    d = d.select("doc_id", cite.splice_offset(F.col("text"), at, at + F.length(mark), F.lit("N")).alias("by_offset"), cite.splice_offset(F.col("text"), at, at + F.length(mark), F.lit("N"), mark).alias("with_marker"), cite.splice_tag(F.regexp_replace("text", r"\[(\d+)\]", "[CITE:$1]"), F.regexp_extract("text", r"\[(\d+)\]", 1), F.lit("N")).alias("by_tag"), tagged.isNotNull().alias("marked"))
    return d


QUERIES["citation_spliced"] = citation_spliced
_AT = "instr(text, m) - 1"
ORACLE_SQL["citation_spliced"] = rf"""select doc_id, text[:a] || case when a = 0 or regexp_matches(text[:a], '{_S}$') or ends_with(text[:a], '[') then '' else ' ' end || '[N]' || text[b + 1:] as by_offset,
  text[:a] || '[' || m || ' N]' || text[b + 1:] as with_marker,
  trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '\[(\d+)\]', '[CITE:\1]', 'g'), '[CITE:' || trim(m, '[]') || ']', ' [N]'), '\[CITE:[^\]]+\]', '', 'g'), '{_S}+', ' ', 'g')) as by_tag, true as marked
from (select doc_id, text, m, instr(text, m) - 1 as a, instr(text, m) - 1 + length(m) as b from (select doc_id, text, regexp_extract(text, '(\[\d+\])', 1) as m from documents where regexp_matches(text, '\[\d+\]')))"""


def citation_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with the distinct marks it may use, with and without brackets."""
    e = table(spark, sf, "reference_entry").select("entry_id", "keys").filter("keys is not null and size(keys) > 0").distinct()
    return e.select("entry_id", F.array_join(cite.allowed_markers(F.col("keys")), "\n").alias("markers")).distinct()


QUERIES["citation_allowed"] = citation_allowed
ORACLE_SQL["citation_allowed"] = f"""select distinct entry_id, array_to_string(list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i), chr(10)) as markers
from (select entry_id, list_filter(flatten(list_transform(keys, lambda k: [k, {_sub('trim(k)', _INDEX_OFF)}])), lambda x: x <> '') as b from reference_entry where len(keys) > 0)"""

_SURNAME_A = r"(?:^|[,;&]|\band\b|\s)(?:[A-Z]\.?\s*){1,4}([A-Z][A-Za-z'’`-]{2,})\b"
_SURNAME_B = r"(?:^|,\s*|;\s*|\band\s+|&\s*)([A-Z][A-Za-z'’`-]{2,})(?:\s+[A-Z]\b|,|:|\.)"
ORACLE_SQL["reference_keys"] = rf"""with h as (select *, regexp_extract_all(full_text, '\b((?:19|20)\d{{2}}[a-z]?)\b', 1)[-1] as year_found,
    trim(regexp_replace(case when regexp_matches(full_text, '\b(?:19|20)\d{{2}}[a-z]?\b') then regexp_extract(full_text, '(?s)^(.*?)\b(?:19|20)\d{{2}}[a-z]?\b', 1) else full_text[:180] end, '^\s*(?:\[?\d+\]?|\d+[.)])\s+', '')) as head from reference_entry),
n as (select *, case when len(regexp_extract_all(head, {_q(_SURNAME_A)}, 1)) > 0 then regexp_extract_all(head, {_q(_SURNAME_A)}, 1) else regexp_extract_all(head, {_q(_SURNAME_B)}, 1) end as names from h),
k as (select *, case when coalesce(first_author, '') = '' or pub_year is null then []::varchar[] else list_concat(
    list_transform([[', ', ''], [' ', ''], [' (', ')'], [' et al., ', ''], [' et al. ', ''], [' et al. (', ')']], lambda f: first_author || f[1] || pub_year || f[2]),
    case when coalesce(second_author, '') = '' then []::varchar[] else list_transform([[' and ', ', ', ''], [' and ', ' ', ''], [' and ', ' (', ')'], [' & ', ', ', ''], [' & ', ' ', ''], [' & ', ' (', ')']], lambda f: first_author || f[1] || second_author || f[2] || pub_year || f[3]) end) end as ks from n)
select distinct entry_id, year_found, list_filter(names, lambda x: x not in ({', '.join(_q(x) for x in cite.NOT_NAMES)}))[1] as author_found, len(ks)::int as n_keys, ks[1] as first_key from k"""


def mllm_canonical_sql() -> str:
    """The canonical form of the evaluator of model output, step by step."""
    u = _sub(repair(fold_sql(nfkc("url"), tildes=True), mllm=True), r"(?i)\[last visit:[^\]]*$")
    steps = [f"a as (select row_id, trim({u}) as u from pmc_footnote_gold)"]
    off = "[\\[\\](){}<>\"'`]+"
    steps.append(f"b as (select row_id, {_sub(_sub(_sub('u', '^' + off + '|' + off + '$'), '[.,;:)' + chr(92) + ']}>]+$'), _S + '+')} as u from a)")
    steps.append(f"select row_id, case when u = '' then '' else {_parts('u', '(?i)^https?://')} end as url_norm from b")
    return "with " + ", ".join(steps[:2]) + " " + steps[2]


ORACLE_SQL["url_canonical_mllm"] = mllm_canonical_sql()


def _of_sentences(names: tuple[str, ...]) -> str:
    return f"select count(*) as n, {', '.join(f'coalesce(sum(({FLAGS[k][1]})::int), 0)::bigint as {k}' for k in names)} from (select sentence as c from {_rows(_REFERENCE)})"


ORACLE_SQL["sentence_filters"] = _of_sentences(("footer", "machine", "bibliographic", "caption"))


def _printed_sql(c: str) -> str:
    """The cleaned distinct addresses of a text in SQL, as a list: the lookbehind of the grammar becomes a character before the address."""
    grammar = urls.GRAMMARS["markdown"].replace(r"(?<![\w@])", r"(?:^|[^\w@])")
    found = f"list_transform(regexp_extract_all({_sub(c, r'[\w.+-]+@[\w.-]+', ' ')}, {_q(grammar)}, 1), lambda c: {_BY_DIALECT['markdown']})"
    kept = f"list_filter({found}, lambda u: u <> '' and not {_is('u', '(?i)^(?:mailto|tel|javascript|data|file):')})"
    return f"(select list_filter(k, lambda u, i: list_position(list_transform(k, lambda y: lower(y)), lower(u)) = i) from (select {kept} as k))"


ORACLE_SQL["document_urls"] = f"select doc_id, unnest({_printed_sql('text')}) as url from documents"
