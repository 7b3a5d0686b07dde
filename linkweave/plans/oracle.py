"""SQL for DuckDB that gives the same rows as the queries of the core operators.

DuckDB has no NFKC and its regular expressions no lookaround: ``nfkc`` spells out the compatibility forms that occur, and lookarounds become
capturing groups; word boundaries, which know ASCII only, a character of another kind.
"""

from __future__ import annotations

import unicodedata


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _forms() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose NFKC is one character, and those with another, up to U+FFEF; from the Unicode database, without ideographs."""
    one, to, more = [], [], []
    for code in [*range(0xA0, 0x2000), *range(0x2000, 0x2E80), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        c = chr(code)
        n = unicodedata.normalize("NFKC", c)
        if n != c and unicodedata.normalize("NFC", c) == c:
            if len(n) == 1:
                one.append(c)
                to.append(n)
            elif c in "ﬀﬁﬂﬃﬄﬅﬆ½¼¾…‥№™℠℡ĳǆ⅓⅔⅛˜´¨¯¸":
                more.append((c, n))
    return "".join(one), "".join(to), more


def nfkc(c: str) -> str:
    one, to, more = _forms()
    for a, b in more:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize(translate({c}, {_q(one)}, {_q(to)}))"


_S = r"[\s\x0B\x{85}\p{Z}]"


def ws(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'))"


def fold(c: str, tildes: bool = False) -> str:
    c = f"coalesce({c}, '')"
    for chars, to in ((" ", " "), ("“”", '"'), ("’‘", "'"), ("–—−", "-"), *((("∼˜～", "~"),) if tildes else ())):
        c = f"regexp_replace({c}, '[{chars}]', {_q(to)}, 'g')"
    c = f"regexp_replace({c}, '[\\x{{200B}}\\x{{FEFF}}]', '', 'g')"
    return ws(c)


def norm_text(c: str, tildes: bool = False) -> str:
    return fold(nfkc(c), tildes)


_W = r"[\p{L}\p{N}_\p{Mn}]"


def repair(c: str, mllm: bool = False) -> str:
    if not mllm:
        for p in (r"\$\s*\\sim\s*\$", r"\{\s*\\sim\s*\}", r"\\~", "[˜∼～∽∻⁓̴̃̾]"):
            c = f"regexp_replace({c}, '{p}', '~', 'g')"
    c = rf"regexp_replace({c}, '(?i)\b(https?)\s*:\s*/\s*/', '\1://', 'g')"
    if not mllm:
        c = rf"regexp_replace({c}, '(?i)\b(s?ftps?|sftp|s3|gs|az)\s*:\s*/\s*/', '\1://', 'g')"
    c = rf"regexp_replace({c}, '(?i)\bwww\.\s+', 'www.', 'g')"
    if not mllm:
        c = rf"regexp_replace({c}, '(?i)\bdoi:\s+', 'doi:', 'g')"
    for a, b in ((_W, r"[/?#&=:%._~\-]"), (r"[/?#&=:%._~\-]", _W), (r"\.", _W), (_W, r"\.")):
        c = rf"regexp_replace({c}, '({a})\s+({b})', '\1\2', 'g')"
    return c


def _parts(u: str, scheme: str) -> str:
    full = rf"case when regexp_matches({u}, '{scheme}') then {u} else 'http://' || {u} end"
    p = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    x = lambda k: f"regexp_extract({full}, '{p}', {k})"
    host = rf"regexp_replace(lower({x(1)}), '^www\.', '')"
    path = f"lower(rtrim(regexp_replace({x(2)}, '/{{2,}}', '/', 'g'), '/'))"
    return f"ltrim({host} || {path} || case when {x(3)} <> '' then '?' || lower({x(3)}) else '' end, '/')"


def canonical_ctes(source: str, plain: str, name: str = "canon", keep: str = "row_id") -> str:
    """CTEs that end in ``name (keep, url_norm)`` for the expression ``plain`` over ``source``."""
    pairs = [(r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"), ('"', '"'), ("''", "''"), ("`", "`")]
    wrap = "|".join(f"{a}(.*){b}" for a, b in pairs)
    out = [f"{name}_0 as (select {keep}, {fold(repair(plain))} as u from {source})"]
    for k in range(5):
        out.append(rf"{name}_{k + 1} as (select {keep}, trim(regexp_replace(u, '(?s)^\s*(?:{wrap})\s*$', '\1\2\3\4\5\6\7')) as u from {name}_{k})")
    u = r"trim(regexp_replace(regexp_replace(trim(u, ',; '), '^[''\"]+', ''), '[''\"]+$', ''))"
    out.append(f"{name}_a as (select {keep}, {u} as u from {name}_5)")
    out.append(rf"{name}_b as (select {keep}, trim(regexp_replace(u, '(?:[.,;:)\]}}>\"''`]\s*)+$', '')) as u from {name}_a)")
    out.append(rf"{name}_c as (select {keep}, regexp_replace(regexp_replace(regexp_replace(u, '(?i)^doi:\s*https?://(?:dx\.)?doi\.org/', 'doi:'), '(?i)^https?://(?:dx\.)?doi\.org/', 'doi:'), '{_S}+', '', 'g') as u from {name}_b)")
    doi = "'doi:' || rtrim(lower(regexp_replace(u, '(?i)^doi:', '')), '/')"
    url = f"case when u = '' then '' when regexp_matches(u, '(?i)^(?:doi:|10\\.\\d{{4,9}}/)') then {doi} else {_parts('u', '(?i)^[a-z][a-z0-9+.\\-]*://')} end"
    out.append(f"{name} as (select {keep}, {url} as url_norm from {name}_c)")
    return ",\n".join(out)


_NEXT = r"(?:https?://|s?ftp://|sftp://|s3://|gs://|az://|www\.|doi:|DOI:|10\.\d{4,9}/|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,10}|\d{1,3}(?:\.\d{1,3}){3})"
_FIELD = r"""(?i)(?:^|[^\p{L}\p{N}_])((?:https?|s?ftps?|sftp|s3|gs|az)://[^\s\]\[<>"']+|www\.[^\s\]\[<>"']+|doi:\s*[^\s\]\[<>"'(),;|]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,10}(?::\d+)?(?:/[^\s\]\[<>"'|]*)?|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/[^\s\]\[<>"'|]*)?)"""


def field_set_ctes(source: str, keep: str, name: str) -> str:
    """CTEs that end in ``name (keep, url_norm)``: the distinct canonical addresses of the field ``url`` of ``source``."""
    raw = f"trim({repair(fold(nfkc('url')))})"
    # a comma before an address is marked twice, as matches that overlap are skipped
    marked = "part"
    for _ in range(2):
        marked = f"regexp_replace({marked}, ',\\s*({_NEXT})', chr(1) || '\\1', 'g')"
    out = [
        f"{name}_raw as (select {keep}, {raw} as r from {source})",
        rf"{name}_open as (select {keep}, case when regexp_matches(r, '(?s)^\[.*\]$') then trim(r[2:-2]) else r end as r from {name}_raw)",
        f"{name}_bar as (select {keep}, unnest(string_split(r, '|')) as part from {name}_open)",
        f"{name}_chunk as (select {keep}, row_number() over () as k, trim(piece) as chunk from (select {keep}, unnest(string_split({marked}, chr(1))) as piece from {name}_bar) where trim(piece) <> '')",
        f"{name}_found as (select {keep}, k, chunk, regexp_extract_all(chunk, {_q(_FIELD)}, 1) as f from {name}_chunk)",
        f"{name}_each as (select {keep}, k, chunk, true as hit, unnest(f) as v from {name}_found union all select {keep}, k, chunk, false, chunk from {name}_found)",
        canonical_ctes(f"{name}_each", "v", f"{name}_n", f"{keep}, k, hit"),
        f"{name}_good as (select *, max(hit) over (partition by {keep}, k) as any_hit from {name}_n where url_norm <> '')",
        f"{name} as (select distinct {keep}, url_norm from {name}_good where hit or not any_hit)",
    ]
    return ",\n".join(out)


_GOLD = "select *, row_id as ix from pmc_footnote_gold"
_PRED = """select * replace (
    case when row_id % 11 = 0 then url || '/elsewhere' when row_id % 5 = 0 then upper(url) when row_id % 3 = 0 then url || '.' else url end as url,
    case when row_id % 7 = 0 then 'It is not so that ' || target when row_id % 13 = 0 then trailing_sentence else target end as target),
  case when row_id % 9 = 0 then ((label::int + 1) % 6)::varchar else label end as pred_label, label as gold_label,
  case when row_id % 17 = 0 then 'genuine_fp' when row_id % 19 = 0 then 'stage2' else 'exact' end as match_rule
  from gold"""


def _pid(c: str) -> str:
    s = rf"trim(regexp_replace({norm_text(c)}, '(?i)\.pdf$', ''))"
    return rf"case when regexp_full_match({s}, '\d{{4}}\.\d{{3}}') then {s} || '0' else {s} end"


def _split(c: str, held: list[tuple[str, str]], opener: str) -> str:
    """A list of sentences: points of ``held`` hidden, cut after ``.!?`` and blanks before ``opener``."""
    for p, after in held:
        for _ in range(2):
            c = f"regexp_replace({c}, '{p}\\.({after})', '\\1' || chr(1) || '\\2', 'g')"
    for _ in range(2):
        c = f"regexp_replace({c}, '([.!?])\\s+({opener})', '\\1' || chr(2) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({c}, chr(2)), lambda x: trim(translate(x, chr(1), '.'))), lambda x: x <> '')"


def _alternatives(words: str) -> str:
    return "|".join(w.replace(".", r"\.").replace("~", r"\s?") for w in sorted(words.split(), key=len, reverse=True))


_LAYOUT = _split("text", [(rf"\b({_alternatives('Fig Figs Eq Eqs Sec Tab Tabs Ref Refs Vol Vols No Nos pp p ed eds edn et~al i.e e.g cf vs viz etc Mr Mrs Ms Dr Prof St Jr Sr U.S U.K E.U U.S.A')})", "")], r"[A-Z0-9\"''(\[|“”‘’•–—∗†‡Α-Ωα-ω]")
_GUARDED = _split("trim(text)", [(rf"\b({_alternatives('Fig Eq Eqs Sec Ch App Ref Refs No Nos pp p vol Vol et~al i.e e.g etc cf Mr Mrs Ms Dr Prof Jr Sr St vs')})", r"\s"), (r"\b([A-Z])", r"\s")], r"[\"“]?[A-Z]")
_REFERENCE = _split("text", [], r"[A-Z\[(]")


def _rows(expr: str) -> str:
    return f"(select doc_id, unnest(s) as sentence, generate_subscripts(s, 1)::int - 1 as sent_ix from (select doc_id, {expr} as s from documents where text is not null))"


_CONTEXT = f"""select doc_id, sent_ix, lag(sentence) over w as preceding, lead(sentence) over w as trailing,
  lag(sentence) over w is null as at_paragraph_start, lead(sentence) over w is null as at_paragraph_end
from {_rows(_REFERENCE)} window w as (partition by doc_id order by sent_ix)"""

_MENTIONS = """(select paper_id, url, 'body' as location from url_candidate where url is not null
  union all select paper_id, unnest(urls), 'footnote' from footnote union all select paper_id, unnest(urls), 'reference' from reference_entry)"""

_CLASSES = ["general-url", "third-party-dataset", "author-provided-dataset", "third-party-software", "author-provided-software", "project"]
_GROUPS = {"fine": _CLASSES, "coarse": ["general-url", "dataset", "dataset", "software", "software", "project"], "binary": ["not-OADS", *["OADS"] * 5]}


def _class_sql(granularity: str, variant: int) -> str:
    names = "[" + ", ".join(_q(x) for x in _GROUPS[granularity]) + "]"
    every = "(values " + ", ".join(f"({_q(x)})" for x in dict.fromkeys(_GROUPS[granularity])) + ") as every(class)"
    wrong = "match_rule = 'genuine_fp'" + (" or match_rule = 'stage2'" if variant in (1, 2) else "")
    base = f"with gold as ({_GOLD} where lower(trim(split)) = 'test'), pred as ({_PRED}), labelled as (select *, {names}[pred_label::int + 1] as pc, ({wrong}) as wrong from pred where pred_label is not null)"
    if variant in (1, 3):
        base += f""",
g0 as (select ix, paper_id, url, label::int as c from gold where label is not null),
{field_set_ctes('g0', 'ix, paper_id, c', 'gs')},
gv as (select {_pid('paper_id')} as pid, url_norm, c, count(*) as n, min(ix) as first from gs group by all),
gk as (select pid, url_norm, {names}[arg_max(c, (n, -first)) + 1] as gc from gv group by all),
{field_set_ctes('labelled', 'ix, paper_id, pc, wrong', 'ps')},
pk as (select {_pid('paper_id')} as pid, url_norm, pc, wrong, ix from ps),
vv as (select pid, url_norm, pc, count(*) as n, min(ix) as first from pk where not wrong group by all),
vk as (select pid, url_norm, arg_max(pc, (n, -first)) as vc from vv group by all),
av as (select pid, url_norm, pc, count(*) as n, min((wrong::int, ix)) as first from pk group by all),
ak as (select pid, url_norm, first(pc order by n desc, first) as ac from av group by all),
joined as (select gc, ac, vc from gk full join (select * from ak left join vk using (pid, url_norm)) using (pid, url_norm)),
per as (
  select class, sum(k = 'tp')::bigint as tp, sum(k = 'fp')::bigint as fp, sum(k = 'n')::bigint as n from (
    select gc as class, 'tp' as k from joined where gc is not null and vc = gc
    union all select ac, 'fp' from joined where not coalesce(gc is not null and vc = gc, false) and ac is not null
    union all select gc, 'n' from gk) group by class)"""
    else:
        base += f""",
scored as (select pc, not wrong and coalesce({names}[gold_label::int + 1] = pc, false) as hit from labelled),
per as (
  select class, sum(k = 'tp')::bigint as tp, sum(k = 'fp')::bigint as fp, sum(k = 'n')::bigint as n from (
    select pc as class, case when hit then 'tp' else 'fp' end as k from scored
    union all select {names}[label::int + 1], 'n' from gold where label is not null) group by class)"""
    return f"""{base},
c as (select class, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(n, 0) - coalesce(tp, 0) as fn from {every} left join per using (class)),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from (select * from c union all select 'MICRO', sum(tp), sum(fp), sum(fn) from c)),
f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from r)
select class, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(p, 6) as p, round(r, 6) as r, round(f1, 6) as f1 from f
union all select 'MACRO', null, null, null, null, null, round(avg(f1), 6) from f where class <> 'MICRO'"""


def expanded(inner: str) -> str:
    """The numbers of a citation group in SQL, as a list; a comma and a blank make a range, as in the operator."""
    plain = f"replace(regexp_replace({inner}, '[–−]', '-', 'g'), ', ', '-')"
    lo, hi = (rf"try_cast(nullif(regexp_extract(p, '^(\d{{1,4}})\s*[-–−]\s*(\d{{1,4}})\b', {k}), '') as int)" for k in (1, 2))
    one = r"try_cast(nullif(regexp_extract(p, '^(\d{1,4})\b', 1), '') as int)"
    return f"list_sort(list_distinct(flatten(list_transform(list_transform(regexp_split_to_array({plain}, '\\s*[,;]\\s*'), lambda x: trim(x)), lambda p: case when {lo} is not null then case when {lo} > 0 and {lo} <= {hi} and {hi} <= {lo} + 100 then range({lo}, {hi} + 1)::int[] else []::int[] end when {one} is not null then [{one}] else []::int[] end))))"


_LATEST_ENTRIES = "(select entry_id, arg_max(paper_id, loaded_at) as paper_id, arg_max(ref_index, loaded_at) as ref_index, arg_max(full_text, loaded_at) as full_text, arg_max(urls, loaded_at) as urls from reference_entry group by entry_id)"

ORACLE_SQL = {
    "url_canonical": f"with {canonical_ctes('pmc_footnote_gold', fold(nfkc('url')))} select row_id, url_norm from canon",
    "url_field_set": f"with {field_set_ctes('pmc_footnote_gold', 'row_id', 'fs')} select row_id, url_norm from fs",
    "url_eval_prf": f"""with gold as ({_GOLD}), pred as ({_PRED}),
{field_set_ctes('gold', 'row_id, paper_id', 'gs')}, {field_set_ctes('pred', 'row_id, paper_id', 'ps')},
g as (select distinct {_pid('paper_id')} as pid, url_norm from gs where not regexp_matches(url_norm, '(?i)(orcid\\.org|creativecommons\\.org|crossmark|/?mailto:|(?:^|[^a-z])tel:|javascript:)')),
q as (select distinct {_pid('paper_id')} as pid, url_norm from ps),
n as (select count(*) filter (where g.pid is not null and q.pid is not null) as tp, count(*) filter (where g.pid is null) as fp, count(*) filter (where q.pid is null) as fn
  from g full join q on g.pid = q.pid and g.url_norm = q.url_norm)
select tp, fp, fn, round(tp / (tp + fp), 6) as p, round(tp / (tp + fn), 6) as r, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from n""",
    "best_urls": r"""select distinct footnote_id, coalesce(list_filter(urls, lambda u: regexp_matches(u, '(?i)doi\.org'))[1], list_filter(urls, lambda u: regexp_matches(u, '(?i)ncbi|pubmed'))[1], urls[1]) as url
from footnote where len(urls) > 0""",
    "longer_urls": "select distinct entry_id, unnest(list_filter(urls, lambda a: len(list_filter(urls, lambda b: contains(b, a) and length(b) >= length(a) + 3)) = 0)) as url from reference_entry",
    "paper_id_rules": rf"""select row_id, {_pid('paper_id')} as id_exact,
  case when regexp_full_match(s, '\d{{4}}\.\d{{1,3}}') then rpad(s, 9, '0') else s end as id_reference,
  case when regexp_full_match(a, '\d{{4}}\.\d{{3}}') then a || '0' else a end as id_mllm
from (select row_id, paper_id, trim(regexp_replace(regexp_replace(trim(coalesce(paper_id, '')), '(?i)\.pdf$', ''), 'v\d+$', '')) as s,
  coalesce(nullif(regexp_extract(m, '(\d{{4}}\.\d{{3,5}})(?:v\d+)?', 1), ''), m) as a
  from (select *, replace({norm_text('paper_id', True)}, '.pdf', '') as m from pmc_footnote_gold))""",
    "target_keys": rf"""select row_id, t as target_norm, lower({ws(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\b(?:https?://[^\s\]\[<>\"'']+|www\.[^\s\]\[<>\"'']+)', ' URL ', 'g'), '[\[\]()]', ' ', 'g'), '(^|[^\p{L}\p{N}_])\d+\s+(URL)\b', '\1\2', 'g'), '\s+([,.;:])', '\1', 'g')")}) as skeleton
from (select row_id, {norm_text('target', True)} as t from pmc_footnote_gold)""",
    "marker_norms": "select distinct footnote_id, translate(trim(trim(marker), '[]()^:.'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') as marker from footnote",
    "sentences_layout": f"select doc_id, sent_ix, sentence from {_rows(_LAYOUT)}",
    "sentences_guarded": f"select doc_id, sent_ix, sentence from {_rows(_GUARDED)}",
    "sentence_context": _CONTEXT,
    "sentence_window": _CONTEXT,
    "citation_numbers": rf"select doc_id, sent_ix, unnest({expanded('inner_text')}) as num from (select doc_id, sent_ix, unnest(regexp_extract_all(sentence, '\[(\d{{1,4}}(?:\s*[,;\-–]\s*\d{{1,4}})*)\]', 1)) as inner_text from {_rows(_REFERENCE)})",
    "reference_restored": rf"""with e as (select paper_id, ref_index, arg_min(full_text, entry_id) as full_text from {_LATEST_ENTRIES} where ref_index is not null and len(urls) > 0 group by all),
m as (select doc_id, sent_ix, sentence, unnest(list_distinct(regexp_extract_all(sentence, '\[\d{{1,4}}(?:\s*[,;\-–]\s*\d{{1,4}})*\]'))) as marker from {_rows(_REFERENCE)}),
c as (select doc_id, sent_ix, sentence, marker, unnest({expanded("trim(marker, '[]')")}) as num from m)
select c.doc_id, sent_ix, marker, num, sentence[:instr(sentence, marker) + length(marker) - 1] || '[' || full_text || ']' || sentence[instr(sentence, marker) + length(marker):] as restored
from c join documents d on c.doc_id = d.doc_id join e on e.paper_id = d.paper_id and e.ref_index = num::varchar""",
    "index_styles": r"""select paper_id, case when i = 0 then 'author_year' when d >= 0.8 * i then 'numeric' when a >= 0.8 * i then 'alpha' else 'mixed' end as style from (
select paper_id, count(*) filter (where trim(ref_index) <> '') as i, count(*) filter (where regexp_full_match(trim(ref_index), '[\[(]*\d+[\]).]*')) as d, count(*) filter (where regexp_full_match(trim(ref_index), '[\[(]*[A-Za-z][A-Za-z0-9+]*[\]).]*')) as a
from reference_entry group by paper_id)""",
    "footnote_marks": r"""with n as (select footnote_id, arg_max(paper_id, loaded_at) as paper_id, arg_max(marker_norm, loaded_at) as marker_norm, arg_max(footnote_text, loaded_at) as footnote_text from footnote group by 1),
m as (select md_id, paper_id, unnest(list_distinct(regexp_extract_all(text, '\[\^\w+\]'))) as surface from md_file)
select md_id, footnote_id, surface, '[' || footnote_text || ']' as inserted from m join n on m.paper_id = n.paper_id and trim(surface, '[]()^:.') = n.marker_norm""",
    "footnote_nearest_marker": r"""with n as (select distinct paper_id, marker_norm, footnote_id, start_char from footnote where start_char is not null),
p as (select md_id, paper_id, regexp_extract_all(text, '\[\^\w+\]') as marks, regexp_split_to_array(text, '\[\^\w+\]') as between from md_file where text is not null),
m as (select md_id, paper_id, unnest(marks) as surface, unnest(list_transform(marks, lambda x, i: list_sum(list_transform(between[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(marks[:i - 1], lambda y: length(y))), 0)))::int as s from p),
j as (select footnote_id, s, abs(s - start_char) + case when s > start_char then 500 else 0 end + case when s < 1000 and start_char > 2500 then 2000 else 0 end as score
  from n join m on m.paper_id = n.paper_id and trim(surface, '[]()^:.') = n.marker_norm)
select footnote_id, min((score, s))[1] as score, min((score, s))[2] as mark_start from j group by footnote_id""",
    "latest_footnotes": "select footnote_id, arg_max(paper_id, loaded_at) as paper_id, arg_max(marker, loaded_at) as marker, max(loaded_at) as loaded_at from footnote group by footnote_id",
    "location_rollup": f"select coalesce(location, 'OVERALL') as location, count(*) as items, count(distinct paper_id) as papers from {_MENTIONS} group by rollup (location)",
    "corpus_sums": f"select sum(n)::bigint as items, count(*) as papers, sum(u)::bigint as urls from (select paper_id, count(*) as n, count(distinct url) as u from {_MENTIONS} group by paper_id)",
    "papers_without_gold": f"select distinct paper_id from {_MENTIONS} where paper_id not in (select {_pid('paper_id')} from pmc_footnote_gold)",
    "target_collapse": f"""with g as (select row_id, coalesce(paper_id, '') as paper_id, coalesce(target, '') as target, coalesce(label, '') as label, url from pmc_footnote_gold),
{field_set_ctes('g', 'row_id, paper_id, target', 'fs')},
u as (select paper_id, target, string_agg(distinct url_norm, ' | ' order by url_norm) as urls from fs group by all),
f as (select paper_id, target, min(row_id) as first_row, coalesce(arg_min(label, row_id) filter (where trim(label) <> ''), '') as label from g group by all)
select f.paper_id, f.target, first_row, label, coalesce(urls, '') as urls from f left join u using (paper_id, target)""",
    "majority_labels": "select paper_id, arg_max(label, (n, -f)) as label from (select paper_id, label, count(*) as n, min(row_id) as f from pmc_footnote_gold where label is not null and paper_id is not null group by all) group by paper_id",
}
ORACLE_SQL |= {f"class_{g}_v{v}": _class_sql(g, v) for g in ("fine", "coarse", "binary") for v in (1, 2, 3, 4)}
