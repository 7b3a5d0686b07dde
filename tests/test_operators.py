"""Sentences, citations, splicing, matching and scoring on hand-made rows."""

import random
import re

from pyspark.sql import functions as F

from linkweave.operators import citations as cite
from linkweave.operators import extract_layout, extract_markdown, extract_tei, graph, matching, predicates, regions, scoring
from linkweave.operators import sentences as sen
from linkweave.plans.queries import QUERIES
from linkweave.sources import mllm, tei


def one(spark, value, column, schema="c string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


def test_splitters(spark):
    c = F.col("c")
    assert one(spark, "A b. C d. E f? G", sen.split_layout(c)) == ["A b.", "C d.", "E f?", "G"]
    assert one(spark, "See Fig. 2 now. Next", sen.split_layout(c)) == ["See Fig. 2 now.", "Next"]
    assert one(spark, "By J. Smith et al. In vitro. Then", sen.split_guarded(c)) == ["By J. Smith et al. In vitro.", "Then"]
    assert one(spark, "As in [1]. [2] says. (Yes.) No", sen.split_reference(c)) == ["As in [1].", "[2] says.", "(Yes.) No"]
    assert one(spark, None, sen.split_layout(c)) is None and one(spark, "", sen.split_layout(c)) == []


def test_markdown_spans():
    assert [t for t, _, _ in sen.markdown_sentences("It is 3.5 cm. See e.g. Fig. 2. Done! ok? No")] == ["It is 3.5 cm.", "See e.g. Fig. 2.", "Done! ok?", "No"]
    assert [p[0] for p in sen.markdown_paragraphs("ab\ncd\n\nef\n")] == ["ab cd"]
    assert [p[0] for p in sen.markdown_paragraphs("ab\ncd\n\nef\n", compat=False)] == ["ab cd", "ef"]
    for t, a, b in sen.markdown_paragraphs("  x y \n\n z.\n\nq"):
        assert "  x y \n\n z.\n\nq"[a:b].split() == t.split()
    assert sen.markdown_sentences("") == [] and sen.markdown_paragraphs("") == []


def test_tei_fragments():
    assert sen.logical_sentences(["See www.", "example.org now."]) == [("See www.example.org now.", 0, 1)]
    assert [x[0] for x in sen.logical_sentences(["A (b", "c). Done.", "End."])] == ["A (b c). Done.", "End."]


def test_context(spark):
    df = spark.createDataFrame([(1, ["a.", "b.", "c."]), (2, ["z."]), (3, [])], "id int, s array<string>")
    got = {(r["id"], r["sent_ix"]): (r["preceding"], r["target"], r["trailing"], r["at_paragraph_start"], r["at_paragraph_end"]) for r in sen.posexplode_context(df, F.col("s"), "id").collect()}
    assert got == {(1, 0): (None, "a.", "b.", True, False), (1, 1): ("a.", "b.", "c.", False, False), (1, 2): ("b.", "c.", None, False, True), (2, 0): (None, "z.", None, True, True)}


def test_paragraphs_and_pages(spark):
    c = F.col("c")
    assert one(spark, "prose here\n\nhttps://x.org/y\n\nmore", sen.layout_paragraphs(c)) == ["prose here https://x.org/y", "more"]
    assert one(spark, "=== PAGE 1 ===\na\n=== PAGE 2 ===\nb", sen.split_pages(c)) == ["\na\n", "\nb"]
    assert one(spark, "a\fb", sen.split_pages(c)) == ["a", "b"]


def test_numeric_groups(spark):
    c = F.col("c")
    table = {"5": ([5], [5]), "6,7": ([6, 7], [6, 7]), "6, 7": ([6, 7], [6, 7]), "1, 15": (list(range(1, 16)), [1, 15]), "7, 8, 12": ([7, 8], [7, 8, 12]), "21–23": ([21, 22, 23], [21, 22, 23]), "10 – 12": ([10, 11, 12], [10, 12])}
    for inner, (compat, layout) in table.items():
        assert one(spark, inner, cite.expand_numeric(c)) == compat, inner
        assert one(spark, inner, cite.expand_numeric(c, "layout")) == layout, inner
    assert one(spark, "1, 15", cite.expand_numeric(c, compat=False)) == [1, 15]


def test_markers_and_splicing(spark):
    c = F.col("c")
    assert one(spark, "[¹²]", cite.marker_norm(c)) == "12"
    assert one(spark, "7", cite.marker_variants(c)) == ["7", "⁷"]
    assert one(spark, "We use X[CITE:1] here.", cite.splice_tag(c, F.lit("1"), F.lit("http://x.org"))) == "We use X [http://x.org] here."
    assert one(spark, "As in [3].", cite.splice_first(c, F.lit("[3]"), F.lit("Smith. T. http://x.org"))) == "As in [3][Smith. T. http://x.org]."
    assert one(spark, "We use tool7 here.", cite.splice_offset(c, F.lit(11), F.lit(12), F.lit("http://x.org"))) == "We use tool [http://x.org] here."
    assert one(spark, "As in [3].", cite.splice_offset(c, F.lit(6), F.lit(9), F.lit("full"), F.lit("3"))) == "As in [3 full]."
    assert one(spark, "ab", cite.splice_offset(c, F.lit(9), F.lit(99), F.lit("x"))) == "ab [x]"
    assert one(spark, "[12] Smith J. Title", cite.strip_label(c)) == "Smith J. Title"


def test_nearest_of_all_marks(spark, tmp_path):
    text = "One[^1] two[^2]." + " x" * 50 + " Again[^1] and more." + " x" * 50 + " Last[^1] of it."
    spark.createDataFrame([(1, "P", text), (2, "P", None)], "md_id long, paper_id string, text string").write.parquet(f"{tmp_path}/md_file.parquet")
    notes = [(7, "P", "1", "note", 140, 1), (8, "P", "2", "note", 140, 1)]
    spark.createDataFrame(notes, "footnote_id long, paper_id string, marker_norm string, footnote_text string, start_char int, loaded_at int").write.parquet(f"{tmp_path}/footnote.parquet")
    got = {tuple(r) for r in QUERIES["footnote_nearest_marker"](spark, str(tmp_path)).collect()}
    at = [m.start() for m in re.finditer(r"\[\^1\]", text)]
    assert at[0] < at[1] <= 140 < at[2] and got == {(7, 140 - at[1], at[1]), (8, 140 - text.index("[^2]"), text.index("[^2]"))}
    assert {tuple(r)[:3] for r in QUERIES["footnote_marks"](spark, str(tmp_path)).collect()} == {(1, 7, "[^1]"), (1, 8, "[^2]")}


def test_entries(spark):
    refs = "1. Smith J, Doe A. Title. 2019. http://x.org/a\ncontinued\n2. Roe B. Other. 2001."
    got = one(spark, refs, cite.numbered_entries(F.col("c")))
    assert [(r["index"], r["full_text"]) for r in got] == [("1", "1. Smith J, Doe A. Title. 2019. http://x.org/a continued"), ("2", "2. Roe B. Other. 2001.")]
    assert one(spark, "1. only one", cite.numbered_entries(F.col("c"))) == []
    assert one(spark, "S.A. Berger and A. Stamatakis. On trees. 2019a.", cite.surnames(F.col("c"))) == ["Berger", "Stamatakis"]
    assert one(spark, "in 1999 and 2019a.", cite.last_year(F.col("c"))) == "2019a"
    keys = spark.range(1).select(cite.author_year_keys(F.lit("Smith"), F.lit("Doe"), F.lit("2019")).alias("k")).first()["k"]
    assert len(keys) == 12 and "Smith et al., 2019" in keys and "Smith & Doe (2019)" in keys
    df = spark.createDataFrame([("a", "1"), ("a", "[2]"), ("b", "AB12"), ("c", None), ("d", "1"), ("d", "x y")], "p string, i string")
    assert {r["p"]: r["style"] for r in cite.index_styles(df, "p", "i").collect()} == {"a": "numeric", "b": "alpha", "c": "author_year", "d": "mixed"}


def test_regions(spark):
    text = "x" * 100 + "\n# References\n1. a\n" + "y" * 10
    assert one(spark, text, regions.reference_start(F.col("c"))) == 101
    assert one(spark, "nothing", regions.reference_start(F.col("c"))) is None
    assert one(spark, "a\nReferences\nb", regions.layout_body_end(F.col("c"))) == 2


def test_predicates(spark):
    c = F.col("c")
    assert one(spark, "12. Smith J. x", predicates.bibliographic_line(c)) and not one(spark, "Plain words.", predicates.bibliographic_line(c))
    assert one(spark, None, predicates.publisher_footer(c)) and one(spark, "SELECT a FROM b", predicates.machine_text(c))
    assert one(spark, "Department of X", predicates.affiliation_line(c)) and one(spark, "> 3http://a.org", predicates.layout_footnote_line(c))


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    nodes = {x for e in edges for x in e}
    assert set(got) == nodes and all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes)
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_maximum_matching():
    random.seed(2)
    for _ in range(300):
        n, m = random.randint(1, 6), random.randint(1, 6)
        e = [(g, p, 1, 90.0) for g in range(n) for p in range(m) if random.random() < 0.4]
        adj = {(g, p) for g, p, _, _ in e}

        def best(g, used):
            return 0 if g == n else max([best(g + 1, used)] + [1 + best(g + 1, used | {p}) for p in range(m) if p not in used and (g, p) in adj])

        got = matching.maximum_matching(e)
        assert len(got) == best(0, frozenset()) == len({p for _, p in got}) and set(got) <= adj


ROWS = "ix long, paper_id string, target string, url string, location string, label string, split string"


def test_context_scores(spark):
    gold = spark.createDataFrame([(0, "p", "We use a fine tool here.", "a.org/1", "body", "0", "test"), (1, "p", "Another sentence stands.", "a.org/2", "body", "0", "test"), (2, "p", "Licence text of it.", "creativecommons.org/x", "body", "0", "test"), (3, "q", "Cited words in order.", "b.org/1", "reference", "0", "test")], ROWS)
    pred = spark.createDataFrame([(0, "p.pdf", "We use a fine tool here", "https://www.A.org/1/", " Body", "", ""), (1, "p", "Quite different, though.", "a.org/2", "body", "", ""), (2, "q", "in order. Cited words", "b.org/1", "reference", "", ""), (3, "q", "x", "b.org/9", "reference", "", ""), (4, "r", "x", "b.org/9", "reference", "", "")], ROWS)
    got = {r["location"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.context_report(gold, pred).collect()}
    assert got == {"body": (1, 1, 1), "reference": (1, 1, 0), "OVERALL": (2, 2, 1)}


def test_url_scores(spark):
    df = lambda rows: spark.createDataFrame(rows, "paper_id string, url string")
    g = scoring.url_keys(df([("p", "a.org/A"), ("p", "b.org"), ("p", "orcid.org/1"), ("p", None)]), F.col("paper_id"), F.col("url"), True)
    p = scoring.url_keys(df([("p", "http://a.org/a/"), ("p", "c.org"), (None, None)]), F.col("paper_id"), F.col("url"))
    r = scoring.url_prf(g, p).first()
    assert (r["tp"], r["fp"], r["fn"], r["p"], r["r"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    z = scoring.url_prf(g.limit(0), p.limit(0)).first()
    assert (z["tp"], z["p"], z["f1"]) == (0, 0.0, 0.0)


def test_two_stage(spark):
    gold = spark.createDataFrame([(0, "p", "The tool is at a place.", "a.org/1", "reference", "", ""), (1, "p", "Wholly other words stand.", "a.org/2", "reference", "", "")], ROWS)
    pred = spark.createDataFrame([(0, "p", "The tool is at a place", "a.org/1", "reference", "", ""), (1, "p", "Zzz qqq accepted", "a.org/2", "reference", "", ""), (2, "p", "Zzz qqq accepted!", "a.org/2", "reference", "", ""), (3, "p", "nope", "c.org", "reference", "", "")], ROWS)
    acc = spark.createDataFrame([("p", "a.org/2", "Zzz qqq accepted")], "paper_id string, url string, target_norm string")
    got = {(r["side"], r["ix"]): r["stage"] for r in scoring.two_stage(gold, pred, acc).collect()}
    assert got == {("gold", 0): "stage1", ("gold", 1): "stage2", ("pred", 0): "stage1", ("pred", 1): "stage2", ("pred", 2): "extra", ("pred", 3): "fp"}


def test_skeleton_merge(spark):
    rows = spark.createDataFrame([(0, "p", ["u1"], "A b c d e f", "A b c d e f", "a b c d e f"), (1, "p", ["u1", "u2"], "A b c d e f", "A b c d e f", "a b c d e f"), (2, "p", ["u3"], "A b c d e f", "A b c d e f", "a b c d e f"), (3, "q", [], "x", "x", "x")], "ix long, paper_id string, urls array<string>, target_raw string, target_norm string, skeleton string")
    got = {r["ix"]: (r["urls"], r["merged"]) for r in matching.skeleton_merge(rows).collect()}
    assert got == {1: (["u1", "u2"], [0, 1]), 2: (["u3"], [2]), 3: ([], [3])}


def test_classes(spark):
    gold = spark.createDataFrame([(0, "p", "a.org", "0"), (1, "p", "b.org", "3"), (2, "p", "c.org", "3.0")], "ix long, paper_id string, url string, label string")
    pred = spark.createDataFrame([(0, "p", "a.org", "third-party-software", "general-url", "exact"), (1, "p", "b.org", "3", "3", "exact"), (2, "p", "c.org", "3", "3", "stage2"), (3, "p", "d.org", "0", "", "genuine_fp")], "ix long, paper_id string, url string, pred_label string, gold_label string, match_rule string")
    count = lambda v: {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.class_counts(gold, pred, "coarse", v).collect()}
    assert count(1) == {"general-url": (0, 1, 1), "dataset": (0, 0, 0), "software": (1, 2, 1), "project": (0, 0, 0)}
    assert count(3)["software"] == (2, 1, 0) and count(4)["software"] == (2, 1, 0) and count(2)["software"] == (1, 2, 1)
    report = {r["class"]: r for r in scoring.class_report(scoring.class_counts(gold, pred, "binary", 3)).collect()}
    assert report["MICRO"]["tp"] == 2 and abs(report["MACRO"]["f1"] - (report["OADS"]["f1"] + report["not-OADS"]["f1"]) / 2) < 1e-12


MD = """# Introduction

We use a tool available at https://a.example.org/x1. It works. As in [2] it is known7 to be so. Mail me at a@b.example.org now.

7 See https://n.example.org/note for the note.

Padding text that is long enough to push the list below the third of the whole text, which it must be.

# References

1. Roe B. Other title. 2001.
2. Smith J, Doe A. Title. 2019. http://r.example.org/entry
"""


def test_markdown_dialect(spark):
    md = spark.createDataFrame([("p", "p.md", MD), ("q", "q.md", ""), ("n", "n.md", None)], "paper_id string, file string, text string")
    body = extract_markdown.body(md).collect()
    assert [(r["url"], r["preceding"], r["trailing"]) for r in body if r["paper_id"] == "p"] == [("https://a.example.org/x1", None, "It works.")]
    notes, lost = extract_markdown.restored_footnotes(md)
    (n,) = notes.collect()
    assert n["url"] == "https://n.example.org/note" and n["target"] == "As in [2] it is known [See https://n.example.org/note for the note.] to be so."
    assert lost.count() == 0
    (r,) = extract_markdown.restored_references(md).filter("citation_style = 'bracket_number'").collect()
    assert r["target"].startswith("As in [2 2. Smith J, Doe A.") and r["url"] == "http://r.example.org/entry"


def test_layout_dialect(spark):
    txt = spark.createDataFrame([("p", "=== PAGE 1 ===\nProse one. We use https://code.ours.org/to-\nol here. Next one.\n\n3 http://note.org/x\n=== PAGE 2 ===\nReferences\n[1] A 2001 http://r.org")], "paper_id string, text string")
    (r,) = extract_layout.body(txt).collect()
    assert (r["page"], r["url"], r["preceding"], r["target"], r["trailing"]) == (1, "https://code.ours.org/to-ol", "Prose one.", "We use https://code.ours.org/to-ol here.", "Next one.")
    span = lambda t, size, x: {"text": t, "size": size, "bbox": [x, 0.0, x + 5, 1.0]}
    box = lambda c, y, *lines: {"boxclass": c, "x0": 0.0, "y0": y, "x1": 9.0, "y1": y + 5, "textlines": [{"spans": list(s)} for s in lines]}
    page1 = {
        "page_number": 1, "height": 800.0, "fulltext": [], "links": [],
        "boxes": [box("text", 10.0, [span("We use X", 10.0, 0.0), span("1", 6.0, 5.1), span("here [2]. More.", 10.0, 11.0)]), box("footnote", 700.0, [span("1", 6.0, 0.0), span("See http://n.org/a", 8.0, 6.0)])],
    }
    page2 = {
        "page_number": 2, "height": 800.0, "links": [{"kind": 2, "uri": "https://doi.org/10.1/z", "from": [0.0, 21.0, 5.0, 24.0]}],
        "boxes": [box("section-header", 5.0, [span("References", 12.0, 0.0)])],
        "fulltext": [{"type": 0, "bbox": [0.0, 20.0, 9.0, 25.0], "lines": [{"spans": [{"text": "2. Smith. Title of it. http://r.org/page"}]}]}],
    }
    from linkweave.sources.files import LAYOUT

    page_type = LAYOUT.split("pages array<", 1)[1][:-1]
    pages = spark.createDataFrame([("p", "f", 1, [["1", "References", "2"]], 2, page1), ("p", "f", 2, [["1", "References", "2"]], 2, page2)], f"paper_id string, file string, page int, toc array<array<string>>, page_count int, p {page_type}")
    (f,) = extract_layout.footnotes(pages).collect()
    assert f["urls"] == ["http://n.org/a"] and f["target"].startswith("We use X [See http://n.org/a]") and f["trailing"] == "More."
    (c,) = extract_layout.references(pages).collect()
    assert c["url"] == "https://doi.org/10.1/z" and "[2][Smith. Title of it. http://r.org/page]" in c["target"]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div>
<p><s>First one.</s><s>We use X<ref type="foot" target="#f1">1</ref> here.</s><s>As in <ref type="bibr" target="#b0">[3]</ref>.</s><s>See <ref type="url" target="http://u.org/page">u.org</ref> for it.</s><s>Marked <ref type="bibr">9</ref> so.</s></p>
</div><note place="foot" xml:id="f1" n="1">http://x.org/a</note><note place="foot" xml:id="f2" n="9">http://y.org/b</note></body>
<back><div type="references"><listBibl><biblStruct xml:id="b0"><ptr target="http://r.org/c"/><note type="raw_reference">Smith. T. http://r.org/c</note></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei_dialect(spark):
    rows = tei.rows_of("p", "p.tei.xml", TEI) + tei.rows_of("bad", "bad.tei.xml", "<a>")
    df = spark.createDataFrame([tuple(r[k] for k in (c.split()[0] for c in ("paper_id s", "file s", "kind s", "id s", "container s", "para s", "sent s", "eligible s", "direct s", "in_references s", "tokens s", "marker s", "content s", "url s"))) for r in rows], tei.SCHEMA)
    assert df.filter("kind = 'error'").count() == 1
    (b,) = extract_tei.body(df).collect()
    assert b["url"] == "http://u.org/page" and b["target"] == "See http://u.org/page for it."
    notes = {r["footnote_marker"]: r["target"] for r in extract_tei.footnotes(df).collect()}
    assert notes == {"1": "We use X [http://x.org/a] here.", "9": "Marked [http://y.org/b] so."}
    (c,) = extract_tei.references(df).collect()
    assert c["target"] == "As in [3 Smith. T. http://r.org/c]." and c["preceding"] == "We use X1 here."


def test_mllm(spark):
    payload = '{"pdf_file": "PMC1.pdf", "items": [{"restored_sentence": "S.", "url": ["http://a.org", "http://b.org"]}, {"target": "T.", "url_printed": "http://c.org", "preceding": "P."}]}'
    files = spark.createDataFrame([("x/PMC1_body_urls.json", payload), ("y/Q.json", '[{"target_sentence": "U.", "url": "http://d.org"}]'), ("z/bad.json", "nope")], "file string, payload string")
    got = sorted(tuple(r) for r in mllm.flatten(files, "body").collect())
    assert got == [("PMC1", "body", "S.", "", "", "http://a.org | http://b.org"), ("PMC1", "body", "T.", "P.", "", "http://c.org"), ("Q", "body", "U.", "", "", "http://d.org")]
    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "id int, prompt string")

    def client(p):
        if p == "boom":
            raise RuntimeError("no")
        return '{"x": 1}'

    got = {r["id"]: (r["answer"], r["error"] is None) for r in mllm.call_model(df, client).collect()}
    assert got == {1: ('{"x": 1}', True), 2: ("{}", False)}
    items = spark.createDataFrame([("d", 1, "http://abcdef.org/x", "see abcdef.org/x http abcdef"), ("d", 2, "http://abcdef.org/x", "http://abcdef.org/x"), ("d", 3, "http://zzzzzz.org/y", "none"), ("d", 4, "http://zzzzzz.org/y", "none")], "pdf string, page int, url string, page_text string")
    assert sorted(r["page"] for r in mllm.own_pages(items).collect()) == [2, 3, 4]
