"""Cases that reviews found: order of files, nested wrappers, repeated citations, roles of lines."""

import subprocess
import sys

from pyspark.sql import functions as F

from linkweave.functions.urls import canonical_url, clean_url, strip_wrappers
from linkweave.operators import extract_markdown
from linkweave.operators import predicates as is_
from linkweave.session import cut, release, run_dir
from linkweave.sources.files import read_located


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rows_follow_sorted_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("paper_id,target,url,location\np,first,u,body\n")
    (tmp_path / "b.csv").write_text("paper_id,target,url,location\n" + "".join(f"p,b{i},u,body\n" for i in range(2000)))
    (tmp_path / "c.csv").write_text("paper_id,target,url,location\np,last,u,body\n")
    rows = read_located(spark, str(tmp_path)).orderBy("ix").select("target", "ix").collect()
    assert [r["target"] for r in rows] == ["first", *[f"b{i}" for i in range(2000)], "last"] and len({r["ix"] for r in rows}) == 2002


def test_wrappers_come_off_until_none_is_left(spark):
    assert one(spark, strip_wrappers(F.lit("((((((((<'http://x.org'>))))))))"))) == "http://x.org"
    assert one(spark, strip_wrappers(F.lit("((x)"), 1)) == "(x" and one(spark, strip_wrappers(F.lit(" x "))) == "x" and one(spark, strip_wrappers(F.lit(""))) == ""
    assert one(spark, canonical_url(F.lit("[" * 9 + "http://x.org/a" + "]" * 9))) == "x.org/a"


def test_layout_addresses_lose_all_final_marks(spark):
    for tail in ("!", "?", "’", "”", ".)", ""):
        assert one(spark, clean_url(F.lit("http://x.org/a" + tail), "layout")) == "http://x.org/a"


def test_every_author_year_citation_is_restored(spark):
    text = "# Introduction\n\nAs Smith (2001) said, it is. Others agree with it [Smith, 2001]. So did Smith (2001).\n\nReferences\n\nSmith J. A work. 2001. http://x.org/w\n"
    df = spark.createDataFrame([("p", "f", text)], "paper_id string, file string, text string")
    got = sorted((r["citation_start_char"], r["target"]) for r in extract_markdown.restored_references(df).collect())
    assert len(got) == 3 and len({a for a, _ in got}) == 3
    assert all("[Smith" in t and "http://x.org/w]" in t for _, t in got)


def test_roles(spark):
    rows = [("see figshare http://x.org", None), ("Contact: e-mail a@b.org", "mail"), ("![x](y.png)", "image"), ("References", "heading"), ("[1] http://x.org", "note"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "line string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", is_.line_role(F.col("line"))).collect())
    para = [("Figure 1 is http://x.org", "caption"), ("Figure 1. Data deposited at http://x.org", None), ("All rights reserved", "licence"), ("<td>x</td>", "table"), ("use curl http", "technical"), (None, None)]
    df = spark.createDataFrame(para, "p string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", is_.paragraph_role(F.col("p"))).collect())


def test_written_tables_are_released():
    code = (
        "import os, glob; from linkweave.session import *; s = get_session('1'); cut(s.range(3), 't'); d = run_dir(s).replace('file://', '');"
        "assert glob.glob(d + '/t-*'); release(s); assert not os.path.exists(d); print('done')"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "done" in out.stdout, out.stderr[-2000:]
    assert cut and release and run_dir


def test_near_texts_by_brute_force(spark):
    import random

    from linkweave.functions.similarity import ratio
    from linkweave.operators.matching import near_texts

    random.seed(4)
    texts = set()
    for _ in range(60):
        base = "".join(random.choice("abcde ") for _ in range(random.choice([3, 10, 40, 90, 130])))
        texts.add(base)
        for _ in range(4):
            t = list(base)
            for _ in range(random.randint(0, 6)):
                k = random.randrange(len(t) + 1)
                if random.random() < 0.5:
                    t.insert(k, random.choice("abcde "))
                elif len(t) > k:
                    t.pop(k)
            texts.add("".join(t))
    rows = [(random.choice("pq"), t) for t in texts]
    want = {(p, *sorted((a, b))) for p, a in rows for q, b in rows if p == q and a != b and a and b and ratio(a, b) >= 97.0}
    df = spark.createDataFrame(rows, "paper_id string, skeleton string")
    got = [tuple(r) for r in near_texts(df, "paper_id", "skeleton").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_large_papers_merge_and_match_as_small_ones(spark, monkeypatch):
    import random

    from linkweave.operators import matching

    random.seed(7)
    names = ["The tool of the north is described at the place of its making", "Another sentence stands here and tells of nothing else at all", "Short one"]
    rows = []
    for i in range(160):
        t = random.choice(names)
        if random.random() < 0.4:
            k = random.randrange(len(t))
            t = t[:k] + random.choice("xy") + t[k:]
        rows.append((i, random.choice("pq"), random.sample(["u1", "u2", "u3"], random.choice([0, 1, 1, 2])), t, t, t.lower()))
    df = spark.createDataFrame(rows, "ix long, paper_id string, urls array<string>, target_raw string, target_norm string, skeleton string")
    edges = spark.createDataFrame([("p", g, p, 1, float(80 + (g * p) % 20)) for g in range(40) for p in range(40) if (g * 7 + p * 3) % 5 < 1], "paper_id string, g long, p long, shared long, sim double")
    merge = lambda: sorted((r["ix"], tuple(r["urls"]), tuple(r["merged"])) for r in matching.skeleton_merge(df).collect())
    match = lambda: sorted(tuple(r) for r in matching.match_edges(edges).collect())
    small = (merge(), match())
    monkeypatch.setattr(matching, "SMALL", 5)
    assert (merge(), match()) == small and sum(len(m) for _, _, m in small[0]) == 160


def test_components_of_chains_and_combs(spark):
    from linkweave.operators.graph import components

    chain = [(i, i + 1) for i in range(0, 60)] + [(2 * i + 1001, 2 * i + 1000) for i in range(60)] + [(2 * i + 1000, 2 * i + 1002) for i in range(59)] + [(5000, 5000)]
    got = components(spark.createDataFrame(chain, "a long, b long")).groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("lo")).collect()
    assert sorted((r["lo"], r["n"]) for r in got) == [(0, 61), (1000, 120), (5000, 1)]


def test_run_writes_items_and_summaries(spark, tmp_path):
    from linkweave.run import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.md").write_text("# Introduction\n\nWe use a tool available at https://a.example.org/x1. It works.\n\nMore text.\n\n")
    (tmp_path / "in" / "q.md").write_text("Nothing.\n")
    got = run(spark, "markdown", str(tmp_path / "in"), str(tmp_path / "out"), by_paper=True)
    assert got["body"] == {"papers": 2, "papers_with_items": 1, "items": 1, "urls": 1} and got["reference"]["items"] == 0 and "error" not in got["footnote"]
    assert spark.read.json(str(tmp_path / "out/body/items")).first()["url"] == "https://a.example.org/x1"
    assert spark.read.json(str(tmp_path / "out/body/summary")).count() == 2
    assert "error" in run(spark, "markdown", str(tmp_path / "none"), str(tmp_path / "out2"), ("body",))["body"]


def test_converters_are_tried_again(spark):
    from linkweave.sources import convert

    def service(name, content):
        if name == "bad":
            raise ValueError("no pdf")
        if name == "busy":
            raise convert.Transient("503")
        return "<?xml version='1.0'?><TEI>" + "x" * 300 if name == "good" else "short"

    df = spark.createDataFrame([(n, bytearray(b"%PDF")) for n in ("good", "bad", "busy", "odd")], "file string, content binary")
    got = {r["file"]: r for r in convert.convert(df, service, pause=0.01).collect()}
    assert got["good"]["error"] is None and got["bad"]["error"] == "ValueError: no pdf" and got["busy"]["error"] == "transient: 503" and got["odd"]["error"] == "no valid output"
    done = spark.createDataFrame([("good", "x")], "file string, output string")
    assert {r["file"] for r in convert.unconverted(df, done).collect()} == {"bad", "busy", "odd"}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_split_once(spark):
    """The split of a text into body and list is in the plan once, not wherever its parts are named (F1)."""
    df = spark.createDataFrame([("p", "p.md", "# Introduction\n\nAs in [1] so.\n\n# References\n\n1. A. 2001. http://a.example/x\n2. B. 2002.\n")], "paper_id string, file string, text string")
    entries = extract_markdown.reference_entries(df)
    assert _plan(entries).count("E-?mail address") == 1
    assert [(r["index"], r["body"]) for r in entries.orderBy("entry_ix").collect()] == [("1", "# Introduction\n\nAs in [1] so.\n\n"), ("2", "# Introduction\n\nAs in [1] so.\n\n")]


def test_notes_are_looked_at_once(spark):
    """A line is held against the form of a note once for its addresses and never again for the blanks in its place (F2)."""
    df = spark.createDataFrame([("p", "p.md", "It counts7 well.\n\n7 See https://n.example/n/p for it.\n\nMore.\n")], "paper_id string, file string, text string")
    notes = extract_markdown.footnotes(df)
    assert _plan(notes).count("bibliography") <= 2
    (r,) = notes.collect()
    assert (r["marker"], r["start"], r["urls"], r["body"]) == ("7", 18, ["https://n.example/n/p"], "It counts7 well.\n\n" + " " * len("7 See https://n.example/n/p for it.") + "\n\nMore.\n")


def test_notes_of_a_text_are_cited_in_one_call(spark):
    """Marks and sentences are found by one call of Python, to which a body goes once and not once for each of its notes (F2)."""
    text = "It counts7 well. It ends.\n\nAnother stands here8.\n\n7 See https://n.example/n/p for it.\n\n 8: www.m.example/𝒳q\n\nMore\\footnote{At https://o.example/o}.\n\nEnd.\n"
    df = spark.createDataFrame([("p", "p.md", text), ("p", "p.md", text), ("q", "q.md", "7 See https://n.example/n/q for it.\n"), ("r", "r.md", None)], "paper_id string, file string, text string")
    rows, lost = extract_markdown.restored_footnotes(df)
    for d in (rows, lost):
        assert _plan(d).count("MapInArrow") + _plan(d).count("EvalPython") == 1
    got = sorted((r["marker"], r["url"], r["target"], r["trailing"], r["footnote_start_char"]) for r in rows.collect())
    assert got == [
        ("7", "https://n.example/n/p", "It counts [See https://n.example/n/p for it.] well.", "It ends.", 50),
        ("8", "www.m.example/𝒳q", "Another stands here [www.m.example/𝒳q].", None, 87),
        ("inline1", "https://o.example/o", "More [At https://o.example/o].", None, 113),
    ]
    assert [(r["paper_id"], r["reason"]) for r in lost.collect()] == [("q", "marker_not_found")]


def test_texts_are_cut_only_before_lines_that_may_begin_something(spark):
    """Lines that can be neither heading nor note aren't looked at; the body is what it was, whatever characters stand in it (F2)."""
    from linkweave.operators.regions import reference_start, split_references

    texts = {
        "𝒳y\n# References:\n1. A": 3,  # offsets count characters
        "References\nx": 0,
        "a\nReference list of things\nb": None,
        "a\n\tReferences\nb": None,  # a tab is no blank
        "a\n#\tReferences .\nb": 2,
        "a\nSources\n" + "b" * 40 + "\n wor\u212as cited\nc\nSources\nd": 51,  # the first in the last 65 %
        "a\nSources\nSources\n" + "b" * 90: 10,  # the last
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["at"], r["body"]) for r in df.select("text", reference_start(F.col("text")).alias("at"), split_references(F.col("text"))[0].alias("body")).collect()}
    assert got == {t: (at, t if at is None else t[:at]) for t, at in texts.items()}
    notes = _plan(extract_markdown.footnotes(df.select(F.lit("p").alias("paper_id"), F.lit("f").alias("file"), "text")))
    assert "split(raw" in notes and not [x for x in notes.split("split(raw")[1:] if not x.split(", ", 1)[1].startswith("\\n(?=")]


def test_alike_sentences_with_addresses_of_their_own_are_not_paired(spark, monkeypatch):
    """sentences of a large paper are compared only where their addresses can bring them together."""
    from linkweave.operators import matching

    rows = []
    for i in range(60):  # sets of two rows, joined by an address that a third one links; all sentences alike
        t = f"The data of station {i % 10} are at the place that is named behind this sentence"
        rows += [(3 * i, "p", [f"a{i}"], t, t, t.lower()), (3 * i + 1, "p", [f"b{i}"], t, t, t.lower()), (3 * i + 2, "p", [f"b{i}", f"a{i}"], t, t, t.lower())]
    df = spark.createDataFrame(rows, "ix long, paper_id string, urls array<string>, target_raw string, target_norm string, skeleton string")
    merge = lambda: sorted((r["ix"], tuple(r["urls"]), tuple(r["merged"])) for r in matching.skeleton_merge(df).collect())
    want = merge()
    assert len(want) == 120 and max(len(m) for _, _, m in want) == 2

    def never(*_):
        raise AssertionError("sentences were paired")

    monkeypatch.setattr(matching, "SMALL", 20)
    monkeypatch.setattr(matching, "near_texts", never)
    assert merge() == want


def test_candidates_write_no_texts(spark, monkeypatch):
    """a pair of rows is found once, by one of the addresses they share, and its sentences are written nowhere."""
    from linkweave.operators import matching

    written = []
    monkeypatch.setattr(matching, "cut", lambda df, name="t": written.append(df.columns) or cut(df, name))
    df = spark.createDataFrame([(1, "p", ["u", "v", "w"], "A sentence"), (2, "p", ["x"], "A sentence")], "ix long, paper_id string, urls array<string>, target_norm string")
    got = [tuple(r) for r in matching.candidate_edges(df, df).collect()]
    assert sorted(got) == [("p", 1, 1, 3, 100.0), ("p", 2, 2, 1, 100.0)]
    assert written == [["paper_id", "g", "p", "shared", "sim"]]
