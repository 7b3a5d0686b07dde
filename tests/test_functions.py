"""Edge tables of the column functions, with expected values worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.functions import paper_ids, text, urls
from linkweave.functions.similarity import lcs_length, ratio


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").repartition(2)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_canonical(spark):
    cases = {
        "https://www.Example.org/Data/": "example.org/data",
        "http://example.org//a//b?Q=1#frag": "example.org/a/b?q=1",
        "https://doi.org/10.1234/AbC/": "doi:10.1234/abc",
        "doi: 10.1234/ABC": "doi:10.1234/abc",
        "10.1234/abc.": "doi:10.1234/abc",
        "http : // example.org / ~user": "example.org/~user",
        r"http://host/$\sim$user": "host/~user",
        "http://host/˜user": "host/~user",
        "ftp://FTP.example.org/x": "ftp.example.org/x",
        "https://example.org:8080/x": "example.org:8080/x",
        "https://u@example.org/x": "u@example.org/x",
        "<www.example.com>": "example.com",
        '"https://example.org/x",': "example.org/x",
        "https://en.example.org/wiki/A_(b)": "en.example.org/wiki/a_(b",
        "http://[bad/x": "http://[bad/x",
        "(https://example.org/a).": "(https:/example.org/a",
        "": "",
        None: "",
    }
    got = [g for (g,) in values(spark, list(cases), urls.canonical_url(F.col("c")).alias("u"))]
    assert dict(zip(cases, got)) == cases


def test_canonical_is_idempotent(spark):
    rows = ["https://www.Example.org/Data/", "doi:10.1/x", "a.b/c?d=E", "HTTP://X.org//y/", "x y", "ftp://h/p/"]
    once = [g for (g,) in values(spark, rows, urls.canonical_url(F.col("c")).alias("u"))]
    assert [g for (g,) in values(spark, once, urls.canonical_url(F.col("c")).alias("u"))] == once


def test_mllm_canonical_keeps_dois(spark):
    assert values(spark, ["https://doi.org/10.1/X [last visit: today", "ftp://h/p"], urls.canonical_url(F.col("c"), "mllm").alias("u")) == [("doi.org/10.1/x",), ("ftp:/h/p",)]


def test_url_set(spark):
    rows = ["https://a.org/x1 and https://a.org/x0", "[a.org/1, b.org/2]", "a.org/1|A.org/1/", "no address", None, ""]
    got = [g for (g,) in values(spark, rows, urls.url_set(F.col("c")).alias("u"))]
    assert got == [["a.org/x0", "a.org/x1"], ["a.org/1", "b.org/2"], ["a.org/1"], ["noaddress"], [], []]


def test_trailing_zero_survives(spark):
    assert values(spark, ["https://a.org/10"], urls.url_set(F.col("c")).alias("u")) == [(["a.org/10"],)]


def test_paper_ids(spark):
    c = F.col("c")
    rows = ["1205.208", "1205.208.pdf", "1205.2080v2", "arXiv:1205.208v1.pdf", "PMC1.pdf", None]
    got = values(spark, rows, paper_ids.exact(c).alias("e"), paper_ids.heuristic_reference(c).alias("h"), paper_ids.mllm(c).alias("m"))
    assert got[0] == ("1205.2080", "1205.2080", "1205.2080")
    assert got[1][0] == "1205.2080" and got[2][1] == "1205.2080" and got[3][2] == "1205.2080"
    assert got[4] == ("PMC1", "PMC1", "PMC1") and got[5] == ("", "", "")


def test_file_ids(spark):
    rows = ["/a/b/PMC1.tei.xml", "x/1205.2080.md", "p.layout.json"]
    assert [g for (g,) in values(spark, rows, paper_ids.from_file(F.col("c")).alias("p"))] == ["PMC1", "1205.2080", "p.layout"]


def test_cleaners(spark):
    c = F.col("c")
    rows = ["https://e.org/wiki/Foo_(bar)).", "HTTP : // e.org/x,", "<https://e.org/a>", None]
    assert [g for (g,) in values(spark, rows, urls.clean_url(c, "markdown").alias("u"))] == ["https://e.org/wiki/Foo_(bar)", "http://e.org/x", "https://e.org/a", ""]
    assert values(spark, ["http://e.org/x. Accessed 3 May"], urls.clean_url(c, "reference").alias("u")) == [("http://e.org/x",)]


def test_arrays_of_urls(spark):
    df = spark.createDataFrame([(["http://a.org", "http://a.org/long", "http://b.org"],), ([],), (["x", "https://doi.org/10.1/a"],)], "u array<string>")
    got = df.select(urls.prefer_longer(F.col("u")).alias("l"), urls.best_url(F.col("u")).alias("b")).collect()
    assert got[0]["l"] == ["http://a.org/long", "http://b.org"] and got[0]["b"] == "http://a.org"
    assert got[1]["b"] is None and got[2]["b"] == "https://doi.org/10.1/a"


def test_texts(spark):
    c = F.col("c")
    assert values(spark, ["ﬁne “x” – y​ z"], text.norm_text(c).alias("t")) == [('fine "x" - y z',)]
    assert values(spark, ["See [1] https://a.org/x (here) ."], text.target_skeleton(c).alias("t")) == [("see url here.",)]
    assert values(spark, ["a\n```\ncode\n```\nb"], text.strip_fences(c).alias("t")) == [("a\n\n\n\nb",)]
    assert values(spark, ["x [label](http://a.org) ![i](p.png)"], text.unwrap_links(c).alias("t")) == [("x label ",)]
    assert values(spark, ["R&amp;D\r\nx"], text.normalize_chars(c).alias("t")) == [("R&D\nx",)]
    df = spark.createDataFrame([(["exam-", "ple of", "Semi-", "Arid"],)], "l array<string>")
    assert df.select(text.rejoin_lines(F.col("l"), guarded=True).alias("t")).first()["t"] == "example of Semi- Arid"
    assert df.select(text.rejoin_lines(F.col("l")).alias("t")).first()["t"] == "example of SemiArid"


def test_ratio_table():
    assert ratio("kitten", "sitting") == pytest.approx(61.538462, abs=1e-6)
    assert ratio("abc", "abc") == 100 and ratio("abc", "") == 0 and ratio("", "") == 100
    assert ratio("We use tool7.", "We use tool 7.") == pytest.approx(96.296296, abs=1e-6)
    assert ratio(None, "x") is None


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs_by_brute_force(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1] and ratio(a, b) == ratio(b, a)
