"""Packed fields against what a careful reader would list."""

import pytest

from linkweave.operators.packed_values import Model, bare, lattice, split_packed, viterbi

A, B, C = "https://a.example/x_(2019)/1", "www.b.example/y?id=1&v=2", "http://c.example/z/x,y"
CELLS = [
    (f"{A}; {B}", [A, B]),
    (f"{A},{B}", [A, B]),
    (f"{A}|{B} |", [A, B]),
    (f"{A} and {B} and {C}", [A, B, C]),
    (f'["{A}", "{B}"]', [A, B]),
    (f"'{A}' and '{B}'", [A, B]),
    (f"<{A}>, <{B}>", [A, B]),
    (f"(1) {A} (2) {B}", [A, B]),
    (f"1. {A}\n2. {B}", [A, B]),
    (f"docs: {A}; code: {B}", [A, B]),
    (f"{A} (or {B})", [A, B]),
    (f'"{A},2" | "{B};b=1"', [f"{A},2", f"{B};b=1"]),
    (f"{A}; {A}", [A, A]),
    (f"{{{A}, {B}}}", [A, B]),
    (f"{A} / {B} • {C}", [A, B, C]),
]
SINGLE = [A, f"{C};", f"Available: {A}", "https://www . d.example/x", "https: //www.d.example/x", f'"{A}"', f"{A} (accessed 2 May 2017)", "", None, "PMC90000001", f"({A})."]


def test_cells(spark):
    rows = [(i, c) for i, (c, _) in enumerate(CELLS)] + [(1000 + i, c) for i, c in enumerate(SINGLE)] + [(2000 + i, f"https://h{i % 7}.example/p{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, cell string").selectExpr("id", "cell as url", "'x' as value", "1 as pos")
    got: dict[int, list] = {}
    for r in split_packed(df, "id", "url").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["value"]))
    assert {i: [v for _, v in sorted(x)] for i, x in got.items()} == {i: want for i, (_, want) in enumerate(CELLS)}
    assert all([p for p, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())


def test_singles_and_empty(spark):
    df = spark.createDataFrame([(1, f"{A};"), (2, None), (3, "")], "id long, url string")
    assert [tuple(r) for r in split_packed(df, "id", "url", singles=True).collect()] == [(1, 1, A)]
    assert split_packed(df.limit(0), "id", "url").count() == 0


def test_long_cell():
    chunks, delims = lattice("; ".join([A] * 3000))
    pat = "\x1f".join(x for k, c in enumerate(chunks) for x in ([c[0]] if k == 0 else [delims[k - 1], c[0]]))
    assert len(chunks) == 3000 and all(viterbi(pat, Model()))


@pytest.mark.parametrize("text,want", [(f"({A}),", A), (f"{A}.", f"{A}."), (f"- {A}", A), ("", "")])
def test_bare(text, want):
    assert bare(text) == want


def test_hosts_without_scheme_count_where_the_column_knows_them(spark):
    rows = [(i, f"https://h{i % 7}.example/p{i}") for i in range(300)]
    rows += [(1000, "h3.example/a; h4.example/b"), (1001, "see data.csv; read.me/x"), (1002, "https://h1 . h2.example/x"), (1003, "h5.example/only"), (1004, "http://new.example/1 and www.h2.example/2 or h6.example/3.")]
    got: dict[int, list] = {}
    for r in split_packed(spark.createDataFrame(rows, "id long, url string"), "id", "url").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["value"]))
    assert {i: [v for _, v in sorted(x)] for i, x in got.items()} == {1000: ["h3.example/a", "h4.example/b"], 1004: ["http://new.example/1", "www.h2.example/2", "h6.example/3."]}


def test_expectation_maximisation_does_not_merge_lists():
    from collections import Counter

    from linkweave.operators.packed_values import expected

    pats = {"A": 500, "A\x1f; \x1fE": 200, "E\x1f, \x1fA\x1f, \x1fa": 100, "n\x1f \x1fA\x1f \x1fn\x1f \x1fE": 50, "a": 80}
    counts: dict[str, float] = {}
    for _ in range(12):
        out = Counter()
        for p, n in pats.items():
            expected(p, Model(counts), float(n), out)
        counts = dict(out)
    model = Model(counts)
    assert viterbi("A\x1f; \x1fE", model) == [True] and viterbi("E\x1f, \x1fA\x1f, \x1fa", model) == [True, True] and viterbi("n\x1f \x1fA\x1f \x1fn\x1f \x1fE", model) == [True, True, True]
    # the lattice has the other edge too: a delimiter that was never seen to separate, before a host that starts nothing else
    joins = Model(counts | {"j:-\x1fa": 1e14, "s:-\x1fa": 0.0})
    assert viterbi("A\x1f-\x1fa", joins) == [False]
