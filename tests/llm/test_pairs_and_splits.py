"""Problems 1, 2 and 4 against brute force."""

import random
import re
import unicodedata
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import format_duplicates as fd
from linkweave.llm import linked_splits as ls
from linkweave.llm import lookalikes as la


def canon(x):
    return "\0" if x is None else "".join(c for c in x if unicodedata.category(c)[0] not in "ZPS" and c not in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85").lower()


def records(n=400):
    random.seed(5)
    ids, urls = ["PMC1", "pmc 1", "(PMC1)", "PMC2", None, ""], ["http://a.b/c", "HTTP://A.B/C", "a.b", None, "", " - "]
    rows = []
    for i in range(n):
        a, b = random.choice(ids), random.choice(urls)
        if random.random() < 0.2:
            a, b = b, a
        rows.append((i, a, b, random.choice(["t", "T", None]), random.choice([None, "1"])))
    return rows


SCHEMA = "row_id long, paper_id string, url string, target string, _h string"


def test_copy_pairs(spark):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda r: (tuple(sorted((canon(r[1]), canon(r[2])))), r[3], r[4])
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if key(a) == key(b)}
    got = [tuple(r) for r in fd.copy_pairs(df, "row_id", ("paper_id", "url"), ("target", "_h")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r[0])
    want_n = {min(g): len(g) for g in groups.values()}
    got_n = {r["id"]: r["n_copies"] for r in fd.collapse(df, "row_id", ("paper_id", "url"), ("target", "_h")).collect()}
    assert got_n == want_n


def test_hot_group_and_small_filter(spark, monkeypatch):
    monkeypatch.setattr(fd, "HOT", 8)
    rows = [(i, "PMC1", "u", "t", None) for i in range(60)] + [(100 + i, f"PMC{i}", "v", "t", None) for i in range(2, 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert fd.copy_pairs(df, "row_id", ("paper_id", "url"), ("target", "_h"), max_bits=1 << 16).count() == 60 * 59 // 2
    assert fd.collapse(df, "row_id", ("paper_id", "url"), ("target", "_h")).count() == 199
    assert fd.copy_pairs(df.limit(0), "row_id", ("paper_id", "url"), ("target", "_h")).count() == 0
    assert fd.collapse(df.limit(0), "row_id", ("paper_id", "url"), ("target", "_h")).count() == 0


def hits(h, filters):
    lane = fd.lane_of(h, len(filters))
    return np.array([fd._hit(h[i : i + 1], np.frombuffer(filters[k][0], np.uint8), filters[k][1])[0] for i, k in enumerate(lane.astype(int))])


def test_filter_has_no_false_negative(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(x),) for x in [*h, *h[:300]]], "h long").repartition(7)
    hit = hits(h, fd.repeated_filters(df, 5300))
    assert hit[:300].all() and hit[300:].mean() < 0.05


def test_small_filters_are_as_many_as_needed(spark, monkeypatch):
    """4,096 bits hold 256 hashes: 2,000 repeats need eight filters or more, and few others pass."""
    monkeypatch.setattr(fd, "RANGE_ROWS", 100)
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**62), 2**62, 20_000)
    df = spark.createDataFrame([(int(x),) for x in [*h, *h[:2000]]], "h long").repartition(5)
    filters = fd.repeated_filters(df, 22_000, max_bits=4096)
    assert len(filters) >= 8 and all(bits <= 4096 for _, bits in filters)
    hit = hits(h, filters)
    assert hit[:2000].all() and hit[2000:].mean() < 0.05
    rows = [(i, f"PMC{i % 3000}", "u", "t", None) for i in range(4000)]
    rec = spark.createDataFrame(rows, SCHEMA).repartition(4)
    maybe = fd.possible_repeats(rec, "row_id", ("paper_id", "url"), ("target", "_h"), max_bits=4096)
    assert maybe.count() == 4000 and 2000 <= maybe.filter("_maybe").count() < 2200
    assert fd.copy_pairs(rec, "row_id", ("paper_id", "url"), ("target", "_h"), max_bits=4096).count() == 1000
    monkeypatch.setattr(fd, "TASK_ROWS", 10)  # a hot group is dealt out
    hot = spark.createDataFrame([(i, "PMC1", "u", "t", None) for i in range(95)] + [(100, "PMC2", "u", "t", None)], SCHEMA)
    assert {tuple(r) for r in fd.copy_groups(hot, "row_id", ("paper_id", "url"), ("target", "_h")).collect()} == {(i, 0, 95) for i in range(95)}


def test_torn_papers_and_assignment(spark):
    random.seed(8)
    rows = []
    for i in range(300):
        p, f = f"PMC{random.randrange(260):08d}", random.choice([None, None, *[f"f{k}" for k in range(200)]])
        a, b = (p.lower().replace("pmc", "pmc: "), "http://x") if random.random() < 0.5 else ("http://x", f"({p})")
        rows.append((i, a, b, f, random.choice([None, None, None, " Train", "TEST", "train", "other"]), "x"))
    rows += [(900, None, None, None, None, "x"), (901, None, "u", None, "test", "x")]
    df = spark.createDataFrame(rows, "row_id long, paper_id string, url string, file string, split string, node string")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    plain = lambda r: next((m.group().upper() for v in r[1:3] if v for m in [re.fullmatch(r"(?i)pmc\d{8}", re.sub(r"\W|_", "", v))] if m), None)
    for r in rows:
        if plain(r) and r[3]:
            root[find("p" + plain(r))] = find("f" + r[3])
    splits = {}
    for r in rows:
        s = (r[4] or "").strip().lower()
        if s in ls.SPLITS and plain(r):
            splits.setdefault(find("p" + plain(r)), set()).add(s)
    want = {plain(r) for r in rows if plain(r) and len(splits.get(find("p" + plain(r)), ())) > 1}
    facts = ls.entity_facts(df, ("paper_id", "url"), "file", "split")
    assert {r["paper_id"] for r in ls.torn_papers(facts, ls.components(facts)).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    out, table = ls.assign_splits(df, "row_id", targets, ("paper_id", "url"), "file", "split")
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        if plain(r):
            by.setdefault(find("p" + plain(r)), set()).add((got[r[0]]["split"], got[r[0]]["status"]))
    assert all(len(v) == 1 for v in by.values())
    for c, v in by.items():
        s = splits.get(c, set())
        assert v == ({(None, "quarantined")} if len(s) > 1 else {(next(iter(s)), "kept")} if s else {(next(iter(v))[0], "new")})
    assert got[901]["split"] == "test" and got[900]["split"] in ls.SPLITS
    # a second batch: what is known keeps its split; linking two components of different splits quarantines them
    kept = {r["node"]: r["split"] for r in table.collect() if r["status"] == "kept"}
    a, b = next((x, y) for x in kept for y in kept if x[:2] == y[:2] == "p:" and kept[x] != kept[y])
    more = spark.createDataFrame([(1, a[2:], "u", "new-file", None), (2, b[2:], "u", "new-file", None), (3, "PMC99999999", "u", None, None)], "row_id long, paper_id string, url string, file string, split string")
    out2, table2 = ls.assign_splits(more, "row_id", targets, ("paper_id", "url"), "file", "split", previous=table)
    assert {r["id"]: r["status"] for r in out2.collect()} == {1: "quarantined", 2: "quarantined", 3: "new"}
    later = {r["node"]: r["split"] for r in table2.collect()}
    assert set(kept) <= set(later) and all(later[n] in (kept[n], None) for n in kept)


def test_quarantine_lasts(spark):
    schema = "row_id long, paper_id string, url string, file string, split string"
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    assign = lambda rows, table: ls.assign_splits(spark.createDataFrame(rows, schema), "row_id", targets, ("paper_id", "url"), "file", "split", previous=table)
    _, table = assign([(1, "PMC00000001", "u", "f1", "train"), (2, "PMC00000002", "u", "f2", "test"), (3, "PMC00000003", "u", "f3", "train")], None)
    out, table = assign([(1, "PMC00000001", "u", "f2", None)], table)
    assert out.first()["status"] == "quarantined"
    out, table = assign([(1, "PMC00000001", "u", "f2", None), (2, "PMC00000004", "u", "f3", None)], table)
    assert {r["id"]: (r["split"], r["status"]) for r in out.collect()} == {1: (None, "quarantined"), 2: ("train", "kept")}
    out, table = assign([(1, "PMC00000002", "u", "f1", "test"), (2, "PMC00000005", "u", "f3", None), (3, "PMC00000005", "u", "f1", None)], table)
    assert {(r["split"], r["status"]) for r in out.collect()} == {(None, "quarantined")}
    assert {r["node"]: r["status"] for r in table.collect()}["p:PMC00000004"] == "quarantined"


def test_untouched_quarantine_release_and_totals_of_all_batches(spark):
    schema = "row_id long, paper_id string, url string, file string, split string"
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    assign = lambda rows, table: ls.assign_splits(spark.createDataFrame(rows, schema), "row_id", targets, ("paper_id", "url"), "file", "split", previous=table)
    state = lambda table: {r["node"]: (r["split"], r["status"], r["n"]) for r in table.collect()}
    _, table = assign([(1, "PMC00000001", "u", "f1", "train"), (2, "PMC00000001", "u", None, "test"), *[(10 + i, f"PMC{i + 10:08d}", "u", None, "train") for i in range(80)]], None)
    assert state(table)["p:PMC00000001"] == state(table)["f:f1"][:2] + (2,) == (None, "quarantined", 2)
    _, table = assign([(1, "PMC00000002", "u", None, None)], table)  # an unrelated paper
    got = state(table)
    assert got["f:f1"] == (None, "quarantined", 0) and got["p:PMC00000010"] == ("train", "kept", 1) and len(got) == 83
    # 80 rows are train by now, so that new ones fill validation and test
    out, table = assign([(i, f"PMC{i:08d}", "u", None, None) for i in range(1000, 1019)], table)
    n = {}
    for r in out.collect():
        n[r["split"]] = n.get(r["split"], 0) + 1
    assert n.get("train", 0) <= 1 and abs(n["validation"] - n["test"]) <= 3
    held = next(r["component"] for r in table.collect() if r["status"] == "quarantined")
    table = ls.released(table, spark.createDataFrame([(held, "test")], "component string, split string"))
    out, table = assign([(1, "PMC00000001", "u", "f9", None)], table)
    assert tuple(out.select("split", "status").first()) == ("test", "kept") and state(table)["f:f9"] == ("test", "kept", 0) and state(table)["p:PMC00000001"][2] == 3
    out, table2 = ls.assign_splits(spark.createDataFrame([], schema), "row_id", targets, ("paper_id", "url"), "file", "split", previous=table)
    assert out.count() == 0 and state(table2) == state(table)


def test_splits_hit_their_shares(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), F.format_string("PMC%08d", (F.col("id") / 3).cast("int")).alias("paper_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("split"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    out, _ = ls.assign_splits(df, "row_id", targets, ("paper_id", "url"), "file", "split")
    n = {r["split"]: r["count"] / 6000 for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["test"] - 0.1) < 0.01
    out, table = ls.assign_splits(df.limit(0), "row_id", targets, ("paper_id", "url"), "file", "split")
    assert out.count() == 0 and table.count() == 0


def test_skeletons():
    same = [("paypal", "pаypаl"), ("file", "ﬁle"), ("a b", "a b"), ("a b", "a　b"), ("Señor", "Señor"), ("abc", "ａｂｃ"), ("x-y", "x‑y"), ("ab", "a​b"), ("ab", "a­b"), ("l", "ⅼ"), ("Axe", "Αxе")]
    for a, b in same:
        assert la.skeleton_of(a) == la.skeleton_of(b), (a, b)
    other = [("x2", "x²"), ("CO2", "CO₂"), ("resume", "résumé"), ("a b", "a  b"), ("Ab", "ab"), ("a-b", "a–b"), ("1/2", "½"), ("a", "b")]
    for a, b in other:
        assert la.skeleton_of(a) != la.skeleton_of(b), (a, b)
    for t in ("Ｆｕｌｌ ﬁne Ѕtrange ñ", "", "ascii only", "Ω∑漢字" * 5000):
        assert la.skeleton_of(la.skeleton_of(t)) == la.skeleton_of(t)
        assert la.clean_of(la.clean_of(t)) == la.clean_of(t)


def test_public_table(spark):
    table = la.public_prototypes(spark)
    assert len(table) > 4000
    of = lambda t: la.skeleton_of(t, table)
    same = [("a.b", "a․b"), ("BP", "ꓐꓑ"), ("1/2", "1⁄2"), ("1/2", "1∕2"), ("a:b", "a∶b"), ("paypal", "pаypаl"), ("In", "Ӏn"), ("Il", "Іl"), ("m", "ⅿ"), ("dz", "ʣ"), ("abc", "ａｂｃ"), ("a..b", "a‥b"), ("10", "1০")]
    for a, b in same:
        assert of(a) == of(b), (a, b, of(b))
    other = [("x2", "x²"), ("CO2", "CO₂"), ("resume", "résumé"), ("a-b", "a–b"), ("a'b", "a’b"), ("1/2", "½"), ("I", "l"), ("O", "0"), ("m", "rn"), ("1", "①"), ("Ab", "ab"), ("a…", "a..."), ("a•b", "a·b")]
    for a, b in other:
        assert of(a) != of(b), (a, b)
    for t in map(chr, [c for c in table if not 0xD800 <= c < 0xE000]):
        assert of(of(t)) == of(t) and la.clean_of(la.clean_of(t, table), table) == la.clean_of(t, table), hex(ord(t[0]))


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(la, "HOT", 4)
    rows = [(i, "p", "abc" if i % 3 else "аbc") for i in range(30)] + [(100 + i, "p", f"х{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, grp string, url string")
    got = [tuple(r) for r in la.look_alike_pairs(df, "id", "grp", ("url",)).collect()]
    assert len(got) == 200 and set(got) == {(a, b) for a in range(30) for b in range(a + 1, 30) if (a % 3 == 0) != (b % 3 == 0)}


def test_look_alike_pairs(spark):
    rows = [(1, "p", "abc", None), (2, "p", "аbc", "x"), (3, "p", "abc", "х"), (4, "q", "аbc", "x"), (5, "p", "a​bc", ""), (6, None, "abc", "x"), (7, "p", "ABC", "y")]
    df = spark.createDataFrame(rows, "id long, grp string, url string, target string")
    want = set()
    for a, b in combinations(rows, 2):
        if a[1] is not None and a[1] == b[1] and any(a[k] and b[k] and a[k] != b[k] and la.skeleton_of(a[k]) == la.skeleton_of(b[k]) for k in (2, 3)):
            want.add((a[0], b[0]))
    got = [tuple(r) for r in la.look_alike_pairs(df, "id", "grp", ("url", "target")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert la.look_alike_pairs(df.limit(0), "id", "grp", ("url", "target")).count() == 0
