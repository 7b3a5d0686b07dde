"""The evaluators against brute force on random rows: collapsing, candidates, sizes of assignments, counts."""

import random

from pyspark.sql import functions as F

from linkweave.operators import matching, scoring

WORDS = "the tool archive of northern rivers lists many samples that were taken in spring and stored near harbour seven".split()


def rows(seed, n):
    rng = random.Random(seed)
    same = random.Random(0)  # all tables speak of the same things
    bases = [" ".join(same.sample(WORDS, 9)) for _ in range(5)]
    out = []
    for i in range(n):
        t = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        urls = " | ".join(rng.sample(["http://a.org/1", "http://b.org/2", "http://c.org/3", "http://creativecommons.org/x"], rng.choice([0, 1, 1, 2])))
        out.append((i, rng.choice(["p", "q"]), " ".join(t), urls, rng.choice(["body", "footnote"]), rng.choice(["0", "1", ""]), "test"))
    return out


SCHEMA = "ix long, paper_id string, target string, url string, location string, label string, split string"


def indel(a, b):
    """200 LCS / (len a + len b), by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def largest(edges):
    """The size of a maximum assignment, by augmenting paths."""
    near, of = {}, {}
    for g, p in edges:
        near.setdefault(g, []).append(p)

    def augment(g, seen):
        for p in near[g]:
            if p not in seen:
                seen.add(p)
                if p not in of or augment(of[p], seen):
                    of[p] = g
                    return True
        return False

    return sum(augment(g, set()) for g in near)


def collapsed(rs):
    out = {}
    for ix, paper, target, url, loc, *_ in rs:
        u = {x.strip().removeprefix("http://") for x in url.split("|") if x.strip()}
        key = (loc, paper, target)
        if key in out:
            out[key][1].update(u)
        else:
            out[key] = (ix, set(u))
    return [(loc, paper, t, ix, u) for (loc, paper, t), (ix, u) in out.items()]


def test_candidates_assignment_and_counts(spark):
    for seed in (1, 2):
        gold, pred = rows(seed, 60), rows(seed + 50, 60)
        g, p = collapsed(gold), collapsed(pred)
        edges = [(a, b) for a in g for b in p if a[:2] == b[:2] and a[4] & b[4] and indel(a[2], b[2]) >= 80.0]
        gd, pd_ = spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(pred, SCHEMA)
        keep = lambda d: matching.collapse(scoring.context_rows(d), ["loc", "paper_id", "target_norm"])
        found = matching.candidate_edges(keep(gd), keep(pd_), on=("loc", "paper_id")).collect()
        want = {(a[3], b[3]): (len(a[4] & b[4]), round(indel(a[2], b[2]), 6)) for a, b in edges}
        assert {(r["g"], r["p"]): (r["shared"], round(r["sim"], 6)) for r in found} == want and want
        pairs = matching.match_edges(matching.candidate_edges(keep(gd), keep(pd_), on=("loc", "paper_id"))).collect()
        assert {(r["g"], r["p"]) for r in pairs} <= set(want) and len({r["g"] for r in pairs}) == len({r["p"] for r in pairs}) == len(pairs) == largest(list(want))
        hit = {r["g"] for r in pairs}
        forgiven = lambda u: any("creativecommons.org" in x for x in u)
        fn = sum(a[3] not in hit and not forgiven(a[4]) for a in g)
        got = scoring.context_counts(gd, pd_).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
        assert tuple(got) == (len(pairs), len(p) - len(pairs), fn)


def test_reference_counts(spark):
    gold, pred = rows(11, 50), rows(61, 50)
    keys = lambda rs: [(r[1], x.strip().removeprefix("http://"), " ".join(sorted(r[2].split()))) for r in rs for x in r[3].split("|") if x.strip()]
    g, p = keys(gold), keys(pred)
    gk, pk, papers = {k[:2] for k in g}, {k[:2] for k in p}, {r[1] for r in gold if r[3]}
    hits = {a[:2] for a in g for b in p if a[:2] == b[:2] and indel(a[2], b[2]) >= 80.0}
    soft = {(r[1], x.strip().removeprefix("http://")) for r in gold if "creativecommons" in r[3] for x in r[3].split("|")}
    want = (len(hits), len({k for k in pk - gk if k[0] in papers}), len(gk - hits - soft))
    got = scoring.reference_counts(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(pred, SCHEMA)).first()
    assert tuple(got) == want


def test_merge_by_brute_force(spark):
    rs = rows(21, 80)
    d = scoring.mllm_rows(spark.createDataFrame(rs, SCHEMA), "gold", False)
    recs = sorted((r["ix"], r["paper_id"], set(r["urls"]), r["skeleton"]) for r in d.collect())
    left, want = recs, []
    while left:
        base, group, urls, rest = left[0], [left[0]], set(left[0][2]), []
        for r in left[1:]:
            if r[1] == base[1] and (urls & r[2] or not urls or not r[2]) and indel(base[3], r[3]) >= 97.0:
                group.append(r)
                urls |= r[2]
            else:
                rest.append(r)
        want.append((tuple(x[0] for x in group), tuple(sorted(urls))))
        left = rest
    got = [(tuple(r["merged"]), tuple(r["urls"])) for r in matching.skeleton_merge(d).collect()]
    assert sorted(got) == sorted(want) and any(len(m) > 1 for m, _ in want)
