"""Problems 5 to 9: round trips, brute force, and cases made by hand."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import automata, encoding, markup, mixing, page_noise, subjects
from linkweave.llm.markup_tree import clean, parse
from linkweave.llm.page_lines import Page, divided, header_shape

# --- pages ---


def test_automaton_by_brute_force():
    random.seed(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(300)}
    trie = automata.Trie(words)
    for k in (1, 2):
        search = automata.Levenshtein(k).search
        for _ in range(150):
            q = "".join(random.choice("abcd") for _ in range(random.randint(0, 8)))
            assert sorted(search(q, trie)) == sorted((w, distance(q, w)) for w in words if distance(q, w) <= k)


@pytest.mark.parametrize("line,shape", [("Annals of Solmel Practice 42 (2001)", 2), ("A. Korran and B. Torkor", 2), ("KORRAN ET AL.", 2), ("The index of Ranpel", 1), ("Korran A, Torkor B. Title", 0), ("which were found in 3", 0), ("Korran. See", 0), ("", 0)])
def test_header_shapes(line, shape):
    assert header_shape(line) == shape


def test_furniture_and_divided_words():
    p = Page("The bilin-\n\nSeite 330\nProc. Riknor Workshop on Samples 11 (1990)\n\ngual accent of semi-\nprofessional players was stu¬\ndied in the lab.")
    assert [(i, k) for i, k, _, s in p.found if s > 1] == [(2, "page_number"), (3, "running_header")]
    assert [(a + b, by) for a, _, b, by in divided(p)] == [("bilingual", True), ("semiprofessional", True), ("studied", True)]
    assert Page("").found == [] and Page("one line").found == []


def corpus(spark):
    random.seed(6)
    nouns = "tournament register measure instrument department library sediment harvest pattern signal".split()
    text = lambda: " ".join(f"The {random.choice(nouns)} follows the semi-professional {random.choice(nouns)} near the old harbour." for _ in range(4))
    rows = [("footnote", i, text()) for i in range(120)]
    rows += [("footnote", 900, "The tournarnent follows the harvcst near the old li-\nbrary of semi-\nprofessional\n12\npatterns."), ("footnote", 901, None), ("footnote", 902, "  \n"), ("md_file", 903, "Pre- and post-test siqnal of the sedi- ment."), ("footnote", 900, "The tournarnent follows the harvcst near the old li-\nbrary of semi-\nprofessional\n12\npatterns.")]
    return spark.createDataFrame(rows, "kind string, id long, text string")


def test_page_noise(spark):
    df = corpus(spark)
    want = {("footnote", 900, "misread_word", "tournament"), ("footnote", 900, "misread_word", "harvest"), ("footnote", 900, "broken_word", "library"), ("footnote", 900, "page_number", "4"), ("md_file", 903, "misread_word", "signal"), ("md_file", 903, "broken_word", "sediment")}
    got = [tuple(r) for r in page_noise.page_noise(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in page_noise.page_noise(df, limit=0).collect()} == want  # corrections joined instead of broadcast
    assert {tuple(r) for r in page_noise.page_noise(df, words=30).collect()} == want  # and counts of rare words
    fixed = {r["id"]: r["text"] for r in page_noise.repair(df).collect()}
    joined = page_noise.repair(df, limit=0, words=30).collect()
    assert len(joined) == df.count() and {r["id"]: r["text"] for r in joined} == fixed
    assert fixed[900] == "The tournament follows the harvest near the old library of semi-professional patterns." and fixed[901] is None and fixed[902] == "  \n"
    assert fixed[903] == "Pre- and post-test signal of the sediment."
    assert page_noise.page_noise(df.limit(0)).count() == 0


def test_misread_words_in_capitals_and_short_ones(spark):
    random.seed(6)
    nouns = "document volume sample tournament harvest".split()
    text = lambda: " ".join(f"The {random.choice(nouns)} of {random.choice(nouns)} in the old Sammlung was near the DOCUMENT." for _ in range(4))
    rows = [("footnote", i, text()) for i in range(120)] + [("footnote", 900, "Docurnent was near. Volurne was 0f the old Samrnlung and 1n the D0CUMENT. NASA was near the ICA.")]
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    got = {tuple(r)[1:] for r in page_noise.page_noise(df).collect()}
    assert got == {(900, "misread_word", w) for w in ("document", "volume", "of", "sammlung", "in")}
    fixed = page_noise.repair(df).filter("id = 900").first()["text"]
    assert fixed == "Document was near. Volume was of the old Sammlung and in the DOCUMENT. NASA was near the ICA."


def test_words_with_two_confusions_and_edits():
    assert page_noise.edits("harvcst", "harvest") == [("e", "c")] and page_noise.edits("tournarnent", "tournament") == [("m", "rn")]
    assert page_noise.edits("hurvcst", "harvest") == [("a", "u"), ("e", "c")] and page_noise.edits("xurvcstt", "harvest") == []


class Words:
    """A language of a few words and pairs."""

    def __init__(self, words, pairs):
        self.words, self.compounds, self.top, self.total = words, {}, 10_000, 100_000
        self.pairs = np.zeros(page_noise.PAIRS, dtype=np.int64)
        for a, b in pairs:
            self.pairs[page_noise.pair_bucket(a, b)] = 500


def test_repair_asks_the_neighbours_and_keeps_first_lines():
    language = Words({"library": 50}, [("the", "barn"), ("burn", "wood")])
    fixes = {"bnrn": (["burn", "barn"], [1.0, 0.9])}
    text = "The History of Rome\nunderstands what the\nbnrn in the li-\nbrary holds: bnrn wood\n\\(bnrn\\)."
    page = Page(text)
    assert [x[3] for x in page.found] == [1]
    assert page_noise.repaired(text, language, page_noise.Suspects(fixes)) == "The History of Rome understands what the barn in the library holds: burn wood\n\n\\(bnrn\\)."
    found = page_noise.noise_of(text, language, page_noise.Suspects(fixes))
    assert found == [("broken_word", "library"), ("misread_word", "barn"), ("misread_word", "burn")]


# --- markup ---

DOC = """# 1 Intro &amp; more

Costs were $15 and $61 per seat, but $E = m c^2$ holds and \\(a < b\\) too.

- first **item**
- second item

1. one
2. two

in group
6. Our corpus is one.

```python
# not a heading
* not an item
```

<pre><code>x &lt;- 1
</code></pre>

<h2 class="s"><b>Results</b></h2>

\\section*{Methods \\& data}\\label{sec:1}

== Wiki head ==

Setext
------

\\begin{itemize}
  \\item alpha \\& beta
\\end{itemize}

$$
F_1 = 2
$$

<math display="block">c &lt; d</math>

\\begin{equation}
k = 1
\\end{equation}
"""


def test_pieces(spark):
    rows = [(i, DOC) for i in range(40)] + [(100, None), (101, ""), (102, "plain text only"), (103, "```\nnever closed")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("content", F.lit(1))
    got = {}
    for r in markup.pieces(df).collect():
        got.setdefault(r["id"], set()).add((r["piece"], r["content"]))
    assert got[0] == {
        ("heading", "1 Intro & more"), ("heading", "Results"), ("heading", "Methods & data"), ("heading", "Wiki head"), ("heading", "Setext"),
        ("item", "first item"), ("item", "second item"), ("item", "one"), ("item", "two"), ("item", "alpha & beta"),
        ("code", "# not a heading"), ("code", "x <- 1"),
        ("formula", "E = m c^2"), ("formula", "a < b"), ("formula", "F_1 = 2"), ("formula", "c < d"), ("formula", "k = 1"),
    }
    assert not {100, 101, 102} & set(got) and got[103] == {("code", "never closed")}
    out = {r["id"]: r["text"] for r in markup.clean_texts(df).collect()}
    assert "1 Intro & more" in out[0] and "- first item\n- second item" in out[0] and "$E = m c^2$" in out[0] and "<" not in out[0].replace("<- 1", "").replace("a < b", "").replace("c < d", "") and out[100] is None and out[101] == ""
    assert markup.pieces(df.limit(0)).count() == 0


TREE = """<ul class="toc"><li>alpha</li><li>beta<ol><li>gamma</li></ol></li></ul><H2 id="r">Our
results</h2><p>Before <PRE>x = 1
# no heading</Pre> between <pre>y</pre> after.</p>
- one
  - two

| index | value |
|---|---|
| 7 | 8 |

![The caption](a.png)

<table><tr><td>c1</td><td>c2</td></tr></table>

Lorna Belquor and Ranbel Torvik

Here $%s = 1$ is long.

The sentence goes
on with Korran and Torvik and
ends.

It breaks

Annals of Solmel Practice

in two.
"""


def test_tags_wherever_lines_break_and_no_text_lost():
    long = "a_1 + " * 1700 + "b"
    text = TREE % long
    model = markup.fit([DOC, TREE % "x_1"] * 40)
    decoder = markup.Decoder(model)
    kinds, nodes = decoder(text)
    got = [(markup.KINDS[k], markup.piece(markup.KINDS[k], x)) for k, x in zip(kinds, nodes) if k]
    assert got == [("item", "alpha"), ("item", "beta"), ("item", "gamma"), ("heading", "Our results"), ("code", "x = 1"), ("code", "y"), ("item", "one"), ("item", "two"), ("formula", f"{long} = 1")]
    out = markup.cleaned(kinds, nodes)
    for t in ("- alpha\n- beta\n  - gamma", "Our results", "Before", "x = 1\n# no heading", "between", "after.", "- one\n  - two", "index | value\n7 | 8", "The caption", "c1 | c2", "Lorna Belquor and Ranbel Torvik", f"${long} = 1$", "goes on with Korran and Torvik and ends."):
        assert t in out, t
    assert "Annals" not in out  # a sentence goes on across it
    assert [x.depth for x in nodes if x.family == "li"] == [1, 1, 3]
    assert decoder("") == ([], []) and markup.cleaned(*decoder("<ul><li>")) == ""


def test_decoding_has_no_contradiction():
    from linkweave.llm.markup_tree import Node

    nodes = [Node("fence", "", "", 0), Node("hash", "", "", 0, parent=0), Node("dollar", "", "", 0, parent=1, span=(0, 3)), Node("li", "", "", 0), Node("hash", "", "", 0, parent=3)]
    flat = [-1.0, -1.0, -1.0, -1.0, -1.0]
    sure = lambda k: [0.0 if i == k else -9.0 for i in range(5)]
    assert markup.decode(nodes, [sure(3), sure(1), sure(4), sure(2), sure(1)]) == [0, 1, 4, 0, 1] or markup.decode(nodes, [sure(3), sure(1), sure(4), sure(2), sure(1)])[0] == 3
    for scores in ([flat] * 5, [sure(3)] + [flat] * 4, [sure(0), sure(1), sure(4), sure(2), flat]):
        k = markup.decode(nodes, scores)
        assert not (k[0] == 3 and (k[1] or k[2])) and not (k[1] == 1 and k[2] not in (0, 4)) and not (k[3] == 2 and k[4] == 1)


def test_nested_nodes_and_clean():
    nodes = parse("```\n# x\n```")
    assert [(n.family, n.parent) for n in nodes] == [("fence", -1), ("hash", 0)]
    assert clean("a **b** _c_ `d` [t](http://x) <i>e</i> \\emph{f} x\\_y R&amp;D'''g'''[^1]") == "a b c d t e f x_y R&Dg"
    assert parse("") == []


@pytest.mark.parametrize(
    "field,want",
    [
        ("<a href='http://x.org/a' target='_blank'>http://x.org/a</a>", "http://x.org/a"), ("[t](http://x.org/a \"T\")", "http://x.org/a"), ("](http://x.org/a)", "http://x.org/a"), ("{\\tt http://x.org/\\~{}u\\_v}", "http://x.org/~u_v"),
        ("{{cite web|url=http://x.org|title=T}}", "http://x.org"), ("&lt;http://x.org&gt;", "http://x.org"), ("\\footnote{\\url{http://x.org\\&y}}", "http://x.org&y"), ("''http://x.org''", "http://x.org"), ("_http://x.org/a_", "http://x.org/a"),
        ("[t]: http://x.org", "http://x.org"), ("http://x.org</a>", "http://x.org"), ("http://x.org?a[]=1", "http://x.org?a[]=1"), ("http://x.org/v_(a)_b", "http://x.org/v_(a)_b"), ("http://x.org/x**2", "http://x.org/x**2"), ("http://x.org/l'x", "http://x.org/l'x"),
        ("http://x.org?f=*", "http://x.org?f=*"), ("http://x.org?amp=1", "http://x.org?amp=1"), ("", ""),
    ],
)
def test_bare_addresses(field, want):
    fields = [x for i in range(60) for x in (f"<a href='http://y.org/{i}' class='c'>t</a>", f"[t {i}](http://y.org/{i})", f"{{\\tt http://y.org/a\\_{i}}}", f"''http://y.org/{i}''", f"&lt;http://y.org/{i}&gt;", f"\\footnote{{\\url{{http://y.org/{i}}}}}", f"http://y.org/a_{i}", f"_http://y.org/{i}_", f"http://y.org/{i}</a>")]
    assert markup.bare_addresses([field], markup.fit_layers(fields)) == [want]


# --- tokens and mixtures ---


def test_ids_equal_the_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    random.seed(9)
    texts = ["", "a" * 5000, "<|endoftext|> x", "é​ 漢字かな \r\n\t x", " " * 300 + "a", "".join(random.choice("abAB é漢0 \n's’😀") for _ in range(4000)), "ab" * 20000, "The work was done in 2012.", "The work was done in 2012."]
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(99, None, "s")]
    got = {r["id"]: list(r["ids"]) for r in encoding.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()}
    want = {i: e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))} | {99: []}
    assert got == want
    assert t.decode(got[5]) == texts[5]
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_pivotal_rounding(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = np.random.default_rng(3)
    p = rng.random(3000)
    size = rng.integers(1, 5000, 3000)
    df = spark.createDataFrame([(i, "g" if i % 3 else "h", float(x), int(n)) for i, (x, n) in enumerate(zip(p, size))], "id long, grp string, p double, size long")
    got = {r["id"]: r["extra"] for r in mixing.round_fractions(df, seed=1).collect()}
    assert len(got) == 3000 and set(got.values()) <= {0, 1}
    for keep in (lambda i: i % 3, lambda i: not i % 3):
        assert abs(sum(got[i] for i in got if keep(i)) - sum(p[i] for i in got if keep(i))) <= 1
        # by size too: what a block passes on is one row of it at most
        assert abs(sum(got[i] * size[i] for i in got if keep(i)) - sum(p[i] * size[i] for i in got if keep(i))) <= 0.005 * sum(size[i] for i in got if keep(i))
    assert got == {r["id"]: r["extra"] for r in mixing.round_fractions(df.repartition(3), seed=1).collect()}
    hit = np.mean([[got2 for got2 in mixing._pivot(np.arange(4) + 10 * s, np.array([0.2, 0.5, 0.7, 0.6]), s, True)[0]] for s in range(3000)], axis=0)
    assert np.allclose(hit, [0.2, 0.5, 0.7, 0.6], atol=0.04)


def test_mixture(spark):
    docs = [(i, f"Some words of text number {i} " * (1 + i % 4), "big") for i in range(600)] + [(1000 + i, f"Little text {i}", "small") for i in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "Little text 0", "small"), (2003, "x y z", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 4), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats long")
    sized = mixing.sizes(df, "doc_id", "text", "source")
    m = mixing.mix(sized, targets)
    got = {r["id"]: r["copies"] for r in m.collect()}
    assert len(got) == len(docs) and got[2000] == got[2001] == got[2003] == got[2002] == 0 and all(got[1000 + i] == 3 for i in range(10))
    total = sized.agg(F.sum("tokens")).first()[0]
    s = {r["source"]: r for r in mixing.shares(m, targets).collect()}
    assert s["small"]["held_back"] and s["none"]["held_back"] and not s["big"]["held_back"] and abs(s["big"]["tokens_used"] / total - 0.5) < 0.02 and s["none"]["tokens_used"] == 0
    assert s["small"]["used_up"] and s["none"]["used_up"] and not s["big"]["used_up"]
    for r in s.values():
        assert abs(r["tokens_used"] / total - r["reachable_share"]) < 0.002
    # short because its texts repeat, not because of its cap
    twice = spark.createDataFrame([(i, f"Text {i % 10} of a few words", "dup") for i in range(40)] + [(100 + i, f"Other text {i} of many more words", "rest") for i in range(20)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("dup", 0.5, 1), ("rest", 0.5, 9)], "source string, target_share double, max_repeats long")
    r = {x["source"]: x for x in mixing.shares(mixing.mix(mixing.sizes(twice, "doc_id", "text", "source"), goal), goal).collect()}
    assert r["dup"]["used_up"] and not r["dup"]["held_back"] and r["dup"]["reachable_share"] < 0.5 and not r["rest"]["used_up"]
    assert mixing.mix(mixing.sizes(df.limit(0), "doc_id", "text", "source"), targets).count() == 0


# --- subjects ---

TOPICS = {"sport": "goal league runner medal referee stadium".split(), "law": "court judge statute verdict clause appeal".split(), "astronomy": "star orbit galaxy comet nebula quasar".split()}


def test_sentences():
    assert subjects.sentences("As Smith et al. [2] said, it is so. See (http://x.org/a_(b).c). Then p < 0.05. No. 3 is it.\n\nNew one") == ["As Smith et al. [2] said, it is so.", "See .", "Then p < 0.05.", "No. 3 is it.", "New one"]
    assert subjects.sentences("") == [] and subjects.sentences(" \r\n ") == []


def test_subjects_on_held_out(spark):
    random.seed(12)
    names = list(TOPICS)

    def sentence(s):
        a, b = random.sample(TOPICS[s], 2)
        return random.choice([f"The {a} was measured against the {b} in group {random.randrange(9)}.", f"Data on the {a} came from us, and data on the {b} from them.", f"It remains unclear whether the {a} depends on the {b} alone."])

    docs, truth = [], {}
    for i in range(360):
        s = random.sample(names, random.choice([1, 1, 2]))
        k = random.randint(6, 10)
        body = [sentence(s[j % len(s)]) for j in range(k)] + ["All authors read and approved this text."]
        if len(s) == 1:
            body.append(sentence(random.choice([n for n in names if n not in s])))  # touched on in passing
        docs.append((i, " ".join(body), random.choice(["en", "en", None])))
        truth[i] = set(s)
    docs += [(900, None, None), (901, "", "en"), (902, "All authors read and approved this text.", "en")]
    labels = [(i, random.choice(names) if random.random() < 0.1 else s) for i in range(0, 120) for s in truth[i]] + [(12345, "sport"), (1, "cooking"), (2, None)]
    df = spark.createDataFrame(docs, "id long, text string, lang string")
    lab = spark.createDataFrame(labels, "id long, subject string")
    got = {}
    for r in subjects.subjects_of(df, lab, names).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    held = [i for i in truth if i >= 120]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right / len(held) > 0.9, Counter((len(truth[i]), len(got.get(i, ()))) for i in held)
    assert not {900, 901, 902} & set(got)
    assert subjects.subjects_of(df.limit(0), lab, names).count() == 0
    assert subjects.subjects_of(df.limit(5), lab.limit(0), names).count() == 0


def test_frequent_sets_by_brute_force(spark, monkeypatch):
    from itertools import combinations

    monkeypatch.setattr(subjects, "TREE", 40)
    random.seed(2)
    rows = [("s", "", " ".join(random.sample("abcdefgh", random.randint(0, 5))), random.randrange(3), random.randint(1, 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, lang string, s string, c int, n long").repartition(3)
    want = Counter()
    for _, _, s, c, n in rows:
        known = [w for w in "abcdef" if w in s.split()]
        for x in [(w, "") for w in known] + list(combinations(known, 2)):
            want[(*x, c)] += n
    got = {(r["a"], r["b"], r["c"]): r["n"] for r in subjects.frequent_sets(df, list("abcdef"), 3).collect()}
    assert got == dict(want)


def test_repeated_long_sentences_stay_cheap(spark):
    text = " ".join(f"topical{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60))
    rows = [("s", "", text, i % 2, 1) for i in range(1000)] + [("s", "", " ".join(f"w{i}" for i in range(5000)), 0, 1)]
    df = spark.createDataFrame(rows, "t string, lang string, s string, c int, n long")
    sets = subjects.frequent_sets(df, [*text.split(), *[f"w{i}" for i in range(5000)]], 2)
    assert sets.filter("a like 'topical%' and b = ''").count() == 120 and sets.filter("a like 'topical%' and b <> ''").count() == 60 * 59
    assert sets.filter("a like 'w%' and b = ''").count() == 5000
