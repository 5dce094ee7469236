"""Spelling variants, ranked search and main text against plain versions and on hand-made rows."""

from __future__ import annotations

import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filmloom.llm import lexical_search, main_text, page_tree, spelling_variants
from filmloom.llm.page_layouts import Layout
from filmloom.llm.queries import QUERIES
from tests.llm.cases import ODD, SCHEMA, lower

FOLDER = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


def of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Spelling variants


def plain_words(docs, slip=97, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(words):
    links = {w: [] for w in words}
    for a, b in itertools.combinations(sorted(words), 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(links[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def test_variants_of_the_documents(spark, docs):
    expected = plain_words(docs)
    few = {w: n for w, n in expected.items() if n >= 12}
    table = spark.createDataFrame(list(few.items()), "word string, n bigint")
    assert sorted(of(spelling_variants.corpus_words(spark.read.parquet(f"{FOLDER}/documents.parquet")), "word", "n")) == sorted(expected.items())
    assert sorted(of(spelling_variants.variants(table), "word", "n", "n_near", "form", "form_n", "root")) == plain_variants(few)


def test_crowded_chunks(spark):
    # A common beginning and a common end, runs of one letter, letters outside ASCII, equal counts, a chain of forms.
    rng = random.Random(5)
    words = {"gegen" + "".join(rng.choices("abc", k=rng.randint(0, 5))): rng.choice([3, 6, 12, 60]) for _ in range(400)}
    words |= {"".join(rng.choices("xyé", k=rng.randint(1, 5))) + "zeichen": rng.choice([3, 7, 20]) for _ in range(150)}
    words |= {"a" * n: 2**n for n in range(5, 12)} | {"a" * n + "b" + "a" * m: 5 for n in range(4) for m in range(4, 7)}
    words |= {"ÀÀÀÀÀ": 9, "ÀÀÀÀÿ": 9, "ààààà": 4, "hallo" + "x" * 300: 3, "hallo" + "x" * 299: 30}
    table = spark.createDataFrame([*words.items(), (None, 4)], "word string, n bigint")
    expected = plain_variants(words)
    for group in (1, 24):
        pairs = of(spelling_variants.near_pairs(table, group), "a", "b")
        assert len(pairs) == len({frozenset(p) for p in pairs}) == sum(r[2] for r in expected) // 2
    found = of(spelling_variants.variants(table), "word", "n", "n_near", "form", "form_n", "root")
    assert sorted(r for r in found if r[0] is not None) == expected and (None, 4, 0, None, None, None) in found


def test_words_of_odd_rows(spark, odd):
    long = " ".join(f"Wörter{chr(97 + i % 26)}lang" for i in range(700_000))
    extra = spark.createDataFrame([(77, long), (None, "Straße straße STRASSE Ābcdef naïve"), (78, "é" * 5_000_000), (79, None)], "doc_id bigint, text string")
    rows = [(r[0], r[1]) for r in ODD] + [tuple(r) for r in extra.collect()]
    both = odd.select("doc_id", "text").unionByName(extra)
    assert dict(of(spelling_variants.corpus_words(both, least_count=1), "word", "n")) == plain_words(rows, least=1)
    assert dict(of(spelling_variants.corpus_words(both, slip=0), "word", "n")) == plain_words(rows, slip=0)
    nothing = spark.createDataFrame([], "doc_id bigint, text string, n string")
    assert spelling_variants.variants(spelling_variants.corpus_words(nothing)).count() == 0


# Ranked search


def plain_ranks(docs, items, k=10):
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [c for _, c in counts if c]
    total, words = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, Counter()).update(TERM.findall(lower(text)))
    out = []
    for item, wanted in terms.items():
        scores = []
        for d, c in counts:
            if c:
                m = 25 + 75 * sum(c.values()) * total // words
                score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in wanted.items() if c[t])
                if score > 0:
                    scores.append((-score, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_ranks_of_the_documents(spark, docs, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = plain_ranks(docs, items)
    found = sorted(of(QUERIES["op12_ranked_lexical_search"](spark, FOLDER), "item_id", "rank", "doc_id", "score"), key=repr)
    assert found == expected
    # Small trees, small leaves, several blocks and groups of items.
    monkeypatch.setattr(lexical_search, "GROUP_WORDS", 400)
    monkeypatch.setattr(lexical_search, "ITEM_WORDS", 60)
    monkeypatch.setattr(lexical_search, "CELLS", 3000)
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    one = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(2)
    again = lexical_search.ranked(one, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert sorted(of(again, "item_id", "rank", "doc_id", "score"), key=repr) == expected


def test_bounds_of_a_tree_hold():
    rng = np.random.default_rng(3)
    n, size = 300, 40
    dense = (rng.random((n, size)) < 0.15) * rng.integers(1, 9, (n, size))
    dense[:120] = dense[0]  # documents that end at one node
    dense[0, 0] = dense[:, 0].max() + 1
    rows, ranks = np.nonzero(dense)
    tree = lexical_search._Tree(np.arange(n), rng.integers(25, 400, n), rows, ranks, dense[rows, ranks], size)
    assert sorted(tree.ids.tolist()) == list(range(n)) and (tree.tf == dense[tree.ids]).all()
    assert tree.leaves[0][0] == 0 and tree.leaves[-1][1] == n and (tree.leaves[1:, 0] == tree.leaves[:-1, 1]).all()
    for node, (a, b) in enumerate(tree.spans):
        lo, hi = tree.leaves[a][0], tree.leaves[b - 1][1]
        assert (tree.node_tf[node] == tree.tf[lo:hi].max(0)).all() and tree.node_m[node] == tree.m[lo:hi].min()
        covered = sorted(x for c in tree.children[node] for x in range(*tree.spans[c]))
        assert not covered or covered == list(range(a, b))


def test_ranks_of_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    items = [(1, "Quick brown FOX fox"), (1, "dog"), (None, "one two"), (2, None), (3, ""), (4, "é ñ ß word17 word17"), (5, "absent"), (1, "dog"), (6, "x" * 3_000_000)]
    table = spark.createDataFrame([(*i, "t", 5) for i in items], "item_id bigint, text string, n string, rank int")
    found = lexical_search.ranked(odd, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(of(found, *found.columns), key=repr) == plain_ranks(rows, items)
    copies = [(i, "same words here") for i in range(500)] + [(900, "other words")]
    many = spark.createDataFrame(copies, "doc_id int, text string")
    asked = spark.createDataFrame([("a", "words here"), ("b", None)], "item_id string, text string")
    assert sorted(of(lexical_search.ranked(many, asked), "item_id", "rank", "doc_id", "score"), key=repr) == plain_ranks(copies, [("a", "words here")])
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lexical_search.ranked(none, asked).count() == 0 and lexical_search.ranked(many, asked.limit(0)).count() == 0


# Main text


def article(source):
    inner = re.search("<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?p>|</?h1>", inner))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model(spark):
    return main_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    page = page_tree.parse("<div class=a><p>One, two.<p>Three<ul><li>x<li>y</ul></div><footer>z</footer>")
    forest = main_text.Forest([page, page_tree.parse("<p>only")])
    unary, pair = rng.normal(size=main_text.WIDTH), rng.normal(size=(main_text.EDGES, 2, 2))
    scores = np.bincount(forest.owners, unary[forest.slots], forest.n)
    total, each, joint = 0.0, np.zeros(forest.n), np.zeros((forest.n, 2, 2))
    for labels in itertools.product((0, 1), repeat=forest.n):
        w = math.exp(sum(s * y for s, y in zip(scores, labels, strict=True)) + sum(pair[forest.edges[i], labels[p], labels[i]] for i, p in enumerate(forest.parents) if p >= 0))
        total += w
        each += w * np.array(labels)
        for i, p in enumerate(forest.parents):
            if p >= 0:
                joint[i, labels[p], labels[i]] += w
    p, edges, log_total = main_text.Forest.marginals(forest, unary, pair)
    assert np.allclose(p, each / total) and np.allclose(edges, joint / total) and math.isclose(log_total, math.log(total))


def test_given_pages(spark):
    expected = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = QUERIES["op13_main_text"](spark, "/root/testdata/sf0.01")
    assert {r[0]: r[1:3] for r in of(found, "page_id", "url", "text", "n_chars")} == expected
    assert found.filter("n_chars <> length(text)").isEmpty()


def test_other_layouts(spark, model):
    # Layouts and texts that the model was not fitted on.
    sources = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()][:60]
    pages, labels = main_text.training_set(sources, seed=99, layouts=4)
    forest = main_text.Forest(pages)
    p, _, _ = forest.marginals(*model)
    right = wrong = missed = 0
    for page, y, at in zip(pages, labels, forest.starts, strict=False):
        for i, text in enumerate(page.texts):
            if text:
                chosen = p[at + i] > 0.5
                right, wrong, missed = right + len(text) * (chosen and y[i]), wrong + len(text) * (chosen and not y[i]), missed + len(text) * (not chosen and y[i])
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


PROSE = [
    "The ferry crossed the bay twice a day, and most of the people on board knew each other by name.",
    "In winter the service stopped, so letters had to go the long way round, over the hills and the old stone bridge.",
    "When the new road was opened, the ferry was sold, and its captain became the keeper of the lighthouse.",
]


@pytest.mark.parametrize("page", [
    '<body><header><a href=/>Home</a></header><nav><a href=/a>News</a> <a href=/b>Sport</a></nav><main><h1>Ferry</h1>{}</main><aside><h3>Related</h3><a href=/c>More about boats</a></aside><footer>&copy; 2024 Example. All rights reserved.</footer>',
    '<div id="header"><ul><li><a href=/>Start</a><li><a href=/b>Contact</a></ul></div><div class="cookie-notice">We use cookies to improve this site.</div><div id="content"><h1>Ferry</h1>{}</div><div class="sidebar"><ul><li><a href=/1>One</a></ul></div><div id="footer">Imprint</div>',
    '<article class="post"><h1>Ferry</h1>{}</article><section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I remember that ferry very well, my uncle worked on it for years.</p></div><div class="comment"><p>Lovely story, thank you.</p></div></section><form class="newsletter"><label>Subscribe</label><input></form>',
    '<script>if (a < b) document.write("<p>no</p>")</script><style>p > b {{}}</style><div class="advert">Buy two boats today and pay for one only!</div><div class="entry-content"><h1>Ferry</h1>{}</div><div class="comments"><ol><li>First! What a nice old story about the sea.</li></ol></div>',
])
def test_usual_forms(model, page):
    source = page.format("".join(f"<p>{t}</p>" for t in PROSE))
    assert main_text.main_texts([source], *model) == ["\n\n".join(["Ferry", *PROSE])]


def test_blocks_of_a_page():
    def blocks(source):
        return [t for t in page_tree.parse(source).texts if t]

    assert blocks("a<br>b <b>c</b>d&nbsp;&amp;&lt;e&#x41;&eacute;") == ["a b cd &<eAé"]
    assert blocks("<p><b>one<br><p>two</b> three<div>four</p>five</div>six") == ["one", "two three", "four", "five", "six"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("x<!-- <p>no</p> -->y<script>var t='</p>';</script>z<style>no</style><textarea>no</textarea><select><option>no</select>") == ["xyz"]
    assert blocks("1 < 2 <3 a<b") == ["1 < 2 <3 a"] and blocks("<p title='a>b' x=\"<p>\">t") == ["t"]
    assert blocks("") == blocks("<div>") == blocks("<!-- open") == blocks("<script>open") == [] and blocks("</p></div>a") == ["a"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"] and blocks("<div>" * 3000 + "deep" + "</div>" * 10 + "er") == ["deep", "er"]
    assert blocks("A   B\n\t C\r\n") == ["A B C"] and blocks("<noscript>no</noscript><svg><title>n</title><text>n</text></svg>yes") == ["yes"]


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>A short text, but a text.</p></article>"), (2, None, "<" * 1000), (3, "u", "<p>" + "word. " * 700_000), (4, "u", "<div>" * 100_000), (5, "u", "<a href='" * 30_000), (6, "u", "&amp" * 1000)]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows] + [(9, "v", "<p>x", "t", 3)] * 2, "page_id bigint, url string, html string, text string, n_chars int")
    found = main_text.extracted(pages, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == 10
    texts = {(r[0], r[1]): r[2] for r in of(found, "page_id", "url", "text") if r[0] != 9}
    assert texts[1, "u"] == "" and texts[4, "u"] == "" and texts[None, None] == "A short text, but a text."
    assert main_text.extracted(pages.limit(0)).count() == 0


def test_pages_that_mark_nothing(spark):
    # No page of the table is labelled: the model then knows the layouts alone.
    pages = spark.createDataFrame([(i, "u", f"<div class=menu><a href=/>x</a></div><div class=content><h1>Page {i}</h1>{''.join(f'<p>{t}</p>' for t in PROSE)}</div>") for i in range(20)], "page_id int, url string, html string")
    assert {r[0]: r[1] for r in of(main_text.extracted(pages), "page_id", "text")} == {i: "\n\n".join([f"Page {i}", *PROSE]) for i in range(20)}


def test_layouts_hold_every_part():
    rng = random.Random(0)
    layout = Layout(rng, PROSE, ["Home", "About"])
    pages = [layout.page(PROSE) for _ in range(200)]
    marks = [main_text.marked_labels(page_tree.parse(p)) for p in pages]
    assert all(1 in m and 0 in m for m in marks)
