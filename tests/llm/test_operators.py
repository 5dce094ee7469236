"""The ten operators against plain versions on the smallest data folder and on hand-made documents."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filmloom.llm import (
    components as C,
    decontamination,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    mixing,
    paragraph_dedup,
    pii,
    quality_lm,
    vector_search,
)
from filmloom.llm import words as W
from filmloom.llm.queries import QUERIES
from tests.llm.cases import COPY, LETTERED, LONG, ODD, SCHEMA, SPACED, lower, near_components, shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r[1:])
    return out


# ---- words

def test_word_hashes_agree_with_words():
    texts = ["", None, "A b\tA", "É é", "x" * (W.PIECE + 5) + " tail", "a b", "B"]
    part = W.Texts(pa.array(texts, pa.string()))
    starts, ends, first = W.spans(part, W.SPACED)
    hashes = W.word_hashes(part, starts, ends)
    words = [w for t in texts for w in SPACED.findall(lower(t))]
    assert np.diff(first).tolist() == [len(SPACED.findall(t or "")) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    column = pa.array(["ab" * 10, "", None, "c" * 100, "d"], pa.string())
    parts = list(W.slices(column, 30))
    assert [s for s, _ in parts] == sorted({s for s, _ in parts}) and sum(len(t) for _, t in parts) == 5
    assert b"".join(t.data.tobytes() for _, t in parts).decode() == "ab" * 10 + "c" * 100 + "d"


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(of(C.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component"))
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 1 language-model scores

def test_lm_order_three_agrees_with_counting(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abC") for _ in range(rng.choice([0, 1, 2, 5, 40])))) for i in range(30)]
    got = by_id(of(lm_scoring.scores(spark.createDataFrame(texts, "doc_id bigint, text string"), 3), "doc_id", "n_words", "n_backoff", "log_score"))
    words = {d: SPACED.findall(lower(t)) for d, t in texts}
    counts = defaultdict(int)
    for w in words.values():
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                counts[tuple(w[i:i + n])] += 1
    total = sum(map(len, words.values()))
    for d, w in words.items():
        score, backed = 0.0, 0
        for i in range(len(w)):
            depth = min(3, i + 1)
            n, factor = depth, 0.0
            while n > 1 and counts[tuple(w[i - n + 1:i + 1])] < 2:
                n, factor = n - 1, factor + np.log(0.4)
            gram = tuple(w[i - n + 1:i + 1])
            score += factor + np.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
            backed += n < depth
        assert got[d] == [(len(w), backed, pytest.approx(score))]


def test_lm_odd_rows(spark, odd, empty):
    got = by_id(of(lm_scoring.scores(odd), "doc_id", "n_words", "log_score"))
    assert sum(map(len, got.values())) == len(ODD)
    assert got[4] == got[5] == got[6] == got[12] == [(0, 0.0)] and got[8][0][0] == 60_000 and len(got[2]) == 2
    assert lm_scoring.scores(empty).count() == 0


def test_lm_texts_travel_packed_by_block(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PACK_BYTES", 1000)
    rows = [(i % 3, None if i % 7 == 0 else i, f"some words {i} " * (i % 5)) for i in range(200)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("block", "doc_id", "text"), r)) for r in rows[a:a + 50]]) for a in range(0, 200, 50)]
    packed = pa.Table.from_batches(lm_scoring._packed(batches))
    assert packed.num_rows > 3 and packed.nbytes < sum(b.nbytes for b in batches)
    for block in range(3):
        found = lm_scoring._unpacked(packed.filter(pa.compute.equal(packed["block"], block)).column("rows"))
        assert list(zip(found["doc_id"].to_pylist(), found["text"].to_pylist())) == [r[1:] for r in rows if r[0] == block]


# ---- 2 personal data

def plain_spans(text):
    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == 1 and max(map(int, m.group().split("."))) > 255) or (kind == 2 and not (16 <= len(digits) <= 19 and luhn)) or (kind == 3 and not 8 <= len(digits) <= 15):
                continue
            found.append((kind, *m.span()))
    return found


def test_base_spans_agree_with_the_patterns(docs):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab1259@@..%%--++ ()_é") for _ in range(60)) for _ in range(3000)]
    made += ["a@b.c%x@y.z", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111", "+1 (988) 555-2485.", "4111-1111-1111-1111", "0000001.2.3.4 1.2.3.999", "@a.b", "a@b", "a@@b.c"]
    for text in [t for _, t in docs] + made:
        assert pii.base_spans(text or "") == plain_spans(text or "")


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 500_000 + "9" * 500_000 + "." * 1000) == []
    assert pii.base_spans("@" * 300_000 + "x" * 300_000 + "@") == []


def test_terms_that_reveal_an_entity(spark):
    texts = [(i, f"note{i} alpha{i} zorblatt wrote from bob@mail.com beta{i} gamma{i} often") for i in range(4)]
    texts += [(10 + i, f"filler{i} often wrote from here and there") for i in range(40)] + [(60, "once Zorblatt came"), (61, None)]
    copies = [(70 + i, "copied quuxword beside eve@mail.com again") for i in range(5)]
    df = spark.createDataFrame(texts + copies, "doc_id bigint, text string")
    got = by_id(of(pii.found_spans(df), "doc_id", "spans"))
    kinds = {d: [(s["kind"], s["removed"]) for s in v[0][0]] for d, v in got.items()}
    assert kinds[0] == [(0, True), (4, True)] and kinds[60] == [(4, True)] and kinds[10] == [] and kinds[61] == []
    assert kinds[70] == [(0, True)]  # copies are one context
    text = dict(of(pii.sanitised(df), "doc_id", "text"))
    assert text[60] == "once [removed] came" and "[email]" in text[0] and text[61] is None


def test_rated_pairs_agree_with_counting(spark):
    rng = random.Random(8)
    people = [f"p{i}@mail.com" for i in range(6)]
    texts = []
    for i in range(150):
        words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 3, 12]))]
        if rng.random() < 0.3:
            who = rng.randrange(6)
            words += [people[who], f"Name{who}" if rng.random() < 0.9 else "Été", f"7.7.7.{who}"] * rng.choice([1, 2])
        rng.shuffle(words)
        texts += [(i, " ".join(words))] * rng.choice([1, 1, 3])
    texts += [(900, None), (None, "p1@mail.com name1 only"), (901, "p1@mail.com name1 only")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    different = {t for _, t in texts if t is not None}
    n, n_entity, n_term, both = len(different), defaultdict(int), defaultdict(int), defaultdict(int)
    for t in different:
        spans = plain_spans(t)
        held = {pii._entity(k, t[a:b]) for k, a, b in spans}
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(LETTERED, lower(t))]
        for w in {w for w, _, _ in words}:
            n_term[w] += 1
        for e in held:
            n_entity[e] += 1
            for w in {w for w, a, b in words if not any(x < b and a < y for _, x, y in spans)}:
                both[e, w] += 1
    want = {}
    for (e, w), k in both.items():
        if n_entity[e] >= 2 and n_term[w] >= 2 and n_term[w] <= n ** 0.3 * n_entity[e] ** 0.7 * (1 + 1e-9):
            want[e, hash_of(w)] = (n_entity[e], n_term[w], k, n, np.log(n * k / (n_term[w] * n_entity[e])) / np.log(n / n_entity[e]))
    rated = pii.rated_pairs(df).collect()
    assert len(want) > 10 and {(r["entity"], r["term"]): (r["n_entity"], r["n_term"], r["together"], r["total"], pytest.approx(r["share"])) for r in rated} == want
    tests = len({w for _, w in want}) * len({e for e, _ in want})
    chosen = {w for (e, w), (ne, nt, k, _, share) in want.items()
              if k >= 2 and share >= 0.7 and k * np.log(k * n / (ne * nt)) - k + ne * nt / n >= np.log(tests / 0.05)}
    assert {r["term"] for r in pii.disclosing_terms(df).collect()} == chosen and {hash_of(f"name{i}") for i in range(6)} & chosen


def hash_of(word):
    part = W.Texts(pa.array([word]))
    starts, ends, _ = W.spans(part, W.LETTERED)
    return int(W.signed(W.word_hashes(part, starts, ends))[0])


def test_words_apart_from_spans():
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = np.sort(rng.choice(80, 20, replace=False)).reshape(-1, 2)
        taken = np.array([sorted(rng.choice(80, 2, replace=False)) for _ in range(rng.integers(0, 6))], np.int64).reshape(-1, 2)
        want = [not any(x < b and a < y for x, y in taken) for a, b in edges]
        assert pii._apart(edges[:, 0], edges[:, 1], taken).tolist() == want


def test_marking_many_spans_of_one_text(spark):
    """Thousands of addresses and terms in one text, in blocks of terms, stay linear and whole."""
    texts = [(i, f"bob{j}@mail.com né zorb{j} x{i}") for j in range(3) for i in range(10 * j, 10 * j + 6)]
    texts += [(100 + i, f"other né words {i}") for i in range(300)]
    texts += [(1000, " ".join(f"é zorb{i % 3} a{i}@b.cd" for i in range(20_000)))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    whole = {r["doc_id"]: r["spans"] for r in pii.found_spans(df).collect()}
    assert [s["kind"] for s in whole[1000]] == [0] * 20_000 + [4] * 20_000
    text = texts[-1][1]
    assert all(text[s["start"]:s["end"]].startswith("zorb") for s in whole[1000] if s["kind"] == 4)
    once, pii.TERMS_AT_ONCE = pii.TERMS_AT_ONCE, 1
    try:
        assert {r["doc_id"]: r["spans"] for r in pii.found_spans(df).collect()} == whole
    finally:
        pii.TERMS_AT_ONCE = once


def test_pii_odd_rows(spark, odd, empty):
    assert pii.found_spans(odd).count() == len(ODD) and pii.found_spans(empty).count() == 0
    assert all(s == [] for _, s in of(pii.found_spans(odd), "doc_id", "spans"))


# ---- 3 decontamination

def plain_contamination(docs, items):
    parsed = [(i, LETTERED.findall(lower(t))) for i, t in items]
    out = []
    for d, text in docs:
        words, hit, met = LETTERED.findall(lower(text)), set(), set()
        for item, its in parsed:
            size = min(10, len(its))
            if not size:
                continue
            windows = {tuple(its[j:j + size]) for j in range(len(its) - size + 1)}
            for p in range(len(words) - size + 1):
                if tuple(words[p:p + size]) in windows:
                    hit.update(range(p, p + size))
                    if item is not None:
                        met.add(str(item))
        out.append((d, len(words), len(hit), sorted(met)))
    return out


def test_contamination_agrees_with_all_windows(spark, monkeypatch):
    rng = random.Random(1)
    words = ["a", "b", "C", "d", "é", "Ü9"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ".", " \n"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 5, 9, 10, 11, 15, 30]))) for i in range(20)] + [(20, None), (None, make(12)), (21, make(12))]
    items.append((22, items[-1][1]))
    docs = [(i, make(rng.choice([0, 1, 4, 9, 10, 20, 60, 200]))) for i in range(80)] + [(80, None), (81, "")]
    docs += [(100 + i, f"zz {items[i % 23][1]} qq") for i in range(46)] + [(100, "zz")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(plain_contamination(docs, items))
    for size in (decontamination.BLOCK_WORDS, 100):  # one block, then several
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", size)
        found = of(decontamination.contamination(d, b), "doc_id", "n_words", "spans", "item_ids")
        assert sorted((i, n, sum(s["end"] - s["start"] for s in spans), list(ids)) for i, n, spans, ids in found) == expected
        kept = sorted(x for (x,) in of(decontamination.without_contaminated(d, b), "doc_id"))
        assert kept == [r[0] for r in expected if not r[2]]


def test_contamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, COPY, "x"), (None, None, None)], "item_id bigint, text string, doc_id string")
    got = by_id(of(decontamination.contamination(odd, items), "doc_id", "n_words", "item_ids"))
    assert sum(map(len, got.values())) == len(ODD) and got[2] == [(19, ["1"])] * 2 and got[4] == got[12] == [(0, [])] and got[9] == [(1, [])]
    clean = decontamination.without_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 6
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(odd, items.filter("false")).filter("size(item_ids) > 0").count() == 0


# ---- 4 exact top-k

def test_top_k_odd_rows(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), -0.001, 0.5]) for i in range(100)] + [(200, None), (201, [nan, 1.0]), (202, [inf]), (203, [None]), (204, []), (None, [1.0]), (50, [2.0, 0.0, 0.5]), (50, [9.0, 9.0, 9.0]), (205, [1e300, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    found = by_id(of(vector_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5), "query_id", "rank", "vec_id", "score"))
    chosen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            chosen[i] = min(chosen.get(i, v), v)
    exact = {i: [max(-2**62, min(2**62, int(np.floor(256 * x)))) for x in v] for i, v in chosen.items()}
    for q in (0, 50):
        score = lambda i: max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(exact[q], exact[i]))))
        best = sorted(((-score(i), i) for i in exact if i != q))[:5]
        assert sorted(found[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(found) == {0, 50}
    nothing = vectors.filter("false")
    assert vector_search.top_k(nothing, nothing, 5).count() == 0 and vector_search.top_k(vectors.filter("vec_id = 0"), vectors.filter("vec_id = 0"), 5).count() == 0


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ROWS_PER_BLOCK", 70)
    monkeypatch.setattr(vector_search, "QUERIES_PER_BLOCK", 3)
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = sorted(of(vector_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5), "query_id", "rank", "vec_id", "score"))
    exact = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in of(vectors, "vec_id", "embedding")}
    expected = [(q, n, i, int(-s)) for q in exact if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(exact[q] @ exact[i]), i) for i in exact if i != q)[:5], 1)]
    assert found == sorted(expected)


@pytest.mark.parametrize("scale, kind", [(1.0, np.float32), (300.0, np.float64), (2.0**20, np.int64), (2.0**25, object)])
def test_top_k_in_every_kind_of_numbers(scale, kind):
    """Sparse and full dimensions, ties and a query among the rows, in the numbers that hold the sums exactly."""
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(300, 12)), 1) * scale
    vectors[:, 6:] *= rng.random((300, 6)) < 0.1
    vectors[100:140] = vectors[100]
    ids = rng.permutation(300) * 7
    lists = lambda v: pa.array([list(x) for x in v], pa.list_(pa.float64()))
    queries, rows = (vector_search._Block.of(pa.array(ids[:m]), lists(vectors[:m])) for m in (130, 300))
    assert len(rows.columns) == 6 and len(rows.dims) == 6 and vector_search._kind(queries.norm() * rows.norm() * 1.001) is kind
    exact = {int(i): [int(x) for x in np.floor(256 * v)] for i, v in zip(ids, vectors)}
    found = list(vector_search._best(queries.pack(), rows.pack(), 5))
    assert [q for q, _, _ in found] == sorted(int(i) for i in ids[:130])
    for q, near, scores in found:
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(near, scores)] == [(max(-(2**63) + 1, s), i) for s, i in best]


def test_blocks_of_vectors_are_small_to_copy():
    """Each block is copied to every block it meets: two bytes a weight of usual size, and eight for an id."""
    vectors = np.random.default_rng(6).normal(size=(1000, 64)).astype(np.float32) / 8
    packed = vector_search._Block.of(pa.array(range(1000)), pa.array(list(vectors), pa.list_(pa.float32()))).pack()
    assert len(packed) < 1000 * (8 + 64 * 2) + 1000


# ---- 5 near duplicates

def test_near_duplicates_agree_with_all_links(spark, docs):
    sets, parts = near_components(docs)
    found = of(QUERIES["op5_minhash_near_dedup"](spark, FOLDER), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(found) == sorted((d, len(sets[d]), parts[d], parts[d] == d) for d, _ in docs)


def test_near_duplicates_that_only_meet_in_a_group(spark):
    """A base, copies with one to five changed words each, and copies of copies: links past the star count too."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [list(base)]
    for _ in range(150):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(words)
    docs = [(1000 - i, " ".join(w)) for i, w in enumerate(texts)]
    sets, parts = near_components(docs)
    found = of(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(found) == sorted((d, len(sets[d]), parts[d], parts[d] == d) for d, _ in docs)
    assert 1 < len(set(parts.values())) < len(docs)


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = by_id(of(minhash_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept"))
    size = len(shingles(COPY))
    assert got[1] == [(size, 1, True)] and got[2] == [(size, 1, False)] * 2 and got[3] == [(size, 1, False)] and got[10] == [(size, 1, False)]
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)] and got[7] == [(1, 7, True)] * 2 and got[9] == [(1, 9, True)]
    assert sorted(got[None]) == [(0, None, True), (size, None, True)] and got[8][0][1:] == (8, True)
    assert minhash_dedup.near_duplicates(empty).count() == 0


# ---- 6 licences

def test_licence_lines_are_found_and_prose_is_not(spark, docs):
    names = {"mit": "released under the mit license", "gpl": "gnu general public license", "cc-by-nc": "cc by-nc 4.0", "apache-2.0": "apache license, version 2.0"}
    found = {d: (lic, unknown) for d, lic, unknown in of(QUERIES["op6_license_scan"](spark, FOLDER), "doc_id", "licences", "unknown")}
    assert {d: ",".join(sorted(k for k, v in names.items() if v in lower(t))) for d, t in docs} == {d: lic for d, (lic, _) in found.items()}


def test_held_out_licence_notices():
    model = license_scan.train(["The weather was fine and nobody said a word.", "Plain prose about rivers, boats and bread."] * 50)
    texts = [
        "This file is licensed under the Apache License, Version 2.0 (the License)", "Code released under the MIT license.", "Licensed under the Quomble License",
        "The weather was fine in the Bronx", "Sich Sich Sich Sich Sich", "words " * 60 + "\n" + "more " * 30 + "Licensed under CC BY-SA 4.0 " + "more " * 30,
    ]
    found = license_scan.judge(W.Texts(pa.array(texts, pa.string())), model)[1]
    assert [sorted(set(f)) for f in found] == [["apache-2.0"], ["mit"], ["unknown"], [], [], ["cc-by-sa"]]


def test_wrapped_notices_of_every_family():
    model = license_scan.train(["The weather was fine and nobody said a word.", "Plain prose about rivers, boats and bread."] * 50)
    for width in (30, 45, 72):
        for name, templates in license_scan.TEMPLATES.items():
            for template in templates:
                wrapped = "\n".join("# " + x for x in textwrap.wrap(f"{template}.", width))
                texts = W.Texts(pa.array([f"some words before\n{wrapped}\nand some after", wrapped], pa.string()))
                assert [sorted(set(f) - {"unknown"}) for f in license_scan.judge(texts, model)[1]] == [[name]] * 2, template
    texts = W.Texts(pa.array(["Copyright (c) 2024 Jane Doe.\nAll rights reserved.", "© 2024 X. All rights reserved.", "Copyright 2024 X. All rights reserved.\nReleased under the BSD 3-Clause License"], pa.string()))
    assert [sorted(set(f) - {"unknown"}) for f in license_scan.judge(texts, model)[1]] == [["proprietary"], ["proprietary"], ["bsd"]]
    apart = W.Texts(pa.array(["Permission is hereby granted\n\nfree of charge\n\nto any person"], pa.string()))
    assert set(license_scan.judge(apart, model)[1][0]) <= {"unknown"}


def test_licences_in_other_words_tags_and_short_lines():
    model = license_scan.train(["The weather was fine and nobody said a word.", "Plain prose about rivers, boats and bread."] * 50)
    cases = {
        "Licensed under Quomble terms": ["unknown"], "Lizenziert unter der Quomble Lizenz": ["unknown"], "Publié sous la licence Quomble": ["unknown"],
        "MIT License": ["mit"], "Apache License\nVersion 2.0, January 2004": ["apache-2.0"], "// SPDX-License-Identifier: MIT": ["mit"],
        "# SPDX-License-Identifier: GPL-2.0-or-later OR CC-BY-SA-4.0": ["cc-by-sa", "gpl"], "SPDX-License-Identifier: Quomble-1.0": ["unknown"],
        "MIT": [], "The weather was fine": [], "One Two One Two": [], "SPDX-License-Identifier: MIT-0": ["unknown"],
    }
    found = license_scan.judge(W.Texts(pa.array(list(cases), pa.string())), model)[1]
    assert dict(zip(cases, (sorted(set(f)) for f in found))) == cases


def test_licence_odd_rows(spark, odd, empty):
    got = by_id(of(license_scan.scan(odd), "doc_id", "n_paragraphs", "licences"))
    assert sum(map(len, got.values())) == len(ODD) and got[4] == got[5] == [(0, [])] and got[11] == [(3, [])]
    assert license_scan.scan(empty).count() == 0


# ---- 7 quality

def plain_kneser_ney(texts, order, symbols):
    """Interpolated modified Kneser-Ney by its textbook definition; texts are lists of symbols."""
    counts = [defaultdict(int) for _ in range(order + 1)]
    for s in texts:
        padded = [0] * (order - 1) + s
        for i in range(len(s)):
            counts[order][tuple(padded[i:i + order])] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1

    def discounts(table):
        seen = [sum(c == i for c in table.values()) for i in range(5)]
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0
        return [0.0] + [max(0.0, min(i, i - (i + 1) * y * seen[i + 1] / seen[i])) if seen[1] and seen[i] else 0.5 for i in (1, 2, 3)]

    cuts = [None] + [discounts(counts[n]) for n in range(1, order + 1)]
    totals = [None] + [defaultdict(lambda: [0, 0.0]) for _ in range(order)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            totals[n][g[:-1]][0] += c
            totals[n][g[:-1]][1] += min(cuts[n][min(c, 3)], c)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / symbols
        total, cut = totals[len(g)].get(g[:-1], (0, 0.0))
        if not total:
            return below
        c = counts[len(g)].get(g, 0)
        return (c - min(cuts[len(g)][min(c, 3)], c) if c else 0) / total + cut / total * below

    return p


def test_kneser_ney_agrees_with_its_definition(spark):
    texts = ["the cat sat on the mat. THE end", "a cat, a hat & a bat 42", "über die Brücke", "the the the cat"]
    symbols = [quality_lm.TABLE[np.frombuffer(t.encode(), np.uint8)].tolist() for t in texts]
    p = plain_kneser_ney(symbols, quality_lm.ORDER, quality_lm.SYMBOLS)
    model = quality_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    dense = np.exp(quality_lm._dense(model).astype(np.float64))
    rng = random.Random(3)
    grams = [tuple(([0, 0, 0] + s)[i:i + 4]) for s in symbols for i in range(len(s))] + [tuple(rng.randrange(48) for _ in range(4)) for _ in range(300)]
    for g in grams:
        assert dense[sum(x * 48 ** (3 - i) for i, x in enumerate(g))] == pytest.approx(p(g), rel=1e-5)
    assert dense.reshape(-1, 48).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_bytes_as_they_are_agree_with_the_definition(spark):
    """The model of classify: n-grams of five bytes, none of them folded; below single bytes their symbols."""
    texts = ["the cat sat on the mat. THE end", "a cat, a hat & a bat 42", "über die Brücke", "the the the cat", None, ""]
    model = quality_lm.model_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    data = [list((t or "").encode()) for t in texts]
    symbols = [quality_lm.TABLE[np.array(d, np.int64)].tolist() for d in data]
    counted, all_left = plain_kneser_ney(data, 5, float("inf")), plain_kneser_ney(data, 5, 1)  # without and with a whole weight below
    of_symbols = plain_kneser_ney(symbols, 4, 48)
    seen = np.bincount(sum(data, []), minlength=256) + 1
    share = seen / np.bincount(quality_lm.TABLE, seen)[quality_lm.TABLE]
    rng = random.Random(4)
    grams = [tuple(([0] * 4 + d)[i:i + 5]) for d in data for i in range(len(d))] + [tuple(rng.choice(b"aehtT.,\xc3\xff ") for _ in range(5)) for _ in range(300)]
    got = np.exp(model.log_p(np.array([sum(x * 256 ** (4 - i) for i, x in enumerate(g)) for g in grams])))
    for g, p in zip(grams, got):
        below = of_symbols(tuple(quality_lm.TABLE[list(g[1:])].tolist())) * share[g[-1]]
        assert p == pytest.approx(counted(g) + (all_left(g) - counted(g)) * below, rel=1e-4)
    for g in grams[::10]:
        start = sum(x * 256 ** (4 - i) for i, x in enumerate(g[:4]))
        assert np.exp(model.log_p(start + np.arange(256))).sum() == pytest.approx(1, abs=1e-3)


def test_quality_tells_all_bytes_apart(spark):
    """Capitals, digits, signs and letters of other scripts that one symbol stood for; only the trusted form is expected."""
    pairs = [("Anna", "Enna"), ("in 1912", "in 1987"), ("yes (no)", "yes ,no-"), ("über", "öber"), ("дом", "лом")]
    for good, other in pairs:
        docs = spark.createDataFrame([(1, f"{good} " * 20, "en"), (2, f"{other} " * 20, "en")], "doc_id bigint, text string, lang string")
        judged = by_id(of(quality_lm.classify(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")), "doc_id", "perplexity", "kept"))
        assert judged[2][0][0] > 1.5 * judged[1][0][0] and judged[1][0][1] and not judged[2][0][1], (good, other, judged)


def test_quality_counts_the_same_however_it_is_cut(spark, monkeypatch):
    texts = spark.createDataFrame([(f"{i % 7} words of text {i}\n" * (1 + i % 5),) for i in range(200)], "text string").repartition(3)
    whole = sorted(of(quality_lm.counted(texts), "key", "n"))
    assert sum(n for _, n in whole) == sum(len(t) for t, in of(texts, "text"))
    monkeypatch.setattr(quality_lm, "SLICE", 100)
    monkeypatch.setattr(quality_lm, "HELD", 300)
    held = pa.RecordBatch.from_arrays([pa.array([t for t, in of(texts, "text")])], ["text"])
    sums = defaultdict(int)
    for out in quality_lm._count([held]):
        for key, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist()):
            sums[key] += n
    assert sorted(sums.items()) == whole


def test_quality_keeps_the_good_and_drops_junk(spark):
    judged = by_id(of(QUERIES["op7_quality_perplexity"](spark, "/root/testdata/sf0.01"), "doc_id", "kept"))
    labels = of(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "quality", "toxic")
    good = [judged[d][0][0] for d, q, t in labels if q == 1 and t == 0]
    bad = [judged[d][0][0] for d, q, _ in labels if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_quality_limit_is_the_quantile_of_trusted_documents(spark):
    scored = spark.createDataFrame([("en", i / 100) for i in range(1, 10_001)] + [("de", i / 10) for i in range(1, 31)], "__lang string, __p double")
    # 9800 + 1.645 * 14 of 10,000, and all of 30.
    assert dict(of(quality_lm.limits(scored, "__lang"), "__lang", "limit")) == {"en": 98.24, "de": 3.0}


def test_quality_drops_bad_and_toxic_documents_apart(spark):
    judged = by_id(of(QUERIES["op7_quality_perplexity"](spark, "/root/testdata/sf0.1"), "doc_id", "kept"))
    labels = of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "quality", "toxic")

    def kept(quality, toxic):
        return np.mean([judged[d][0][0] for d, q, t in labels if (q, t) == (quality, toxic)])

    assert kept(1, 0) >= 0.98 and kept(0, 0) < 0.06 and kept(0, 1) < 0.03 and kept(1, 1) < 0.5


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (8, 0, 0), (10, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    judged = quality_lm.classify(odd, labels)
    got = by_id(of(judged, "doc_id", "perplexity", "kept"))
    assert sum(map(len, got.values())) == len(ODD) and len(judged.columns) == len(odd.columns)
    assert got[4] == got[5] == got[12] == [(None, False)] and got[1][0][1] and not got[9][0][1]
    untrained = by_id(of(quality_lm.classify(odd, labels.filter("false")), "doc_id", "threshold", "kept"))
    assert untrained[1] == [(None, True)] and untrained[5] == [(None, False)]
    assert quality_lm.classify(empty, labels).count() == 0


# ---- 8 passages

def test_every_long_shared_run_shows(spark, docs):
    def holders(size):
        held = defaultdict(set)
        for d, t in docs:
            words = SPACED.findall(lower(t))
            for i in range(len(words) - size + 1):
                held[tuple(words[i:i + size])].add(d)
        return {d for s in held.values() if len(s) > 1 for d in s}

    flagged = {d for d, r in of(QUERIES["op8_paragraph_dedup"](spark, FOLDER), "doc_id", "repeats") if r}
    assert holders(50) <= flagged <= holders(25) and holders(50)


def test_similar_lines_are_removed_by_component(spark):
    line = [f"word{i}" for i in range(60)]
    near = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(line))
    rows = [(5, "intro\n" + near()), (3, near(30)), (9, near(10) + "\nshort line"), (7, "other " * 10), (4, near(20) + "\n" + near(20)), (None, near())]
    got = by_id(of(paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "removed", "n_paragraphs"))
    removed = {d: [(r["at"], r["like"]) for r in v[0][0]] for d, v in got.items()}
    assert removed == {5: [(1, 3)], 3: [], 9: [(0, 3)], 7: [], 4: [(0, 3), (60, 3)], None: []}


def test_passages_inside_other_text(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"{rng.random()}" for _ in range(n))
    for trial in range(6):
        passage = fresh(51)
        rows = [(1, f"{fresh(80)} {passage} {fresh(90)}"), (2, f"{fresh(7)}\n{passage.replace(' ', chr(10), 1)}"), (3, fresh(200)), (2, fresh(60)), (4, passage), (4, passage)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = of(paragraph_dedup.repeated_passages(df), "doc_id", "passages")
        assert sorted(d for d, p in got if p) == [1, 2, 4, 4] and all(x["first_doc"] == 1 for d, p in got for x in p)


def test_passages_odd_rows(spark, odd, empty):
    got = by_id(of(paragraph_dedup.repeated_passages(odd), "doc_id", "n_words", "passages", "removed"))
    assert sum(map(len, got.values())) == len(ODD) and got[4] == got[5] == got[12] == [(0, [], [])] and got[8] == [(60_000, [], [])]
    assert paragraph_dedup.repeated_passages(empty).count() == 0
