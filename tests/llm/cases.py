"""Hand-made documents and plain versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

SPACED = re.compile("[^\x20\x09-\x0d]+")
LETTERED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

LONG = " ".join(f"word{i % 9973}" for i in range(60_000))
COPY = "The quick brown fox jumps over the lazy dog while seven wise men look on in quiet wonder today"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, row string, key string, rep bigint, "
    "h1 bigint, component string, spans string, words string, size string, target string, draws string, shard string, position string, perplexity string, threshold string"
)


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, None, "r", "k", 1, 2, "c", "s", "w", "z", "t", "d", "sh", "p", "pp", "th")


#: Nulls in every column, empty, blank, short and very long texts, repeated rows, ties, one endless word.
ODD = [
    row(1, COPY), row(2, COPY.upper()), row(2, COPY.upper()), row(3, COPY + "!"), row(4, None), row(5, ""), row(6, " \t\n "), row(7, "one two"), row(7, "One\ttwo"),
    row(8, LONG), row(9, "x" * 3_000_000), row(None, COPY), row(None, None, None, None), row(10, COPY, None, None), row(11, "é ü\nñ\n\nß", "fr", "ß"),
    tuple([12] + [None] * 20),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, size=5):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def near_components(docs):
    """Exact links over an inverted index."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, components(sets, links)
