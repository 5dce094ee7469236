"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W
from filmloom.plans.storage import write_through

WINDOW = 10  # shared words that count as contamination
GRAM = 5  # words of a fingerprint
CHOICE = WINDOW - GRAM + 1  # grams of which the least is kept: every shared window holds a kept one
REACH = WINDOW - GRAM
BLOCK_WORDS = 4_000_000  # benchmark words broadcast at once: 32 MB, whatever the benchmark's size
SEGMENT = 32_768  # longer items are indexed in overlapping segments


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the kept grams: the rightmost least one of each window of grams."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = W.grams(words, GRAM)
    rows = W.row_of_each(first)
    whole = np.flatnonzero(rows[:len(words) - WINDOW + 1] == rows[WINDOW - 1:])
    windows = np.lib.stride_tricks.sliding_window_view(hashes, CHOICE)[whole]
    kept = np.unique(whole + (CHOICE - 1 - np.argmin(windows[:, ::-1], axis=1)))
    return kept, hashes[kept]


class Index:
    """Fingerprints of one block of benchmark items. Items of fewer words than a window are looked up whole."""

    def __init__(self, items: list[tuple[list[str], np.ndarray]]):
        long = [(ids, words) for ids, words in items if len(words) >= WINDOW]
        self.ids = [ids for ids, _ in long]
        self.words = np.concatenate([w for _, w in long]) if long else np.zeros(0, np.uint64)
        first = np.cumsum([0, *[len(w) for _, w in long]])
        self.item = W.row_of_each(first)
        at, hashes = winnow(self.words, first)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True
        short: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        for ids, words in items:
            if 0 < len(words) < WINDOW:
                short[len(words)][int(W.grams(words, len(words))[0])] += ids
        self.short = {size: dict(found) for size, found in short.items()}

    def _extended(self, words: np.ndarray, rows: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right of a shared gram the words agree, up to one window."""
        def equal(step: int) -> np.ndarray:
            i, j = at + step, there + step
            ok = (i >= 0) & (i < len(words)) & (j >= 0) & (j < len(self.words))
            i, j = np.where(ok, i, 0), np.where(ok, j, 0)
            return ok & (rows[i] == rows[at]) & (self.item[j] == self.item[there]) & (words[i] == self.words[j])

        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step in range(1, REACH + 1):
            left += (left == step - 1) & equal(-step)
            right += (right == step - 1) & equal(GRAM - 1 + step)
        same = np.logical_and.reduce([equal(s) for s in range(GRAM)])
        return np.where(same, left, -WINDOW), right

    def match(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Number of words per row, rows' first words, a flag per word, and the ids of the items met by each row."""
        starts, ends, first = W.spans(texts, W.LETTERED)
        words = W.word_hashes(texts, starts, ends)
        rows = W.row_of_each(first)
        items: list[set[str]] = [set() for _ in range(len(texts))]
        edges = np.zeros(len(words) + 1, np.int64)
        at, hashes = winnow(words, first)
        maybe = self.seen[hashes >> np.uint64(42)]
        at, hashes = at[maybe], hashes[maybe]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        many = high - low
        at = np.repeat(at, many)
        there = self.at[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        left, right = self._extended(words, rows, at, there)
        hit = left + GRAM + right >= WINDOW
        at, there, left, right = at[hit], there[hit], left[hit], right[hit]
        np.add.at(edges, at - left, 1)
        np.add.at(edges, at + GRAM + right, -1)
        if len(at):
            for row, item in np.unique(np.stack([rows[at], self.item[there]]), axis=1).T:
                items[row].update(self.ids[item])
        for size, known in self.short.items():
            runs = W.grams(words, size)
            whole = rows[:len(runs)] == rows[size - 1:] if len(runs) else np.zeros(0, bool)
            keys = np.fromiter(known, np.uint64, len(known))
            for i in np.flatnonzero(whole & np.isin(runs, keys)):
                edges[i] += 1
                edges[i + size] -= 1
                items[rows[i]].update(known[int(runs[i])])
        return np.diff(first), first, np.cumsum(edges[:-1]) > 0, items


def _read_items(batches):
    for batch in batches:
        for start, texts in W.slices(batch.column(1)):
            starts, ends, first = W.spans(texts, W.LETTERED)
            words = W.word_hashes(texts, starts, ends)
            ids, parts = [], []
            for i, item in enumerate(batch.column(0).slice(start, len(texts)).to_pylist()):
                own = words[first[i]:first[i + 1]]
                for at in range(0, max(1, len(own) - WINDOW + 1), SEGMENT):
                    ids.append(item)
                    parts.append(own[at:at + SEGMENT + WINDOW - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.binary())], ["item_id", "words"])


def index_blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in blocks of bounded size, each broadcast for itself."""
    spark = benchmark.sparkSession
    read = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_read_items, "item_id string, words binary")
    items = write_through(read.groupBy("words").agg(F.collect_set("item_id").alias("ids")), "benchmark")
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * BLOCK_WORDS)))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Index([(r["ids"], np.frombuffer(r["words"], np.uint64)) for r in rows]))


_FOUND = "doc_id bigint, text string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _scanner(index: Broadcast):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string())),
    ])

    def scan(batches):
        for batch in batches:
            for start, texts in W.slices(batch.column(1)):
                before = batch.slice(start, len(texts))
                n_words, first, hit, items = index.value.match(texts)
                spans, ids = before.column("spans").to_pylist(), before.column("item_ids").to_pylist()
                for i in np.flatnonzero(np.add.reduceat(np.append(hit, False), first[:-1]) * (n_words > 0)):
                    flags = hit[first[i]:first[i + 1]].copy()
                    for s in spans[i]:
                        flags[s["start"]:s["end"]] = True
                    spans[i], ids[i] = _runs(flags), sorted({*ids[i], *items[i]})
                yield pa.RecordBatch.from_arrays(
                    [before.column(0), before.column(1).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(ids, schema.field("item_ids").type)],
                    schema=schema,
                )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` of words inside shared windows, and the ``item_ids`` met.

    A window is ten consecutive words of an item, or a whole item of one to nine words; words are runs of
    letters and digits with A-Z lower-cased. Both sides keep the least gram hash of each sliding window, so
    a shared window always shares a fingerprint; hits are extended word by word and count from ten words on.
    The benchmark is scanned against in blocks of bounded size, without a shuffle of the documents.

    A null or empty text has no words and meets nothing. A null item_id still marks words but is not listed; items
    that repeat are listed by each of their ids. Repeated rows of ``docs`` each get their row. Other columns
    are not read. Without documents the result is empty, without items nothing is hit.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    state = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.lit(0).cast("bigint").alias("n_words"),
        none.alias("spans"), F.array().cast("array<string>").alias("item_ids"),
    )
    for block in index_blocks(benchmark):
        state = state.mapInArrow(_scanner(block), _FOUND)
    return state.drop("text")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    at = docs.columns.index("text")

    def keeper(index: Broadcast):
        def keep(batches):
            for batch in batches:
                for start, texts in W.slices(batch.column(at)):
                    n_words, first, hit, _ = index.value.match(texts)
                    hits = np.add.reduceat(np.append(hit, False), first[:-1]) * (n_words > 0)
                    yield batch.slice(start, len(texts)).filter(pa.array(hits == 0))

        return keep

    for block in index_blocks(benchmark):
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs
