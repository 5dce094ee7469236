"""Ranked lexical search over frequency-ordered document trees.

Documents are first reduced to the terms that any query item has. Each block of these vectors becomes a tree
of its own: terms ordered from the most to the least frequent of the corpus are a path, documents with equal
beginnings share it, and a node covers all documents below it. A node keeps the largest ``tf`` of every term
and the smallest ``m`` of its documents, so no document below scores more than a document with these would. An
item descends depth-first, best child first, and leaves out every node whose bound is below the
``k``-th score found so far; what it reaches is scored exactly. Nodes of at most ``LEAF`` documents are not divided.

The best ``k`` of an item go from block to block within a task, so later blocks are cut earlier; the lists of
all tasks are merged by a rank that Spark also applies before the exchange.

Memory is bounded: items are taken in groups of ``GROUP_WORDS`` words, whose term hashes are broadcast and released
again, and a tree holds ``CELLS`` numbers at most for the terms of ``ITEM_WORDS`` item words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm.words import LETTERED, Texts, cut_between, slices, spans, word_hashes
from filmloom.plans.storage import write_through

TOP = 10
GROUP_WORDS = 500_000
ITEM_WORDS = 16_384
CELLS = 6 << 20
LEAF = 64
ROWS = 4096  # documents unpacked at once
LAST = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last


def _hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and the row of each."""
    starts, ends, first = spans(texts, LETTERED)
    return word_hashes(texts, starts, ends), np.repeat(np.arange(len(texts)), np.diff(first))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``terms`` (hashes as long) and ``counts`` of each item row."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(batch.column(0))
            for first, texts in slices(batch.column(1)):
                hashes, rows = _hashes(texts)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + first)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, term bigint")
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count"))


def _reduced(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``doc_id``, ``n`` (all terms) and the vocabulary terms of each document with their ``tf``."""
    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                n, cells = np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
                for piece in cut_between(texts, LETTERED):
                    hashes, rows = _hashes(piece)
                    n += np.bincount(rows, minlength=len(texts))
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                    cells = np.concatenate([cells, rows[hit] * len(known) + at[hit]])
                cells, tf = np.unique(cells, return_counts=True)
                rows, terms = np.divmod(cells, max(len(known), 1))
                offsets = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array(n),
                    pa.ListArray.from_arrays(offsets, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                ], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(reduce_texts, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def _document_counts(vectors: DataFrame, size: int) -> DataFrame:
    """``term`` and ``df``; a task adds up all it reads before it gives a row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["term", "df"])

    return vectors.select("terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class _Tree:
    """Documents of one block in path order; nodes as ranges of leaves with their bounds."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, rows: np.ndarray, ranks: np.ndarray, tf: np.ndarray, size: int):
        """``rows`` ascend; ``ranks`` (0: most frequent) ascend within a row."""
        cuts = np.searchsorted(rows, np.arange(len(ids) + 1))
        keys = ranks.astype(">u4")
        paths = [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.m = ids[order], m[order]
        self.tf = np.zeros((len(ids), size), np.int32)
        self.tf[place[rows], ranks] = tf
        # Length of the path that neighbours share; -1 outside.
        shared = np.full(len(ids) + 1, -1, np.int64)
        for i in range(1, len(ids)):
            a, b = (ranks[cuts[o]:cuts[o + 1]] for o in order[i - 1:i + 1])
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[i] = differ[0] if len(differ) else n
        self._divide(shared)
        starts = self.leaves[:, 0]
        self.leaf_tf, self.leaf_m = np.maximum.reduceat(self.tf, starts), np.minimum.reduceat(self.m, starts)
        self.node_tf = np.stack([self.leaf_tf[a:b].max(0) for a, b in self.spans])
        self.node_m = np.array([self.leaf_m[a:b].min() for a, b in self.spans])

    def _divide(self, shared: np.ndarray) -> None:
        """Leaves (ranges of documents), nodes (``spans`` of leaves) and the children of each node; node 0 is the root."""
        leaves: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.spans: list[list[int]] = []

        def leaf(lo: int, hi: int, parent: int) -> None:
            leaves.append((lo, hi))
            self._node(len(leaves) - 1, len(leaves), parent)

        work = [(0, len(self.ids), -1, -1)]
        while work:
            lo, hi, parent, closing = work.pop()
            if closing >= 0:
                self.spans[closing][1] = len(leaves)
                continue
            inner = shared[lo + 1:hi]
            if hi - lo <= LEAF or not len(inner) or (inner == inner.max()).all() and inner[0] == shared[lo:hi + 1].max() and self._equal(lo, hi):
                leaf(lo, hi, parent)
                continue
            me = self._node(len(leaves), len(leaves), parent)
            edges = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            # Small neighbours under one node are one leaf.
            parts, at = [], 0
            while at < len(edges) - 1:
                to = at + 1
                while to < len(edges) - 1 and edges[to + 1] - edges[at] <= LEAF:
                    to += 1
                parts.append((edges[at], edges[to]))
                at = to
            if len(parts) == 1:
                parts = [(edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
            work.append((0, 0, 0, me))
            work += [(a, b, me, -1) for a, b in reversed(parts)]
        self.leaves = np.array(leaves, np.int64)

    def _equal(self, lo: int, hi: int) -> bool:
        """All documents of the range end at one node."""
        return not np.any((self.tf[lo:hi] > 0) != (self.tf[lo] > 0))

    def _node(self, first: int, last: int, parent: int) -> int:
        self.spans.append([first, last])
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(len(self.spans) - 1)
        return len(self.spans) - 1

    def search(self, cols: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """``best``: up to ``k`` of ``(-score, doc_id)``, ascending; returned with what this tree adds."""
        def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
            tf = tf.astype(np.int64)
            return (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None])) @ weight

        node_tf = self.node_tf[:, cols]
        used = node_tf[0] > 0
        if not used.any():
            return best
        cols, weight, node_tf = cols[used], weight[used], node_tf[:, used]
        work = [(int(score(node_tf[:1], self.node_m[:1])[0]), 0)]
        while work:
            bound, node = work.pop()
            if bound <= 0 or len(best) == k and bound < -best[-1][0]:
                continue
            below = self.children[node]
            if below:
                bounds = score(node_tf[below], self.node_m[below])
                rank = np.argsort(bounds, kind="stable")
                work += [(int(bounds[i]), below[i]) for i in rank]
                continue
            lo, hi = self.leaves[self.spans[node][0]]
            scores = score(self.tf[lo:hi, cols], self.m[lo:hi])
            good = np.flatnonzero((scores > 0) & (scores >= (-best[-1][0] if len(best) == k else 1)))
            if len(good):
                best = sorted(best + list(zip((-scores[good]).tolist(), self.ids[lo:hi][good].tolist(), strict=True)))[:k]
        return best


def _searched(vectors: DataFrame, plan: Broadcast, k: int) -> DataFrame:
    """``item`` (its number), ``doc_id`` and ``score``: the best ``k`` of each task."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, total, words, blocks = plan.value
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            wide = 75 * total * int(n.max(initial=0)) >= 2**63
            m = 25 + (np.array([75 * int(x) * total // words for x in n], np.int64) if wide else 75 * n * total // words)
            lengths = batch.column(2).value_lengths().to_numpy()
            every, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), lengths)
            for chosen, items in blocks:  # terms of a block of items by frequency, and its items
                local = np.full(len(rank), -1, np.int32)
                local[chosen] = np.arange(len(chosen))
                ranks = local[every]
                rows, ranks, counts = owner[ranks >= 0], ranks[ranks >= 0], tf[ranks >= 0]
                order = np.lexsort((ranks, rows))
                rows, ranks, counts = rows[order], ranks[order], counts[order]
                step = max(LEAF, CELLS // max(len(chosen), 1))
                having = np.unique(rows)
                for at in range(0, len(having), step):
                    some = having[at:at + step]
                    a, b = np.searchsorted(rows, [some[0], some[-1] + 1])
                    tree = _Tree(ids[some], m[some], np.searchsorted(some, rows[a:b]), ranks[a:b], counts[a:b], len(chosen))
                    for item, cols, weight in items:
                        best[item] = tree.search(cols, weight, best.get(item, []), k)
        found = [(item, doc, -score) for item, top in best.items() for score, doc in top]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        docs = pa.array([None if d == LAST else d for d in columns[1]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), docs, pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(search, "item int, doc_id bigint, score bigint")


def _plan(held: pa.Table, vocabulary: np.ndarray, counts: pa.Table, total: int, words: int) -> tuple:
    """Frequency order of the terms, and the items in blocks of ``ITEM_WORDS``: ``(rank, N, L, [(terms, [(item, columns, weights)])])``."""
    df = np.zeros(len(vocabulary), np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int32)
    rank[order] = np.arange(len(df))
    w = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    item = held.column("item").to_numpy()
    term = np.searchsorted(vocabulary, held.column("term").to_numpy().view(np.uint64))
    repeats = held.column("count").to_numpy()
    by_item = np.argsort(item, kind="stable")
    item, term, repeats = item[by_item], term[by_item], repeats[by_item]
    edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    blocks, at = [], 0
    while at < len(edges) - 1:
        to = at + 1
        while to < len(edges) - 1 and edges[to + 1] - edges[at] <= ITEM_WORDS:
            to += 1
        chosen = order[np.sort(rank[np.unique(term[edges[at]:edges[to]])])]
        place = {t: i for i, t in enumerate(chosen.tolist())}
        blocks.append((chosen, [
            (int(item[a]), np.array([place[t] for t in term[a:b].tolist()], np.int64), w[term[a:b]] * repeats[a:b]) for a, b in zip(edges[at:to], edges[at + 1:to + 1], strict=True)
        ]))
        at = to
    return rank, total, words, blocks


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` best documents of each item with a score above 0.

    Terms are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased, compared by 64-bit hashes. With N
    documents that have a term, L terms in all, n in the document, df documents with a term and tf of its occurrences: a term
    weighs ``w = floor(1000 ln((2N+2)/(2df+1)))``, ``m = 25 + (75 n N) div L``, and a document scores the sum over the
    item's terms, repeats included, of ``w * ((10^9 tf) div (1000 tf + 8 m))``.

    Rows are documents of their own even if they repeat a doc_id; a null doc_id comes last among equals. Rows with one
    item_id (null is one too) make one item with the terms of all. Null and empty texts have no terms: such items have no rows. Other
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = write_through(_item_terms(items), "item-terms")
    groups = max(1, -(-terms.count() // GROUP_WORDS))
    out = []
    for g in range(groups):
        mine = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        held = mine.toArrow()  # at most about GROUP_WORDS rows
        names = held.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        held = held.append_column("item", names.indices)
        vocabulary = np.unique(held.column("term").to_numpy().view(np.uint64))
        shared = spark.sparkContext.broadcast(vocabulary)
        vectors = write_through(_reduced(docs, shared), "term-vectors")
        total, words = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        plan = spark.sparkContext.broadcast(_plan(held, vocabulary, _document_counts(vectors, len(vocabulary)).toArrow(), total, words))
        found = write_through(_searched(vectors, plan, k), "matches")
        shared.destroy()
        plan.destroy()
        named = spark.createDataFrame(pa.table({"item": pa.array(range(len(names.dictionary)), pa.int32()), "item_id": names.dictionary}), f"item int, item_id {kind}")
        out.append(found.join(named, "item").select("item_id", "item", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
