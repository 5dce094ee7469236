"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Exploding every n-gram of every document into a row would move many times the input. Here a block of documents
sends each distinct n-gram hash once, packed by hash shard; a shard adds up the counts of all blocks (its part of the
count table) and answers each block with the counts of the n-grams it sent. The join of n-grams and counts is thus
made by hash, block by block, and nothing is held whole anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2  # a longer n-gram seen once is the one being scored, which says nothing
BLOCK_BYTES = 12 << 20  # text per block
SHARD_GRAMS = 2_000_000  # n-grams sent to a shard, before they are added up
PACK_BYTES = 24 << 20  # text of a task dealt to blocks at once
CODEC = pa.Codec("zstd", 1)
TEXT_CODEC = pa.Codec("zstd", 3)


def _pack_planes(values: np.ndarray) -> bytes:
    """Number of 64-bit values, then their bytes, plane by plane, compressed; the high planes are nearly all zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T) if len(values) else np.zeros((8, 0), np.uint8)
    return len(values).to_bytes(8, "little") + CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack_planes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(CODEC.decompress(data[8:], 8 * size, asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted hashes, by their differences."""
    return _pack_planes(np.diff(values, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(data), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _pack_planes(counts.astype(np.uint64))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack_planes(data).view(np.int64)


def _packed(batches):
    """Rows of ``block``, ``doc_id`` and ``text`` packed by block: texts compressed together take less than row by row."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        packs = []
        for rows in np.split(order, cuts[1:]):
            part = table.select(["doc_id", "text"]).take(pa.array(rows)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=TEXT_CODEC)) as writer:
                writer.write_table(part)
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[order][cuts], pa.int32()), pa.array(packs, pa.binary())], ["block", "rows"])

    size = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def _unpacked(packs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs])


class _Block:
    """Words of a block of documents; the n-grams of each order as hashes, by position."""

    def __init__(self, column: pa.ChunkedArray):
        words, sizes = [], []
        for _, texts in W.slices(column):
            starts, ends, first = W.spans(texts, W.SPACED)
            words.append(W.word_hashes(texts, starts, ends))
            sizes.append(np.diff(first))
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.cumsum([0, *self.sizes])
        self.rows = W.row_of_each(self.first)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last word and hashes of the n-grams that stay within a document."""
        runs = W.grams(self.words, size)
        whole = np.flatnonzero(self.rows[:len(runs)] == self.rows[size - 1:]) if len(runs) else np.zeros(0, np.int64)
        # The length is part of the hash, so that orders never meet.
        return whole + size - 1, W.mix(runs[whole] + np.uint64(size))


def _shard_cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins in a sorted array; a shard owns an equal range."""
    edges = [(s << 64) // shards for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]])


def _sender(order: int, shards: int):
    def send(table: pa.Table) -> pa.Table:
        block = _Block(_unpacked(table.column("rows")).column("text"))
        found = [np.unique(block.grams(n)[1], return_counts=True) for n in range(1, order + 1)]
        hashes, counts = np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found])
        by = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[by], counts[by]
        cuts = _shard_cuts(hashes, shards)
        used = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
            "shard": pa.array(used, pa.int32()),
            "hashes": pa.array([_pack(hashes[cuts[s]:cuts[s + 1]]) for s in used], pa.binary()),
            "counts": pa.array([_pack_counts(counts[cuts[s]:cuts[s + 1]]) for s in used], pa.binary()),
        })

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Add up one shard's counts over all blocks and give each block its totals."""
    hashes = [_unpack(x.as_py()) for x in table.column("hashes")]
    counts = [_unpack_counts(x.as_py()) for x in table.column("counts")]
    every = np.concatenate(hashes)
    keys, at = np.unique(every, return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, at, np.concatenate(counts))
    mine = np.split(totals[at], np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "totals": pa.array([_pack_counts(m) for m in mine], pa.binary())})


def _scorer(order: int, total_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = _unpacked(left.column("rows"))
        block = _Block(docs.column("text"))
        n = len(block.words)
        per_order = []
        found = [np.unique(block.grams(m)[1], return_inverse=True) for m in range(1, order + 1)]
        hashes = np.concatenate([h for h, _ in found])
        by = np.argsort(hashes, kind="stable")
        totals = np.empty(len(hashes), np.int64)
        if len(hashes):
            parts = sorted(zip(right.column("shard").to_pylist(), right.column("totals").to_pylist()))
            totals[by] = np.concatenate([_unpack_counts(t) for _, t in parts])
        start = 0
        for m, (keys, at) in enumerate(found, 1):
            counts = np.zeros(n, np.int64)
            counts[block.grams(m)[0]] = totals[start:start + len(keys)][at]
            per_order.append(counts)
            start += len(keys)
        value = np.log(np.maximum(per_order[0], 1)) - np.log(max(total_words, 1))
        used = np.ones(n, np.int64)
        depth = np.minimum(np.arange(n) - block.first[block.rows] + 1, order) if n else np.zeros(0, np.int64)
        for m in range(2, order + 1):
            history = np.zeros(n, np.int64)
            history[1:] = per_order[m - 2][:-1]
            seen = (per_order[m - 1] >= MIN_COUNT) & (depth >= m)
            value = np.where(seen, np.log(np.maximum(per_order[m - 1], 1)) - np.log(np.maximum(history, 1)), np.where(depth >= m, np.log(BACKOFF) + value, value))
            used = np.where(seen, m, used)
        sums = np.bincount(block.rows, value, len(block.sizes))
        backed = np.bincount(block.rows, used < depth, len(block.sizes)).astype(np.int64)
        return pa.table([docs.column("doc_id").combine_chunks(), pa.array(block.sizes, pa.int64()), pa.array(backed), pa.array(sums, pa.float64())], schema=schema)

    return score


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_backoff`` (words scored by a shorter n-gram) and ``log_score``.

    A word's score is the count of the longest n-gram that ends in it and was seen at least twice, over the count of that
    n-gram without the word; each step to a shorter one costs a factor 0.4; a single word's score is its share of
    all words. ``log_score`` sums the natural logs. Counts are taken over all documents. Words are split at white
    space with A-Z lower-cased; n-grams stay within a document.

    A null or empty text has no words and scores 0. Repeated rows and null ids are documents like any other. Other
    columns are not read. An empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.sum(_word_total())).first()
    n_bytes, n_words = size[0] or 0, size[1] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    shards = max(1, -(-n_words * order // SHARD_GRAMS))
    # The partition number spreads rows that repeat; it is the same whenever the table is read again.
    tag = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = texts.select(tag.alias("block"), "doc_id", "text").mapInArrow(_packed, "block int, rows binary").repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_sender(order, shards), "block int, shard int, hashes binary, counts binary")
    answers = sent.groupBy("shard").applyInArrow(_answer, "block int, shard int, totals binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(order, n_words), "doc_id bigint, n_words bigint, n_backoff bigint, log_score double"
    )


def _word_total():
    inner = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) == 0, 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+")))
