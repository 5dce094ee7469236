"""Repeated passages: paragraph MinHash banding, exact confirmation and removal by components.

Two kinds of paragraph are compared. Lines of 25 words or more meet by MinHash bands tuned for recall and are confirmed by
their exact Jaccard similarity. Passages inside longer paragraphs, or across lines, need not make any line similar;
for them the text is also read as overlapping pieces of 25 words that begin where a word run has the least hash of its
surroundings (the minimum of a sliding window), so that texts sharing 50 words share a whole piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W
from filmloom.llm.minhash_dedup import SHINGLE, Scheme, class_components, longs, minima, parities
from filmloom.plans.storage import write_through

LEAST_WORDS = 25  # of a paragraph, and the words of a piece
SURE_WORDS = 50  # a shared run of this many words always shares a piece
CHOICE = SURE_WORDS - LEAST_WORDS + 1
ANCHOR = 5
#: Two rows per band: a pair at 0.75 misses all eight bands once in 750.
PARAGRAPHS = Scheme(rows=2, bands=8, parity_bits=512, least_estimate=None, closer=8)

_PARTS = (
    "doc_id bigint, row bigint, n_words bigint, piece_at array<bigint>, piece array<bigint>, n_paragraphs bigint, "
    "line_at array<bigint>, line_words array<bigint>, line_key array<binary>, line_shingles array<bigint>, line_parity array<bigint>, line_bands array<bigint>"
)


def _pieces(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the pieces of a slice."""
    if len(words) < SURE_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchors = W.grams(words, ANCHOR)
    # Every run of SURE_WORDS words holds CHOICE starts of pieces that end inside it; the least anchor starts one.
    whole = np.flatnonzero(rows[:len(words) - SURE_WORDS + 1] == rows[SURE_WORDS - 1:])
    windows = np.lib.stride_tricks.sliding_window_view(anchors, CHOICE)
    at = np.unique(np.concatenate([part + CHOICE - 1 - np.argmin(windows[part][:, ::-1], axis=1) for part in np.array_split(whole, max(1, len(whole) >> 16))])) if len(whole) else whole
    return at, W.grams(words, LEAST_WORDS)[at]


def line_spans(texts: W.Texts, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word of every line with words, and one past the last."""
    breaks = np.flatnonzero(texts.data == 10)
    line = np.searchsorted(breaks, starts)
    rows = W.row_of_each(first)
    new = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
    return new, np.append(new[1:], len(starts)) if len(new) else new


def _line_sets(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes, np.ndarray]]:
    runs = W.grams(words, SHINGLE)
    return [
        (a, b, hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest(), np.unique(runs[a:b - SHINGLE + 1]))
        for a, b in zip(begin.tolist(), end.tolist()) if b - a >= LEAST_WORDS
    ]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _parts(batches):
    for batch in batches:
        for start, texts in W.slices(batch.column(2), 2 << 20):
            own = batch.slice(start, len(texts))
            starts, ends, first = W.spans(texts, W.SPACED)
            words, rows = W.word_hashes(texts, starts, ends), W.row_of_each(first)
            at, piece = _pieces(words, rows)
            begin, end = line_spans(texts, starts, first)
            lines = _line_sets(words, begin, end)
            line_at = np.array([a for a, *_ in lines], np.int64)
            of_line, of_piece = rows[line_at] if len(lines) else line_at, rows[at]
            n = len(texts)
            per_line, per_piece, all_lines = (np.bincount(x, minlength=n) for x in (of_line, of_piece, rows[begin] if len(begin) else begin))
            bands = minima([s for *_, s in lines], PARAGRAPHS)[1] if lines else np.zeros((0, PARAGRAPHS.bands), np.uint64)
            parity = parities([s for *_, s in lines], PARAGRAPHS) if lines else np.zeros((0, PARAGRAPHS.parity_bits // 64), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    own.column(0), own.column(1), pa.array(np.diff(first), pa.int64()),
                    _lists(at - first[of_piece], per_piece, pa.int64()), _lists(W.signed(piece), per_piece, pa.int64()), pa.array(all_lines, pa.int64()),
                    _lists(line_at - first[of_line], per_line, pa.int64()), _lists(np.array([b - a for a, b, *_ in lines], np.int64), per_line, pa.int64()),
                    _lists(np.array([k for _, _, k, _ in lines], object), per_line, pa.binary()), _lists(np.array([len(s) for *_, s in lines], np.int64), per_line, pa.int64()),
                    _lists(W.signed(np.ascontiguousarray(parity)).reshape(-1), per_line * parity.shape[1], pa.int64()),
                    _lists(W.signed(np.ascontiguousarray(bands)).reshape(-1), per_line * bands.shape[1], pa.int64()),
                ],
                ["doc_id", "row", "n_words", "piece_at", "piece", "n_paragraphs", "line_at", "line_words", "line_key", "line_shingles", "line_parity", "line_bands"],
            )


def _sets_of_lines(batches):
    for batch in batches:
        for _, texts in W.slices(batch.column(0)):
            starts, ends, first = W.spans(texts, W.SPACED)
            words = W.word_hashes(texts, starts, ends)
            lines = _line_sets(words, *line_spans(texts, starts, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for _, _, k, _ in lines], pa.binary()), pa.array([s.tobytes() for *_, s in lines], pa.binary())], ["key", "shingles"]
            )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` what it shares with other documents.

    ``n_words`` and ``n_paragraphs`` (lines with words); ``passages``, the pieces of 25 words that another document also holds, each
    with its first word's number ``at`` and the smallest ``first_doc`` that holds it; ``removed``, the lines to remove, with the number
    of their first word, of their words and the document ``like`` whose line stays.

    Lines of at least 25 words are linked when the Jaccard similarity of their five-word shingles is 0.75 or more; of
    each component the line of the smallest doc_id, and there the first, stays. A run of at least 50 words shared
    by two documents always shows in ``passages``; shorter runs from 25 words on may. A piece is compared by the
    64-bit hash of its words.

    A null or empty text has no words. Rows with a null doc_id share nothing and lose nothing. Rows that repeat a doc_id are one
    document: they do not count as another one for passages. Other columns are not read. An empty table gives an empty
    table.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    parts = write_through(keyed.mapInArrow(_parts, _PARTS), "paragraphs")
    known = parts.filter("doc_id IS NOT NULL")

    pieces = known.select("doc_id", "row", F.explode(F.arrays_zip("piece_at", "piece")).alias("p")).select("doc_id", "row", F.col("p.piece_at").alias("at"), F.col("p.piece").alias("piece"))
    shared = pieces.groupBy("piece").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).filter("first_doc <> last").drop("last")
    passages = pieces.join(shared, "piece").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("at", "first_doc"))).alias("passages"))

    def of_line(name: str, size: int):
        return F.transform("line_key", lambda _, i: F.slice(F.col(name), i * size + 1, size))

    zipped = F.arrays_zip(
        F.col("line_key").alias("key"), F.col("line_at").alias("at"), F.col("line_words").alias("n"), F.col("line_shingles").alias("n_shingles"),
        of_line("line_parity", PARAGRAPHS.parity_bits // 64).alias("parity"), of_line("line_bands", PARAGRAPHS.bands).alias("bands"),
    )
    names = ["key", "at", "n", "n_shingles", "parity", "bands"]
    lines = known.select("doc_id", "row", F.explode(zipped).alias("l")).select("doc_id", "row", *[F.col("l").getField(c).alias(c) for c in names])
    classes = write_through(
        lines.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "parity", "bands")]).withColumn("signature", F.array().cast("array<bigint>")),
        "line-classes",
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = keyed.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        return texts.mapInArrow(_sets_of_lines, "key binary, shingles binary").join(wanted.select(F.col("wanted").alias("key")), "key", "left_semi")

    labels = class_components(classes, sets_of, PARAGRAPHS).withColumnRenamed("node", "key")
    places = lines.select("doc_id", "row", "at", "n", "key").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    stays = places.groupBy("component").agg(F.min(F.struct("doc_id", "at", "row")).alias("stays"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    gone = places.join(stays, "component").filter(F.struct("doc_id", "at", "row") != F.col("stays"))
    removed = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("at", "n", F.col("stays.doc_id").alias("like")))).alias("removed"))

    out = parts.select("doc_id", "row", "n_words", "n_paragraphs").join(passages, ["doc_id", "row"], "left").join(removed, ["doc_id", "row"], "left")
    return out.select(
        "doc_id", "n_words", "n_paragraphs",
        F.coalesce("passages", F.array().cast("array<struct<at:bigint,first_doc:bigint>>")).alias("passages"),
        F.coalesce("removed", F.array().cast("array<struct<at:bigint,n:bigint,like:bigint>>")).alias("removed"),
    )
