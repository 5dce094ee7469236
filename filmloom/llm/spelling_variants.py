"""Spelling variants of a corpus vocabulary by asymmetric q-chunks.

Two words are near when one inserted, deleted or replaced code point makes them equal. Of a near pair, the
longer word ``x`` (either one, if equally long) is cut into two disjoint chunks, its halves. The edit touches
one half, so the other stands unchanged in ``y``, at its own position or, behind a deletion, one earlier.
Every word therefore gives its two chunks, and the positional grams that a chunk of a word as long or one
longer can meet within that shift; equal chunks are joined and the rest of the two words is compared.

A chunk can be common (a frequent prefix). A group of more than ``GROUP`` words is not paired: the half
that holds the edit is halved again, and the chunk that stays is added to the key. This ends at a window of
one code point, where all words of a group are near each other and a group is as small as the alphabet.
So the pairs looked at are at most ``GROUP`` times the rows, whatever the words share.

Work on whole texts: the first pass counts words piece by piece in Arrow batches, all else is joins of the
vocabulary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm.words import LOWER, Texts, cut_between, slices
from filmloom.plans.storage import write_through

LEAST_LENGTH = 5  # code points of a word
LEAST_COUNT = 3  # occurrences of a word in the corpus
SLIP = 97  # of so many hashes one makes its word lose a code point; 0 for none
GROUP = 24  # words with one chunk that are paired directly

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # 0xC3 begins U+00C0 to U+00FF
_INSIDE = _LETTER | (np.arange(256) >= 0x80)  # where a long text isn't cut
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))
_LONG = 48  # bytes; longer words take the library's checksum


def _letters(data: np.ndarray) -> np.ndarray:
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return inside


def _checksums(data: np.ndarray, starts: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each word, going on from the checksum before it."""
    out = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    for i in order[:int((size > _LONG).sum())]:
        out[i] = zlib.crc32(data[starts[i]:starts[i] + size[i]].tobytes(), int(before[i])) ^ 0xFFFFFFFF
    order = order[int((size > _LONG).sum()):]
    crc, at, left = out[order], starts[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def _count(texts: Texts, prefix: np.ndarray, slip: int) -> pa.RecordBatch:
    """Words of a piece and their counts; ``prefix`` is each row's checksum of ``<doc_id>:``."""
    data = LOWER[texts.data]
    inside = _letters(data)
    before = np.concatenate([[False], inside[:-1]])
    before[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[texts.offsets[1:][texts.offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = points[ends] - points[starts]
    lost: Counter[str] = Counter()
    keep = length >= LEAST_LENGTH
    if slip:
        long_enough = length > LEAST_LENGTH  # shorter ones are too short without a code point
        rows = np.searchsorted(texts.offsets, starts, "right") - 1
        crc = np.ones(len(starts), np.uint32)
        crc[keep] = _checksums(data, starts[keep], (ends - starts)[keep], prefix[rows[keep]])
        hit = keep & (crc % slip == 0)
        for i in np.flatnonzero(hit & long_enough):
            word, k = data[starts[i]:ends[i]].tobytes().decode(), int(crc[i]) % int(length[i])
            lost[word[:k] + word[k + 1:]] += 1
        keep &= ~hit
    size = (ends - starts)[keep]
    ends_at = np.concatenate([[0], np.cumsum(size)])
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts[keep]] += 1
    marks[ends[keep]] -= 1
    chosen = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    whole = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(chosen.tobytes()))
    found = pc.value_counts(whole)
    words = pa.concat_arrays([found.field(0), pa.array(list(lost), pa.large_string())])
    counts = pa.concat_arrays([found.field(1), pa.array(list(lost.values()), pa.int64())])
    return pa.RecordBatch.from_arrays([words.cast(pa.string()), counts], ["word", "n"])


def corpus_words(docs: DataFrame, slip: int = SLIP, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, for words of at least five code points and ``least_count``.

    ``docs`` has ``doc_id`` and ``text``. Words are runs of ``A-Z a-z U+00C0-U+00FF`` with A-Z lower-cased. With
    ``slip``, a run whose ``crc32('<doc_id>:<run>')`` is a multiple of it loses the code point at that hash modulo its
    length. A null text has no words; a null doc_id counts as an empty one; repeated rows count each time; other columns are not
    read. An empty table gives an empty one.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[first:first + len(texts)]], np.uint32)
                for piece in cut_between(texts, _INSIDE):
                    if len(piece.data):
                        yield _count(piece, prefix, slip)

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _rows(words: DataFrame) -> DataFrame:
    """Chunks of every word, and its grams for the chunks of words one longer; ``at`` and ``to`` bound the changed half of the longer."""
    length = F.char_length("word")
    parts = [F.struct((length + d).alias("size"), at.cast("int").alias("at"), to.cast("int").alias("to"))
             for d in (0, 1) for half in [F.floor((length + d) / 2)] for at, to in ((half, length + d), (F.lit(0), half))]
    return words.withColumn("part", F.explode(F.array(*parts))).select("word", "n", "part.*").withColumn("key", _key())


def _behind(word: str | Column, size: Column, to: Column) -> Column:
    """What follows the window: the same for both words of a pair."""
    length = F.char_length(word)
    return F.substring(word, to + 1 + length - size, length)


def _key() -> Column:
    return F.xxhash64("size", "at", "to", F.substring("word", F.lit(1), F.col("at")), _behind("word", F.col("size"), F.col("to")))


def _paired(rows: DataFrame) -> DataFrame:
    """Near pairs inside groups of equal keys, each once in all windows: ``a, na, b, nb``."""
    x, y = (rows.select("key", "size", "at", "to", *[F.col(c).alias(c + s) for c in ("word", "n")], F.char_length("word").alias("length" + s)) for s in ("_x", "_y"))
    x = x.filter("length_x = size")
    pairs = x.join(y, ["key", "size", "at", "to"]).filter("length_y < length_x OR word_x < word_y")
    at, to, size = F.col("at"), F.col("to"), F.col("size")

    def window(word: str, length: str) -> Column:
        return F.substring(word, at + 1, to - at + F.col(length) - size)

    a, b = window("word_x", "length_x"), window("word_y", "length_y")
    same = (F.substring("word_x", F.lit(1), at) == F.substring("word_y", F.lit(1), at)) & (_behind("word_x", size, to) == _behind("word_y", size, to))
    # A deleted code point inside a run of equal ones counts where the run ends, so in one window only.
    later = (F.col("length_y") < size) & F.startswith(a, b) & (F.substring("word_x", to, F.lit(1)) == F.substring("word_x", to + 1, F.lit(1)))
    return pairs.filter(same & (F.levenshtein(a, b, 1) == 1) & ~later).select(
        F.col("word_x").alias("a"), F.col("n_x").alias("na"), F.col("word_y").alias("b"), F.col("n_y").alias("nb"))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Every pair of near words once: ``a, na, b, nb``. ``words`` has distinct ``word`` and ``n``; null words are in no pair."""
    rows, out = write_through(_rows(words.filter("word IS NOT NULL")), "chunks"), []
    while True:
        crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__m"), F.max(F.col("to") - F.col("at")).alias("__w")).filter(
            (F.col("__m") > group) & (F.col("__w") > 1)).select("key")
        crowded = write_through(crowded, "crowded-chunks")
        if crowded.isEmpty():
            out.append(write_through(_paired(rows), "near-words"))
            break
        out.append(write_through(_paired(rows.join(crowded, "key", "left_anti")), "near-words"))
        middle = F.floor((F.col("at") + F.col("to")) / 2).cast("int")
        halves = F.array(F.struct("at", middle.alias("to")), F.struct(middle.alias("at"), "to"))
        split = rows.join(crowded, "key", "left_semi").select("word", "n", "size", F.explode(halves).alias("h")).select("word", "n", "size", "h.*")
        rows = write_through(split.filter("to > at").withColumn("key", _key()), "chunks")
    return reduce(DataFrame.unionByName, out)


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms; doubling steps, so rounds grow with the logarithm of the longest chain."""
    now = write_through(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        now = write_through(now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "forms")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``words`` (distinct ``word``, ``n``).

    ``form`` is the near word of largest ``n`` (ties: the first in code-point order) if that is at least ``ratio`` times the
    word's own. ``ratio`` must exceed 1, so chains of forms end.
    """
    words = write_through(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("nb").alias("form_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("form"), F.col("na").alias("form_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("top"))
    named = words.join(best, "word", "left")
    large = -F.col("top.less") >= ratio * F.col("n")
    judged = write_through(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("top.form")).alias("form"), F.when(large, -F.col("top.less")).alias("form_n"),
    ), "variants")
    return judged.join(_roots(judged.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
