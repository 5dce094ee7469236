"""Repeated lines, by range-partitioned line hashes and per-document keep bitmaps. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.plans.storage import write_through

BLANKS = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 20  # code points of a key
LEAST_DOCUMENTS = 3


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; the fast built-in is right where all bytes are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def line_index(docs: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``doc_id``, ``row`` and ``pos`` of every line long enough to count, sorted by hash, document and position.

    The hash has 128 bits. The range partitions are cut by hash and document, so a line that a third of all
    documents hold fills several partitions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parsed = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), _row_hash().alias("row"), F.posexplode(_lines(ascii_lower(text))).alias("pos", "line")
    ).withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= LEAST_LENGTH)
    narrow = write_through(
        parsed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc_id", "row", "pos"), "lines"
    )
    ranged = narrow.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    return write_through(ranged, "line-index")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """For each row that loses a line: ``doc_id``, ``row``, and ``keep``, one long for 64 lines, bit set where the line stays.

    The bitmap ends at the last group of 64 lines that loses one; lines after it stay.
    """
    index = line_index(docs)
    # One row per line and document first, then per line: both aggregate before they shuffle.
    held = index.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    repeated = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).filter(
        F.col("n_docs") >= LEAST_DOCUMENTS
    )
    gone = index.join(repeated, ["h1", "h2"]).filter(F.col("doc_id") < F.col("last"))
    group = F.expr("pos div 64")
    words = gone.groupBy("doc_id", "row", group.alias("group")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    packed = words.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("group", F.bitwise_not("gone").alias("keep")))).alias("parts"))
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), F.array_max(F.map_keys("parts"))), lambda g: F.coalesce(F.col("parts")[g], F.lit(-1).cast("bigint")))
    return packed.select("doc_id", "row", full.alias("keep"))


def with_kept_lines(docs: DataFrame, kept: str, lines: str = "__lines") -> DataFrame:
    """``docs`` with the array ``lines`` of all lines and the array ``kept`` of those that stay.

    A key is the line stripped of blanks at both ends with A-Z lower-cased. Keys of at least 20 code points
    that at least three documents hold lose all their lines except in the largest doc_id that holds them.

    A null or empty text is one empty line. Rows without a doc_id neither count as documents nor lose lines;
    rows that repeat a doc_id are one document. An empty table gives an empty table. ``kept`` and ``lines``
    must be names that ``docs`` does not have; its other columns may have any names.
    """
    maps = keep_bitmaps(docs).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("keep").alias("__keep"))
    tagged = docs.select("*", F.col("doc_id").cast("bigint").alias("__doc"), _row_hash().alias("__hash"))
    joined = tagged.join(maps, (F.col("__doc") == F.col("__id")) & (F.col("__hash") == F.col("__row")), "left").withColumn(lines, _lines(F.col("text")))

    def stays(_, i):
        part = F.get("__keep", F.floor(i / 64).cast("int"))
        return F.coalesce(F.getbit(part, i % 64) == 1, F.lit(True))

    chosen = F.when(F.col("__keep").isNull(), F.col(lines)).otherwise(F.filter(lines, stays))
    return joined.withColumn(kept, chosen).select(*[F.col(f"`{c}`") for c in docs.columns], lines, kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; ``n_chars``, if there, follows the text."""
    done = with_kept_lines(docs, "__kept")
    changed = F.size("__kept") < F.size("__lines")
    out = done.withColumn("__text", F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col("text")))
    fresh = {"text": F.col("__text"), "n_chars": F.when(changed, F.length("__text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])
