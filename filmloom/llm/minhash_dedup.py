"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W
from filmloom.llm.components import components
from filmloom.plans.storage import write_through

SHINGLE = 5
SIMILARITY = 75  # percent
BITS = 2  # kept of each minimum


@dataclass(frozen=True)
class Scheme:
    """Bands of minima, and the filters before whole sets are compared."""

    rows: int
    bands: int
    parity_bits: int  # of a set's bitmap; two sets differ in at least as many members as their bitmaps in bits
    least_estimate: float | None  # pairs estimated below it are not compared; None: no estimate is made
    closer: int = 0  # second bands by which members that a star leaves apart are tried once more, see class_components
    factors: np.ndarray = field(init=False)
    shifts: np.ndarray = field(init=False)
    row_factors: np.ndarray = field(init=False)
    salts: np.ndarray = field(init=False)

    def __post_init__(self):
        rng, n = np.random.default_rng(5), self.rows * self.bands
        for name, value in (
            ("factors", rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)),
            ("shifts", rng.integers(0, 2**32, n, dtype=np.uint32)),
            ("row_factors", rng.integers(0, 2**63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)),
            ("salts", rng.integers(0, 2**63, self.bands, dtype=np.uint64)),
        ):
            object.__setattr__(self, name, value)

    @property
    def signature_longs(self) -> int:
        return self.rows * self.bands * BITS // 64


#: A pair at 0.75 misses all bands once in 190,000; 0.5 is 5.4 standard deviations of the estimate below 0.75.
DOCUMENTS = Scheme(rows=4, bands=32, parity_bits=1024, least_estimate=0.5)


def shingle_sets(texts: W.Texts) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each row a 16-byte key of its word sequence and its sorted distinct shingle hashes."""
    starts, ends, first = W.spans(texts, W.SPACED)
    words = W.word_hashes(texts, starts, ends)
    runs = W.grams(words, SHINGLE)
    for a, b in zip(first[:-1], first[1:]):
        own = words[a:b]
        key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        if b - a >= SHINGLE:
            yield key, np.unique(runs[a:b - SHINGLE + 1])
        elif b > a:
            yield key, np.array([W.sequence_hash(own)], np.uint64)
        else:
            yield key, np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima, and the band hashes, of non-empty sets."""
    offsets = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), scheme.rows * scheme.bands), np.uint32)
    for k in range(least.shape[1]):
        least[:, k] = np.minimum.reduceat(flat * scheme.factors[k] + scheme.shifts[k], offsets)
    by_band = least.reshape(len(sets), scheme.bands, scheme.rows).astype(np.uint64)
    bands = W.mix((by_band * scheme.row_factors).sum(axis=2, dtype=np.uint64) + scheme.salts)
    low = W.mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    lanes = 64 // BITS
    low = low[:, :scheme.signature_longs * lanes].reshape(len(sets), -1, lanes)
    packed = (low << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    return packed, bands


def parities(sets: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """For each set a bitmap in which every member flips the bit that its hash names."""
    size = scheme.parity_bits
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = (np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64)
    flipped = np.bincount(rows * size + bits, minlength=len(sets) * size) & 1
    return np.packbits(flipped.astype(np.uint8).reshape(len(sets), size), axis=1).view(np.uint64)


def longs(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.reshape(-1))


def _sign(batches):
    for batch in batches:
        for start, texts in W.slices(batch.column(1)):
            keys, sets = zip(*shingle_sets(texts))
            full = [i for i, s in enumerate(sets) if len(s)]
            packed = np.zeros((len(sets), DOCUMENTS.signature_longs), np.uint64)
            bands = np.zeros((len(sets), DOCUMENTS.bands), np.uint64)
            parity = np.zeros((len(sets), DOCUMENTS.parity_bits // 64), np.uint64)
            if full:
                some = [sets[i] for i in full]
                (packed[full], bands[full]), parity[full] = minima(some, DOCUMENTS), parities(some, DOCUMENTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), longs(packed), longs(parity), longs(bands)],
                ["doc_id", "key", "n_shingles", "signature", "parity", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``key`` (equal for equal word sequences), ``n_shingles``, ``signature``, ``parity``, ``bands``."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _sign, "doc_id bigint, key binary, n_shingles bigint, signature array<bigint>, parity array<bigint>, bands array<bigint>"
    )


def estimate(a: str, b: str, scheme: Scheme) -> Column:
    """Similarity estimated from two packed signatures, corrected for bits that agree by chance."""
    agree = F.lit(0)
    for i in range(scheme.signature_longs):
        differ = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        agree = agree + (64 // BITS - F.bit_count((differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(F.lit(0x5555555555555555))))
    chance = 1 / (1 << BITS)
    return (agree / F.lit(float(scheme.signature_longs * 64 // BITS)) - chance) / (1 - chance)


def _packed_sets(batches):
    for batch in batches:
        for start, texts in W.slices(batch.column(0)):
            keys, sets = zip(*shingle_sets(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(start, len(texts)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["wanted", "key", "shingles"],
            )


def _compare(batches):
    for batch in batches:
        left, right = batch.column("shingles_a"), batch.column("shingles_b")
        keep = []
        for i in range(len(batch)):
            a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= SIMILARITY * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("shingles_b"))
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("shingles_a"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(_compare, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles (A-Z
    lower-cased, words split at white space) is 0.75 or more; a component's id is its smallest doc_id.

    * Rows with equal word sequences are one class; only classes are compared.
    * Each class that shares a band with others is compared with the best connected class of that band
      (the one with the most neighbours over all bands). What these stars leave apart is then compared
      without exception: members outside a bucket's largest component with every member of another one.
      So a large group of copies costs one comparison per member and band, not one per pair.
    * Pairs are first estimated by bit counts of the packed minima and then confirmed on whole sets.

    A null or empty text, or one of white space, has the empty set and is linked with nothing. A text
    of fewer than five words is one shingle. Rows with a null doc_id are linked with nothing and kept, their
    component_id is null. Several rows of one doc_id each get a row; they are linked only if their
    texts are. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    signed = write_through(signatures(docs), "minhash")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = write_through(
        known.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "signature", "parity", "bands")]), "classes"
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted, "rep")
        sets = texts.select("text", "wanted").mapInArrow(_packed_sets, "wanted binary, key binary, shingles binary")
        return sets.filter("wanted = key").select("key", "shingles")

    joined = class_components(classes, sets_of, DOCUMENTS)
    # The smallest doc_id of each component of classes, then of each row.
    smallest = joined.join(classes.select(F.col("key").alias("node"), "rep"), "node")
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("rep").alias("least")), "component")
    labels = classes.select("key", "rep").join(smallest.select(F.col("node").alias("key"), "least"), "key", "left").select(
        "key", F.coalesce("least", "rep").alias("component_id")
    )
    linked = known.select("doc_id", "n_shingles", "key").join(labels, "key").select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_components(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scheme: Scheme) -> DataFrame:
    """Components of the classes that have a link: ``node`` and ``component``, both keys.

    ``classes`` has ``key``, ``rep``, ``n_shingles``, ``signature``, ``parity`` and ``bands``; ``sets_of`` gives ``key`` and ``shingles``
    for a table of ``rep`` and ``wanted`` (a key).
    """
    rows = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = write_through(rows.join(shared, "bucket"), "buckets")
    facts = classes.select("key", "n_shingles", "signature", "parity", "bands")

    # Whole shingle sets, only for classes that share a bucket.
    wanted = members.select("key").distinct().join(classes.select("key", "rep"), "key").select("rep", F.col("key").alias("wanted"))
    sets = write_through(sets_of(wanted).dropDuplicates(["key"]), "sets")

    # First round: every member against the best connected member of its bucket.
    hubs = members.groupBy("key").agg(F.sum("size").alias("hub"))
    best = members.join(hubs, "key").groupBy("bucket").agg(F.max(F.struct("hub", "key")).alias("best"))
    star = write_through(members.join(best, "bucket").select(F.col("best.key").alias("a"), F.col("key").alias("b")).filter("a <> b").distinct(), "star")
    links = write_through(_confirmed(_with_facts(star, facts, scheme), sets), "links")

    if scheme.closer:
        # Members of one bucket that also share a second band, against one of them: closer to each other than to the hub.
        apart = _apart(members, links, facts).select("bucket", "key", "component", F.explode(F.slice("bands", 1, scheme.closer)).alias("second"))
        chosen = apart.groupBy("bucket", "second").agg(F.min_by(F.struct("key", "component"), F.xxhash64("key")).alias("one"))
        tried = apart.join(chosen, ["bucket", "second"]).filter(F.col("component") != F.col("one.component"))
        tried = tried.select(F.col("one.key").alias("a"), F.col("key").alias("b")).distinct()
        links = links.unionByName(write_through(_confirmed(_with_facts(tried, facts, scheme), sets), "links"))

    # Last round: exactly the pairs that share a bucket but no component yet, each in the first band that it shares.
    placed = write_through(_apart(members, links, facts), "placed")
    minor, every = placed.filter("component <> main").alias("x"), placed.alias("y")
    earlier = F.lit(True)
    for i in range(scheme.bands - 1):
        earlier = earlier & ((F.col("x.band") <= i) | (F.col("x.bands")[i] != F.col("y.bands")[i]))
    pairs = minor.join(
        every,
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.key") > F.col("y.key"))) & earlier & _promising("x", "y", scheme),
    ).select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")).distinct()
    done = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    last = write_through(_confirmed(pairs.join(done, ["a", "b"], "left_anti"), sets), "links")
    return components(links.unionByName(last))


def _apart(members: DataFrame, links: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their ``component`` and the bucket's largest, ``main``."""
    labels = components(links)
    placed = members.select("bucket", "band", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    per_part = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = per_part.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return placed.join(largest.select("bucket", F.col("top.component").alias("main")), "bucket").join(facts, "key")


def _promising(x: str, y: str, scheme: Scheme) -> Column:
    """Pairs worth a comparison of whole sets: by size and by bitmap, which exclude no link, and by estimate."""
    n_x, n_y = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    differ = F.lit(0)
    for i in range(scheme.parity_bits // 64):
        differ = differ + F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i]))
    safe = (100 * F.least(n_x, n_y) >= SIMILARITY * F.greatest(n_x, n_y)) & ((100 + SIMILARITY) * differ <= (100 - SIMILARITY) * (n_x + n_y))
    return safe if scheme.least_estimate is None else safe & (estimate(f"{x}.signature", f"{y}.signature", scheme) >= scheme.least_estimate)


def _with_facts(pairs: DataFrame, facts: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) that are worth a comparison."""
    x, y = facts.alias("x"), facts.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).filter(_promising("x", "y", scheme)).select("a", "b")
