"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W
from filmloom.plans.storage import write_through

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.7, 0.9  # share of an entity's information that a term gives away
CHANCE = 0.05  # pairs expected by chance among all that are compared
TERMS_AT_ONCE = 1_000_000  # broadcast: 8 MB
SEEN_BITS = 26  # a filter of 8 MB; hashes that meet in a bit are counted apart afterwards
HELD = 200_000  # distinct terms counted before a task passes them on

# The patterns are given.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # number of the kind, start, end


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and forward over the domain: linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, in the order of kinds and then of starts."""
    spans = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m.group())) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            spans.append((3, *m.span()))
    return spans


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _digits(value)}"


class _Places:
    """Byte offsets of code points, and code points of byte offsets, of one text's bytes."""

    def __init__(self, data: np.ndarray):
        self.heads = np.flatnonzero((data & 0xC0) != 0x80) if (data >= 0x80).any() else None

    def code_points(self, at: np.ndarray) -> np.ndarray:
        return at if self.heads is None else np.searchsorted(self.heads, at)

    def byte_offsets(self, at: np.ndarray, size: int) -> np.ndarray:
        return at if self.heads is None else np.append(self.heads, size)[at]


def _apart(starts: np.ndarray, ends: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Which of the words overlap none of the ``taken`` spans (rows of start and end); sorted search, so linear in both."""
    if not len(taken):
        return np.ones(len(starts), bool)
    taken = taken[np.argsort(taken[:, 0], kind="stable")]
    reach = np.append(np.maximum.accumulate(taken[:, 1]), -1)  # -1: no span begins before the word ends
    return reach[np.searchsorted(taken[:, 0], ends, "left") - 1] <= starts


def _holders(batches):
    """One row per text with entities: its key, its entities and the distinct terms outside of them."""
    names = ["key", "entities", "terms"]
    for batch in batches:
        for at, texts in W.slices(batch.column(0)):
            keys, entities, terms = [], [], []
            for i, text in enumerate(batch.column(0).slice(at, len(texts)).to_pylist()):
                if not (found := base_spans(text)):
                    continue
                part = W.Texts(pa.array([text], pa.string()))
                starts, ends, _ = W.spans(part, W.LETTERED)
                taken = _Places(part.data).byte_offsets(np.array([span[1:] for span in found]), len(part.data))
                keys.append(batch.column(1)[at + i].as_py())
                entities.append(sorted({_entity(kind, text[x:y]) for kind, x, y in found}))
                terms.append(W.signed(np.unique(W.word_hashes(part, starts, ends)[_apart(starts, ends, taken)])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64()))], names)


def _bits(rows: DataFrame, value: str, condition: str = "true") -> tuple[np.ndarray, int]:
    """A bit for the top bits of each ``value`` that meets the condition, as at most 2^20 words, and the number of rows."""
    bit = f"shiftrightunsigned({value}, {64 - SEEN_BITS})"
    words = rows.groupBy(F.expr(f"{bit} div 64").alias("word")).agg(
        F.expr(f"bit_or(if({condition}, shiftleft(1L, cast({bit} % 64 as int)), 0L))").alias("bits"), F.count(F.lit(1)).alias("n")
    ).toArrow()
    table = np.zeros(1 << (SEEN_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64), int(words.column("n").to_numpy().sum())


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - SEEN_BITS)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _terms_of(batches, seen: np.ndarray, repeated: np.ndarray, again: bool):
    """Per slice of texts whose key has its bit in ``repeated`` (or has not): keys, row numbers and the distinct seen terms of each row."""
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        chosen = _has(repeated, keys.view(np.uint64)) == again
        if not chosen.any():
            continue
        own, column = keys[chosen], batch.column(0).filter(pa.array(chosen))
        for at, texts in W.slices(column):
            starts, ends, first = W.spans(texts, W.LETTERED)
            hashes = W.word_hashes(texts, starts, ends)
            hit = np.flatnonzero(_has(seen, hashes))
            rows, terms = W.row_of_each(first)[hit], W.signed(hashes)[hit]
            order = np.lexsort((terms, rows))
            rows, terms = rows[order], terms[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
            yield own[at:at + len(texts)], rows[new], terms[new]


def _single_counter(seen: Broadcast, repeated: Broadcast):
    """Number of the texts that no other row can hold with each term."""

    def count(batches):
        held: Counter[int] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
            held.clear()
            return out

        for _, _, terms in _terms_of(batches, seen.value, repeated.value, False):
            found, times = np.unique(terms, return_counts=True)
            for term, n in zip(found.tolist(), times.tolist()):
                held[term] += n
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return count


def _repeated_terms(seen: Broadcast, repeated: Broadcast):
    """Key and terms of the texts that other rows may hold too."""

    def collect(batches):
        for keys, rows, terms in _terms_of(batches, seen.value, repeated.value, True):
            offsets = pa.array(np.searchsorted(rows, np.arange(len(keys) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(terms))], ["key", "terms"])

    return collect


_RATED = "entity string, term bigint, n_entity bigint, n_term bigint, together bigint, total bigint, share double, surprise double, needed double"


def rated_pairs(docs: DataFrame) -> DataFrame:
    """Every pair of an entity and a term that stand in one text and that could reach the least share, with its statistics.

    ``n_entity``, ``n_term`` and ``together`` are the n(e), n(t) and n(t, e) of ``disclosing_terms``, ``total`` is n. ``surprise`` is the
    exponent of the Chernoff bound on ``together`` texts or more where n(e) n(t) / n are expected, k ln(k / m) - k + m;
    ``needed`` is ln(tests / 0.05), tests being the terms times the entities that are compared.
    """
    spark = docs.sparkSession
    texts = docs.filter("text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    holders = write_through(
        texts.mapInArrow(_holders, "key bigint, entities array<string>, terms array<bigint>").groupBy("key").agg(
            F.any_value("entities").alias("entities"), F.any_value("terms").alias("terms")
        ),
        "entity-texts",
    )
    owned = holders.select("key", F.explode("entities").alias("entity"))
    often = write_through(owned.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter("n_entity >= 2"), "entities")
    if often.isEmpty():  # one text shows no co-occurrence
        return spark.createDataFrame([], _RATED)
    owned = write_through(owned.join(often, "entity"), "entities-of-texts")
    most = owned.groupBy("key").agg(F.max("n_entity").alias("most"))
    terms = write_through(holders.join(most, "key").select("key", "most", F.explode("terms").alias("term")), "terms-of-texts")
    repeats, total = _bits(texts.groupBy("key").count(), "key", "count > 1")
    # Each row of the key table is one text, so the sum of its rows is the number of different texts.
    seen = spark.sparkContext.broadcast(_bits(terms.select("term").distinct(), "term")[0])
    repeated = spark.sparkContext.broadcast(repeats)
    single = texts.mapInArrow(_single_counter(seen, repeated), "term bigint, n bigint")
    several = texts.mapInArrow(_repeated_terms(seen, repeated), "key bigint, terms array<bigint>").groupBy("key").agg(F.any_value("terms").alias("terms"))
    spread = single.unionByName(several.select(F.explode("terms").alias("term"), F.lit(1).cast("bigint").alias("n"))).groupBy("term").agg(F.sum("n").alias("n_term"))
    spread = write_through(spread.filter("n_term >= 2"), "term-counts")
    seen.destroy()
    repeated.destroy()

    def reachable(n_entity):  # n(t, e) is at most n(e), so a more frequent term cannot give the least share
        return F.col("n_term") <= F.lit(float(total)) ** (1 - GENERALISE) * F.col(n_entity) ** GENERALISE * (1 + 1e-9)

    rare = terms.join(spread, "term").filter(reachable("most")).select("key", "term", "n_term")
    pairs = rare.join(owned, "key").filter(reachable("n_entity") & (F.col("n_entity") < total)).groupBy("entity", "term").agg(
        F.any_value("n_entity").alias("n_entity"), F.any_value("n_term").alias("n_term"), F.count(F.lit(1)).alias("together")
    )
    pairs = write_through(pairs, "term-pairs")
    tests = pairs.select("term").distinct().count() * pairs.select("entity").distinct().count()
    n, expected = F.lit(float(total)), F.col("n_term") * F.col("n_entity") / F.lit(float(total))
    return pairs.withColumn("total", F.lit(total).cast("bigint")).withColumn(
        "share", F.log(F.col("together") / expected) / F.log(n / F.col("n_entity"))
    ).withColumn("surprise", F.col("together") * F.log(F.col("together") / expected) - F.col("together") + expected).withColumn(
        "needed", F.lit(math.log(max(tests, 1) / CHANCE))
    )


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term`` (hash of a lower-cased word) and ``removed`` for terms that reveal a protected entity.

    An entity is an e-mail address, IP address, card or phone number. Rows with equal texts are one text, so copies prove
    nothing. Of all n texts, n(e) hold the entity, n(t) the term and n(t, e) both, anywhere in the text, the term outside of any entity.
    A term gives away the share PMI(t, e) / IC(e) = log(n n(t, e) / (n(t) n(e))) / log(n / n(e)) of the entity's information.
    From 0.7 on it is generalised, from 0.9 on removed, if at least two texts hold both and so many would not come by chance:
    over all terms and entities compared, such a count is expected less than 0.05 times. An entity of one text reveals nothing about terms.
    """
    pairs = rated_pairs(docs).filter((F.col("together") >= 2) & (F.col("share") >= GENERALISE) & (F.col("surprise") >= F.col("needed")))
    return pairs.groupBy("term").agg(F.max("share").alias("share")).select("term", (F.col("share") >= REMOVE).alias("removed"))


_SPANS = "array<struct<kind:int,start:bigint,end:bigint,removed:boolean>>"


def _marker(block: Broadcast, first_pass: bool, last_pass: bool):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", kind), ("clean", pa.string())])

    def mark(batches):
        terms, removed = block.value
        for batch in batches:
            for at, texts in W.slices(batch.column(1)):
                part = batch.slice(at, len(texts))
                rows = [t or "" for t in part.column(1).to_pylist()]
                if first_pass:
                    spans = [[{"kind": k, "start": a, "end": b, "removed": True} for k, a, b in base_spans(t)] for t in rows]
                else:
                    spans = part.column(2).to_pylist()
                if len(terms):
                    starts, ends, first = W.spans(texts, W.LETTERED)
                    hashes = W.signed(W.word_hashes(texts, starts, ends))
                    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    hits = np.flatnonzero(terms[place] == hashes)
                    row_of = W.row_of_each(first)[hits]
                    for r in np.unique(row_of):
                        low, high = texts.offsets[r:r + 2]
                        own = hits[np.searchsorted(row_of, r):np.searchsorted(row_of, r, "right")]
                        at_points = _Places(texts.data[low:high])
                        a, b = at_points.code_points(starts[own] - low), at_points.code_points(ends[own] - low)
                        free = _apart(a, b, np.array([(s["start"], s["end"]) for s in spans[r]], np.int64).reshape(-1, 2))
                        spans[r] += [
                            {"kind": 4, "start": x, "end": y, "removed": z}
                            for x, y, z in zip(a[free].tolist(), b[free].tolist(), removed[place[own[free]]].tolist())
                        ]
                        spans[r].sort(key=lambda s: (s["kind"], s["start"]))
                text = part.column(1).cast(pa.string())
                clean = text
                if last_pass and any(spans):
                    clean = pa.array([_replace(t, found) if found else (t if known else None) for t, found, known in zip(rows, spans, text.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(spans, kind), clean], schema=schema)

    return mark


def marked(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text``, ``spans`` of personal data and of terms that reveal it, and the ``clean`` text.

    A span has the number of its ``kind`` (see ``KINDS``), code point ``start`` and ``end``, and whether it is ``removed`` or only
    generalised. Spans of patterns stand as they match; terms that overlap one are part of it already. ``clean`` has ``[email]`` and
    so on in place of the spans, ``[term]`` for a generalised term, ``[removed]`` for a removed one.

    A null text has no spans and stays null. Repeated rows and null ids are rows like any other. Other columns are
    not read. An empty table gives an empty table.
    """
    sc = docs.sparkSession.sparkContext
    terms = write_through(disclosing_terms(docs), "terms")
    blocks = max(1, -(-terms.count() // TERMS_AT_ONCE))
    state = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.array().cast(_SPANS).alias("spans"))
    for i in range(blocks):
        rows = sorted((r["term"], r["removed"]) for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).collect())
        block = sc.broadcast((np.array([t for t, _ in rows], np.int64), np.array([x for _, x in rows], bool)))
        state = state.mapInArrow(_marker(block, i == 0, i + 1 == blocks), f"doc_id bigint, text string, spans {_SPANS}, clean string")
        if i + 1 < blocks:  # written, so that an executor never holds two blocks
            state = write_through(state.drop("clean"), "marked")
            block.destroy()
    return state


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` of ``marked``."""
    return marked(docs).drop("clean")


def _replace(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:  # inside a longer span or overlapping its end
            at = max(at, s["end"])
            continue
        out += [text[at:s["start"]], "[removed]" if s["kind"] == 4 and s["removed"] else f"[{KINDS[s['kind']]}]"]
        at = s["end"]
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the clean text of ``marked``."""
    return marked(docs).select("doc_id", F.col("clean").alias("text"))
