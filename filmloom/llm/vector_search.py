"""Exact top-k search by exhaustive term-at-a-time accumulation over blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

SCALE = 256
ROWS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 65_536
LEAST_PER_BLOCK, BLOCKS = 4096, 48  # fewer rows are still cut into some blocks, so that all cores have work
QUERIES_AT_ONCE = 128
GROUP = 64  # scores whose maximum is looked at first
EDGE = 2.0**62
FULL = 0.25  # share of a block's rows from which a dimension's postings are held as a whole column


class _Block:
    """A block as postings, rows by id: for each dimension the rows with a weight other than 0, and the weights."""

    def __init__(self, ids: np.ndarray, dims: np.ndarray, cuts: np.ndarray, rows: np.ndarray, weights: np.ndarray, columns: np.ndarray, table: np.ndarray):
        self.ids, self.dims, self.cuts, self.rows, self.weights = ids, dims, cuts, rows, weights
        self.columns, self.table = columns, table  # dimensions that nearly all rows have, a line of ``table`` for each

    @classmethod
    def of(cls, ids: pa.Array, vectors: pa.Array) -> _Block:
        by = np.argsort(np.asarray(ids, np.int64), kind="stable")
        ids, vectors = np.asarray(ids, np.int64)[by], vectors.take(pa.array(by))
        lengths = np.asarray(vectors.value_lengths())
        values = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -EDGE, EDGE).astype(np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        used = values != 0
        rows, dims, values = rows[used], dims[used], values[used]
        kind = next(k for k in (np.int16, np.int32, np.int64) if not len(values) or np.abs(values).max() <= np.iinfo(k).max)
        held = np.bincount(dims, minlength=1) >= max(1.0, FULL * len(ids))
        columns, full = np.flatnonzero(held), held[dims]
        table = np.zeros((len(columns), len(ids)), kind)
        table[np.searchsorted(columns, dims[full]), rows[full]] = values[full]
        rows, dims, values = rows[~full], dims[~full], values[~full]
        order = np.argsort(dims, kind="stable")
        few, sizes = np.unique(dims, return_counts=True)
        return cls(ids, few, np.concatenate([[0], np.cumsum(sizes)]), rows[order].astype(np.int32), values[order].astype(kind), columns, table)

    def pack(self) -> bytes:
        head = np.array([len(self.ids), len(self.dims), len(self.rows), len(self.columns), self.table.dtype.itemsize], np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, self.ids, self.dims.astype(np.int64), self.cuts.astype(np.int64), self.columns.astype(np.int64), self.rows, self.weights, self.table))

    @classmethod
    def unpack(cls, data: bytes) -> _Block:
        n, few, m, columns, size = np.frombuffer(data, np.int64, 5).tolist()
        kind, at, parts = {2: np.int16, 4: np.int32, 8: np.int64}[size], 40, []
        for k, count in ((np.int64, n), (np.int64, few), (np.int64, few + 1), (np.int64, columns), (np.int32, m), (kind, m), (kind, columns * n)):
            parts.append(np.frombuffer(data, k, count, at))
            at += parts[-1].nbytes
        ids, dims, cuts, columns, rows, weights, table = parts
        return cls(ids, dims, cuts, rows, weights, columns, table.reshape(len(columns), n))

    def norm(self) -> float:
        """Length of the longest row."""
        squares = np.bincount(self.rows, self.weights.astype(np.float64) ** 2, len(self.ids)).astype(np.float64)
        for line in self.table:
            squares += line.astype(np.float64) ** 2
        return float(np.sqrt(squares.max(initial=0)))

    def posting(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weights of a dimension."""
        at = int(np.searchsorted(self.columns, dim))
        if at < len(self.columns) and self.columns[at] == dim:
            rows = np.flatnonzero(self.table[at])
            return rows, self.table[at][rows]
        at = int(np.searchsorted(self.dims, dim))
        if at < len(self.dims) and self.dims[at] == dim:
            return self.rows[self.cuts[at]:self.cuts[at + 1]], self.weights[self.cuts[at]:self.cuts[at + 1]]
        return np.zeros(0, np.int32), np.zeros(0, np.int64)


def _pack(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    ids, vectors = (table.column(c).combine_chunks() for c in ("vec_id", "vector"))
    return pa.table({"block": table.column("block").slice(0, 1), "packed": pa.array([_Block.of(ids, vectors).pack()], pa.binary())})


def _kind(peak: float) -> type:
    """The fastest numbers in which sums up to ``peak`` are exact."""
    return np.float32 if peak < 2.0**24 else np.float64 if peak < 2.0**53 else np.int64 if peak < EDGE else object


def _best(query_block: bytes, row_block: bytes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block its best rows of another one: query id, row ids, scores."""
    queries, block = _Block.unpack(query_block), _Block.unpack(row_block)
    ids, n = block.ids, len(block.ids)
    # No partial sum of a score is beyond the product of the lengths; a thousandth is for the rounding of these.
    kind = _kind(queries.norm() * block.norm() * 1.001)
    none = {np.float32: -np.inf, np.float64: -np.inf, np.int64: -(2**63) + 1, object: -(1 << 400)}[kind]
    table = block.table.astype(kind)
    asked = np.zeros((len(queries.ids), len(block.columns)), kind)
    for j, dim in enumerate(block.columns):
        rows, weights = queries.posting(dim)
        asked[rows, j] = weights.astype(kind)
    few = [(*queries.posting(dim), *block.posting(dim)) for dim in block.dims]
    few = [(q[order], w[order].astype(kind), hit, gain.astype(kind)) for q, w, hit, gain in few if len(q) for order in [np.argsort(q, kind="stable")]]
    edges = np.arange(0, n, GROUP)
    place = np.searchsorted(ids, queries.ids)
    for at in range(0, len(queries.ids), QUERIES_AT_ONCE):
        some = queries.ids[at:at + QUERIES_AT_ONCE]
        # All dimensions that most rows have are added up at once, the others one by one along their postings.
        scores = asked[at:at + len(some)] @ table if len(table) else np.zeros((len(some), n), kind)
        for q, w, hit, gain in few:
            a, b = np.searchsorted(q, [at, at + len(some)])
            if a < b:
                scores[np.ix_(q[a:b] - at, hit)] += w[a:b, None] * gain
        own = np.flatnonzero(ids[np.minimum(place[at:at + len(some)], n - 1)] == some)
        scores[own, place[at + own]] = none
        # The k-th largest of the groups' maxima is reached by k scores at least.
        peaks = np.maximum.reduceat(scores, edges, axis=1)
        least = np.partition(peaks, len(edges) - k, axis=1)[:, len(edges) - k] if len(edges) > k else np.full(len(some), none, kind)
        for i, query in enumerate(some):
            near = np.flatnonzero(scores[i] >= least[i])
            if len(near) > 4 * k:
                mine = scores[i, near]
                near = near[mine >= np.partition(mine, len(mine) - k)[len(mine) - k]]
            top = near[np.argsort(-scores[i, near], kind="stable")[:k]]  # the rows are in the order of their ids
            top = top[scores[i, top] != none]
            if len(top):
                yield int(query), ids[top], np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores[i, top]], np.int64)


def _search(k: int):
    def search(batches):
        for batch in batches:
            for i in range(len(batch)):
                found = list(_best(batch.column("queries")[i].as_buffer(), batch.column("rows")[i].as_buffer(), k))
                per_query = [len(ids) for _, ids, _ in found]
                columns = [np.repeat([q for q, _, _ in found], per_query), np.concatenate([ids for _, ids, _ in found] or [[]]), np.concatenate([s for _, _, s in found] or [[]])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    return search


def _blocks(vectors: DataFrame, n: int, rows: int) -> tuple[DataFrame, int]:
    """Vectors of a table of ``n`` rows, packed in blocks of about ``rows``, and the number of blocks."""
    n = max(1, -(-n // rows))
    tagged = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return tagged.groupBy("block").applyInArrow(_pack, "block int, packed binary"), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query over all vectors but its own: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components become ``floor(256 x)``; the score is their integer inner product, a missing component counts 0.
    Ties go to the smaller vec_id. Both tables have ``vec_id`` and ``embedding`` and are cut into blocks of bounded
    size. Each pair of a query block and a row block is one row: the query's weights are added along the postings of
    the row block into dense scores, those of dimensions that most rows have as one product of matrices in numbers
    that hold every sum exactly, and the best k are cut out by partition.
    The lists of all blocks are then merged, k rows per query and block.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Of rows that repeat a
    vec_id the smallest vector counts. Components beyond 2^62 after scaling are held there, sums are then
    exact and scores held to the range of long. A query with no other vector has no rows; empty tables give none.
    """
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def clean(df: DataFrame) -> DataFrame:
        single = isinstance(df.schema["embedding"].dataType.elementType, FloatType)  # half the bytes
        ok = df.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>" if single else "array<double>")).filter(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(wrong, F.lit(True))
        )
        return ok.groupBy("vec_id").agg(F.min("embedding").alias("vector"))

    n = vectors.count()
    row_blocks, n_rows = _blocks(clean(vectors), n, min(ROWS_PER_BLOCK, max(LEAST_PER_BLOCK, -(-n // BLOCKS))))
    query_blocks, n_queries = _blocks(clean(queries), queries.count(), QUERIES_PER_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = query_blocks.select(F.col("block").alias("q"), F.col("packed").alias("queries"), every(n_rows).alias("r"))
    right = row_blocks.select(F.col("block").alias("r"), F.col("packed").alias("rows"), every(n_queries).alias("q"))
    found = left.join(right, ["q", "r"]).select("queries", "rows").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
