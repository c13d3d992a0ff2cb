"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers.  A block of up to ``BLOCK`` rows keeps, per
attribute, bitmaps of its ``SLICES`` most significant bits (above the block's
minimum).  For a query q the score above a constant is the sum of |q_c| * y_c,
where y_c are the attribute's slices, complemented if q_c is negative.  Every
binary digit of |q_c| adds the attribute's slices, shifted, by full adders on
bitmaps (carry-save: columns of equal weight are summed from the lowest up).
The k-th greatest sum is then read off from the most significant slice
downward; the slices left out bound each row's score from both sides, rows that
may still reach the k-th are the boundary, and their scores are computed as
integers.  So the result is exact.

Queries go to the executors in parts of at most ``PART`` vectors; each part is
one pass over the index, in which every task sees its own blocks only and
returns k rows per query and block.  A part's ranks are written before the next
one is read, so one part at a time is held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_path, stored

BLOCK = 1 << 15
SLICES = 5
PART = 4096
SCALE = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): floor(1024 * x) of each component as double. Null ids and vectors that are null or hold a null or non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).cast("array<long>").alias("q"))


class _Block:
    """Rows of one dimension with their slices."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.rows, self.dim = x.shape
        self.low = x.min(axis=0)
        above = x - self.low
        self.bits = int(above.max()).bit_length() if above.size else 0
        self.dropped = max(0, self.bits - SLICES)
        kept = self.bits - self.dropped
        padded = -(-self.rows // 64) * 64
        self.words = padded // 64
        high = np.zeros((self.dim, padded), np.int64)
        high[:, : self.rows] = (above >> self.dropped).T
        self.slices = [[np.packbits((row >> b) & 1, bitorder="little").view(np.uint64) for b in range(kept)] for row in high.astype(np.uint8)]
        self.flipped = [[~s for s in own] for own in self.slices]
        self.valid = np.packbits(np.arange(padded) < self.rows, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices, lowest first, of the sum of |q_c| * y_c."""
        columns: list[list[np.ndarray]] = []
        for c, v in enumerate(query.tolist()):
            own, m = (self.flipped if v < 0 else self.slices)[c], abs(v)
            while m:
                p = (m & -m).bit_length() - 1
                m &= m - 1
                while len(columns) < p + len(own):
                    columns.append([])
                for b, s in enumerate(own):
                    columns[p + b].append(s)
        out, at = [], 0
        while at < len(columns):
            col = columns[at]
            carries = []
            while len(col) > 2:
                a, b, c = col.pop(), col.pop(), col.pop()
                t = a ^ b
                col.append(t ^ c)
                carries.append((a & b) | (t & c))
            if len(col) == 2:
                a, b = col
                col = [a ^ b]
                carries.append(a & b)
            if carries:
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1] += carries
            out.append(col[0] if col else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best."""
        if self.rows <= k or not self.dim or not self.bits:
            return np.arange(self.rows)
        sums = self.sums(query)
        equal, above, kth = self.valid, np.zeros(self.words, np.uint64), 0
        for s in reversed(sums):  # the k-th greatest sum
            some = equal & s
            kth <<= 1
            if int(np.bitwise_count(above | some).sum()) >= k:
                equal, kth = some, kth | 1
            else:
                above, equal = above | some, equal & ~s
        slack = int(np.abs(query).sum()) * ((1 << self.dropped) - 1)
        least = max(0, kth - -(-slack >> self.dropped) - 1)
        equal, above = self.valid, np.zeros(self.words, np.uint64)
        for b in range(len(sums) - 1, -1, -1):  # rows whose sum is at least that
            if least >> b & 1:
                equal = equal & sums[b]
            else:
                above, equal = above | (equal & sums[b]), equal & ~sums[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little", count=self.rows))

    def best(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows other than the query's own."""
        others = k + int((self.ids == own_id).sum())
        rows = self.boundary(query, others)
        rows = rows[self.ids[rows] != own_id]
        score = self.x[rows] @ query
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _searched(part, k: int):
    def blocks(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sizes = np.diff(at)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = flat[at[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0), np.int64)
                held.setdefault(int(dim), []).append((ids[own], x))
                if sum(len(i) for i, _ in held[int(dim)]) >= BLOCK:
                    parts = held.pop(int(dim))
                    yield np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        for parts in held.values():
            yield np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])

    def searched(batches):
        for ids, x in blocks(batches):
            index = _Block(ids, x)
            for query_id, query in part.value:
                if len(query) == index.dim:
                    found, score = index.best(query_id, query, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query_id)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return searched


def _parts(queries: DataFrame):
    part = []
    for row in queries.toLocalIterator():
        part.append((row.vec_id, np.array(row.q, np.int64)))
        if len(part) == PART:
            yield part
            part = []
    if part:
        yield part


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the greatest integer inner product with each query row; ties to the smaller vec_id.

    ``is_query``: condition on vec_id.  Candidates are all rows with another
    vec_id and as many components.  Rows that ``quantised`` leaves out take no
    part; rows that repeat a vec_id are candidates each, and one query, with the
    least of their vectors.
    Scores must fit 64 bits.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    index = stored(quantised(vectors), "vectors")
    blocks = index.repartition(max(1, -(-index.count() // BLOCK)))
    path, schema = new_path(spark, "ranks"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for part in _parts(index.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))):
        held = spark.sparkContext.broadcast(part)
        found = blocks.mapInArrow(_searched(held, k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema(schema).parquet(path)
