"""Vector code compression: product quantisation by Lloyd rounds over heaps.

Vectors are quantised to integers and cut into parts; each part position has a
codebook of up to ``ENTRIES`` integer vectors.  Rows stand in blocks, and a
block keeps, per part position, a heap for each codebook entry with the parts
assigned to it.  A part's key is the slack of its bounds, the distance to the
second nearest entry less the distance to its own, plus its entry's cumulative
drift at that time.  After an update an entry's drift grows by its own move and
the greatest move of the others.  A part whose key is still above its entry's
drift can't have changed sides; a round pops those that are not, computes their
distances to all entries as exact integers, and pushes them anew.  So results
equal those of plain Lloyd rounds, ties to the lower index included.

A round is one pass over the blocks, which are written with their heaps and
read back by the next; the files of the round before are deleted.  A task
returns the change of the sums and counts, at most a number for each component of
each entry.  The driver holds codebooks and sums only.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 1 << 14
#: Rows whose distances to all entries are held at once.
SCAN = 1 << 12
_EXACT = 1 << 53
_LONG = float(1 << 63)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): floor(1024 * x) of each component as double. Vectors that are null or hold a null, a non-finite component, or one beyond 64 bits once scaled are left out."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < _LONG))
    rows = vectors.where(F.col("embedding").isNotNull() & fits)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).cast("array<long>").alias("q"))


# --- exact distances -------------------------------------------------------
def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which squared distances between their rows are exact: doubles, or Python's integers where components are huge."""
    most = max([abs(int(f(a))) for a in arrays if a.size for f in (np.min, np.max)], default=0)
    kind = np.float64 if 4 * max(1, arrays[0].shape[1]) * most**2 < _EXACT else object
    return [a.astype(kind) for a in arrays]


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower, and how much nearer it is than the second."""
    entry, slack = np.empty(len(x), np.uint8), np.full(len(x), np.inf)
    for at in range(0, len(x), SCAN):
        rows, c = _numbers(x[at : at + SCAN], book)
        d = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ c.T) + (c * c).sum(axis=1)[None, :]
        own, line = d.argmin(axis=1), np.arange(len(d))
        entry[at : at + SCAN] = own
        if len(book) > 1:
            least = _roots(d[line, own])
            d[line, own] = d.max() + 1
            slack[at : at + SCAN] = _roots(d.min(axis=1)) - least
    return entry, slack


def _errors(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances to the own entries, as exact integers."""
    rows, c = _numbers(x, book)
    gap = rows - c[entry]
    out = (gap * gap).sum(axis=1)
    return out.astype(np.int64) if out.dtype != object else out


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What an update adds to each entry's drift: its own move and the greatest of the others."""
    a, b = _numbers(old, new)
    own = _roots(((a - b) * (a - b)).sum(axis=1))
    if len(own) < 2:
        return own
    first, second = np.sort(own)[::-1][:2]
    return own + np.where(np.arange(len(own)) == own.argmax(), second, first)


# --- blocks ----------------------------------------------------------------
class _Block:
    """Up to ``BLOCK`` rows: components (rows x dim, padded), each part's entry, and heaps as flat arrays in heap order, entry by entry."""

    def __init__(self, x: np.ndarray, parts: int, entries: int):
        self.x, self.parts, self.entries, self.width = x, parts, entries, x.shape[1] // parts
        self.entry = np.zeros((parts, len(x)), np.uint8)
        self.keys, self.rows = np.zeros((parts, 0)), np.zeros((parts, 0), np.int32)
        self.sizes = np.zeros((parts, entries), np.int32)

    def part(self, p: int) -> np.ndarray:
        return self.x[:, p * self.width : (p + 1) * self.width]

    def to_bytes(self) -> list[bytes]:
        return [self.x.dtype.str.encode(), self.x.tobytes(), self.entry.tobytes(), self.keys.tobytes(), self.rows.tobytes(), self.sizes.tobytes()]

    @classmethod
    def from_bytes(cls, n: int, dim: int, parts: int, entries: int, raw: list[bytes]) -> _Block:
        kind, x, entry, keys, rows, sizes = raw
        out = cls(np.frombuffer(x, kind.decode()).reshape(n, dim), parts, entries)
        out.entry = np.frombuffer(entry, np.uint8).reshape(parts, n).copy()
        out.keys, out.rows = np.frombuffer(keys).reshape(parts, -1), np.frombuffer(rows, np.int32).reshape(parts, -1)
        out.sizes = np.frombuffer(sizes, np.int32).reshape(parts, entries)
        return out

    def assigned(self, books: list[np.ndarray], drift: np.ndarray, changes: _Changes | None) -> None:
        """Bring all parts to their nearest entries."""
        keys, rows, sizes = [], [], []
        for p, book in enumerate(books):
            heaps = self._heaps(p)
            if not self.keys.shape[1]:  # the first round
                due = np.arange(len(self.x))
            else:
                due = self._popped(heaps, drift[p])
            if len(due):
                new, slack = _nearest(self.part(p)[due], book)
                if changes is not None:
                    changes.moved(p, self.part(p)[due], self.entry[p][due] if self.keys.shape[1] else None, new)
                self.entry[p][due] = new
                key = slack + drift[p][new]
                for e, k, row in zip(new.tolist(), key.tolist(), due.tolist(), strict=True):
                    heapq.heappush(heaps[e], (k, row))
            flat = [pair for heap in heaps for pair in heap]
            keys.append([k for k, _ in flat])
            rows.append([row for _, row in flat])
            sizes.append([len(heap) for heap in heaps])
        self.keys, self.rows, self.sizes = np.array(keys, np.float64), np.array(rows, np.int32), np.array(sizes, np.int32)

    def _heaps(self, p: int) -> list[list]:
        pairs = list(zip(self.keys[p].tolist(), self.rows[p].tolist(), strict=True))
        ends = np.cumsum(self.sizes[p]).tolist()
        return [pairs[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _popped(self, heaps: list[list], drift: np.ndarray) -> np.ndarray:
        """Rows whose slack the drift of their entry has used up; the margin covers what roots and sums are rounded by."""
        due = []
        for heap, d in zip(heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= d + 1e-9 * (1 + abs(d) + abs(heap[0][0])) + self._margin():
                due.append(heapq.heappop(heap)[1])
        return np.array(due, np.int64)

    def _margin(self) -> float:
        """Of the rounding of a root of the greatest distance there may be."""
        if not hasattr(self, "_most"):
            self._most = 1e-12 * math.sqrt(max(1, self.width)) * float(max(abs(int(self.x.max())), abs(int(self.x.min())))) if self.x.size else 0.0
        return self._most


class _Changes:
    """By how much sums and counts of the entries change."""

    def __init__(self, parts: int, entries: int, width: int):
        self.sums, self.counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object)

    def moved(self, p: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        if old is not None:
            other = old != new
            x, old, new = x[other], old[other], new[other]
            self._add(p, x, old, -1)
        self._add(p, x, new, 1)

    def _add(self, p: int, x: np.ndarray, entry: np.ndarray, sign: int) -> None:
        small = not x.size or max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 62
        own = np.zeros(self.sums.shape[1:], np.int64 if small else object)
        np.add.at(own, entry, x.astype(own.dtype))
        self.sums[p] += sign * own.astype(object)
        self.counts[p] += sign * np.bincount(entry, minlength=len(own)).astype(object)

    def rows(self) -> list[dict]:
        """Changed numbers as (part, entry, at, change); at is -1 for the count."""
        out = []
        for p, e in np.argwhere((self.sums != 0).any(axis=2) | (self.counts != 0)).tolist():
            numbers = [(-1, self.counts[p, e]), *enumerate(self.sums[p, e])]
            out += [{"part": p, "entry": e, "at": at, "change": str(n)} for at, n in numbers if n]
        return out


_STATE = ["kind", "x", "entry", "keys", "rows", "sizes"]
_CHANGE = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("change", pa.string())]))
_SCHEMA = "ids array<long>, labels array<{}>, kind binary, x binary, entry binary, keys binary, rows binary, sizes binary, changes array<struct<part: int, entry: int, at: int, change: string>>"


def _held(ids: pa.Array, labels: pa.Array, raw: list[bytes], changes: list[dict]) -> pa.RecordBatch:
    def lists(values):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays([lists(ids), lists(labels), *(pa.array([b], pa.binary()) for b in raw), pa.array([changes], _CHANGE)], names=["ids", "labels", *_STATE, "changes"])


def _in_blocks(dim: int, parts: int, entries: int):
    """Rows of (vec_id, label, q) to blocks without heaps; components in the least integer type, and zeros up to whole parts."""

    def block(ids, labels, x):
        x = np.pad(x, ((0, 0), (0, -dim % parts)))
        most = max(abs(int(x.max())), abs(int(x.min())) - 1) if x.size else 0
        x = x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
        return _held(ids, labels, _Block(x, parts, entries).to_bytes(), [])

    def blocks(batches):
        ids, labels, xs, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                if n and n + own.num_rows > BLOCK:
                    yield block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(xs))
                    ids, labels, xs, n = [], [], [], 0
                ids.append(own.column(0))
                labels.append(own.column(1))
                xs.append(own.column(2).flatten().to_numpy().reshape(own.num_rows, dim))
                n += own.num_rows
        if n:
            yield block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(xs))

    return blocks


def _read(batches, dim: int, parts: int, entries: int):
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
            if len(ids):
                yield ids, labels, _Block.from_bytes(len(ids), dim, parts, entries, [batch.column(c)[row].as_py() for c in range(2, 8)])


def _round(books: list[np.ndarray], drift: np.ndarray, dim: int):
    """A pass that assigns the parts and writes the blocks again; a task's last row has the changes of sums."""
    parts, entries = len(books), len(books[0])

    def assigned(batches):
        changes, last = _Changes(parts, entries, dim // parts), None
        for ids, labels, block in _read(batches, dim, parts, entries):
            block.assigned(books, drift, changes)
            last = ids.slice(0, 0), labels.slice(0, 0)
            yield _held(ids, labels, block.to_bytes(), [])
        if last:
            yield _held(*last, [b""] * len(_STATE), changes.rows())

    return assigned


def _coded(books: list[np.ndarray], drift: np.ndarray, dim: int):
    """The last pass: a row with code and error for each vector."""
    parts, entries = len(books), len(books[0])

    def coded(batches):
        for ids, labels, block in _read(batches, dim, parts, entries):
            block.assigned(books, drift, None)
            error = sum(_errors(block.part(p), book, block.entry[p]) for p, book in enumerate(books)).tolist()
            text = np.ascontiguousarray(block.entry.T).tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            fitting = [e if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(fitting, pa.int64())], names=["vec_id", "label", "code", "error"])

    return coded


# --- the operator ----------------------------------------------------------
def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that ``quantised`` keeps.

    Codebooks start as the parts of the ``entries`` (256 at most) smallest
    vec_ids; repeated ids count as rows each, the lesser vector first, null ids
    last.  With fewer rows there are fewer entries.  Vectors with another length
    than the first one's are left out; one that doesn't divide by ``parts`` is
    filled up with zeros.  An error beyond 64 bits, or a label's sum of such, is
    null.  An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("between 1 and 256 entries: a code is a byte")
    spark = vectors.sparkSession
    rows = quantised(vectors)
    label = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {label}, code string, error long"
    by_id = F.col("vec_id").asc_nulls_last(), F.col("q")
    first = rows.orderBy(*by_id).limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], schema)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(first[0].q)
    rows = rows.where(F.size("q") == dim)
    start = [r.q for r in rows.orderBy(*by_id).limit(entries).select("q").collect()]
    start = np.array(start, np.int64).reshape(len(start), dim)
    start = np.pad(start, ((0, 0), (0, -dim % parts)))
    books, padded = np.split(start, parts, axis=1), start.shape[1]
    sums, counts = np.zeros((parts, len(start), padded // parts), object), np.zeros((parts, len(start)), object)
    drift = np.zeros((parts, len(start)))
    state = stored(rows.mapInArrow(_in_blocks(dim, parts, len(start)), _SCHEMA.format(label)), "blocks")
    for _ in range(rounds):
        now = stored(state.mapInArrow(_round(books, drift, padded), _SCHEMA.format(label)), "blocks")
        dropped(state)
        state = now
        change = state.select(F.inline("changes")).groupBy("part", "entry", "at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))
        for r in change.toLocalIterator():  # at most a number for each component of each entry
            if r.at < 0:
                counts[r.part, r.entry] += int(r.change)
            else:
                sums[r.part, r.entry, r.at] += int(r.change)
        updated = []
        for p, book in enumerate(books):
            new = book.copy()
            for e in range(len(book)):
                if counts[p, e]:
                    new[e] = [s // counts[p, e] for s in sums[p, e]]
            drift[p] += _moves(book, new)
            updated.append(new)
        books = updated
    coded = stored(state.mapInArrow(_coded(books, drift, padded), schema), "codes")
    dropped(state)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count_if(F.col("error").isNull()).alias("beyond"))
    by_label = by_label.select("of_label", F.when(F.col("beyond") == 0, F.col("label_error")).try_cast("long").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
