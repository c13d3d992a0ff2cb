"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles (sizes doubling from
``BASE``); an item of fewer is a candidate wherever one of its shingles is.
For a partition of items of at most m shingles, a document is cut
into blocks of m shingles, and two neighbouring blocks are one window: a
passage of m shingles lies whole within one, however long the document is, so
the similarity of item and window stays above ``containment / 4``.  Minima of
``HASHES`` hash functions are taken once for the smallest blocks; those of
larger blocks are minima of minima.  A window and an item that agree in a
minimum are a candidate, verified by exact containment of the item's shingle
set in the whole document's.

All of it happens in one pass over the documents, without a shuffle.  Items'
minima and sets go to the executors in parts of at most ``PART`` shingles
(a proven bound); a larger benchmark takes further passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gram_hashes, mix, new_path, shingle_set, stored, text_batches, word_hashes

BASE = 16
HASHES = 48
PART = 1_000_000
#: A table of 2 ** FILTER_BITS flags keeps most values that no item has from the search.
FILTER_BITS = 22
_LOW = np.uint64((1 << FILTER_BITS) - 1)

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _minima(grams: np.ndarray, size: int) -> np.ndarray:
    """The least value of each hash function over each block of ``size`` shingles: (functions, blocks)."""
    at = np.arange(0, len(grams), size)
    out = np.empty((HASHES, len(at)), np.uint64)
    step = max(1, 2048 // size) * size
    for s in range(0, len(grams), step):
        own = grams[s : s + step]
        cut = np.arange(0, len(own), size)
        out[:, s // size : s // size + len(cut)] = np.minimum.reduceat(np.multiply.outer(_MULTIPLIERS, own), cut, axis=1)
    return out


def _level(n: int) -> int:
    """The partition of an item of n shingles: the least with n <= BASE * 2 ** level."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / BASE))))


class _Items:
    """A part of the benchmark: by level, the sorted minima of its items; the sorted shingles of small items; and the items' sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        by: dict[int, list[int]] = {}
        for i, own in enumerate(sets):
            if len(own) >= BASE:
                by.setdefault(_level(len(own)), []).append(i)
        small = [i for i, own in enumerate(sets) if len(own) < BASE]
        flat = np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in small)])
        order = np.argsort(flat, kind="stable")
        maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        maybe[flat & _LOW] = True
        self.small = maybe, flat[order], np.repeat(np.array(small, np.int64), [len(sets[i]) for i in small])[order]
        self.levels = {}
        for level, items in by.items():
            values = np.stack([np.multiply.outer(_MULTIPLIERS, sets[i]).min(axis=1) for i in items], axis=1)
            flat = values.reshape(-1)
            order = np.argsort(flat, kind="stable")
            maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
            maybe[flat & _LOW] = True
            self.levels[level] = maybe, flat[order], np.tile(np.array(items), HASHES)[order], np.repeat(np.arange(HASHES), len(items))[order]

    def near(self, grams: np.ndarray) -> set[int]:
        """Small items that share a shingle with the document, others that agree with a window of it in a minimum."""
        maybe, values, items = self.small
        wanted = np.unique(grams[maybe[grams & _LOW]])
        low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
        found = {k for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True) for k in items[a:b].tolist()}
        if not self.levels:
            return found
        blocks, level = _minima(grams, BASE), 0
        for at in sorted(self.levels):
            while level < at:
                blocks = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], 2), axis=1)
                level += 1
            windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            maybe, values, items, functions = self.levels[at]
            h, w = np.nonzero(maybe[windows & _LOW])
            if not len(h):
                continue
            wanted = windows[h, w]
            low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            for a, b, k in {*zip(low[low < high].tolist(), high[low < high].tolist(), h[low < high].tolist(), strict=True)}:
                found.update(items[a:b][functions[a:b] == k].tolist())
        return found


def _found(own: _Items, texts: list, percent: int):
    """(text, item, common) of the items that texts hold."""
    words, bounds = word_hashes(texts)
    for i in range(len(texts)):
        w = words[bounds[i] : bounds[i + 1]]
        if not len(w):
            continue
        grams = gram_hashes(w, min(5, len(w)))
        near = own.near(grams)
        if not near:
            continue
        document = np.unique(grams)
        for k in sorted(near):
            at = np.searchsorted(document, own.sets[k])
            common = int((document[np.minimum(at, len(document) - 1)] == own.sets[k]).sum())
            if 100 * common >= percent * len(own.sets[k]):
                yield i, k, common


def _contained(items, percent: int):
    def contained(batches):
        own = items.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in text_batches(batch, "text"):
                rows = [(ids[start + i], own.ids[k], common, len(own.sets[k])) for i, k, common in _found(own, texts, percent)]
                if rows:
                    a, b, c, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c, n)], names=["doc_id", "item_id", "common", "item_shingles"])

    return contained


def _clean(items, percent: int):
    def clean(batches):
        own = items.value
        for batch in batches:
            for start, texts in text_batches(batch, "text"):
                keep = np.ones(len(texts), bool)
                keep[[i for i, _, _ in _found(own, texts, percent)]] = False
                yield batch.slice(start, len(texts)).filter(pa.array(keep))

    return clean


def _parts(benchmark: DataFrame):
    """The items as lists (ids, sets) of at most PART shingles, streamed to the driver one partition at a time."""
    ids, sets, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words, _ = word_hashes([row.text])
        own = shingle_set(words)
        if len(own):
            ids.append(row.item_id)
            sets.append(own)
            size += len(own)
        if size >= PART:
            yield ids, sets
            ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


SCHEMA = "doc_id long, item_id long, common long, item_shingles long"


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, common, item_shingles): items of which at least ``percent`` % of the distinct five-word shingles are in a document.

    Words are lower-cased A-Z runs without ASCII white space; a text of fewer
    than five words is one shingle, an empty or null one has none and matches
    nothing.  Repeated rows give repeated matches; a null doc_id is kept as
    null.  Empty tables give no rows.
    """
    spark, path = docs.sparkSession, None
    for part in _parts(benchmark):  # one at a time is held
        path = path or new_path(docs.sparkSession, "contaminated")
        items = spark.sparkContext.broadcast(_Items(*part))
        docs.select("doc_id", "text").mapInArrow(_contained(items, percent), SCHEMA).write.mode("append").parquet(path)
        items.destroy()
    return spark.read.schema(SCHEMA).parquet(path) if path else spark.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their id: a pass over the texts for each part of the benchmark, without a shuffle."""
    context = docs.sparkSession.sparkContext
    items = None
    for part in _parts(benchmark):
        if items:  # the part before is written and let go
            docs = stored(docs, "clean")
            items.destroy()
        items = context.broadcast(_Items(*part))
        docs = docs.mapInArrow(_clean(items, percent), docs.schema)
    return docs
