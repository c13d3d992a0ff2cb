"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a dozen shares and means (``FEATURES``).  The model is a
look-up table per feature and one per chosen pair of features: boosting visits
the features in turn, each round fitting one shallow tree (a few cuts of the
feature's bins) to the residual, and adds its leaves to that feature's table.
Pairs are ranked by how much of the residual a tree of four leaves over their
bins explains, and boosted by such trees on a coarser grid.  A score is the sum of table entries
at a text's bins, so scoring is a few vectorised additions in the same pass
that reads the text.

Training collects at most ``SAMPLE`` labelled rows' features (the smallest
crc32 of the id first), never texts, to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_batches, word_hashes

#: Bound on labelled rows that training collects (features only, under 10 MB).
SAMPLE = 40_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIRS, PAIR_ROUNDS, CUTS, RATE = 120, 8, 40, 3, 0.15
THRESHOLD = 0.3

FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "exclaim", "bars", "periods", "commas", "distinct_words", "top_word", "repeated_next", "distinct_lines", "line_words", "capitalised", "distinct_pairs", "longest_word")

_CLASS = np.zeros((256, 7), dtype=np.float32)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~+=<>{}[]\\_/", "!?", "|", ".", ",;:")):
    _CLASS[[ord(c) for c in _chars], _i] = 1


def features(texts: list) -> np.ndarray:
    """(texts, features): what the model sees of each text; zeros for null, empty and white-space texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    words, bounds = word_hashes(texts)
    for i, t in enumerate(texts):
        own = words[bounds[i] : bounds[i + 1]]
        n = len(own)
        if not n:
            continue
        raw = t.encode("utf-8", "surrogatepass")
        size = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, digits, symbols, exclaim, bars, periods, commas = (counts @ _CLASS).tolist()
        distinct, times = np.unique(own, return_counts=True)
        pairs = own[1:] * np.uint64(3) + own[:-1]
        lines = [x for x in raw.split(b"\n") if x]
        starts = t.split()
        capitalised = sum(map(str.istitle, starts)) / len(starts) if starts else 0
        out[i] = (
            np.log1p(n),
            size / n,
            upper / size,
            digits / size,
            symbols / n,
            exclaim / n,
            bars / n,
            periods / n,
            commas / n,
            len(distinct) / n,
            times.max() / n,
            (own[1:] == own[:-1]).mean() if n > 1 else 0,
            len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)),
            capitalised,
            len(np.unique(pairs)) / max(1, n - 1),
            max(map(len, starts)) if starts else 0,
        )
    return out


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


class Additive:
    """Tables by feature and by pair of features; scores are probabilities of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
        self.pair_cuts = [c[:: max(1, len(c) // (PAIR_BINS - 1) or 1)][: PAIR_BINS - 1] for c in self.cuts]
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(BINS) for _ in range(k)]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not n:
            return
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        margin = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(k):
                step = self._leaves(bins[j], margin, y, BINS)
                self.tables[j] += step
                margin += step[bins[j]]
        coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        pairs = {(a, b): coarse[a] * PAIR_BINS + coarse[b] for a in range(k) for b in range(a)}
        gains = [(self._quarters(cell, margin, y)[0], a, b) for (a, b), cell in pairs.items()]
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros(PAIR_BINS**2) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for table, pair in zip(self.pair_tables, self.pairs, strict=True):
                step = self._quarters(pairs[pair], margin, y)[1]
                table += step
                margin += step[pairs[pair]]

    @staticmethod
    def _quarters(cell, margin, y):
        """Gain and step of a tree of four leaves over a pair's grid: a cut of one feature, then of the other on each side."""
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p)))
        best, found = 0.0, np.zeros((PAIR_BINS, PAIR_BINS))
        for turned in (False, True):
            gs, hs = (g.T, h.T) if turned else (g, h)
            for i in range(1, PAIR_BINS):
                gain, step = 0.0, np.empty((PAIR_BINS, PAIR_BINS))
                for side in (slice(i), slice(i, None)):
                    low_g, low_h = np.cumsum(gs[side].sum(axis=0)), np.cumsum(hs[side].sum(axis=0))
                    low, high = low_g[:-1] / (low_h[:-1] + 2.0), (low_g[-1] - low_g[:-1]) / (low_h[-1] - low_h[:-1] + 2.0)
                    worth = low * low_g[:-1] + high * (low_g[-1] - low_g[:-1])
                    j = int(worth.argmax())
                    gain += float(worth[j])
                    step[side, : j + 1], step[side, j + 1 :] = low[j], high[j]
                if gain > best:
                    best, found = gain, step.T if turned else step
        return best, RATE * found.ravel()

    @staticmethod
    def _leaves(bins, margin, y, size):
        """A tree of up to CUTS cuts over a feature's bins: each next cut is where it lowers the loss most."""
        p = 1 / (1 + np.exp(-margin))
        g, h = np.cumsum(np.bincount(bins, y - p, size)), np.cumsum(np.bincount(bins, p * (1 - p), size))
        worth = lambda a, b: (b[0] - a[0]) ** 2 / (b[1] - a[1] + 2.0)
        edges = [0, size]
        at = lambda e: (g[e - 1], h[e - 1]) if e else (0.0, 0.0)
        for _ in range(CUTS):
            best = (1e-9, None)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high - low < 2:
                    continue
                e = np.arange(low + 1, high)
                mid = (g[e - 1], h[e - 1])
                gain = worth(at(low), mid) + worth(mid, at(high)) - worth(at(low), at(high))
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(e[i])), key=lambda z: z[0])
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        step = np.zeros(size)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            (ga, ha), (gb, hb) = at(low), at(high)
            step[low:high] = RATE * (gb - ga) / (hb - ha + 2.0)
        return step

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            margin += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            margin += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right") * PAIR_BINS + np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-margin))


def _features_of(batches):
    for batch in batches:
        for start, texts in text_batches(batch, "text"):
            found = features(texts)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, len(texts)) for c in ("doc_id", "quality")] + [flat], names=["doc_id", "quality", "x"])


def _scored(model):
    def scored(batches):
        for batch in batches:
            for start, texts in text_batches(batch, "text"):
                ids = batch.column("doc_id").slice(start, len(texts))
                score = model.value.score(features(texts))
                out = [ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted"])

    return scored


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit the model to documents with a label ``quality`` of 0 or 1 that aren't held out; other rows and null ids are ignored.

    An id with several labels counts as 1 if any of them is.  Without a label, every score is one half.
    """
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    chosen = own.where(crc % 5 != 0).orderBy(crc, "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of 12 bytes
    found = rows.mapInArrow(_features_of, "doc_id long, quality int, x array<double>").dropDuplicates(["doc_id"]).limit(sample).toPandas()
    found = found.sort_values("doc_id") if len(found) else pd.DataFrame({"x": [], "quality": []})
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return Additive(x, found["quality"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; the score reads nothing but the text.

    predicted is 1 where score >= 0.3.  Null and empty texts are scored as
    texts without words.  An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def _accepted(model):
    def accepted(batches):
        for batch in batches:
            for start, texts in text_batches(batch, "text"):
                keep = model.value.score(features(texts)) >= THRESHOLD
                yield batch.slice(start, len(texts)).filter(pa.array(keep))

    return accepted


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose predicted quality is 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_accepted(model), docs.schema)
