"""Helpers the operators share: shared storage, word shingles, components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- shared storage --------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a single machine; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        at = f"file://{tempfile.mkdtemp(prefix='skyframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` made and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for parent in parents:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession):
    """Within it, a query's shuffle files go as it ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_skyframe_llm_cache", {})


def release_memory() -> None:
    """Give memory that the Python worker has freed, and its earlier tasks left, back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


# --- words and shingles ----------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    held = process_cache()
    have = held.get("powers")
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        have[0] = 1
        have = held["powers"] = np.multiply.accumulate(have)
    return have


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and where each text's words start (one bound more than texts).

    A-Z are lower-cased; words are runs without the six ASCII white spaces.
    A null has no words.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=len(raw))
    ends_of_text = np.cumsum(sizes)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    length = ends - starts
    letters = joined[~space].astype(np.uint64)
    first = np.cumsum(length) - length
    within = np.arange(len(letters)) - np.repeat(first, length)
    letters += np.uint64(1)
    letters *= _powers(int(length.max()) + 1)[within]
    hashes = mix(np.add.reduceat(letters, first) + length.astype(np.uint64))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    return hashes, bounds


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; run i starts at word i. Empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += words[j : j + n]
    return mix(out)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; the whole sequence is one shingle where there are fewer words."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(k, len(words))))


def binary_column(blobs: list) -> pa.Array:
    return pa.array(blobs, type=pa.binary())


def text_batches(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Row ranges of a batch whose texts have at most about ``most`` characters together."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


# --- components ------------------------------------------------------------
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of undirected ``links``; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step is a few shuffles of narrow rows, grouped minima are pre-aggregated,
    and no list of a node's neighbours is ever gathered.  Nulls and self
    links are ignored; an empty input gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        dropped(edges)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
