"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are range-partitioned by id, or by a given order, and sorted, encoded
within their partition and written at once; a file holds one range, its stripes can be read
in parallel, and a look-up by id is pruned by footer, row index and Bloom
filter.  Each row keeps the number of its range, so the offset of a document in
the whole stream is the sum of the ranges before it and of the rows before it
in its range: the list of ranges is the only thing that is ordered as a whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_path, release_memory
from .tokens import default_tokenizer, encoder, text_slices, tokenizer_json

END = 0
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id long, chunk int, row long, n int, ids array<int>"


def _encoded(json):
    def encoded(batches):
        release_memory()  # of the worker's earlier tasks
        own = encoder(json.value)
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                ids = own.encode(texts, END)
                kept = [batch.column(c).slice(start, len(texts)) for c in ("doc_id", "chunk", "row")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ids.offsets.to_numpy())), ids], names=["doc_id", "chunk", "row", "n", "ids"])
                del ids, kept
                release_memory()

    return encoded


def _sums(batches):
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "chunk", "row")] + [pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "chunk", "row", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, ranges: int | None = None, order: tuple = ()) -> str:
    """Write the ids of every whole text, each document's followed by ``END``, in ascending order; returns ``path``.

    ``order``: columns to go by before doc_id; by doc_id alone if not given.
    A null text is empty.  Rows equal in these are ordered by their text; nulls
    come first.  ``ranges``: number of files; the session's number of shuffle
    partitions if not given.
    """
    spark = docs.sparkSession
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer or default_tokenizer()))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = {f"place_{i}": c for i, c in enumerate(order)}
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), *[c.alias(p) for p, c in places.items()])
    rows = rows.repartitionByRange(n, *places, "doc_id", "tie").sortWithinPartitions(*places, "doc_id", "tie", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("row"))
    ids = rows.mapInArrow(_encoded(json), SCHEMA)
    writer = ids.write.option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", 10000)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, chunk, row, n, ids) of files that ``write_tokens`` made."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files: where each document's ids are in the whole stream, and their checksum."""
    rows = read_tokens(spark, path).drop("n").mapInArrow(_sums, "doc_id long, chunk int, row long, n_tokens long, ids_crc32 long")
    chunks = read_tokens(spark, path).groupBy("chunk").agg(F.sum(F.col("n").cast("long")).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("chunk", F.coalesce(ahead, F.lit(0)).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(before, F.lit(0)))
    return rows.join(chunks, "chunk").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_written(docs: DataFrame, tokenizer: str | None = None, order: tuple = ()) -> DataFrame:
    """Write the ids to the shared folder, by ``order`` and doc_id, and return ``token_index`` of what was written."""
    path = write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, order=order)
    return token_index(docs.sparkSession, path)
