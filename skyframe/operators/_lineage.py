"""Cutting lineage in the folder all nodes see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset, in a temporary folder on a single machine; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        at = f"file://{tempfile.mkdtemp(prefix='skyframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(frame: DataFrame) -> DataFrame:
    """The frame written once to a shared path and read back."""
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, "settled")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more."""
    for frame in frames:
        jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
