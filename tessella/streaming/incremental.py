"""Incremental tiles: each micro-batch of features is rendered and merged into a Parquet tile store.

Not something a batch tile builder has of itself; it is the batch merge, driven by Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import render
from tessella.plans.build import encoded
from tessella.sources.config import Config


def upsert(features: DataFrame, store: str, config: Config, version: int) -> str:
    """Merge a batch's tiles into the newest version of the store; gives the path of the new one.

    A version is written whole before `latest` names it, so a repeated batch only writes again what it wrote before.
    """
    spark = features.sparkSession
    path, new = f"{store}/v{version}", encoded(features, config)
    old = current(spark, store, before=version)
    made = new if old is None else render.merge(old, new)
    made.write.mode("overwrite").parquet(path)
    return path


def versions(spark, store: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def current(spark, store: str, before: int | None = None) -> DataFrame | None:
    found = [v for v in versions(spark, store) if before is None or v < before]
    return spark.read.parquet(f"{store}/v{found[-1]}") if found else None


def start(features: DataFrame, store: str, config: Config, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of features (render.FEATURE columns) into the store."""
    writer = features.writeStream.foreachBatch(lambda df, n: upsert(df, store, config, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
