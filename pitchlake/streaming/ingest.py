"""Streams of pages and stints: each page once, upserts by batch, interval maps in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from pitchlake.operators.graph import merge_last
from pitchlake.operators.interval_map import IntervalMap


def distinct_pages(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each page once: repeated keys are dropped within the watermark, which bounds the state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, path: str, key: list[str], version: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Writer that merges each batch into the table at ``path``: the last version of a key wins.

    Keys lie in hash buckets; a batch rewrites only the buckets that its keys touch, each as ``bucket=B/v=N`` with N the
    batch's number, and then removes the bucket's older versions but the last, which a batch that runs again after a failure
    still needs. ``current`` reads the newest version of every bucket.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        touched = [r["_bucket"] for r in placed.select("_bucket").distinct().collect()]  # at most ``buckets``
        for b in touched:
            before = [v for v in _versions(spark, path, b) if v < number]
            old = spark.read.schema(batch.schema).parquet(f"{path}/bucket={b}/v={before[-1]}") if before else batch.limit(0)
            fresh = placed.filter(F.col("_bucket") == b).drop("_bucket")
            merge_last(old, fresh, key, version).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/bucket={b}/v={number}")
            for v in before[:-1]:
                _path(spark, f"{path}/bucket={b}/v={v}")[1].delete(_path(spark, f"{path}/bucket={b}/v={v}")[0], True)
        placed.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, bucket: int) -> list[int]:
    """Complete versions of a bucket, ascending."""
    where, fs = _path(spark, f"{path}/bucket={bucket}")
    if not fs.exists(where):
        return []
    found = [f.getPath() for f in fs.listStatus(where)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(_path(spark, f"{p.toString()}/_SUCCESS")[0]))


def current(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> DataFrame:
    """The table that ``upsert_batches`` keeps: the newest version of each bucket."""
    newest = [f"{path}/bucket={b}/v={v[-1]}" for b in range(buckets) if (v := _versions(spark, path, b))]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def interval_stream(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, kind, start, end, version): after each batch the periods and gaps of the keys whose map changed.

    The ordered disjoint intervals of a key are its state; an insertion finds overlaps by binary search. Rows with nulls
    or reversed bounds are left out. ``version`` counts the changes of a key: the rows of its highest version hold.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        starts, ends, version = state.get if state.exists else ([], [], 0)
        held, changed = IntervalMap(list(starts), list(ends)), False
        for pdf in batches:
            for s, e in zip(pdf["start"], pdf["end"]):
                changed |= held.insert(int(s), int(e)) is not None
        if changed:
            state.update((held.starts, held.ends, version + 1))
            yield pd.DataFrame([(k[0], *r, version + 1) for r in held.rows()], columns=["key", "kind", "start", "end", "version"])

    rows = stream.selectExpr(f"cast({key} AS bigint) AS key", f"cast({start} AS bigint) AS start", f"cast({end} AS bigint) AS end")
    rows = rows.filter("key IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start <= end")
    return rows.groupBy("key").applyInPandasWithState(
        update, "key bigint, kind string, start bigint, end bigint, version bigint", "starts array<bigint>, ends array<bigint>, version bigint", "update", "NoTimeout"
    )
