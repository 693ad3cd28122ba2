"""Sinks: CSV bridge, per-record documents, batch documents, registry tables (OP-06..09).

All writes go to the shared folders the caller names (on a cluster: under
``spark.checkpoint.dir`` or a table location), never to a machine-local temp.
Each write is idempotent for its ``run_id`` / ``batch_id``: a replay
overwrites the same partition instead of adding to it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUN_ID_FORMAT


def run_name(run_ts: dt.datetime, fmt: str = RUN_ID_FORMAT) -> str:
    """OP-09: run id text, ``ddMMyyyy_HHmmss`` by default (a parameter, not the clock)."""
    py = fmt.replace("dd", "%d").replace("MM", "%m").replace("yyyy", "%Y") \
            .replace("HH", "%H").replace("mm", "%M").replace("ss", "%S")
    return run_ts.strftime(py)


def run_id_column(run_ts: dt.datetime, fmt: str = RUN_ID_FORMAT) -> Column:
    """OP-09 as a column: ``date_format(run timestamp, fmt)``.

    The timestamp is a zone-free ``timestamp_ntz``, so the id does not depend
    on the session time zone.
    """
    ts = F.lit(run_ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return F.date_format(ts, fmt)


def bridge_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """OP-06: selected rows as CSV with a header row (UTF-8), helper columns dropped."""
    out = df.drop(*drop) if drop else df
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def per_record_sink(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """OP-07: one document per record, stored as rows ``(doc_name, doc_text)``.

    Documents go into Parquet files partitioned by a hash bucket of the name:
    never one file per row. ``buckets`` defaults to the session's shuffle
    partition count, so the number of writer tasks grows with the cluster.
    Callers dedupe names first (last wins, ``render.per_record_documents``).
    """
    n = int(buckets or docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (docs.withColumn("bucket", F.pmod(F.xxhash64("doc_name"), F.lit(n)))
         .repartition(n, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))


def batch_doc_sink(batches: DataFrame, path: str, run_id: str) -> dict:
    """OP-08: one row per batch under ``run_id=...``; batch order = ``batch_id``.

    Dynamic partition overwrite replaces only this run's partition, so a rerun
    of the same run id is idempotent. Returns the number of batches and
    documents, observed while writing (OP-30 without an extra pass).
    """
    obs = Observation(f"batches_{run_id}")
    (batches.observe(obs, F.count(F.lit(1)).alias("batches"),
                     F.coalesce(F.sum("n_docs"), F.lit(0)).cast("bigint").alias("documents"))
            .withColumn("run_id", F.lit(run_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id").parquet(path))
    return obs.get


def read_batches(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id).orderBy("batch_id")


def write_registry_table(df: DataFrame, path: str, status: str = "status", mode: str = "overwrite") -> None:
    """Store a registry fact table partitioned by ``status_class`` (PRINTED / ACTIVE).

    The run's selection then reads only the ACTIVE folders (partition
    pruning), however large the printed history grows.
    """
    from ..operators.select import status_class
    from ..schemas import STATUS_CLASS
    (df.drop(STATUS_CLASS) if STATUS_CLASS in df.columns else df) \
        .withColumn(STATUS_CLASS, status_class(status)) \
        .write.mode(mode).partitionBy(STATUS_CLASS).parquet(path)
