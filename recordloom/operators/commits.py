"""All-or-nothing loads and runs (OP-74, OP-50): one commit row per id, written last.

A load writes four tables and a run writes documents, quarantine, ledger, log
and reports; no single write says that all of them are complete. So a log
folder beside them gets a ``begin`` row for the id before the first write and
a ``commit`` row after the last one, each one small file. Every reader keeps
the rows of ids whose latest entry is ``commit``: a filter, not a table
format. A crash between any two writes leaves the state as it was before the
id began. Rerunning an id withdraws it first and brings it back whole.

A folder that nothing of ours was ever begun in has no log; its rows all count.
The first ``begin`` there enters the ids it finds as committed.

A commit row can carry the largest serial of its load, so the next identity
serial (OP-41) needs no scan of the fact table.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_if_exists

LOG = "_commits"
SCHEMA = "id string, seq long, state string, max_serial long"


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    return read_if_exists(spark, f"{root}/{LOG}")


def _append(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")


def _latest(log: DataFrame) -> DataFrame:
    """id, state and max_serial of each id's latest entry (a row per load or run)."""
    entry = F.max(F.struct("seq", "state", "max_serial")).alias("e")
    return log.groupBy("id").agg(entry).select("id", "e.state", "e.max_serial")


def begin(spark: SparkSession, root: str, ident: str, present: DataFrame | None = None) -> None:
    """Open ``ident``: from now on its rows under ``root`` don't count.

    ``present`` (one column ``id``) lists the ids found under ``root``; they
    are entered as committed if there is no log yet.
    """
    now = time.time_ns()
    rows = [(ident, now, "begin", None)]
    if _log(spark, root) is None and present is not None:
        rows += [(r["id"], now, "commit", None) for r in present.select("id").distinct().collect()
                 if r["id"] is not None and r["id"] != ident]
    _append(spark, root, rows)


def commit(spark: SparkSession, root: str, ident: str, max_serial: int | None = None) -> None:
    """Close ``ident``: all its rows count from now on. Call it after its last write."""
    _append(spark, root, [(ident, time.time_ns(), "commit", max_serial)])


def committed(df: DataFrame, root: str, col: str) -> DataFrame:
    """The rows of ``df`` whose id (``col``) is committed under ``root``."""
    log = _log(df.sparkSession, root)
    if log is None or col not in df.columns:
        return df
    # A row per load or run; a semi join, so the number of ids has no bound to keep to.
    # Ids are compared as text: a folder value such as 20260115 is read as a number.
    done = _latest(log).filter("state = 'commit'").select(F.col("id").alias("__id"))
    return df.join(done, F.col(col).cast("string") == F.col("__id"), "left_semi")


def largest_serial(fact: DataFrame, root: str, col: str = "load_id", serial: str = "serial",
                   exclude: str | None = None) -> int:
    """Largest serial among the committed rows of ``fact``, but for those of the load ``exclude`` (which runs again).

    It is the largest of the commit rows' summaries; only loads whose row has
    none (entered from an older folder, or lost) are scanned for it.
    """
    log = _log(fact.sparkSession, root)
    if log is None or col not in fact.columns:
        return int(fact.agg(F.max(serial).alias("m")).first()["m"] or 0)
    done = _latest(log).filter("state = 'commit'")
    if exclude is not None:
        done = done.filter(F.col("id") != F.lit(exclude))
    known = done.agg(F.max("max_serial").alias("m"), F.count_if(F.col("max_serial").isNull()).alias("missing")).first()
    found = known["m"] or 0
    if known["missing"]:
        unknown = [r["id"] for r in done.filter("max_serial IS NULL").select("id").collect()]
        found = max(found, fact.filter(F.col(col).cast("string").isin(unknown)).agg(F.max(serial).alias("m")).first()["m"] or 0)
    return int(found)
