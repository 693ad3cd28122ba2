"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.joins import may_hold
from recordloom.session import scratch_path, scratch_root

# White space of the contracts: blank and the five ASCII controls 0x09-0x0D.
WORD_RE = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` as Parquet and read it back.

    Cuts the lineage on storage every executor sees, so a lost executor costs
    no recomputation, and gives the optimizer the table's true size: Spark
    broadcasts it later only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more (their readers are written themselves)."""
    for table in tables:
        spark = table.sparkSession
        root = scratch_root(spark)
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if root.split(":", 1)[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(df: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``decisions`` (a written table, one row per ``keys``, hashes all) to ``df``.

    Rows of ``df`` whose key can't be among the decisions stay where they are;
    only the others are shuffled. ``df`` is read twice for that.
    """
    tested = may_hold(df, decisions, keys[0])
    extra = [f for f in decisions.schema if f.name not in keys]
    plain = tested.where("NOT may_hold").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]).drop("may_hold")
    met = tested.where("may_hold").drop("may_hold").join(decisions, keys, "left").select(*plain.columns)
    return plain.unionByName(met)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in pieces of ``rows`` rows: texts are long, and what is made of a piece is held at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger: texts are long, and a worker holds a batch or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def text_of(col: str) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def content_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes ``key_a``, ``key_b`` that stand for the columns' values."""
    flags = [c.isNull() for c in cols]
    return [
        F.xxhash64(*cols, *flags).alias("key_a"),
        F.xxhash64(F.lit("second hash"), *flags, *cols).alias("key_b"),
    ]


def words(text: Column) -> Column:
    """Whole-text words: maximal runs outside the contracts' white space."""
    return F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))


def chained(left: str, right: str, n: str) -> str:
    """SQL: hashes of the pairs of the first ``n`` entries of two arrays."""
    return f"zip_with(slice({left}, 1, {n}), {right}, (a, b) -> xxhash64(a, b))"


def window5_hashes(df: DataFrame, hashes: str, out: str, only_repeats: bool = False) -> DataFrame:
    """Add ``out``: hashes of all five consecutive entries of the array column ``hashes``.

    Built from pairs of pairs, three cheap passes over the array: 2 = 1 + 1,
    4 = 2 + 2, 5 = 4 + 1. Arrays under five entries give an empty array. With
    ``only_repeats``, an array in which no four entries come twice (so no five
    do) gives an empty one and skips the last pass.
    """
    n = f"size({hashes})"
    empty = "cast(array() AS array<bigint>)"
    two = df.withColumn(out, F.expr(
        f"CASE WHEN {n} >= 5 THEN {chained(hashes, f'slice({hashes}, 2, {n} - 1)', f'{n} - 1')} ELSE {empty} END"))
    four = two.withColumn(out, F.expr(
        f"CASE WHEN {n} >= 5 THEN {chained(out, f'slice({out}, 3, {n} - 3)', f'{n} - 3')} ELSE {empty} END"))
    wanted = f"{n} >= 5" + (f" AND size(array_distinct({out})) < size({out})" if only_repeats else "")
    return four.withColumn(out, F.expr(
        f"CASE WHEN {wanted} THEN {chained(out, f'slice({hashes}, 5, {n} - 4)', f'{n} - 4')} ELSE {empty} END"))
