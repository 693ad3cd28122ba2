"""Scans and intake normalisation (OP-01..05)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_piece, last_piece
from ..schemas import AUTHORITY_MAP, NA_TOKENS, STATE_MASTER, schema_of


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if the path is not there. Any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def folder_ids(spark: SparkSession, path: str, name: str, finished: bool = True) -> list[int]:
    """Values of the folders ``<path>/<name>=<value>``, ascending; ``finished``: only those a write has completed.

    One listing of names: no file is opened.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    pattern = fs.Path(f"{path}/{name}=*" + ("/_SUCCESS" if finished else ""))
    found = [f.getPath() for f in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []]
    return sorted(int((p.getParent() if finished else p).getName().split("=", 1)[1]) for p in found)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scan_sheet(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv",
               schema: T.StructType | None = None, with_row_order: bool = True,
               line_breaks_in_cells: bool = True) -> DataFrame:
    """OP-01: read exported sheet files (CSV with a header row, or Parquet).

    Many files are read at once. Every cell is read as text unless a schema is
    given. With ``with_row_order`` the source position of each row is kept as
    ``_input_order`` (file path, 0-based data row in the file), so first-wins
    rules can follow the sheet's order.

    A CSV cell may hold line breaks, so a file is one task. Sheets known to
    have none (``line_breaks_in_cells=False``) are split like any text file,
    however large a file is (see :func:`_number_splits`).
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        whole = with_row_order and line_breaks_in_cells
        df = reader.option("header", True).option("multiLine", whole).csv(path)
        if with_row_order:
            df = _number_splits(df)
    elif fmt == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
        if with_row_order:
            df = df.withColumn("_input_order", F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.row_index").alias("pos")))
    else:
        raise ValueError(f"unsupported sheet format: {fmt}")
    return df


def _number_splits(df: DataFrame) -> DataFrame:
    """Add ``_input_order`` to a scan without row numbers, in two passes.

    The first pass counts the rows of every split (file and block start) and
    finds its first id: a task reads its splits one after another, so ids
    follow the rows inside a split. A running sum over a file's splits (a row
    per split) is the position of each split's first row; the second pass adds
    the row's place in its split.
    """
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    numbered = df.select("*", *split, F.monotonically_increasing_id().alias("__id"))
    counted = numbered.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("__file", "__start", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return numbered.join(placed, ["__file", "__start"]).select(*df.columns, F.struct(
        F.col("__file").alias("file"), (F.col("__before") + F.col("__id") - F.col("__first")).alias("pos")).alias("_input_order"))


def scan_tables(spark: SparkSession, root: str, names: Iterable[str] = (
        "applicant", "ministryofhomeaffairs", "ib_authority", "state")) -> dict[str, DataFrame]:
    """OP-02: the registry tables stored as Parquet directories under ``root``.

    Read with their declared schemas (no inference); partition columns such
    as ``status_class`` are discovered from the folder names as usual.
    """
    out = {}
    for n in names:
        df = spark.read.parquet(f"{root.rstrip('/')}/{n}")
        declared = schema_of(n)
        out[n] = df.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields],
                           *[c for c in df.columns if c not in declared.fieldNames()])
    return out


def scan_jdbc(spark: SparkSession, url: str, table: str, props: dict[str, str],
              lower: int, upper: int, partition_column: str = "serial",
              num_partitions: int = 8) -> DataFrame:
    """OP-02 (database variant): parallel JDBC read split on ``partition_column``."""
    return (spark.read.format("jdbc")
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", partition_column)
            .option("lowerBound", str(lower)).option("upperBound", str(upper))
            .option("numPartitions", str(num_partitions))
            .options(**props).load())


def sheet_lines(sheet: DataFrame) -> DataFrame:
    """Replace ``_input_order`` by ``_file`` and ``_row``, the line in the file (the header is line 1).

    A ``_row`` column that the sheet itself carries is kept as it is.
    """
    row = [] if "_row" in sheet.columns else [(F.col("_input_order.pos") + F.lit(2)).alias("_row")]
    return sheet.select(*[c for c in sheet.columns if c != "_input_order"],
                        F.col("_input_order.file").alias("_file"), *row)


def normalize_headers(df: DataFrame) -> DataFrame:
    """OP-03: strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def normalize_na(df: DataFrame, tokens: Iterable[str] = NA_TOKENS,
                 columns: Iterable[str] | None = None) -> DataFrame:
    """OP-04: text cells equal to a missing-value token become NULL."""
    toks = list(tokens)
    cols = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(F.col(c).isin(toks), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c)
        for c in df.columns
    ])


def state_master(spark: SparkSession, rows: Iterable[tuple[str, str]] = STATE_MASTER) -> DataFrame:
    """OP-05: constant state dimension, codes and names upper-cased as loaded."""
    df = spark.createDataFrame(list(rows), "state_code string, state_name string")
    return df.select(F.upper("state_code").alias("state_code"), F.upper("state_name").alias("state_name"))


def authority_map(spark: SparkSession, rows: Iterable[tuple[str, str]] = AUTHORITY_MAP) -> DataFrame:
    """OP-05: constant authority map (intake text -> id)."""
    return spark.createDataFrame(list(rows), "authority_text string, ib_staff_authority_id string")


def authority_master(spark: SparkSession, rows: Iterable[tuple[str, str]] = AUTHORITY_MAP) -> DataFrame:
    """OP-05 + SF-13: authority dimension rows split into name and designation."""
    m = authority_map(spark, rows)
    return m.select(
        "ib_staff_authority_id",
        first_piece("authority_text").alias("ib_staff_authority_name"),
        last_piece("authority_text").alias("ib_staff_authority_designation"),
    )
