"""Stand-in registry tables built from the driver's TPC-H-style tables.

These builders only shape rows into the schemas the jobs expect (see
FIXTURES.md §2); they do none of the jobs' work. Untidy values (NULLs,
orphans, padded statuses, missing cells, duplicate keys) are placed by
arithmetic on the source keys so both Spark and the DuckDB oracle derive
exactly the same rows. Fact, parent and intake tables scale with their
source tables, the authorities with supplier and the states with nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import AUTHORITY_MAP, STATE_MASTER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def applicant(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Fact table ``applicant`` from orders x customer (one row per order).

    ``orders`` may be a micro-batch of the orders table (streaming pick-up).
    """
    o = orders if orders is not None else table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    reg = F.col("o_orderdate").cast("date")
    st = F.col("o_orderstatus")
    status = (
        F.when((st == "F") & (k % 5 == 0), F.lit(" printed "))
        .when(st == "F", F.lit("PRINTED"))
        .when((st == "P") & (k % 4 == 0), F.lit(None).cast("string"))
        .when(st == "P", F.lit("in process"))
        .otherwise(F.lit("IN PROCESS"))
    )
    return j.select(
        F.concat(F.lit("FN-"), _s(k)).alias("file_number"),
        (k + 1).alias("serial"),
        F.col("c_name").alias("name"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("sex"),
        F.date_sub(reg, 10).alias("birth_date"),
        F.col("c_mktsegment").alias("place"),
        F.concat(F.lit("N"), _s(F.col("c_nationkey"))).alias("state_code"),
        F.lower("o_orderpriority").alias("name_of_father"),
        F.concat(F.lit("m "), F.lower("c_mktsegment")).alias("name_of_mother"),
        F.concat(F.lit("unit "), _s(F.col("o_custkey"))).alias("address_line_1"),
        F.when(k % 10 == 3, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("address_line_2"),
        F.col("c_mktsegment").alias("address_line_3"),
        reg.alias("registration_date"),
        status.alias("status"),
        F.when(st == "F", F.date_add(reg, 30)).alias("date_issued"),
        F.when(k % 50 == 0, F.lit(None).cast("string"))
        .when(k % 51 == 0, F.lit("MHA-missing"))
        .otherwise(F.concat(F.lit("MHA-"), _s(F.col("o_custkey")))).alias("mha_file_number"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 6 == 5, F.lit("IB-missing"))
        .otherwise(F.concat(F.lit("IB-"), _s(F.expr("o_custkey div 15")))).alias("ib_staff_authority_id"),
    )


def ministry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent table ``ministryofhomeaffairs`` from customer (one file per customer)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("MHA-"), _s(F.col("c_custkey"))).alias("mha_file_number"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("mha_date"),
    )


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension ``ib_authority`` from supplier (one authority per supplier)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("IB-"), _s(F.col("s_suppkey"))).alias("ib_staff_authority_id"),
        F.col("s_name").alias("ib_staff_authority_name"),
        F.concat(F.lit("Desk "), _s(F.col("s_nationkey"))).alias("ib_staff_authority_designation"),
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension ``state`` from nation."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("N"), _s(F.col("n_nationkey"))).alias("state_code"),
        F.col("n_name").alias("state_name"),
    )


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "applicant": applicant(spark, sf_dir),
        "ministryofhomeaffairs": ministry(spark, sf_dir),
        "ib_authority": authority(spark, sf_dir),
        "state": state(spark, sf_dir),
    }


# Order of the intake rows: the loader's "first row wins" follows it.
INTAKE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def intake(spark: SparkSession, sf_dir: str, padded_headers: bool = False,
           na_tokens: bool = False) -> DataFrame:
    """Flat intake sheet from lineitem (duplicate keys included).

    The sheet's row order is carried as the ``_input_order`` struct, so the
    first-wins rules have a total order without a global numbering pass.
    ``padded_headers`` adds blanks around header names; ``na_tokens`` writes
    missing cells as the text a spreadsheet export would hold.
    """
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    pk = F.col("l_partkey")
    sk = F.col("l_suppkey")
    ship = F.col("l_shipdate").cast("date")
    codes = F.array(*[F.lit(c) for c, _ in STATE_MASTER])
    auths = F.array(*[F.lit(t) for t, _ in AUTHORITY_MAP], F.lit("UNKNOWN PERSON, CLERK"))
    missing = F.lit("N/A") if na_tokens else F.lit(None).cast("string")
    cols = [
        F.concat(F.lit("FN-"), _s(ok * 10 + F.col("l_linenumber"))).alias("File_Number"),
        F.concat(F.lit("Person "), _s(pk)).alias("Name"),
        # A few rows break the table rules (sex U, unknown state XX), so a load
        # has violations to report.
        F.when(pk % 89 == 0, F.lit("U")).when(pk % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("Sex"),
        F.date_sub(ship, 20).alias("Birth_Date"),
        F.concat(F.lit("Town "), _s(sk % 50)).alias("Place"),
        F.when(sk % 97 == 0, F.lit("XX"))
        .otherwise(F.element_at(codes, (sk % len(STATE_MASTER) + 1).cast("int"))).alias("State"),
        F.concat(F.lit("F "), _s(pk)).alias("Name_Of_Father"),
        F.concat(F.lit("M "), _s(sk)).alias("Name_Of_Mother"),
        F.concat(F.lit("unit "), _s(F.col("l_linenumber"))).alias("Address_line_1"),
        F.when(ok % 10 == 3, missing).otherwise(F.col("l_linestatus")).alias("Address_line_2"),
        F.concat(F.lit("street "), _s(sk)).alias("Address_line_3"),
        ship.alias("Registration_Date"),
        # A third of the parent keys are new to the registry (prefix MHA-N).
        F.when(ok % 3 == 0, F.concat(F.lit("MHA-N"), _s(ok)))
        .otherwise(F.concat(F.lit("MHA-"), _s(F.expr("l_orderkey div 10")))).alias("MHA_FILE_NUMBER"),
        F.date_add(F.lit("1995-01-01").cast("date"), (pk % 3).cast("int")).alias("MHA_DATE"),
        F.element_at(auths, (pk % (len(AUTHORITY_MAP) + 1) + 1).cast("int")).alias("Signing_Authority"),
        F.struct(*[F.col(c) for c in INTAKE_ORDER]).alias("_input_order"),
    ]
    df = li.select(*cols)
    if padded_headers:
        df = df.toDF(*[f"  {c} " if not c.startswith("_") else c for c in df.columns])
    return df


def processing_sheet(spark: SparkSession, sf_dir: str, year: int, dirty: bool = True) -> DataFrame:
    """Processing sheet (sheet mode) from orders x customer.

    Text serials ``n/year``, dates as text in two formats (plus unparsable
    text), untidy ``STATUS`` values, an optional ``Date_Issued``. With
    ``dirty`` some active rows miss mandatory cells and some share a
    ``File_Number``. ``_row`` is the sheet line (header is line 1).
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    reg = F.col("o_orderdate").cast("date")
    st = F.col("o_orderstatus")
    status = (
        F.when((st == "F") & (k % 5 == 0), F.lit(" printed\t"))
        .when(st == "F", F.lit("PRINTED"))
        .when((st == "P") & (k % 4 == 0), F.lit(None).cast("string"))
        .when(st == "P", F.lit("In Process"))
        .otherwise(F.lit("IN PROCESS"))
    )
    reg_text = (
        F.when(k % 53 == 0, F.lit("not a date"))
        .when(k % 2 == 0, F.date_format(reg, "yyyy-MM-dd"))
        .otherwise(F.date_format(reg, "dd/MM/yyyy"))
    )
    fn = F.concat(F.lit("FN-"), _s(k))
    mother = F.concat(F.lit("m "), F.lower("c_mktsegment"))
    if dirty:
        fn = F.when(k % 101 == 1, F.concat(F.lit("FN-"), _s(k - 1))).otherwise(fn)
        mother = (
            F.when(k % 97 == 5, F.lit(None).cast("string"))
            .when(k % 89 == 7, F.lit("   "))
            .otherwise(mother)
        )
    return j.select(
        fn.alias("File_Number"),
        # Every 103rd serial reuses the previous number with last year's suffix,
        # so two rows share the prefix a per-record document is named by.
        F.when(k % 103 == 2, F.concat(_s(k), F.lit("/"), F.lit(str(year - 1))))
        .otherwise(F.concat(_s(k + 1), F.lit("/"), F.lit(str(year)))).alias("Serial"),
        F.upper("c_name").alias("Name"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("Sex"),
        F.concat(F.date_format(F.date_sub(reg, 10), "dd/MM/yyyy"), F.lit(", "),
                 F.upper("c_mktsegment")).alias("When_and_where_born"),
        F.upper("o_orderpriority").alias("Name_of_the_Father"),
        mother.alias("Name_of_the_Mother"),
        F.concat(F.lit("UNIT "), _s(F.col("o_custkey"))).alias("Description_and_residence_of_informant"),
        reg_text.alias("Registration_date"),
        F.concat(F.lit("MHA-"), _s(F.col("o_custkey"))).alias("MHA_File_And_date"),
        F.concat(F.lit("OFFICER "), _s(k % 12)).alias("Signing_Authority_Name"),
        F.concat(F.lit("OFFICER "), _s(k % 12), F.lit(", DESK")).alias("Signing_Authority_Name_Designation"),
        status.alias("STATUS"),
        F.when(st == "F", F.date_format(F.date_add(reg, 30), "dd/MM/yyyy")).alias("Date_Issued"),
        (k + 2).alias("_row"),
    )


def stream_source_options(sf_dir: str) -> tuple[str, dict[str, str]]:
    """Directory + glob that let ``readStream`` pick up the orders table."""
    return sf_dir.rstrip("/"), {"pathGlobFilter": "orders.parquet"}
