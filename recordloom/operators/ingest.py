"""Loading a flat intake sheet into the star schema (OP-22, 25, 41, 42, 48..50).

``ON CONFLICT DO NOTHING`` becomes: first row per key in intake order
(``row_number() = 1``, limited per key before the shuffle, so a key repeated
on a third of the sheet sends one row per task), then an anti join against
the keys already in the target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import STATUS_IN_PROCESS
from ..session import staged
from ..sources import tables
from . import joins, numbering

ORDER_COL = "_input_order"


def distinct_pairs(df: DataFrame, key: str = "MHA_FILE_NUMBER", value: str = "MHA_DATE") -> DataFrame:
    """OP-48: distinct (key, value) pairs."""
    return df.select(key, value).distinct()


def first_per_key(df: DataFrame, key: str | Sequence[str], order: str | Column = ORDER_COL) -> DataFrame:
    """First row per key in ``order`` (rows with a NULL key are not insertable).

    ``row_number() = 1`` plans a group limit below the shuffle: at most one row
    per key and map task is moved. Loads report the NULL keys as violations.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ord_col = F.col(order) if isinstance(order, str) else order
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ord_col.asc_nulls_last()))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def insert_ignore(new_rows: DataFrame, target: DataFrame | None, key: str,
                  order: str | Column = ORDER_COL) -> DataFrame:
    """OP-49: rows to append: first per key, and only keys not yet in ``target``.

    Whole rows are long. A row whose key (by a hash) no other row and no row of
    the target has is one to append and stays where it is. Of the others, only
    those that may be the first of their key, by their key and order alone, are
    ranked and compared with the target as whole rows.
    """
    keyed = new_rows.filter(F.col(key).isNotNull()).withColumn("__hash", F.xxhash64(key))
    hashes = keyed.select("__hash", F.lit(1).alias("n"))
    if target is not None:
        old = target.select(F.xxhash64(F.col(key).cast(new_rows.schema[key].dataType)).alias("__hash"), F.lit(1).alias("n"))
        hashes = hashes.unionByName(old)
    contested = staged(hashes.groupBy("__hash").agg(F.sum("n").alias("n")).filter("n > 1").select("__hash"), "contested-keys")
    tested = joins.may_hold(keyed, contested, "__hash").withColumnRenamed("may_hold", "__contested")
    alone = tested.filter("NOT __contested").select(*new_rows.columns)
    several = tested.filter("__contested").drop("__contested")

    rank = order if isinstance(order, Column) else F.col(order)
    several = several.withColumn("__order", rank).withColumn("__hash", F.xxhash64(F.col(key), F.col("__order")))
    firsts = staged(first_per_key(several.select(key, "__order", "__hash"), key, "__order").select("__hash"), "first-keys")
    first = first_per_key(joins.may_hold(several, firsts, "__hash").filter("may_hold"), key, "__order").select(*new_rows.columns)
    return alone.unionByName(joins.anti_existing(first, target, key) if target is not None else first)


def first_pairs(df: DataFrame, key: str, value: str, order: str = ORDER_COL) -> DataFrame:
    """OP-48 + OP-49 for the parent: distinct pairs, first pair per key in intake order.

    ``drop_duplicates`` keeps a pair's first occurrence, so the first pair per
    key is simply the key's first row.
    """
    return first_per_key(df.select(key, value, order), key, order).select(key, value)


@dataclass
class StarLoad:
    """Rows to append to each table in one load (publish them together).

    ``violations`` lists the new fact rows that break a foreign key (against
    existing plus new parent rows) or a NOT NULL / CHECK / length rule. A
    load with violations is refused as a whole, as one transaction would be.
    It is built on first use (its dimension size checks are small jobs).
    """

    state: DataFrame
    authority: DataFrame
    ministry: DataFrame
    applicant: DataFrame
    existing: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    unkeyed: DataFrame | None = field(default=None, repr=False)  # intake rows without a file number

    @cached_property
    def violations(self) -> DataFrame:
        found = _load_violations(self.applicant, self.existing, self.state, self.authority, self.ministry)
        return found if self.unkeyed is None else found.unionByName(self.unkeyed)


def load_star(spark: SparkSession, intake: DataFrame, existing: dict[str, DataFrame] | None = None,
              state_rows: DataFrame | None = None, authority_rows: DataFrame | None = None,
              authority_map: DataFrame | None = None, order: str = ORDER_COL,
              largest_serial: int | None = None) -> StarLoad:
    """OP-50: one intake sheet -> new rows for state, authority, parent and fact.

    Steps: header strip (OP-03), constant dimensions (OP-05) upserted
    first-wins (OP-49), parent pairs (OP-17/48/49), authority text lookup
    (OP-22), fact first-wins by file number, anti join against existing facts
    (OP-25), identity serials after the existing maximum in intake order
    (OP-41), the status default (OP-42), then the foreign-key and constraint
    checks of the new rows (OP-57, OP-58).
    """
    existing = existing or {}
    intake = tables.normalize_headers(intake)
    if order not in intake.columns:
        raise ValueError(f"intake has no '{order}' column: first-wins needs the sheet's row order "
                         "(sources.tables.scan_sheet adds it)")
    st_src = state_rows if state_rows is not None else tables.state_master(spark)
    au_src = authority_rows if authority_rows is not None else tables.authority_master(spark)
    amap = authority_map if authority_map is not None else tables.authority_map(spark)

    st_new = _dedupe_small(st_src, "state_code", existing.get("state"))
    au_new = _dedupe_small(au_src, "ib_staff_authority_id", existing.get("ib_authority"))

    mha = first_pairs(intake, "MHA_FILE_NUMBER", "MHA_DATE", order).select(
        F.col("MHA_FILE_NUMBER").alias("mha_file_number"), tx.parse_date("MHA_DATE").alias("mha_date"))
    if existing.get("ministryofhomeaffairs") is not None:
        mha = joins.anti_existing(mha, existing["ministryofhomeaffairs"], "mha_file_number")

    fact = joins.map_lookup(intake, "Signing_Authority", amap).select(
        F.col("File_Number").alias("file_number"),
        F.col("Name").alias("name"),
        F.col("Sex").alias("sex"),
        tx.parse_date("Birth_Date").alias("birth_date"),
        F.col("Place").alias("place"),
        F.col("State").alias("state_code"),
        F.col("Name_Of_Father").alias("name_of_father"),
        F.col("Name_Of_Mother").alias("name_of_mother"),
        F.col("Address_line_1").alias("address_line_1"),
        F.col("Address_line_2").alias("address_line_2"),
        F.col("Address_line_3").alias("address_line_3"),
        tx.parse_date("Registration_Date").alias("registration_date"),
        F.col("MHA_FILE_NUMBER").alias("mha_file_number"),
        F.col("ib_staff_authority_id"),
        F.col(order),
    )
    fact = insert_ignore(fact, existing.get("applicant"), "file_number", order)
    fact = staged(fact, "load-rows")  # counted, then numbered
    fact = numbering.identity_serial(fact, existing.get("applicant"), [order], "serial", largest_serial)
    fact = numbering.column_defaults(fact, {"status": STATUS_IN_PROCESS})
    fact = fact.withColumn("date_issued", F.lit(None).cast("date"))
    fact = fact.select("file_number", "serial", "name", "sex", "birth_date", "place", "state_code",
                       "name_of_father", "name_of_mother", "address_line_1", "address_line_2",
                       "address_line_3", "registration_date", "status", "date_issued",
                       "mha_file_number", "ib_staff_authority_id")
    unkeyed = intake.filter(F.col("File_Number").isNull()).select(
        F.lit("constraints").alias("check_name"), F.lit(None).cast("string").alias("record_key"),
        F.lit("file_number not null").alias("detail"))
    return StarLoad(st_new, au_new, mha, fact, existing, unkeyed)


def _load_violations(fact: DataFrame, existing: dict[str, DataFrame], st_new: DataFrame,
                     au_new: DataFrame, mha_new: DataFrame) -> DataFrame:
    from . import dq

    def with_existing(name: str, new: DataFrame, key: str) -> DataFrame:
        old = existing.get(name)
        return new.select(key) if old is None else old.select(key).unionByName(new.select(key))

    orphans = dq.dq_orphans(fact, with_existing("state", st_new, "state_code"),
                            with_existing("ministryofhomeaffairs", mha_new, "mha_file_number"),
                            with_existing("ib_authority", au_new, "ib_staff_authority_id"))
    rules = dq.dq_constraints(fact).select(F.lit("constraints").alias("check_name"), "record_key",
                                           F.col("violations").alias("detail"))
    out = orphans.unionByName(rules)
    for name, rows, key in (("state", st_new, "state_code"), ("ministryofhomeaffairs", mha_new, "mha_file_number"),
                            ("ib_authority", au_new, "ib_staff_authority_id")):
        out = out.unionByName(
            dq.dq_dimension_constraints(rows, name, key)
            .select(F.lit("constraints").alias("check_name"), "record_key", F.col("violations").alias("detail")))
    return out


def _dedupe_small(rows: DataFrame, key: str, target: DataFrame | None) -> DataFrame:
    # Constant dimensions are literal tables (a handful of rows): keep the
    # first row per key by position, then skip keys the target already has.
    with_pos = rows.withColumn("__pos", F.monotonically_increasing_id())
    first = first_per_key(with_pos, key, "__pos").drop("__pos")
    return joins.anti_existing(first, target, key) if target is not None else first
