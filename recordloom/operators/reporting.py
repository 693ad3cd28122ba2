"""Counts, run summary and dashboard reports (OP-30..38).

All reports are grouped aggregates with map-side partial aggregation; the
grouped results are small (months, age buckets, sexes, authorities, states).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import STATUS_PRINTED
from .joins import join_state, left_join_dimension
from .select import active_table


def count_selected(df: DataFrame) -> DataFrame:
    """OP-30: number of selected records."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_selected"))


def exists_check(df: DataFrame) -> DataFrame:
    """OP-31: any rows? Stops after the first row."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))


def run_summary(run_id: str, fact: DataFrame, flagged: DataFrame, status: str = "status",
                fact_key: str = "file_number", rec_key: str = "File_Number", serial: str = "serial",
                flag: str = "render_failed") -> DataFrame:
    """OP-33: found / rendered / quarantined / updated for one run, as one row.

    ``flagged`` holds the run's records with the boolean ``flag`` (render
    failed). One data flow: the fact's unprinted rows are left-joined to the
    flags on their primary key, aggregated per serial (map-side combined, so a repeated
    serial cannot pile up in one task), then totalled. ``updated`` follows
    the write-back's rule: every still-unprinted row whose serial belongs to
    a rendered record.
    """
    flags = flagged.select(F.col(rec_key).alias(fact_key), F.col(flag).alias("__bad"))
    # Every count concerns rows still to print, so only those are read (a fact
    # stored by status class reads just its ACTIVE folders).
    act_rows = active_table(fact, status)
    j = act_rows.select(fact_key, serial, F.lit(True).alias("__act")).join(flags, fact_key, "left")
    per_serial = j.groupBy(serial).agg(
        F.count_if("__act").alias("n_act"),
        F.count_if(F.col("__bad").isNotNull() & ~F.col("__bad")).alias("n_ok"),
        F.count_if(F.col("__bad")).alias("n_bad"),
    )
    hit = F.col(serial).isNotNull() & (F.col("n_ok") > 0)
    return per_serial.agg(
        F.coalesce(F.sum("n_act"), F.lit(0)).cast("bigint").alias("found"),
        F.coalesce(F.sum("n_ok"), F.lit(0)).cast("bigint").alias("rendered"),
        F.coalesce(F.sum("n_bad"), F.lit(0)).cast("bigint").alias("quarantined"),
        F.coalesce(F.sum(F.when(hit, F.col("n_act"))), F.lit(0)).cast("bigint").alias("updated"),
    ).select(F.lit(run_id).alias("run_id"), "found", "rendered", "quarantined", "updated")


AGE_BUCKETS = ((30, "0-30 days"), (90, "31-90 days"), (365, "91-365 days"))


def age_bucket(run_date: dt.date, date_col: str = "registration_date") -> Column:
    """Age bucket of a date at the run date (a null date counts as oldest)."""
    age = F.datediff(tx.run_date(run_date), F.col(date_col))
    bucket = None
    for limit, label in AGE_BUCKETS:
        cond = age <= F.lit(limit)
        bucket = F.when(cond, F.lit(label)) if bucket is None else bucket.when(cond, F.lit(label))
    return bucket.otherwise(F.lit("over 365 days"))


# Group columns of the five reports, in the order of their grouping sets.
REPORTS = {"volume_trend": "month", "backlog": "age_bucket", "gender": "sex",
           "authority_load": "ib_staff_authority_id", "state": "state_code"}


def counted_in_one_pass(fact: DataFrame, run_date: dt.date, status: str = "status",
                        date_col: str = "registration_date") -> DataFrame:
    """OP-34..38 counted in one scan of the fact: ``report`` and its group value (of one of the five columns of
    ``REPORTS``), n, n_active, oldest_active.

    One aggregate with a grouping set per report; the partial aggregate
    leaves a row per group and task. :func:`reports_of` shapes the five reports.
    """
    rows = fact.select(
        F.date_format(F.col(date_col), "yyyy-MM").alias("month"), age_bucket(run_date, date_col).alias("age_bucket"),
        "sex", "ib_staff_authority_id", "state_code", F.col(date_col).alias("__date"),
        (tx.status_norm_table(status) != F.lit(STATUS_PRINTED)).alias("__active"))
    columns = list(REPORTS.values())
    # grouping_id has a bit per column, the first one highest; a column's bit is 0 in its own set.
    ids = {(1 << len(columns)) - 1 - (1 << len(columns) - 1 - i): name for i, name in enumerate(REPORTS)}
    which = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return (rows.groupingSets([[F.col(c)] for c in columns], *columns)
                .agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).cast("bigint").alias("n"),
                     F.count_if("__active").cast("bigint").alias("n_active"),
                     F.min(F.when(F.col("__active"), F.col("__date"))).alias("oldest_active"))
                .select(which[F.col("__set").cast("int")].alias("report"), *columns, "n", "n_active", "oldest_active"))


def reports_of(counted: DataFrame, authority: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    """The five reports from :func:`counted_in_one_pass` (write it first: each report reads it)."""
    part = {name: counted.filter(F.col("report") == F.lit(name)) for name in REPORTS}
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    key = "ib_staff_authority_id"
    by_authority = left_join_dimension(part["authority_load"].select(key, "n", "n_active"),
                                       authority.select(key, "ib_staff_authority_name"), key)
    by_state = join_state(part["state"].select("state_code", "n", "n_active"), state)
    return {
        "volume_trend": part["volume_trend"].select("month", F.col("n").alias("n_registrations")),
        "backlog": part["backlog"].filter("n_active > 0").select(
            "age_bucket", F.col("n_active").alias("n_backlog"), F.col("oldest_active").alias("oldest_registration")),
        "gender": part["gender"].withColumn("__t", total).select(
            "sex", "n", F.expr("(n * 10000) div __t").cast("bigint").alias("share_bp")),
        "authority_load": by_authority.select(key, F.col("ib_staff_authority_name").alias("authority_name"),
                                              F.col("n").alias("n_records"), "n_active"),
        # Codes that share a state name (or have none) are one row.
        "state": by_state.groupBy("state_name").agg(
            F.sum("n").cast("bigint").alias("n_records"), F.sum(F.col("n") - F.col("n_active")).cast("bigint").alias("n_printed"),
            F.sum("n_active").cast("bigint").alias("n_active")),
    }


def report_volume_trend(fact: DataFrame, date_col: str = "registration_date") -> DataFrame:
    """OP-34: registrations per month."""
    return (fact.groupBy(F.date_format(F.col(date_col), "yyyy-MM").alias("month"))
                .agg(F.count(F.lit(1)).cast("bigint").alias("n_registrations")))


def report_backlog(fact: DataFrame, run_date: dt.date, date_col: str = "registration_date",
                   status: str = "status") -> DataFrame:
    """OP-35: unprinted records by age bucket at the run date, with the oldest date."""
    active = fact.filter(tx.status_norm_table(status) != F.lit(STATUS_PRINTED))
    return (active.groupBy(age_bucket(run_date, date_col).alias("age_bucket"))
                  .agg(F.count(F.lit(1)).cast("bigint").alias("n_backlog"),
                       F.min(date_col).alias("oldest_registration")))


def report_gender(fact: DataFrame, sex: str = "sex") -> DataFrame:
    """OP-36: records by sex with the share in basis points of the total.

    The total comes from a window over the grouped result (a few rows).
    """
    g = fact.groupBy(F.col(sex).alias("sex")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (g.withColumn("__t", total)
             .select("sex", "n", F.expr("(n * 10000) div __t").cast("bigint").alias("share_bp")))


def report_authority_load(fact: DataFrame, authority: DataFrame, key: str = "ib_staff_authority_id",
                          status: str = "status") -> DataFrame:
    """OP-37: workload per signing authority (unmatched / NULL kept as a NULL bucket)."""
    j = left_join_dimension(fact.select(key, status), authority.select(key, "ib_staff_authority_name"), key)
    active = tx.status_norm_table(status) != F.lit(STATUS_PRINTED)
    return (j.groupBy(key, F.col("ib_staff_authority_name").alias("authority_name"))
             .agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                  F.count_if(active).cast("bigint").alias("n_active")))


def report_state(fact: DataFrame, state: DataFrame, status: str = "status") -> DataFrame:
    """OP-38: per state: total, printed and not-yet-printed records."""
    j = join_state(fact.select("state_code", status), state)
    printed = tx.status_norm_table(status) == F.lit(STATUS_PRINTED)
    return (j.groupBy("state_name")
             .agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                  F.count_if(printed).cast("bigint").alias("n_printed"),
                  F.count_if(~printed).cast("bigint").alias("n_active")))
