"""Data-quality operators (OP-51..59) and the fail-closed gate.

Each check returns a DataFrame (a count row or the violating rows). The gate
computes every sheet check in one grouped pass: a partial aggregate per key
(map-side combined, so a hot key never lands whole in one task) followed by
a one-row global aggregate. The first failing check in the fixed order
1 -> 5 decides the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import (ALLOWED_SEX, ALLOWED_STATUS, APPLICANT_NOT_NULL, LENGTH_LIMITS,
                       DIMENSION_NOT_NULL, OPTIONAL_SHEET_COLUMNS, SHEET_HELPERS, STATUS_PRINTED)
from .joins import sized_broadcast

CHECK_NAMES = {
    1: "has_rows",
    2: "has_status_column",
    3: "has_active",
    4: "missing_fields",
    5: "duplicates",
}


def _active_flag(status: str) -> Column:
    return tx.status_norm_sheet(status) != F.lit(STATUS_PRINTED)


def mandatory_columns(df: DataFrame, optional: Sequence[str] = OPTIONAL_SHEET_COLUMNS) -> list[str]:
    """Every sheet column except the optional ones and our own helpers (by name)."""
    return [c for c in df.columns if c not in {*optional, *SHEET_HELPERS}]


def dq_has_rows(df: DataFrame) -> DataFrame:
    """OP-51 (check 1): is there any row? Reads at most one row."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("passed"))


def dq_has_status_column(df: DataFrame, status: str = "STATUS") -> bool:
    """OP-52 (check 2): exact, case-sensitive header (schema only, no job)."""
    return status in df.columns


def dq_has_active(df: DataFrame, status: str = "STATUS") -> DataFrame:
    """OP-53 (check 3): number of rows not yet printed."""
    return df.agg(F.count_if(_active_flag(status)).cast("bigint").alias("n_active"))


def missing_flags(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column]]:
    return [(c, tx.is_missing(F.col(f"`{c}`"))) for c in columns]


def dq_missing_fields(df: DataFrame, status: str = "STATUS", row_col: str = "_row",
                      optional: Sequence[str] = OPTIONAL_SHEET_COLUMNS) -> DataFrame:
    """OP-54 (check 4): active rows with a missing mandatory field.

    Output: the sheet row (``row_col``), its ``file`` if the sheet has
    ``_file``, and the missing field names in column order. A narrow pass: no
    shuffle.
    """
    flags = missing_flags(df, mandatory_columns(df, optional))
    any_missing = F.lit(False)
    for _, f in flags:
        any_missing = any_missing | f
    return (df.filter(_active_flag(status) & any_missing)
              .select(*[F.col("_file").alias("file")] * ("_file" in df.columns), F.col(row_col).alias("row"), tx.join_names(flags).alias("missing_fields")))


def dq_duplicates(df: DataFrame, key: str = "File_Number", status: str = "STATUS",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """OP-55 (check 5): every active row whose key occurs more than once among active rows.

    Keys are counted with a map-side-combined aggregate and joined back
    (NULL-safe: NULL keys count as equal). AQE broadcasts the duplicate-key
    set when it is small and otherwise splits a hot key's partition, instead
    of a window that would put every row of a hot key into one task.
    """
    active = df.filter(_active_flag(status))
    dup_keys = (active.groupBy(key).agg(F.count(F.lit(1)).alias("n_same_key"))
                      .filter(F.col("n_same_key") > 1))
    dk = dup_keys.withColumnRenamed(key, "__dup_key")
    out = active.join(dk, active[key].eqNullSafe(F.col("__dup_key")), "inner").drop("__dup_key")
    cols = list(keep) if keep is not None else [c for c in df.columns]
    return out.select(*cols, "n_same_key")


@dataclass(frozen=True)
class GateResult:
    verdict: str
    failed_check: int | None
    counts: dict

    @property
    def passed(self) -> bool:
        return self.failed_check is None


def dq_gate_counts(df: DataFrame, key: str = "File_Number", status: str = "STATUS",
                   optional: Sequence[str] = OPTIONAL_SHEET_COLUMNS) -> DataFrame:
    """OP-56: one-row frame with every check's count and the verdict.

    Columns: ``n_rows, n_active, n_missing_rows, n_duplicate_rows,
    failed_check, verdict``. When the status column is absent, check 2 fails
    and the other counts are not computed (NULL).
    """
    if not dq_has_status_column(df, status):
        return df.limit(1).agg(
            F.count(F.lit(1)).cast("bigint").alias("n_rows"),
            F.lit(None).cast("bigint").alias("n_active"),
            F.lit(None).cast("bigint").alias("n_missing_rows"),
            F.lit(None).cast("bigint").alias("n_duplicate_rows"),
        ).select("*", F.when(F.col("n_rows") == 0, F.lit(1)).otherwise(F.lit(2)).alias("failed_check")) \
         .withColumn("verdict", _verdict_col())
    flags = missing_flags(df, mandatory_columns(df, optional))
    any_missing = F.lit(False)
    for _, f in flags:
        any_missing = any_missing | f
    act = _active_flag(status)
    if key not in df.columns:
        # No key column: check 5 can't be made, so it fails (with no count).
        totals = df.agg(
            F.count(F.lit(1)).cast("bigint").alias("n_rows"),
            F.count_if(act).cast("bigint").alias("n_active"),
            F.count_if(act & any_missing).cast("bigint").alias("n_missing_rows"),
            F.lit(None).cast("bigint").alias("n_duplicate_rows"),
        )
        return totals.withColumn("failed_check", F.coalesce(_first_failure(), F.lit(5))) \
            .withColumn("verdict", _verdict_col())
    per_key = (df.select(F.col(key).alias("__k"), act.alias("__a"), (act & any_missing).alias("__m"))
                 .groupBy("__k")
                 .agg(F.count(F.lit(1)).alias("__rows"),
                      F.count_if("__a").alias("__act"),
                      F.count_if("__m").alias("__miss")))
    totals = per_key.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("__act"), F.lit(0)).cast("bigint").alias("n_active"),
        F.coalesce(F.sum("__miss"), F.lit(0)).cast("bigint").alias("n_missing_rows"),
        F.coalesce(F.sum(F.when(F.col("__act") > 1, F.col("__act"))), F.lit(0)).cast("bigint")
         .alias("n_duplicate_rows"),
    )
    return totals.withColumn("failed_check", _first_failure()).withColumn("verdict", _verdict_col())


def _first_failure() -> Column:
    """The first failing check in the fixed order (NULL when all pass)."""
    return (F.when(F.col("n_rows") == 0, F.lit(1))
             .when(F.col("n_active") == 0, F.lit(3))
             .when(F.col("n_missing_rows") > 0, F.lit(4))
             .when(F.col("n_duplicate_rows") > 0, F.lit(5)))


def _verdict_col() -> Column:
    expr = None
    for n, name in CHECK_NAMES.items():
        cond = F.col("failed_check") == n
        expr = F.when(cond, F.lit(f"FAIL {n} {name}")) if expr is None else expr.when(cond, F.lit(f"FAIL {n} {name}"))
    return expr.otherwise(F.lit("PASS"))


def dq_gate(df: DataFrame, key: str = "File_Number", status: str = "STATUS",
            optional: Sequence[str] = OPTIONAL_SHEET_COLUMNS) -> GateResult:
    """OP-56: evaluate the gate with one action (one row comes to the driver)."""
    row = dq_gate_counts(df, key, status, optional).first()
    counts = row.asDict()
    return GateResult(counts.pop("verdict"), counts.pop("failed_check"), counts)


def gated(df: DataFrame, result: GateResult) -> DataFrame:
    """Fail closed: downstream gets the rows only when the gate passed."""
    return df if result.passed else df.filter(F.lit(False))


# ---------------------------------------------------------------------------
# Table-mode checks (schema constraints)
# ---------------------------------------------------------------------------

def dq_orphans(fact: DataFrame, state: DataFrame, ministry: DataFrame, authority: DataFrame,
               key: str = "file_number") -> DataFrame:
    """OP-57: foreign-key violations (state mandatory; parent and authority when not NULL).

    Output ``check_name, record_key, detail``. The fact is read once: three
    left joins to the distinct keys set an existence flag each, and a row's
    violations are one array, exploded. State and authority are broadcast
    after a size check; the parent table grows with the fact, so its join is
    planned by AQE. Only rows with a violation leave the last join.
    """
    keys = {"state_code": state, "mha_file_number": ministry, "ib_staff_authority_id": authority}
    j = fact.select(F.col(key).alias("record_key"), *keys)
    for fk, dim in keys.items():
        d = dim.select(fk).filter(F.col(fk).isNotNull()).distinct()
        if dim is not ministry:
            d = sized_broadcast(d)[0]
        j = j.join(d.withColumn(f"__has_{fk}", F.lit(True)), fk, "left")

    def missing(fk: str, check: str, allow_null: bool = True) -> Column:
        hit = F.struct(F.lit(check).alias("check_name"), F.concat(F.lit(f"{fk}="), F.col(fk)).alias("detail"))
        none = F.struct(F.lit(check).alias("check_name"), F.lit(f"{fk} is NULL").alias("detail"))
        out = F.when(F.col(fk).isNotNull() & F.col(f"__has_{fk}").isNull(), hit)
        return out if allow_null else out.when(F.col(fk).isNull(), none)

    found = F.array_compact(F.array(missing("state_code", "fk_state", allow_null=False),
                                    missing("mha_file_number", "fk_mha"), missing("ib_staff_authority_id", "fk_ib_authority")))
    return (j.select("record_key", F.explode(found).alias("v"))
             .select("v.check_name", "record_key", "v.detail"))


def constraint_flags(fact: DataFrame) -> list[tuple[str, Column]]:
    flags: list[tuple[str, Column]] = []
    for c in APPLICANT_NOT_NULL:
        if c in fact.columns:
            flags.append((f"{c} not null", F.col(c).isNull()))
    if "sex" in fact.columns:
        # CHECK passes on NULL.
        flags.append(("sex in (M,F)", F.col("sex").isNotNull() & ~F.col("sex").isin(*ALLOWED_SEX)))
    if "status" in fact.columns:
        flags.append(("status allowed", F.col("status").isNotNull()
                      & ~F.upper(F.col("status")).isin(*ALLOWED_STATUS)))
    for c, n in LENGTH_LIMITS:
        if c in fact.columns:
            flags.append((f"{c} length <= {n}", F.length(F.col(c)) > F.lit(n)))
    return flags


def dq_constraints(fact: DataFrame, key: str = "file_number") -> DataFrame:
    """OP-58: NOT NULL, CHECK and length rules in one pass; one row per bad record."""
    flags = constraint_flags(fact)
    any_bad = F.lit(False)
    for _, f in flags:
        any_bad = any_bad | f
    return (fact.filter(any_bad)
                .select(F.col(key).alias("record_key"), tx.join_names(flags, "; ").alias("violations")))


def dq_dimension_constraints(rows: DataFrame, table: str, key: str) -> DataFrame:
    """OP-58 for the dimensions: NOT NULL and length rules; one row per bad row."""
    flags = [(f"{c} not null", F.col(c).isNull()) for c in DIMENSION_NOT_NULL[table]]
    flags += [(f"{c} length <= {n}", F.length(F.col(c)) > F.lit(n)) for c, n in LENGTH_LIMITS if c == key]
    any_bad = F.lit(False)
    for _, flag in flags:
        any_bad = any_bad | F.coalesce(flag, F.lit(False))
    return (rows.filter(any_bad)
                .select(F.col(key).alias("record_key"), tx.join_names(flags, "; ").alias("violations")))


def dq_primary_key(df: DataFrame, key: str) -> DataFrame:
    """OP-59: keys that are NULL or occur more than once (map-side-combined count)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > 1) | F.col(key).isNull()))
