"""Write-back without UPDATE (OP-70..77).

Parquet tables take no UPDATE, so a write-back produces the table's next
state as a DataFrame (plus a ``changed`` flag) that is written as a new
table or as ledger rows. Every
operator here is a join + ``when``; the key sets are derived inside the
query, so AQE picks broadcast or sort-merge from their measured size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import STATUS_PRINTED
from .joins import left_join_keys


def mark_printed_run(fact: DataFrame, run_keys: DataFrame, run_date: dt.date, key: str = "serial",
                     status: str = "status", issued: str = "date_issued") -> DataFrame:
    """OP-70: rows of this run that are still unprinted -> PRINTED, date_issued = run date.

    ``run_keys`` holds the keys processed by the run (one column ``key``).
    Returns the fact's next state with a boolean ``changed`` column.
    """
    keys = run_keys.select(key).distinct().withColumn("__hit", F.lit(True))
    j = left_join_keys(fact, keys, key)
    change = F.coalesce(F.col("__hit"), F.lit(False)) & (tx.status_norm_table(status) != F.lit(STATUS_PRINTED))
    marked = j.withColumn("changed", change).drop("__hit")
    return _apply(marked, run_date, status, issued, fact.columns)


def _apply(df: DataFrame, run_date: dt.date, status: str, issued: str, columns: Sequence[str]) -> DataFrame:
    ch = F.col("changed")
    out = []
    for c in columns:
        if c == status:
            out.append(F.when(ch, F.lit(STATUS_PRINTED)).otherwise(F.col(c)).alias(c))
        elif c == issued:
            out.append(F.when(ch, tx.run_date(run_date)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out, ch)


def mark_printed_all(sheet: DataFrame, run_date: dt.date, status: str = "STATUS",
                     stamp: str = "Date_Printed") -> DataFrame:
    """OP-71: every row not printed *now* (stripped, any case) -> PRINTED + date text.

    Sheet-mode parity: rows that arrived after rendering are marked too. The
    stamp column is added when absent (OP-72).
    """
    df = ensure_column(sheet, stamp, "string")
    change = tx.status_norm_sheet(status) != F.lit(STATUS_PRINTED)
    df = df.withColumn("changed", change)
    stamp_text = F.lit(run_date.strftime("%d/%m/%Y"))
    cols = []
    for c in df.columns:
        if c == status:
            cols.append(F.when(F.col("changed"), F.lit(STATUS_PRINTED)).otherwise(F.col(c)).alias(c))
        elif c == stamp:
            cols.append(F.when(F.col("changed"), stamp_text).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def count_updated(next_state: DataFrame) -> DataFrame:
    """OP-32: number of rows the write-back changed."""
    return next_state.agg(F.count_if("changed").cast("bigint").alias("updated"))


def ensure_column(df: DataFrame, col: str, dtype: str = "date") -> DataFrame:
    """OP-72: add ``col`` as NULLs of ``dtype`` when the table lacks it."""
    return df if col in df.columns else df.withColumn(col, F.lit(None).cast(dtype))


def idempotent_rerun(fact: DataFrame, run_keys: DataFrame, run_date: dt.date, key: str = "serial") -> DataFrame:
    """OP-73: apply the run's write-back twice; the second pass must change nothing.

    Output: one row ``updated_first, updated_second``.
    """
    first = mark_printed_run(fact, run_keys, run_date, key)
    second = mark_printed_run(first.drop("changed"), run_keys, run_date, key)
    a = first.select(F.col("changed").alias("c1"), F.lit(False).alias("c2"))
    b = second.select(F.lit(False).alias("c1"), F.col("changed").alias("c2"))
    return a.unionByName(b).agg(F.count_if("c1").cast("bigint").alias("updated_first"),
                                F.count_if("c2").cast("bigint").alias("updated_second"))


def key_change_cascade(fact: DataFrame, key_map: DataFrame, fk: str, old: str = "old_key",
                       new: str = "new_key") -> DataFrame:
    """OP-75 (ON UPDATE CASCADE): renamed parent keys follow into the fact.

    A parent key changes to one new key: of several map rows for an old key
    the least new key counts, so no fact row is ever multiplied.
    """
    m = key_map.groupBy(F.col(old).alias(fk)).agg(F.min(new).alias("__new"))
    j = left_join_keys(fact, m, fk)
    return j.select(*[F.coalesce(F.col("__new"), F.col(c)).alias(c) if c == fk else F.col(c)
                      for c in fact.columns])


def rename_parent_keys(parent: DataFrame, key_map: DataFrame, key: str, old: str = "old_key",
                       new: str = "new_key") -> DataFrame:
    """OP-75 on the parent side: the parent's own key changes."""
    return key_change_cascade(parent, key_map, key, old, new)


def parent_delete_set_null(fact: DataFrame, deleted: DataFrame, fk: str, deleted_key: str = "key") -> DataFrame:
    """OP-76 (ON DELETE SET NULL): facts pointing at a deleted parent lose the reference."""
    d = deleted.select(F.col(deleted_key).alias(fk)).distinct().withColumn("__del", F.lit(True))
    j = left_join_keys(fact, d, fk)
    return j.select(*[F.when(F.col("__del").isNotNull(), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                      if c == fk else F.col(c) for c in fact.columns])


def parent_delete_restrict(fact: DataFrame, deleted: DataFrame, fk: str, deleted_key: str = "key") -> DataFrame:
    """OP-77 (ON DELETE RESTRICT): per key to delete, how many facts still use it.

    Output ``key, n_referencing, refused``. The fact side is aggregated per key
    first (map-side combined) before it meets the delete list.
    """
    refs = fact.groupBy(F.col(fk).alias(deleted_key)).agg(F.count(F.lit(1)).alias("n_referencing"))
    d = deleted.select(deleted_key).distinct()
    out = d.join(refs, deleted_key, "left")
    n = F.coalesce(F.col("n_referencing"), F.lit(0)).cast("bigint")
    return out.select(deleted_key, n.alias("n_referencing"), (n > 0).alias("refused"))


def delete_parents(parent: DataFrame, deleted: DataFrame, key: str, deleted_key: str = "key") -> DataFrame:
    """Remove deleted keys from the parent table (pairs with OP-76 / OP-77)."""
    return parent.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_anti")


# ---------------------------------------------------------------------------
# Ledger form of the write-back: write only what changed
# ---------------------------------------------------------------------------

def ledger_rows(next_state: DataFrame, run_id: str, key: str = "file_number",
                cols: Sequence[str] = ("serial", "status", "date_issued")) -> DataFrame:
    """OP-70/74 at scale: the changed rows of a write-back as append-only ledger rows.

    A run writes O(changed rows) instead of a new copy of the whole table.
    ``run_id`` must sort in run order (e.g. ``yyyyMMdd_HHmmss``).
    """
    return next_state.filter(F.col("changed")).select(key, *cols, F.lit(run_id).alias("run_id"))


def printed_ledger(fact: DataFrame, run_keys: DataFrame, run_date: dt.date, run_id: str,
                   key: str = "serial", row_key: str = "file_number") -> DataFrame:
    """OP-70 as ledger rows, reading only what can change.

    The same rows ``mark_printed_run`` would change (the run's keys, still
    unprinted), found by a semi join of the *active* rows with the run keys,
    so a fact stored by status class only reads its ACTIVE folders.
    """
    from .select import active_table
    keys = run_keys.select(key).distinct()
    hit = active_table(fact).join(keys, key, "left_semi")
    return hit.select(row_key, key, F.lit(STATUS_PRINTED).alias("status"),
                      tx.run_date(run_date).alias("date_issued"), F.lit(run_id).alias("run_id"))


def apply_ledger(fact: DataFrame, ledger: DataFrame, key: str = "file_number", run_col: str = "run_id",
                 cols: Sequence[str] = ("status", "date_issued")) -> DataFrame:
    """Current state = base table overlaid with each key's latest ledger row.

    The latest row per key is a map-side-combined ``max_by`` (a key written by
    many runs never piles up in one task); the overlay is a left join that AQE
    plans by size.
    """
    latest = (ledger.groupBy(key)
                    .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(run_col)).alias("__l")))
    j = left_join_keys(fact, latest, key)
    return j.select(*[F.when(F.col("__l").isNotNull(), F.col(f"__l.{c}")).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in fact.columns])


def compact(base: DataFrame, ledger: DataFrame, upto_run: str | None = None, run_col: str = "run_id") -> DataFrame:
    """Fold ledger rows (up to ``upto_run``) into the base table.

    Written back partitioned by status class (``sources.sinks.write_registry_table``)
    the result becomes the new base: printed history moves to the PRINTED
    folders, and later runs only need ledger rows newer than ``upto_run``.
    """
    led = ledger if upto_run is None else ledger.filter(F.col(run_col) <= F.lit(upto_run))
    return apply_ledger(base, led, run_col=run_col)
