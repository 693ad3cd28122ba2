"""Joins of the registry star (OP-20..25).

Base dimension tables are broadcast only after a bounded probe proves their
row count and size small. Sides derived inside the query (key sets, key maps) are not
pre-counted (that would compute them twice); AQE measures them at run time
and turns the join into a broadcast when the shuffled side is small, or keeps
a sort-merge join and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

# Largest dimension we are willing to ship to every executor (rows and bytes).
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def size_at_most(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` of data.

    A bounded probe: at most ``max_rows`` + 1 rows are read, and their text
    widths added up (every column as text, plus 8 bytes per value).
    """
    width = F.lit(0)
    for c in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(8)
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast hint only when rows and bytes are proven within bounds."""
    if size_at_most(df, max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False


def join_parent_inner(fact: DataFrame, parent: DataFrame, key: str = "mha_file_number") -> DataFrame:
    """OP-20: inner equi-join fact -> parent (drops NULL / unknown parents).

    The parent grows with the fact, so no hint: Catalyst broadcasts it only
    under ``autoBroadcastJoinThreshold``, otherwise AQE plans a sort-merge join
    and splits skewed keys. NULL keys are filtered before the shuffle
    (inferred ``isnotnull``).
    """
    return fact.join(parent, key, "inner")


def left_join_dimension(fact: DataFrame, dim: DataFrame, key: str,
                        max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Left outer join to a dimension table; broadcast when proven small.

    A dimension above the bound joins by sort-merge. All NULL keys then hash to
    one reducer; AQE's skew-join handling splits that partition of the (left)
    fact side, so a third of the fact lacking a reference does not end up in
    one task, and the fact is still scanned only once.
    """
    d, _ = sized_broadcast(dim, max_rows)
    return fact.join(d, key, "left")


def join_authority_left(fact: DataFrame, authority: DataFrame, key: str = "ib_staff_authority_id",
                        max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """OP-21: left join fact -> signing authority (NULL when unmatched)."""
    return left_join_dimension(fact, authority, key, max_rows)


def map_lookup(df: DataFrame, text_col: str, mapping: DataFrame, map_key: str = "authority_text",
               value: str = "ib_staff_authority_id", out: str | None = None) -> DataFrame:
    """OP-22: exact-text lookup in a constant map; NULL when absent.

    The map is broadcast when it is proven small.
    """
    m, _ = sized_broadcast(mapping.select(F.col(map_key).alias("__map_key"), F.col(value).alias(out or value)))
    return df.join(m, df[text_col] == F.col("__map_key"), "left").drop("__map_key")


def join_state(fact: DataFrame, state: DataFrame, key: str = "state_code",
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """OP-23: fact -> state dimension (left: orphan codes keep a NULL name)."""
    d, _ = sized_broadcast(state, max_rows)
    return fact.join(d, key, "left")


def left_join_keys(fact: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Left join to a derived key set; the physical strategy is AQE's call."""
    return fact.join(keys, key, "left")


def semi_by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """OP-24: restrict rows to a key set (``WHERE k = ANY(...)``) as a semi join."""
    return df.join(keys.select(key), key, "left_semi")


def anti_existing(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """OP-25: keep rows whose key is not yet in ``target`` (ON CONFLICT DO NOTHING)."""
    return df.join(target.select(key), key, "left_anti")


def anti_existing_small(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """OP-25 when ``df`` is small (a micro-batch) and ``target`` ever-growing.

    The target is first cut down to ``df``'s own keys with a semi join, whose
    key-set side AQE broadcasts when it is small; the large target is then
    scanned but never shuffled, and the anti join runs small against small.
    """
    keys = df.select(key).distinct()
    hits = target.select(key).join(keys, key, "left_semi")
    return df.join(hits, key, "left_anti")


FILTER_BITS = 1 << 28  # of a key filter at most: 8,192 rows of 4 KB, 32 MB


def may_hold(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with a column ``may_hold``: false only where ``key`` (a hash) is not in ``keys``.

    The keys are hashed into a bit map of 16 bits a key, 32 MB at most (then
    more rows are let through, never fewer). The map's 4 KB parts are
    broadcast, a size that doesn't grow with the data; ``df`` is not shuffled.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    place = f"pmod({key}, {bits}L) + 1"
    marks = keys.select(F.expr(f"bitmap_bucket_number({place})").alias("__part"), F.expr(f"bitmap_bit_position({place})").alias("__bit"))
    maps = staged(marks.groupBy("__part").agg(F.expr("bitmap_construct_agg(__bit)").alias("__map")), "key-filter")
    tested = df.withColumn("__part", F.expr(f"bitmap_bucket_number({place})")).join(F.broadcast(maps), "__part", "left")
    bit = f"bitmap_bit_position({place})"
    held = f"shiftright(conv(hex(substring(__map, cast({bit} div 8 AS int) + 1, 1)), 16, 10), cast({bit} % 8 AS int)) % 2 = 1"
    return tested.withColumn("may_hold", F.expr(f"coalesce({held}, false)")).drop("__part", "__map")
