"""Gap-free numbering, identity serials, defaults and batch ranges (OP-40..43).

A global ``row_number()`` without a partition puts every row into one task.
``dense_record_number`` numbers by bucket counts instead: rows are counted per
bucket of the leading order key, buckets that hold too many are split again
(by smaller steps, then by the next order key), a running sum over the small
bucket table gives every bucket's first number, and rows are numbered inside
their bucket. Nothing is sampled, cached or checkpointed: the counting pass
reads only the order keys, and its result, one row per bucket, is the only
thing that is broadcast (at most about ``MAX_BUCKETS`` rows, whatever the data).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 50_000   # at most (while there are no more than MAX_BUCKETS buckets)
LEAST_ROWS = 4_000         # fewer rows aren't worth a bucket of their own
MAX_BUCKETS = 100_000      # larger inputs get larger buckets
MAX_LEVELS = 24
PREFIX_STEP = 2            # characters a text key is split by beyond what its bucket shares

# Bucket of a numbered row: its number, its first and last record, and the number of all records.
BUCKET = ("__bucket", "__first", "__last", "__total")


def _leaves(df: DataFrame, order_cols: Sequence[str | Column]) -> list[tuple[Column, T.DataType]]:
    """The order columns with structs taken apart (a null struct sorts before one of nulls)."""
    out: list[tuple[Column, T.DataType]] = []

    def add(c: Column, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            out.append((c.isNotNull(), T.BooleanType()))
            for f in t.fields:
                add(c.getField(f.name), f.dataType)
        elif isinstance(t, T.TimestampNTZType):  # the day, then the time of day
            out.append((F.unix_date(c.cast("date")).cast("long"), T.LongType()))
            minutes = F.hour(c) * 60 + F.minute(c)
            out.append(((minutes * 60 + F.date_part(F.lit("SECOND"), c)).cast("decimal(12,6)") * 1_000_000, T.LongType()))
        else:
            out.append((c, t))

    for c in order_cols:
        c = F.col(c) if isinstance(c, str) else c
        add(c, df.select(c).schema[0].dataType)
    return out


def _code(c: Column, t: T.DataType) -> tuple[Column, str]:
    """An order key as what buckets are made of, and its kind.

    "long" and "text" sort as the key does; equal "steps" may stand for
    different keys, so the next key can't split them.
    """
    if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("int").cast("long") if isinstance(t, T.BooleanType) else c.cast("long"), "long"
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long"), "long"
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c), "long"
    if isinstance(t, T.StringType):
        return c, "text"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        inside = F.floor(F.greatest(F.least(d, F.lit(4e18)), F.lit(-4e18))).cast("long")
        return F.when(F.isnan(d), F.lit(5 * 10**18)).otherwise(inside), "steps"
    raise TypeError(f"no numbering by {t.simpleString()}: cast it to a number, a date or a text")


class _Buckets:
    """The buckets of one numbering.

    ``levels[i]`` lists the buckets that were split at level i and how: path
    of the bucket, order key, least value, step (or prefix length). ``done``
    lists the buckets that hold few enough rows: path, rows. A path has, per
    level, a step number or a text prefix; paths sort as the rows do.
    """

    def __init__(self, df: DataFrame, order_cols: Sequence[str | Column], rows_per_bucket: int) -> None:
        self.spark = df.sparkSession
        self.codes = [_code(c, t) for c, t in _leaves(df, order_cols)]
        n_keys = range(len(self.codes))
        keys = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(self.codes)])
        facts = [F.count(F.lit(1)).alias("n")] + [
            f(f"k{i}").alias(f"{name}{i}") for i in n_keys for name, f in (("lo", F.min), ("hi", F.max), ("c", F.count))
        ]
        whole = keys.agg(*facts).first()
        self.total = whole["n"]
        # Small inputs get smaller buckets, so that all cores work on them.
        even = -(-self.total // int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        limit = max(min(rows_per_bucket, max(even, LEAST_ROWS)), -(-self.total // MAX_BUCKETS))
        self.levels: list[list[tuple]] = []
        self.done: list[tuple] = []
        waiting = [((), whole, 0)]
        while waiting:
            split = []
            for path, row, key in waiting:
                how = self._how(row, key, limit) if row["n"] > limit and len(self.levels) < MAX_LEVELS else None
                if how:
                    split.append((path, *how))
                else:  # small enough, or all order keys agree
                    self.done.append((path, row["n"]))
            if not split:
                break
            level = len(self.levels)
            self.levels.append(split)
            inside = self._placed(keys, [f"k{i}" for i in n_keys]).filter(F.col("__key").isNotNull())
            path_cols = [c for i in range(level + 1) for c in (f"p{i}", f"t{i}")]
            counted = inside.groupBy(*path_cols).agg(*facts, F.first("__key").alias("key")).collect()
            waiting = [(tuple((r[f"p{i}"], r[f"t{i}"]) for i in range(level + 1)), r, r["key"]) for r in counted]

    def _how(self, row, key: int, limit: int) -> tuple[int, int, int] | None:
        """Order key, least value and step (prefix length for texts) that split a bucket; None if nothing does."""
        while key < len(self.codes):
            lo, hi, kind = row[f"lo{key}"], row[f"hi{key}"], self.codes[key][1]
            if lo is not None and (lo != hi or row[f"c{key}"] < row["n"]):  # several values, or nulls beside one
                if kind != "text":
                    return key, lo, max(1, -(-(hi - lo + 1) * limit * 4 // (row["n"] * 5)))
                shared = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
                return key, 0, shared + PREFIX_STEP
            if kind == "steps" and lo is not None:
                return None
            key += 1
        return None

    def _placed(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``df`` with the path of each row's bucket, and ``__key``: by what it was split at the last level (else null)."""
        for level, split in enumerate(self.levels):
            fields = [f"q{i} long, u{i} string" for i in range(level)] + ["__key int, __lo long, __step long"]
            rows = [(*[x for step in path for x in step], *how) for path, *how in split]
            table = F.broadcast(self.spark.createDataFrame(rows, ", ".join(fields)))
            df = df.drop("__key")
            if level:
                at = [F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}")) for i in range(level) for a, b in (("p", "q"), ("t", "u"))]
                df = df.join(table, at, "left").drop(*[f"{c}{i}" for i in range(level) for c in "qu"])
            else:
                df = df.withColumns({n: F.lit(v).cast(t) for n, v, t in zip(("__key", "__lo", "__step"), rows[0], ("int", "long", "long"))})
            place, text = F.lit(None).cast("long"), F.lit(None).cast("string")
            for i, (_, kind) in enumerate(self.codes):
                here = F.col("__key") == i
                if kind == "text":
                    text = F.when(here, F.substring(F.col(keys[i]), F.lit(1), F.col("__step").cast("int"))).otherwise(text)
                else:
                    place = F.when(here, F.expr(f"({keys[i]} - __lo) div __step")).otherwise(place)
            df = df.withColumns({f"p{level}": place, f"t{level}": text}).drop("__lo", "__step")
        return df

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``BUCKET`` columns."""
        depth = len(self.levels)
        paths = [(path + ((None, None),) * (depth - len(path)), n) for path, n in self.done]
        paths.sort(key=lambda x: [((p is not None, p or 0), (t is not None, (t or "").encode())) for p, t in x[0]])
        rows, before = [], 0
        for number, (path, n) in enumerate(paths):
            rows.append((*[x for step in path for x in step], number, before + 1, before + n))
            before += n
        total = F.lit(self.total).cast("long").alias(BUCKET[3])
        if not depth:
            return df.select("*", *[F.lit(v).cast("long").alias(c) for c, v in zip(BUCKET, rows[0])], total)
        fields = [f"q{i} long, u{i} string" for i in range(depth)] + [f"{c} long" for c in BUCKET[:3]]
        table = self.spark.createDataFrame(rows, ", ".join(fields))
        keys = [f"__k{i}" for i in range(len(self.codes))]
        placed = self._placed(df.withColumns({k: c for k, (c, _) in zip(keys, self.codes)}), keys)
        at = [F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}")) for i in range(depth) for a, b in (("p", "q"), ("t", "u"))]
        return placed.join(F.broadcast(table), at).select(*df.columns, *BUCKET[:3], total)


def dense_record_number(df: DataFrame, order_cols: Sequence[str | Column], rn: str = "rn",
                        rows_per_bucket: int = ROWS_PER_BUCKET, keep_bucket: bool = False) -> DataFrame:
    """OP-40: number rows 1..N without gaps in ``order_cols`` order (nulls first).

    ``order_cols`` must be a total order (unique together) for the numbering
    to be deterministic; pass the record key as the last column. Counting and
    numbering each read ``df``, the former its order keys only; a frame whose
    two readings could differ must be written first.

    With ``keep_bucket`` the ``BUCKET`` columns stay: all rows of a bucket are
    in one partition, so a following assembly needs no shuffle
    (:func:`render.assemble_batches`).
    """
    if set(BUCKET) & set(df.columns):
        df = df.drop(*BUCKET)
    buckets = _Buckets(df, order_cols, rows_per_bucket)
    if not buckets.total:
        out = df.withColumn(rn, F.lit(None).cast("bigint")).withColumns({c: F.lit(None).cast("long") for c in BUCKET})
        out = out.filter(F.lit(False))
    else:
        order = [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order_cols]
        # All rows of a bucket go to one task; a bucket is small.
        place = F.row_number().over(Window.partitionBy(BUCKET[0]).orderBy(*order))
        out = buckets.attach(df).withColumn(rn, (F.col(BUCKET[1]) + place - 1).cast("bigint"))
    return out if keep_bucket else out.drop(*BUCKET)


def identity_serial(new_rows: DataFrame, existing: DataFrame | None, order_cols: Sequence[str | Column],
                    serial: str = "serial", largest: int | None = None) -> DataFrame:
    """OP-41: give inserted rows the next serials after the largest existing one.

    ``largest`` is the largest existing serial where the caller keeps it (the
    loads' commit rows do, see ``commits.largest_serial``); without it the
    existing column is scanned. The new rows are numbered with
    :func:`dense_record_number`, so serials follow the intake order without gaps.
    """
    base = largest
    if base is None and existing is not None:
        base = existing.agg(F.max(serial).alias("m")).first()["m"]
    numbered = dense_record_number(new_rows, order_cols, rn="__rn")
    return numbered.withColumn(serial, (F.col("__rn") + F.lit(int(base or 0))).cast("bigint")).drop("__rn")


def column_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """OP-42: columns not supplied by the insert take their default value.

    As in SQL, the default applies only when the column is absent; an explicit
    NULL stays NULL (and is caught by the constraint checks).
    """
    out = df
    for col, value in defaults.items():
        if col not in df.columns:
            out = out.withColumn(col, F.lit(value))
    return out


def with_batch_id(numbered: DataFrame, batch_size: int, rn: str = "rn", batch_col: str = "batch_id") -> DataFrame:
    """Batch of a numbered row: ``(rn - 1) div batch_size`` (0-based)."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    return numbered.withColumn(batch_col, F.expr(f"(`{rn}` - 1) div {int(batch_size)}").cast("bigint"))


def batch_ranges(numbered: DataFrame, batch_size: int, rn: str = "rn") -> DataFrame:
    """OP-43: split 1..N into inclusive ranges of at most ``batch_size`` records."""
    return (with_batch_id(numbered, batch_size, rn)
            .groupBy("batch_id")
            .agg(F.min(rn).alias("first_record"), F.max(rn).alias("last_record"),
                 F.count(F.lit(1)).alias("n_records")))
