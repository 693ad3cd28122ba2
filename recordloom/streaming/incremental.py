"""Incremental pick-up of new records with Structured Streaming (OP-80..83).

The registry's "poll every N seconds for unprinted rows" becomes a stream of
new fact rows plus a table of pending ones. Each micro-batch runs the batch
pipeline inside ``foreachBatch`` over the new rows and the pending rows of the
batch before: select unprinted rows, drop those the printed ledger already
holds (OP-82), join with the dimensions as they are now, render, number and
assemble; then it writes documents, quarantine, ledger and, at last, the rows
that are still unprinted as the new pending table. So a record whose parent
arrives later, or whose missing fields come with a later authority, is tried
again at every poll until it is printed, as the repeated query would.

All outputs go to ``<out>/<table>/micro_batch=<id>``. A replayed micro-batch
starts from the same pending table, overwrites exactly its own folders and
ignores its own earlier ledger rows, so a restart from the checkpoint gives the
same ledger (exactly-once by idempotent writes).

A watch that runs for long makes many small folders. Every ``fold_after``
micro-batches the finished ones' ledger is folded into one folder per key
bucket (``ledger_folded/upto=<id>``); readers take the newest completed fold
and the micro-batches behind it. Of the pending tables, only the one that a
replay would start from is kept beside the newest. So the folders that a poll
lists don't grow in number with the polls before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import joins, numbering, render, select
from ..plans.pipelines import Registry, certificate_records
from ..schemas import APPLICANT_SCHEMA, DEFAULT_BATCH_SIZE, DEFAULT_POLL_SECONDS, LEDGER_SCHEMA, STATUS_PRINTED
from ..session import staged
from ..sources.tables import drop_folder, folder_ids, read_if_exists

LEDGER_COLUMNS = LEDGER_SCHEMA
LEDGER_BUCKETS = 128  # folders of the ledger by key hash, so a lookup of few keys reads few of them
FOLD_AFTER = 200      # micro-batches whose ledger folders are folded into one per key bucket
PENDING = [*[f.name for f in APPLICANT_SCHEMA], "reason"]
NO_PARENT = "no parent record"

Dimension = DataFrame | Callable[[], DataFrame]


def key_bucket(key: Column | str) -> Column:
    """Ledger folder of a record key."""
    return F.pmod(F.xxhash64(key), F.lit(LEDGER_BUCKETS)).cast("int")


@dataclass
class IncrementalJob:
    """One incremental certificate job.

    ``to_fact`` turns raw stream rows into applicant rows; ``ministry``,
    ``authority`` and ``state`` are the dimension tables, or functions that
    read them (called for every micro-batch, so rows and files added later are
    seen); ``out`` is a shared folder (never machine-local on a cluster).
    """

    spark: SparkSession
    to_fact: Callable[[DataFrame], DataFrame]
    ministry: Dimension
    authority: Dimension
    state: Dimension
    template: str
    run_date: dt.date
    out: str
    batch_size: int = DEFAULT_BATCH_SIZE
    mark: bool = True
    suppress_blank_lines: bool = True
    fold_after: int = FOLD_AFTER
    batches_seen: list[int] = field(default_factory=list)
    failures: dict[int, int] = field(default_factory=dict)

    # -- locations ---------------------------------------------------------
    def path(self, table: str, batch_id: int | None = None) -> str:
        base = f"{self.out.rstrip('/')}/{table}"
        # Folder partition "micro_batch": the documents' own "batch_id" column
        # (the batch of at most batch_size documents) must not be shadowed.
        return base if batch_id is None else f"{base}/micro_batch={batch_id}"

    def init_ledger(self) -> None:
        """An empty ledger folder so readers always find the table."""
        empty = self.spark.createDataFrame([], LEDGER_COLUMNS)
        empty.write.mode("overwrite").parquet(self.path("ledger", -1) + "/key_bucket=0")

    def ledger(self, before_batch: int | None = None) -> DataFrame:
        """All ledger rows (but those of ``before_batch``): the newest fold, and the micro-batches behind it."""
        schema = T.StructType([*LEDGER_COLUMNS.fields, T.StructField("micro_batch", T.LongType()),
                               T.StructField("key_bucket", T.IntegerType())])
        led = self.spark.read.schema(schema).parquet(self.path("ledger"))
        folds = folder_ids(self.spark, self.path("ledger_folded"), "upto")
        if folds:
            folded = self.spark.read.schema(schema).parquet(f"{self.path('ledger_folded')}/upto={folds[-1]}")
            led = folded.unionByName(led.filter(F.col("micro_batch") > F.lit(folds[-1])))
        if before_batch is not None:
            led = led.filter(F.col("micro_batch") != F.lit(before_batch))
        return led

    def fold_ledger(self, before_batch: int) -> None:
        """Fold the ledger of the micro-batches before ``before_batch`` if ``fold_after`` of them are not folded yet.

        A fold counts once its write is complete; until then the folders it
        was made of are read. They are deleted at the next fold only, so a
        reader that began under the fold before still finds its files.
        """
        at, folds = self.path("ledger_folded"), folder_ids(self.spark, self.path("ledger_folded"), "upto")
        last = folds[-1] if folds else -1
        kept = [i for i in folder_ids(self.spark, self.path("ledger"), "micro_batch", finished=False) if i >= 0]
        new = [i for i in kept if last < i < before_batch]
        if len(new) < max(self.fold_after, 1):
            return
        # Rebalanced, not repartitioned: small buckets share a task, a large one is split over several.
        (self.ledger().filter(F.col("micro_batch") <= F.lit(new[-1])).hint("rebalance", "key_bucket")
             .write.mode("overwrite").partitionBy("key_bucket").parquet(f"{at}/upto={new[-1]}"))
        for i in kept:
            if i <= last:
                drop_folder(self.spark, self.path("ledger", i))
        for i in folder_ids(self.spark, at, "upto", finished=False):
            if i < last:
                drop_folder(self.spark, f"{at}/upto={i}")

    def ledger_of(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame:
        """The ledger's folders that can hold one of the keys (column ``file_number``).

        Their numbers come to the driver, at most ``LEDGER_BUCKETS``, and become
        a partition filter: what is listed and read follows the micro-batch.
        """
        wanted = [r[0] for r in keys.select(key_bucket("file_number")).distinct().collect()]
        return self.ledger(before_batch).filter(F.col("key_bucket").isin(wanted))

    def pending(self, before_batch: int | None = None) -> DataFrame | None:
        """Rows still unprinted after the last micro-batch (before ``before_batch``), with the reason; None before the first."""
        written = self._pending_ids(before_batch)
        if not written:
            return None
        # An empty table keeps a marker row.
        return self.spark.read.parquet(self.path("pending", written[-1])).filter("file_number IS NOT NULL").select(*PENDING)

    def _pending_ids(self, before_batch: int | None) -> list[int]:
        ids = folder_ids(self.spark, self.path("pending"), "micro_batch")
        return [i for i in ids if before_batch is None or i < before_batch]

    # -- one micro-batch -----------------------------------------------------
    def process(self, batch: DataFrame, batch_id: int) -> None:
        """OP-82 + OP-90/91 + OP-70 as a ledger append, for one micro-batch."""
        self.batches_seen.append(batch_id)
        ministry, authority, state = (d() if callable(d) else d for d in (self.ministry, self.authority, self.state))
        fact = select.active_table(self.to_fact(batch)).withColumn("reason", F.lit(None).cast("string"))
        if self.mark:
            self.fold_ledger(batch_id)
        waiting = self.pending(batch_id) if self.mark else None
        if waiting is not None:
            # A record that comes again replaces its pending row.
            fact = fact.select(*PENDING)
            fact = fact.unionByName(joins.anti_existing_small(waiting, fact, "file_number"))
        todo = staged(fact, "micro-batch")
        if todo.isEmpty():
            return
        if self.mark:
            done = self.ledger_of(todo, before_batch=batch_id).select("file_number")
            todo = joins.anti_existing_small(todo, done, "file_number")
        reg = Registry(todo.drop("reason"), ministry, authority, state)
        rec = staged(render.failure_flags(certificate_records(reg, self.run_date, ordered=False), self.template), "micro-records")
        ok = rec.filter(~F.col("render_failed")).drop("render_failed", "reason")
        bad = rec.filter(F.col("render_failed")).select("File_Number", "reason")
        if self.mark and batch.isEmpty() and ok.isEmpty():
            return  # a poll without new rows that prints nothing changes nothing
        # A row that waits for the same reason as before was reported then.
        known = todo.filter(F.col("reason").isNotNull()).select(F.col("file_number").alias("File_Number"), "reason")
        (bad.join(known, ["File_Number", "reason"], "left_anti")
            .write.mode("overwrite").parquet(self.path("quarantine", batch_id)))
        num = numbering.dense_record_number(ok, ["serial_no", "File_Number"], "rn", keep_bucket=True)
        docs = render.render_documents(num, self.template, suppress_blank_lines=self.suppress_blank_lines,
                                       keep=["rn", "File_Number", "serial_no", *numbering.BUCKET])
        run_id = f"{self.run_date.strftime('%Y%m%d')}_b{batch_id:012d}"  # padded: ids sort as text
        (render.assemble_batches(docs, self.batch_size)
               .withColumn("run_id", F.lit(run_id))
               .write.mode("overwrite").parquet(self.path("documents", batch_id)))
        if not self.mark:
            return
        (ok.select(F.col("File_Number").alias("file_number"), F.col("serial_no").alias("serial"),
                   F.lit(STATUS_PRINTED).alias("status"), tx.run_date(self.run_date).alias("date_issued"),
                   F.lit(run_id).alias("run_id"), key_bucket("File_Number").alias("key_bucket"))
            .repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(self.path("ledger", batch_id)))
        printed = ok.select(F.col("File_Number").alias("file_number"))
        why = bad.select(F.col("File_Number").alias("file_number"), F.col("reason").alias("__why"))
        left = (todo.drop("reason").join(printed, "file_number", "left_anti").join(why.dropDuplicates(["file_number"]), "file_number", "left")
                    .withColumn("reason", F.coalesce("__why", F.lit(NO_PARENT))).select(*PENDING))
        # The marker row says that this batch has written its pending table, were it empty.
        marker = self.spark.createDataFrame([(None,) * len(PENDING)], T.StructType(
            [T.StructField(f.name, f.dataType) for f in left.schema]))
        left.unionByName(marker).write.mode("overwrite").parquet(self.path("pending", batch_id))
        for i in self._pending_ids(batch_id)[:-1]:  # the last one is where a replay of this micro-batch starts from
            drop_folder(self.spark, self.path("pending", i))

    def guarded(self, batch: DataFrame, batch_id: int) -> None:
        """:meth:`process`; a micro-batch that fails twice goes to the dead-letter folder and the stream goes on.

        The first failure stops the query, whose restart replays the batch. At
        the second its rows are kept (``dead_letter``: rows as JSON and the
        error), or the error alone where the rows can't be read.
        """
        try:
            self.process(batch, batch_id)
        except Exception as e:  # noqa: BLE001 - whatever a bad file or row raises
            self.failures[batch_id] = self.failures.get(batch_id, 0) + 1
            if self.failures[batch_id] < 2:
                raise
            note = F.lit(str(e)[:4000]).alias("error")
            path = self.path("dead_letter", batch_id)
            try:
                batch.select(F.to_json(F.struct("*")).alias("row"), note).write.mode("overwrite").parquet(path)
            except Exception:  # noqa: BLE001
                self.spark.range(1).select(F.lit(None).cast("string").alias("row"), note).write.mode("overwrite").parquet(path)

    # -- the stream ------------------------------------------------------------
    def start(self, source: DataFrame, checkpoint: str, once: bool = True,
              poll_seconds: int = DEFAULT_POLL_SECONDS) -> StreamingQuery:
        """OP-80 (``once``: availableNow) or OP-81 (processing-time polling).

        Polling adds a clock to the source (no rows, but a tick a second), so
        every poll is a micro-batch and retries what is pending, new files or not.
        """
        if not _exists(self.spark, self.path("ledger")):
            self.init_ledger()
        if once:
            trigger = {"availableNow": True}
        else:
            ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.lit(False))
            source = source.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]))
            trigger = {"processingTime": f"{int(poll_seconds)} seconds"}
        w = source.writeStream.foreachBatch(self.guarded).option("checkpointLocation", checkpoint)
        return w.trigger(**trigger).start()


def _exists(spark: SparkSession, path: str) -> bool:
    return read_if_exists(spark, path) is not None


def stream_source(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory`` as a stream (schema fixed up front)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(directory)


def run_with_restarts(start: Callable[[], StreamingQuery], max_restarts: int = 3) -> int:
    """OP-83: a failed micro-batch stops the query; restart it from its checkpoint, for as long as it gets on.

    The checkpoint replays the failed batch, whose writes are idempotent. Only
    ``max_restarts`` failures in a row without a finished micro-batch between
    them end the loop (the storage is gone, say): the last one is raised.
    Returns the number of restarts used.
    """
    restarts = stuck = 0
    furthest = -1
    while True:
        q = start()
        try:
            q.awaitTermination()
            return restarts
        except StreamingQueryException:
            last = q.lastProgress
            reached = -1 if last is None else last["batchId"]
            stuck = 1 if reached > furthest else stuck + 1
            furthest = max(furthest, reached)
            if stuck > max_restarts:
                raise
            restarts += 1
