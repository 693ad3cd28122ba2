"""Composite pipelines (OP-90..94) built from the operators."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, numbering, render, select
from ..schemas import DEFAULT_BATCH_SIZE
from ..sources.tables import read_if_exists


@dataclass(frozen=True)
class Registry:
    """The four registry tables."""

    applicant: DataFrame
    ministry: DataFrame
    authority: DataFrame
    state: DataFrame

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> "Registry":
        return cls(tables["applicant"], tables["ministryofhomeaffairs"],
                   tables["ib_authority"], tables["state"])


def star(reg: Registry, active_only: bool = True) -> DataFrame:
    """OP-02 -> (OP-11) -> OP-20 -> OP-21: the registry's joined scan.

    The status filter runs on the fact before either join, and only the
    columns the record needs are read from each table.
    """
    a = reg.applicant
    if active_only:
        a = select.active_table(a)
    a = a.select("file_number", "serial", "name", "sex", "birth_date", "place", "state_code",
                 "name_of_father", "name_of_mother", "address_line_1", "address_line_2",
                 "address_line_3", "registration_date", "mha_file_number", "ib_staff_authority_id")
    j = joins.join_parent_inner(a, reg.ministry.select("mha_file_number", "mha_date"))
    return joins.join_authority_left(j, reg.authority.select(
        "ib_staff_authority_id", "ib_staff_authority_name", "ib_staff_authority_designation"))


def scan_joined(reg: Registry, active_only: bool = False) -> DataFrame:
    """OP-02 (+ OP-13 first half): the 14 selected columns of the joined star."""
    return star(reg, active_only).select(*select.joined_columns())


def certificate_records(reg: Registry, run_date: dt.date, ordered: bool = True) -> DataFrame:
    """OP-90 (flagship): active records, joined, shaped into the 12-field record.

    ``ordered`` adds the distributed sort by serial (OP-45); consumers that
    number the records themselves pass ``ordered=False``.
    """
    rec = select.project_record(scan_joined(reg, active_only=True), run_date.year)
    return select.order_by_serial(rec, "serial_no", "File_Number") if ordered else rec


def numbered_records(reg: Registry, run_date: dt.date, keep_bucket: bool = False) -> DataFrame:
    """OP-90 -> OP-40: records with their position 1..N in serial order."""
    rec = certificate_records(reg, run_date, ordered=False)
    return numbering.dense_record_number(rec, ["serial_no", "File_Number"], "rn", keep_bucket=keep_bucket)


def certificate_documents(reg: Registry, run_date: dt.date, template: str,
                          batch_size: int = DEFAULT_BATCH_SIZE, suppress_blank_lines: bool = True) -> DataFrame:
    """OP-91: OP-90 -> OP-40 -> OP-60 -> OP-43 -> OP-63.

    One row per batch: its record range and the batch text, documents joined
    by page breaks in serial order. Each group holds at most ``batch_size``
    documents, assembled where the numbering left them.
    """
    numbered = numbered_records(reg, run_date, keep_bucket=True)
    docs = render.render_documents(numbered, template, suppress_blank_lines=suppress_blank_lines,
                                   keep=("rn", "File_Number", *numbering.BUCKET))
    return render.assemble_batches(docs, batch_size)


@dataclass(frozen=True)
class LoopResult:
    run_id: str
    summary: dict
    documents_path: str
    ledger_path: str
    reports_path: str


def close_the_loop(reg: Registry, run_date: dt.date, run_id: str, template: str, out: str,
                   batch_size: int = DEFAULT_BATCH_SIZE, ledger_after: str | None = None) -> LoopResult:
    """OP-94: one full run, written to shared folders under ``out``.

    The registry's current state is the base table overlaid with the ledger
    of earlier committed runs. OP-90 records -> OP-64 quarantine -> OP-40/60/63
    batch documents (written per run id) -> OP-70 write-back of the rendered
    records only, appended as ledger rows (only changed keys are written) ->
    OP-33 run summary (with the observed document count and elapsed time)
    appended to the run log -> OP-34..38 reports for the new state, in one
    pass -> the run's commit row. Readers skip runs without one, so a crash
    anywhere before leaves the earlier state current. Rerunning a run id
    overwrites its own partitions; a new run (OP-81) picks up only what is
    still unprinted. ``run_id`` must sort in run order (``yyyyMMdd_HHmmss``).
    ``ledger_after`` skips ledger rows already folded into the base table by a
    compaction.
    """
    from ..operators import commits, reporting, writeback
    from ..session import staged
    from ..sources import sinks

    started = time.perf_counter()
    spark = reg.applicant.sparkSession
    ledger_path = f"{out}/ledger"
    fact = reg.applicant
    earlier = read_if_exists(spark, ledger_path)
    commits.begin(spark, out, run_id, earlier and earlier.select(F.col("run_id").alias("id")))
    if earlier is not None:
        earlier = commits.committed(earlier, out, "run_id")
        if ledger_after is not None:
            earlier = earlier.filter(F.col("run_id") > F.lit(ledger_after))
        fact = writeback.apply_ledger(fact, earlier)
    reg = Registry(fact, reg.ministry, reg.authority, reg.state)

    # The run's records feed the numbering, the quarantine and the summary.
    flagged = staged(render.failure_flags(certificate_records(reg, run_date, ordered=False), template), "run-records")
    ok = flagged.filter(~F.col("render_failed")).drop("render_failed", "reason")
    bad = flagged.filter(F.col("render_failed")).drop("render_failed")
    num = numbering.dense_record_number(ok, ["serial_no", "File_Number"], "rn", keep_bucket=True)
    docs = render.render_documents(num, template, suppress_blank_lines=True, keep=["rn", *numbering.BUCKET])
    docs_path = f"{out}/documents"
    written = sinks.batch_doc_sink(render.assemble_batches(docs, batch_size), docs_path, run_id)
    bad.write.mode("overwrite").parquet(f"{out}/quarantine/run_id={run_id}")

    run_keys = ok.select(F.col("serial_no").alias("serial"))
    (writeback.printed_ledger(fact, run_keys, run_date, run_id).drop("run_id")
              .write.mode("overwrite").parquet(f"{ledger_path}/run_id={run_id}"))

    summary = reporting.run_summary(run_id, fact, flagged).first().asDict()
    # The document count was observed during the write; it must agree.
    if written["documents"] != summary["rendered"]:
        raise RuntimeError(f"documents written {written['documents']} != rendered {summary['rendered']}")
    summary["batches"] = written["batches"]
    summary["elapsed_sec"] = round(time.perf_counter() - started, 3)
    log = spark.createDataFrame([summary], "run_id string, found long, rendered long, quarantined long, "
                                           "updated long, batches long, elapsed_sec double")
    log.write.mode("append").parquet(f"{out}/run_log")

    state_now = writeback.apply_ledger(
        fact, spark.read.parquet(ledger_path).filter(F.col("run_id") == F.lit(run_id)))
    rep = f"{out}/reports/run_id={run_id}"
    counted = staged(reporting.counted_in_one_pass(state_now, run_date), "run-reports")
    for name, report in reporting.reports_of(counted, reg.authority, reg.state).items():
        report.write.mode("overwrite").parquet(f"{rep}/{name}")
    commits.commit(spark, out, run_id)
    return LoopResult(run_id, summary, docs_path, ledger_path, rep)


@dataclass(frozen=True)
class SheetRun:
    verdict: object          # dq.GateResult
    batches: DataFrame       # empty when the gate failed (fail closed)


def sheet_run(sheet: DataFrame, run_date: dt.date, template: str, batch_size: int = DEFAULT_BATCH_SIZE,
                   key: str = "File_Number", status: str = "STATUS", serial: str = "Serial",
                   row_col: str = "_row", date_columns: tuple[str, ...] = ("Registration_date",),
                   inject_year: bool = True) -> SheetRun:
    """OP-92: sheet -> gate (checks 1..5) -> dates -> text-serial order -> render -> batches.

    The gate is one action; on failure the batches are empty. Records are
    numbered by (first digit run of the serial, key, sheet row) and
    assembled ``batch_size`` at a time.
    """
    from ..functions import text as tx
    from ..operators import dq

    verdict = dq.dq_gate(sheet, key, status)
    act = select.active_sheet(dq.gated(sheet, verdict), status)
    types = dict(act.dtypes)
    for c in date_columns:
        if c in act.columns:
            act = act.withColumn(c, tx.parse_format_date(c, types[c]))
    if inject_year:
        act = select.inject_year(act, run_date.year)
    act = select.add_serial_helper(act, serial)
    place = [c for c in ("_file",) if c in sheet.columns] + [row_col]
    num = numbering.dense_record_number(act, [select.SERIAL_HELPER, key, *place], keep_bucket=True)
    docs = render.render_documents(num, template, suppress_blank_lines=True, keep=["rn", *numbering.BUCKET])
    return SheetRun(verdict, render.assemble_batches(docs, batch_size))


def per_record_run(sheet: DataFrame, template: str, status: str = "STATUS", serial: str | None = "Serial",
                        row_col: str = "_row", date_columns: tuple[str, ...] = ("Registration_date",)) -> DataFrame:
    """OP-93: active sheet rows, dates formatted, one document per serial prefix.

    Rows sharing a prefix overwrite each other (last sheet row wins); without
    a serial column documents are named ``row<n>``. A sheet read from several
    files carries ``_file`` beside the row (``tables.sheet_lines``).
    """
    from ..functions import text as tx

    act = select.active_sheet(sheet, status)
    types = dict(act.dtypes)
    for c in date_columns:
        if c in act.columns:
            act = act.withColumn(c, tx.parse_format_date(c, types[c]))
    docs = render.render_documents(act, template)
    use_serial = serial if serial is not None and serial in sheet.columns else None
    return render.per_record_documents(docs, use_serial, row_col, row_pos=row_col,
                                       file="_file" if "_file" in sheet.columns else None)
