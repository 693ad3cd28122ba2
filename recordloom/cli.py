"""Command line: the registry workflows on real tables (run with spark-submit).

  load    intake sheet files -> new rows for state, authority, parent, applicant
  select  listing of the records still to print (13 columns, by serial)
  run     one table-mode run: documents, quarantine, ledger, run log, reports
  sheet   one sheet-mode run: gate, documents, the sheet's next version
  watch   pick up new applicant files as they arrive and run each batch
  compact fold the runs' ledger into a new copy of the tables

Tables live as Parquet folders under ``--tables`` (``applicant``,
``ministryofhomeaffairs``, ``ib_authority``, ``state``). Loads are written as
``load_id=<id>`` partitions, so a rerun of the same load id replaces itself.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import commits, ingest, writeback
from .plans import pipelines
from .schemas import APPLICANT_SCHEMA, DEFAULT_BATCH_SIZE, DEFAULT_POLL_SECONDS
from .session import ensure_checkpoint_dir
from .sources import sinks, tables

TABLES = ("state", "ib_authority", "ministryofhomeaffairs", "applicant")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("recordloom").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _read_tables(spark: SparkSession, root: str, required: bool = True,
                 exclude_load: str | None = None, keep_load: bool = False) -> dict[str, DataFrame]:
    """The tables under ``root``, committed loads only; ``exclude_load`` hides one load's own
    rows (a rerun of that load must not see itself as already loaded)."""
    out = {}
    for t in TABLES:
        df = spark.read.parquet(f"{root}/{t}") if required else tables.read_if_exists(spark, f"{root}/{t}")
        if df is None:  # table not created yet
            continue
        df = commits.committed(df, root, "load_id")
        if exclude_load is not None and "load_id" in df.columns:
            df = df.filter(F.col("load_id") != F.lit(exclude_load))
        out[t] = df if keep_load else df.drop("load_id")
    # status_class stays on the applicant table: the selection prunes on it.
    return out


def _current(spark: SparkSession, root: str, out: str | None) -> pipelines.Registry:
    t = _read_tables(spark, root)
    fact = t["applicant"]
    if out:
        led = tables.read_if_exists(spark, f"{out}/ledger")
        if led is not None:
            led = commits.committed(led, out, "run_id")
            after = _watermark(spark, root)
            if after is not None:
                led = led.filter(F.col("run_id") > F.lit(after))
            fact = writeback.apply_ledger(fact, led)
    return pipelines.Registry(fact, t["ministryofhomeaffairs"], t["ib_authority"], t["state"])


def _loads(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the loads found under ``root``."""
    found = spark.createDataFrame([], "id string")
    for t in TABLES:
        df = tables.read_if_exists(spark, f"{root}/{t}")
        if df is not None and "load_id" in df.columns:
            found = found.unionByName(df.select(F.col("load_id").cast("string").alias("id")).distinct())
    return found


def cmd_load(a: argparse.Namespace) -> None:
    spark = _session()
    intake = tables.scan_sheet(spark, a.intake, a.format, line_breaks_in_cells=not a.no_line_breaks)
    intake = tables.normalize_na(tables.normalize_headers(intake))
    existing = _read_tables(spark, a.tables, required=False, exclude_load=a.load_id, keep_load=True)
    largest = commits.largest_serial(existing["applicant"], a.tables, exclude=a.load_id) if "applicant" in existing else 0
    existing = {n: df.drop("load_id") for n, df in existing.items()}
    load = ingest.load_star(spark, intake, existing, largest_serial=largest)
    bad = load.violations.groupBy("check_name").count().collect()
    if bad:
        # Refuse the whole load, as the one-transaction insert would.
        print("load refused:", {r["check_name"]: r["count"] for r in bad})
        sys.exit(3)
    commits.begin(spark, a.tables, a.load_id, _loads(spark, a.tables))
    for name, df in (("state", load.state), ("ib_authority", load.authority),
                     ("ministryofhomeaffairs", load.ministry)):
        df.write.mode("overwrite").parquet(f"{a.tables}/{name}/load_id={a.load_id}")
    seen = Observation(f"load_{a.load_id}")
    sinks.write_registry_table(load.applicant.observe(seen, F.max("serial").alias("largest")),
                               f"{a.tables}/applicant/load_id={a.load_id}")
    commits.commit(spark, a.tables, a.load_id, seen.get["largest"] or 0)


def cmd_select(a: argparse.Namespace) -> None:
    from .operators import select
    spark = _session()
    reg = _current(spark, a.tables, a.out)
    listing = select.project_listing(pipelines.scan_joined(reg, active_only=True))
    if a.write:
        listing.write.mode("overwrite").parquet(a.write)
    elif a.show:
        print(f"first {a.show} records:")
        listing.show(a.show, truncate=False)
    else:  # the whole listing, a partition at a time
        print("\t".join(listing.columns))
        for row in listing.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))


def _watermark(spark: SparkSession, root: str) -> str | None:
    """Last run id folded into the tables under ``root`` by ``compact``."""
    folded = tables.read_if_exists(spark, f"{root}/_compacted")
    return None if folded is None else folded.agg(F.max("upto_run")).first()[0]


def cmd_run(a: argparse.Namespace) -> None:
    spark = _session()
    t = _read_tables(spark, a.tables)
    reg = pipelines.Registry(t["applicant"], t["ministryofhomeaffairs"], t["ib_authority"], t["state"])
    template = open(a.template, encoding="utf-8").read()
    res = pipelines.close_the_loop(reg, _date(a.run_date), a.run_id, template, a.out, a.batch_size,
                                   ledger_after=_watermark(spark, a.tables))
    print(res.summary)


def cmd_compact(a: argparse.Namespace) -> None:
    from .schemas import STATUS_CLASS
    spark = _session()
    t = _read_tables(spark, a.tables)
    ledger = commits.committed(spark.read.parquet(f"{a.out}/ledger"), a.out, "run_id")
    after = _watermark(spark, a.tables)
    if after is not None:
        ledger = ledger.filter(F.col("run_id") > F.lit(after))
    upto = a.upto or ledger.agg(F.max("run_id")).first()[0]
    commits.begin(spark, a.to, "compacted")
    for name in ("state", "ib_authority", "ministryofhomeaffairs"):
        t[name].write.mode("overwrite").parquet(f"{a.to}/{name}/load_id=compacted")
    base = t["applicant"].drop(STATUS_CLASS)
    sinks.write_registry_table(writeback.compact(base, ledger, upto), f"{a.to}/applicant/load_id=compacted")
    spark.createDataFrame([(upto,)], "upto_run string").write.mode("overwrite").parquet(f"{a.to}/_compacted")
    commits.commit(spark, a.to, "compacted")


def cmd_sheet(a: argparse.Namespace) -> None:
    spark = _session()
    raw = tables.scan_sheet(spark, a.sheet, a.format, line_breaks_in_cells=not a.no_line_breaks)
    sheet = tables.sheet_lines(tables.normalize_na(tables.normalize_headers(raw)))
    if len(raw.inputFiles()) == 1:
        sheet = sheet.drop("_file")  # one file: its lines alone are the order
    template = open(a.template, encoding="utf-8").read()
    if a.per_record:
        # v1/v2 style: no gate, one document per record named by its serial prefix.
        docs = pipelines.per_record_run(sheet, template)
        sinks.per_record_sink(docs, f"{a.out}/per_record/run_id={a.run_id}")
        return
    run = pipelines.sheet_run(sheet, _date(a.run_date), template, a.batch_size)
    print(run.verdict.verdict, run.verdict.counts)
    if not run.verdict.passed:
        sys.exit(2)
    sinks.batch_doc_sink(run.batches, f"{a.out}/documents", a.run_id)
    if a.mark:
        # The raw cells and headers stay; only the status and the stamp change.
        headers = {c.strip(): c for c in raw.columns}
        nxt = writeback.mark_printed_all(raw.drop("_input_order"), _date(a.run_date), headers.get("STATUS", "STATUS"),
                                         headers.get("Date_Printed", "Date_Printed")).drop("changed")
        (nxt.write.mode("overwrite").option("header", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{a.out}/sheet/run_id={a.run_id}"))


def cmd_watch(a: argparse.Namespace) -> None:
    from .streaming.incremental import IncrementalJob, run_with_restarts, stream_source
    spark = _session()
    # New applicant rows arrive as files; the dimensions are read anew for every micro-batch.
    t = _read_tables(spark, a.tables, required=False)
    missing = [n for n in ("state", "ib_authority", "ministryofhomeaffairs") if n not in t]
    if missing:
        raise SystemExit(f"missing tables under {a.tables}: {', '.join(missing)}")
    template = open(a.template, encoding="utf-8").read()
    job = IncrementalJob(spark=spark, to_fact=lambda b: b,
                         ministry=lambda: _read_tables(spark, a.tables, required=False)["ministryofhomeaffairs"],
                         authority=lambda: _read_tables(spark, a.tables, required=False)["ib_authority"],
                         state=lambda: _read_tables(spark, a.tables, required=False)["state"], template=template,
                         run_date=_date(a.run_date), out=a.out, batch_size=a.batch_size, fold_after=a.fold_after)
    src = stream_source(spark, a.incoming, APPLICANT_SCHEMA, max_files_per_trigger=a.max_files)
    run_with_restarts(lambda: job.start(src, f"{a.out}/_checkpoint", once=a.once, poll_seconds=a.poll))


def _run_id(s: str) -> str:
    """A run id that sorts in run order: it begins with the date as yyyymmdd."""
    try:
        day = dt.datetime.strptime(s[:8], "%Y%m%d")
    except ValueError:
        day = None
    if day is None or day.year < 1900:
        raise argparse.ArgumentTypeError(f"{s}: begin the run id with the date as yyyymmdd, so that ids sort in run order")
    return s


def _date(s: str | None) -> dt.date:
    return dt.date.fromisoformat(s) if s else dt.date.today()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordloom")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("load", help="load an intake sheet into the tables")
    s.add_argument("--intake", required=True)
    s.add_argument("--format", default="csv", choices=["csv", "parquet"])
    s.add_argument("--tables", required=True)
    s.add_argument("--load-id", required=True)
    s.add_argument("--no-line-breaks", action="store_true", help="CSV cells hold no line breaks: large files are split")
    s.set_defaults(fn=cmd_load)

    s = sub.add_parser("select", help="list the records still to print")
    s.add_argument("--tables", required=True)
    s.add_argument("--out", help="run folder whose ledger applies")
    s.add_argument("--write", help="write the listing as Parquet instead of showing it")
    s.add_argument("--show", type=int, help="print a preview of so many records instead of all")
    s.set_defaults(fn=cmd_select)

    for name, fn, help_ in (("run", cmd_run, "one table-mode run"), ("sheet", cmd_sheet, "one sheet-mode run"),
                            ("watch", cmd_watch, "process applicant files as they arrive")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("--template", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--run-date")
        s.add_argument("--batch-size", type=int, default=DEFAULT_BATCH_SIZE)
        s.set_defaults(fn=fn)
        if name in ("run", "sheet"):
            s.add_argument("--run-id", required=True, type=_run_id, help="sorts in run order, e.g. 20260115_093000")
        if name in ("run", "watch"):
            s.add_argument("--tables", required=True)
        if name == "sheet":
            s.add_argument("--sheet", required=True)
            s.add_argument("--format", default="csv", choices=["csv", "parquet"])
            s.add_argument("--no-line-breaks", action="store_true", help="CSV cells hold no line breaks: large files are split")
            s.add_argument("--mark", action="store_true", help="write the sheet's next version with PRINTED marks")
            s.add_argument("--per-record", action="store_true",
                           help="one document per record (named by serial prefix), without the gate")
        if name == "watch":
            s.add_argument("--incoming", required=True)
            s.add_argument("--poll", type=int, default=DEFAULT_POLL_SECONDS)
            s.add_argument("--once", action="store_true", help="process what is there and stop")
            s.add_argument("--fold-after", type=int, default=200, help="micro-batches after which the ledger's small folders are folded")
            s.add_argument("--max-files", type=int, help="cap on new files per micro-batch (bounds a backlog)")
    s = sub.add_parser("compact", help="fold the ledger into a new copy of the tables")
    s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True, help="run folder holding the ledger")
    s.add_argument("--to", required=True, help="root of the compacted tables")
    s.add_argument("--upto", help="last run id to fold (default: all)")
    s.set_defaults(fn=cmd_compact)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main()
