"""The command line on real files: load, select, run, sheet."""

import os

import pytest
from pyspark.sql import functions as F

from recordloom import cli
from recordloom.plans import catalog
from recordloom.sources import testdata

from conftest import SF_SMALL


def test_cli_load_select_run_sheet(spark, scratch):
    root = os.path.join(scratch, "tables")
    reg = testdata.registry(spark, SF_SMALL)
    from recordloom.sources import sinks
    for name, df in reg.items():
        if name == "applicant":
            sinks.write_registry_table(df, f"{root}/{name}/load_id=base")
        else:
            df.write.parquet(f"{root}/{name}/load_id=base")

    # A sheet with rule-breaking rows is refused as a whole.
    bad_dir = os.path.join(scratch, "intake_bad")
    testdata.intake(spark, SF_SMALL).drop("_input_order").coalesce(2).write.option("header", True).csv(bad_dir)
    with pytest.raises(SystemExit) as refused:
        cli.main(["load", "--intake", bad_dir, "--tables", root, "--load-id", "L0"])
    assert refused.value.code == 3
    assert not os.path.exists(f"{root}/applicant/load_id=L0")

    # The corrected sheet loads.
    intake_dir = os.path.join(scratch, "intake")
    testdata.intake(spark, SF_SMALL).drop("_input_order").filter("Sex <> 'U' AND State <> 'XX'") \
        .coalesce(2).write.option("header", True).csv(intake_dir)
    cli.main(["load", "--intake", intake_dir, "--tables", root, "--load-id", "L1"])
    cli.main(["load", "--intake", intake_dir, "--tables", root, "--load-id", "L1"])  # rerun replaces itself
    app = spark.read.parquet(f"{root}/applicant")
    new = app.filter(F.col("load_id") == "L1")
    assert new.count() > 0
    assert app.groupBy("file_number").count().filter("count > 1").count() == 0
    base_max = reg["applicant"].agg(F.max("serial")).first()[0]
    assert new.agg(F.min("serial")).first()[0] == base_max + 1

    listing = os.path.join(scratch, "listing")
    cli.main(["select", "--tables", root, "--write", listing])
    assert spark.read.parquet(listing).count() > 0

    tpl = os.path.join(scratch, "template.txt")
    with open(tpl, "w", encoding="utf-8") as f:
        f.write(catalog.CERTIFICATE_TEMPLATE)
    out = os.path.join(scratch, "run")
    cli.main(["run", "--tables", root, "--template", tpl, "--out", out, "--run-id", "20260115_0900",
              "--run-date", "2026-01-15"])
    docs = spark.read.parquet(f"{out}/documents")
    assert docs.agg(F.sum("n_docs")).first()[0] == spark.read.parquet(f"{out}/ledger").count()

    sheet_dir = os.path.join(scratch, "sheet")
    testdata.processing_sheet(spark, SF_SMALL, 2026, dirty=False).drop("_row").coalesce(1) \
        .write.option("header", True).csv(sheet_dir)
    sout = os.path.join(scratch, "sheet_run")
    cli.main(["sheet", "--sheet", sheet_dir, "--template", tpl, "--out", sout, "--run-id", "20260115_1000",
              "--run-date", "2026-01-15", "--mark"])
    cli.main(["sheet", "--sheet", sheet_dir, "--template", tpl, "--out", sout, "--run-id", "20260115_1100",
              "--per-record"])
    per_record = spark.read.parquet(f"{sout}/per_record")
    assert per_record.count() == per_record.select("doc_name").distinct().count() > 0
    marked = spark.read.option("header", True).csv(f"{sout}/sheet")
    assert marked.filter(F.upper(F.trim("STATUS")) != "PRINTED").count() == 0
    assert spark.read.parquet(f"{sout}/documents").count() > 0


def test_cli_compact_then_run(spark, scratch):
    from recordloom.sources import sinks
    root = os.path.join(scratch, "tables")
    for name, df in testdata.registry(spark, SF_SMALL).items():
        if name == "applicant":
            sinks.write_registry_table(df, f"{root}/{name}/load_id=base")
        else:
            df.write.parquet(f"{root}/{name}/load_id=base")
    tpl = os.path.join(scratch, "template.txt")
    with open(tpl, "w", encoding="utf-8") as f:
        f.write(catalog.CERTIFICATE_TEMPLATE)
    out = os.path.join(scratch, "run")
    cli.main(["run", "--tables", root, "--template", tpl, "--out", out, "--run-id", "20260115_0900",
              "--run-date", "2026-01-15"])
    printed_by_run = spark.read.parquet(f"{out}/ledger").count()
    new_root = os.path.join(scratch, "tables2")
    cli.main(["compact", "--tables", root, "--out", out, "--to", new_root])
    app = spark.read.parquet(f"{new_root}/applicant")
    old_active = spark.read.parquet(f"{root}/applicant").filter("status_class = 'ACTIVE'").count()
    assert app.filter("status_class = 'ACTIVE'").count() == old_active - printed_by_run
    # A run on the compacted tables finds nothing new to print.
    cli.main(["run", "--tables", new_root, "--template", tpl, "--out", out, "--run-id", "20260115_1000",
              "--run-date", "2026-01-15"])
    assert spark.read.parquet(f"{out}/ledger").filter("run_id = '20260115_1000'").count() == 0


def test_cli_watch_once(spark, scratch):
    from recordloom.schemas import APPLICANT_SCHEMA
    root = os.path.join(scratch, "tables")
    for name, df in testdata.registry(spark, SF_SMALL).items():
        if name != "applicant":
            df.write.parquet(f"{root}/{name}/load_id=base")
    incoming = os.path.join(scratch, "incoming")
    app = testdata.applicant(spark, SF_SMALL)
    assert app.schema.fieldNames() == APPLICANT_SCHEMA.fieldNames()
    app.repartition(3).write.parquet(incoming)
    tpl = os.path.join(scratch, "template.txt")
    with open(tpl, "w", encoding="utf-8") as f:
        f.write(catalog.CERTIFICATE_TEMPLATE)
    out = os.path.join(scratch, "stream")
    cli.main(["watch", "--incoming", incoming, "--tables", root, "--template", tpl, "--out", out,
              "--run-date", "2026-01-15", "--once", "--max-files", "1"])
    led = spark.read.parquet(f"{out}/ledger")
    assert led.select("micro_batch").distinct().count() >= 3  # one file per micro-batch
    got = led.select("file_number").distinct().count()
    assert got == catalog.QUERIES["incremental_ledger"](spark, SF_SMALL).count()
