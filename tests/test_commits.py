"""Loads and runs are all-or-nothing: a crash between any two writes leaves the earlier state."""

import datetime as dt
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from recordloom import cli
from recordloom.operators import commits, reporting
from recordloom.plans import catalog, pipelines
from recordloom.sources import sinks, tables, testdata

from conftest import SF_SMALL

RUN = catalog.RUN_DATE


class Crash(Exception):
    pass


def crash_at(monkeypatch, n, under):
    """The n-th Parquet write under a folder writes and then fails (n from 1)."""
    seen = [0]
    real = DataFrameWriter.parquet

    def write(self, path, *a, **k):
        real(self, path, *a, **k)
        if str(path).startswith(under):
            seen[0] += 1
            if seen[0] == n:
                raise Crash(path)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    return seen


def rows(tables_):
    return {n: df.count() for n, df in tables_.items()}


@pytest.fixture()
def base(spark, scratch):
    root = os.path.join(scratch, "tables")
    for name, df in testdata.registry(spark, SF_SMALL).items():
        if name == "applicant":
            sinks.write_registry_table(df, f"{root}/{name}/load_id=base")
        else:
            df.write.parquet(f"{root}/{name}/load_id=base")
    return root


def clean_intake(spark, scratch):
    path = os.path.join(scratch, "intake")
    good = testdata.intake(spark, SF_SMALL).drop("_input_order").filter("Sex <> 'U' AND State <> 'XX'").limit(60)
    # One value an authority of the map, so that no row breaks a rule.
    good = good.withColumn("Signing_Authority", F.lit(catalog.AUTHORITY_MAP[0][0]))
    good.coalesce(1).write.option("header", True).csv(path)
    return path


def test_a_crashed_load_stays_out_of_sight(spark, scratch, base, monkeypatch):
    intake = clean_intake(spark, scratch)
    before = rows(cli._read_tables(spark, base))
    for n in (2, 5):  # after a dimension, after the fact
        with monkeypatch.context() as m:
            crash_at(m, n, base)
            with pytest.raises(Crash):
                cli.main(["load", "--intake", intake, "--tables", base, "--load-id", f"L{n}"])
        assert rows(cli._read_tables(spark, base)) == before
    cli.main(["load", "--intake", intake, "--tables", base, "--load-id", "L5"])
    after = cli._read_tables(spark, base)
    assert after["applicant"].count() > before["applicant"]
    assert after["applicant"].groupBy("serial").count().filter("count > 1").count() == 0
    # The summary gives the largest serial; lost, it is found by a scan of that load alone.
    kept = cli._read_tables(spark, base, keep_load=True)["applicant"]
    most = after["applicant"].agg(F.max("serial")).first()[0]
    assert commits.largest_serial(kept, base) == most
    commits.commit(spark, base, "L5")  # a commit row without a summary
    assert commits.largest_serial(kept, base) == most
    first = after["applicant"].filter(F.col("serial") > 1500).agg(F.min("serial")).first()[0]
    assert first == commits.largest_serial(kept, base, exclude="L5") + 1
    # A rerun that crashes withdraws the load; running it once more brings it back.
    total = rows(after)
    with monkeypatch.context() as m:
        crash_at(m, 3, base)
        with pytest.raises(Crash):
            cli.main(["load", "--intake", intake, "--tables", base, "--load-id", "L5"])
    assert rows(cli._read_tables(spark, base)) == before
    cli.main(["load", "--intake", intake, "--tables", base, "--load-id", "L5"])
    assert rows(cli._read_tables(spark, base)) == total


def test_a_crashed_run_prints_nothing(spark, scratch, base, monkeypatch):
    out = os.path.join(scratch, "runs")
    reg = pipelines.Registry.of(cli._read_tables(spark, base))

    def unprinted():
        now = cli._current(spark, base, out)
        return catalog.select.active_table(now.applicant).count()

    run = lambda ident: pipelines.close_the_loop(reg, RUN, ident, catalog.CERTIFICATE_TEMPLATE, out, 100)
    start = unprinted()
    for n in (4, 9):  # after the ledger, after a report
        with monkeypatch.context() as m:
            crash_at(m, n, out)
            with pytest.raises(Crash):
                run(f"20260115_000{n}")
        assert unprinted() == start
    done = run("20260115_0010").summary
    assert done["updated"] > 0 and unprinted() == start - done["updated"]
    assert run("20260115_0011").summary["updated"] == 0


def test_reports_in_one_pass_equal_the_five_reports(spark):
    reg = catalog.registry(spark, SF_SMALL)
    counted = reporting.counted_in_one_pass(reg.applicant, RUN)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("orders.parquet") <= 1
    got = reporting.reports_of(counted, reg.authority, reg.state)
    want = {
        "volume_trend": reporting.report_volume_trend(reg.applicant), "backlog": reporting.report_backlog(reg.applicant, RUN),
        "gender": reporting.report_gender(reg.applicant), "authority_load": reporting.report_authority_load(reg.applicant, reg.authority),
        "state": reporting.report_state(reg.applicant, reg.state),
    }
    for name, df in want.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, got[name].select(*df.columns).collect())), name


def test_a_large_sheet_is_read_in_splits(spark, scratch):
    path = os.path.join(scratch, "sheet")
    os.makedirs(path)
    for name, n in (("a.csv", 40_000), ("b.csv", 3)):
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write("File_Number,Name\n" + "".join(f'{name}{i},"n, é {i}"\n' for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = tables.scan_sheet(spark, path, line_breaks_in_cells=False)
        assert df.rdd.getNumPartitions() > 5
        got = sorted((os.path.basename(r["_input_order"]["file"]), r["_input_order"]["pos"], r["File_Number"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [("a.csv", i, f"a.csv{i}") for i in range(40_000)] + [("b.csv", i, f"b.csv{i}") for i in range(3)]
    whole = tables.scan_sheet(spark, path)
    assert sorted((os.path.basename(r["_input_order"]["file"]), r["_input_order"]["pos"], r["File_Number"]) for r in whole.collect()) == got


def test_orphans_read_the_fact_once(spark):
    from recordloom.operators import dq
    reg = catalog.registry(spark, SF_SMALL)
    found = dq.dq_orphans(reg.applicant, reg.state, reg.ministry, reg.authority)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("o_orderdate") <= 2
    fact = spark.createDataFrame([("F1", None, None, None), ("F2", "X", "P", "Q"), ("F3", "A", "M", "I")],
                                 "file_number string, state_code string, mha_file_number string, ib_staff_authority_id string")
    dims = [spark.createDataFrame([(v,), (v,)], f"{c} string") for c, v in
            (("state_code", "A"), ("mha_file_number", "M"), ("ib_staff_authority_id", "I"))]
    got = sorted((r[0], r[1], r[2]) for r in dq.dq_orphans(fact, dims[0], dims[1], dims[2]).collect())
    assert got == [("fk_ib_authority", "F2", "ib_staff_authority_id=Q"), ("fk_mha", "F2", "mha_file_number=P"),
                   ("fk_state", "F1", "state_code is NULL"), ("fk_state", "F2", "state_code=X")]


def test_a_repeated_rename_multiplies_no_facts(spark):
    from recordloom.operators import writeback
    fact = spark.createDataFrame([("F1", "A"), ("F2", "A"), ("F3", None)], "file_number string, mha_file_number string")
    renames = spark.createDataFrame([("A", "C"), ("A", "B"), (None, "Z")], "old_key string, new_key string")
    got = writeback.key_change_cascade(fact, renames, "mha_file_number").collect()
    assert sorted((r[0], r[1]) for r in got) == [("F1", "B"), ("F2", "B"), ("F3", None)]
    assert len(got) == 3
