"""Sheets in several files: lines, names, order; marking leaves the other cells alone."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recordloom import cli
from recordloom.plans import pipelines
from recordloom.sources import tables


def write_files(spark, folder, fmt, header="Name,STATUS"):
    """Three files of three rows, the values naming file and line."""
    os.makedirs(folder)
    for f in "abc":
        rows = [(f"{f}{line}", "IN PROCESS") for line in (2, 3, 4)]
        if fmt == "csv":
            with open(f"{folder}/{f}.csv", "w", encoding="utf-8") as out:
                out.write(header + "\n" + "".join(f"{n},{s}\n" for n, s in rows))
        else:
            spark.createDataFrame(rows, "Name string, STATUS string").coalesce(1).write.parquet(f"{folder}/part={f}")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_lines_and_documents_of_three_files(spark, scratch, fmt):
    folder = os.path.join(scratch, "sheet_" + fmt)
    write_files(spark, folder, fmt)
    sheet = tables.sheet_lines(tables.scan_sheet(spark, folder, fmt))
    got = sheet.select("Name", "_row", "_file").collect()
    assert sorted(r["Name"] for r in got) == [f + str(n) for f in "abc" for n in (2, 3, 4)]
    assert all(int(r["Name"][1:]) == r["_row"] for r in got)
    assert len({r["_file"] for r in got}) == 3
    docs = pipelines.per_record_run(sheet, "{{Name}}").collect()
    assert len(docs) == 9 and len({r["doc_name"] for r in docs}) == 9


def test_last_row_of_the_last_file_wins(spark, scratch):
    folder = os.path.join(scratch, "sheet_wins")
    write_files(spark, folder, "csv")
    sheet = tables.sheet_lines(tables.scan_sheet(spark, folder, "csv")).withColumn("Serial", F.lit("7/2026"))
    assert [r["doc_text"] for r in pipelines.per_record_run(sheet, "{{Name}}").collect()] == ["c4"]


def test_mark_changes_two_cells_only(spark, scratch):
    folder = os.path.join(scratch, "sheet_mark")
    os.makedirs(folder)
    header = "File_Number,Serial, Name ,STATUS"
    with open(f"{folder}/a.csv", "w", encoding="utf-8") as out:
        out.write(header + "\nF1,1/2026, Ann ,IN PROCESS\nF2,2/2026,None, printed\n")
    tpl = os.path.join(scratch, "mark_template.txt")
    with open(tpl, "w", encoding="utf-8") as out:
        out.write("{{ Name }}")
    run = os.path.join(scratch, "mark_run")
    cli.main(["sheet", "--sheet", folder, "--template", tpl, "--out", run, "--run-id", "20260115_0900",
              "--run-date", "2026-01-15", "--mark"])
    marked = spark.read.option("header", True).csv(f"{run}/sheet/run_id=20260115_0900")
    assert marked.columns == [*header.split(","), "Date_Printed"]
    assert sorted(tuple(r) for r in marked.collect()) == [
        ("F1", "1/2026", " Ann ", "PRINTED", "15/01/2026"), ("F2", "2/2026", "None", " printed", None)]


def test_run_ids_that_do_not_sort_are_refused():
    for bad in ("01022026_090000", "run1", "31012026_1"):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["run", "--template", "t", "--out", "o", "--tables", "t", "--run-id", bad])


def test_only_a_missing_path_counts_as_no_table(spark, scratch):
    assert tables.read_if_exists(spark, os.path.join(scratch, "nothing_here")) is None
    empty = os.path.join(scratch, "empty_table")
    os.makedirs(empty)
    with pytest.raises(AnalysisException):
        tables.read_if_exists(spark, empty)
