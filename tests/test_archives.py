"""Archive members as partitions: what they hold, how many there are, and what a task holds at a time."""

import tracemalloc
import zipfile

from pyspark.sql.types import StructType
from test_workbooks import write_book

from cairnwork.sources import archives as A
from cairnwork.sources import readers
from cairnwork.sources import workbooks as W


def _archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in members.items():
            out.writestr(name, text)


def test_members_are_partitions_and_equal_the_bounded_reader(spark, tmp_path):
    members = {f"d/t{k:02}.csv": f"﻿Id,name ,x\r\n{k},\"a, {k}\",1\r\n{k},only\r\n" for k in range(9)} | {"readme.txt": "no", "d/T99.CSV": "ID\r\n"}
    _archive(tmp_path / "a.zip", members)
    _archive(tmp_path / "b.zip", {"t.csv": "NAME,ID\nn,1\n"})
    _archive(tmp_path / "c.zip", {"none.txt": ""})
    got = A.csv_members(spark, f"{tmp_path}/*.zip", r"\.csv$", ["id", "name", "gone"])
    assert got.rdd.getNumPartitions() == 11 and got.columns == ["file", "member", "ID", "NAME", "GONE"]
    want = readers.zipped_csv(spark, f"{tmp_path}/*.zip", r"\.csv$", ["id", "name", "gone"])
    assert sorted((r.file.rsplit("/", 1)[1], r.ID, r.NAME, r.GONE) for r in got.collect()) == sorted((r.file.rsplit("/", 1)[1], r.ID, r.NAME, r.GONE) for r in want.collect())
    assert {r.member for r in got.where("ID = '3'").collect()} == {"d/t03.csv"}
    assert A.csv_members(spark, f"{tmp_path}/c.zip", r"\.csv$", ["id"]).count() == 0


def test_a_task_holds_a_small_part_of_a_long_member(spark, tmp_path):
    line = "1,some words that stand in every line of a long member\n"
    with zipfile.ZipFile(tmp_path / "long.zip", "w", zipfile.ZIP_DEFLATED) as out, out.open("long.csv", "w") as raw:
        raw.write(b"ID,TEXT\n")
        for _ in range(60):
            raw.write(line.encode() * 20_000)  # 66 MB in all
    schema = StructType.fromDDL("file string, member string, ID string, TEXT string")
    reader = A._CsvMembers({"path": str(tmp_path / "long.zip"), "member": "csv$"}, schema)
    (part,) = reader.partitions()
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_200_000 and peak < 12_000_000


def test_an_archive_of_over_four_gigabytes(spark, tmp_path):
    """A member before the one that is read takes 4.5 GB of the archive, as a hole in the file; offsets need 64 bits."""
    path = tmp_path / "huge.zip"
    hole = 4_500_000_000
    with open(path, "wb") as raw:
        raw.truncate(hole)
        raw.seek(hole)
        with zipfile.ZipFile(raw, "w") as out:
            out.writestr("late.csv", "ID\n7\n8\n")
    assert path.stat().st_size > hole
    got = A.csv_members(spark, str(path), "csv$", ["id"])
    assert sorted(r.ID for r in got.collect()) == ["7", "8"]


def test_sheets_are_partitions_and_equal_the_bounded_reader(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", [("One", False, {"A1": "x", "B1": 2, "C1": True, "D1": "inline:in", "E1": " ", "F1": None, "G1": "12.0"}), ("Two", True, {"A1": "x", "B2": 1.5}), ("Empty", False, {})])
    write_book(tmp_path / "b.xlsx", [("One", False, {"AA1": "y"})])
    got = A.sheet_cells(spark, f"{tmp_path}/*.xlsx")
    assert got.rdd.getNumPartitions() == 4
    key = lambda r: (r.file.rsplit("/", 1)[1], r.sheet, r.hidden, r.cell, r.value)
    assert sorted(map(key, got.collect())) == sorted(map(key, W.workbook_cells(spark, f"{tmp_path}/*.xlsx").collect()))
