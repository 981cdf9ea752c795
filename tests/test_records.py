"""Record operators on small cases: edge values, readers, sinks and matching against brute force."""

import json
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import scalars as X
from cairnwork.operators import changes, coverage, facts, matching, selection
from cairnwork.plans import records, registry
from cairnwork.sinks import files
from cairnwork.sources import readers

SF = "/root/testdata/sf0.001"


def test_academic_years(spark):
    cases = {
        "CDS_2024-2025.pdf": "2024-25", "2024 – 25": "2024-25", "24-25": "2024-25", "cds2425": "2024-25", "cds 2425x": "2024-25", "2021": None, "89-90": None,
        "98-99": None, "99-00": "1999-00", "2024-26 then 2019-20": "2019-20", "2050-51": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r.t: r.y for r in df.select("t", X.academic_year(F.col("t")).alias("y")).collect()}
    assert found == cases


def test_coverage_states(spark):
    cases = [
        (True, None, None, None, "marked_removed", "no_public_cds_found"), (True, 2023, None, None, "marked_removed", "cds_available_stale"),
        (True, None, 2024, "failed", "marked_removed", "extract_failed"), (False, 2023, 2023, None, "inserted", "out_of_scope"),
        (True, 2022, 2024, "failed", "inserted", "latest_found_extract_failed_with_prior_available"), (True, None, None, None, None, "not_checked"),
        (True, None, 2024, "extraction_pending", "auth_walled_okta", "cds_found_processing"), (True, None, None, None, "auth_walled_google", "source_not_automatically_accessible"),
        (True, 2024, 2024, "extracted", "inserted", "cds_available_current"), (True, None, 2024, "discovered", None, "cds_found_processing"),
    ]
    df = spark.createDataFrame(cases, "a boolean, b int, c int, d string, e string, expected string")
    assert df.where(coverage.coverage_status(*map(F.col, "abcde")) != F.col("expected")).count() == 0


def test_changes_of_quality_and_source(spark):
    columns = ["old", "new", "old_flag", "new_flag", "old_producer", "new_producer", "old_version", "new_version", "old_format", "new_format", "old_source", "new_source", "earlier"]
    base = dict(zip(columns, [1.0, 2.0, None, None, "tier1_x", "tier1_y", "1", "1", "pdf", "pdf", "s", "s", False], strict=True))
    cases = [
        ({}, ("material_delta", "major")), ({"new_source": "t"}, ("material_delta", "watch")), ({"new": None}, ("newly_missing", "notable")),
        ({"new": None, "new_producer": "tier2"}, ("producer_changed", "watch")), ({"new": None, "new_version": "2", "new_format": "xlsx"}, ("format_changed", "watch")),
        ({"old": None}, ("newly_reported", "watch")), ({"old": None, "earlier": True}, ("reappeared", "watch")), ({"new_flag": "wrong_file"}, ("quality_regression", "watch")),
        ({"old_flag": "low_coverage"}, ("quality_recovered", "watch")), ({"old_flag": "low_coverage", "new": None}, None), ({"new": 1.0}, None), ({"old": None, "new": None}, None),
    ]
    types = ["double", "double", *["string"] * 10, "boolean"]
    rows = [(i, *(base | c).values()) for i, (c, _) in enumerate(cases)]
    pairs = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True)))
    weighed = changes.severity(F.col("old"), F.col("new"), {"absolute": F.lit(0.5), "relative": F.lit(None)}, {"absolute": F.lit(None), "relative": F.lit(1.0)}, F.lit(0))
    found = {r.i: (r.event, r.severity) for r in changes.change_events(pairs, F.lit(True), weighed).collect()}
    assert found == {i: e for i, (_, e) in enumerate(cases) if e}


def test_typed_facts(spark):
    values = spark.createDataFrame([(1, "v", "number", " 1,200 ", "L"), (2, "v", "number", "-2", "L"), (3, "v", "number", "x", None), (4, "v", "text", "t", None), (5, "v", "label", "9", None), (6, "v", "text", " ", None)], "id int, var string, kind string, raw string, mark string")
    labels = spark.createDataFrame([("v", "-2", "Data suppressed"), ("v", "L", "Imputed")], "var string, code string, code_label string")
    rows = {r.id: (r.number, r.text, r.label, r.quality) for r in facts.typed_facts(values, labels, ["var"], ["id"]).collect()}
    assert rows == {1: (1200.0, None, None, "imputed"), 2: (None, None, "Data suppressed", "suppressed"), 4: (None, "t", None, "reported"), 5: (None, "9", "9", "reported")}


def test_selection_below_its_limit_counts_all_skips(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b")], "k int, why string")
    for limit, ids, skips in ((1, {1}, {}), (2, {1, 3}, {"a": 1}), (9, {1, 3}, {"a": 1, "b": 1})):
        picked, skipped = selection.select_in_order(rows, F.col("why"), [F.col("k")], limit)
        assert {r.k for r in picked.collect()} == ids and {r.reason: r.n for r in skipped.collect()} == skips


def test_best_names_equals_brute_force(spark):
    found = {r.p_name: (r.other, round(r.score, 9)) for r in registry.QUERIES["J_17_best_names"](spark, SF).collect()}
    names = [r.p_name for r in records.load(spark, SF, "part").select("p_name").distinct().collect()]
    expected = {}
    for a in names:
        near = [(-SequenceMatcher(None, a.lower(), b.lower()).ratio(), b) for b in names if b != a and set(a.lower().split()) & set(b.lower().split())]
        best = min([x for x in near if -x[0] >= 0.7], default=None)
        if best:
            expected[a] = (best[1], round(-best[0], 9))
    assert found == expected


def test_unique_matches_leave_out_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "i int, k string")
    b = spark.createDataFrame([(7, "x"), (8, "y"), (9, None)], "j int, k string")
    assert [tuple(r) for r in matching.unique_matches(a, b, ["k"]).select("i", "j").collect()] == [(1, 7)]


def test_scalar_keys(spark):
    row = spark.range(1).select(
        (X.version_parts(F.lit("1.10")) > X.version_parts(F.lit("1.9.x"))).alias("a"), (X.natural_key(F.lit("C.9")) < X.natural_key(F.lit("C.10"))).alias("b"),
        X.truth(F.lit(" ☒ ")).alias("c"), X.truth(F.lit("maybe")).alias("d"), X.fraction(F.lit(45.0), F.lit("45")).alias("e"), X.registrable_domain(F.lit("HTTPS://u@www.a.b.edu:80/x")).alias("f"),
        X.interpolated_percentile(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("g"), X.interpolated_percentile(F.lit(9.0), F.lit(5.0), F.lit(6.0), F.lit(7.0)).alias("h"),
    ).first()
    assert tuple(row) == (True, True, True, None, 0.45, "b.edu", None, 95.0)


def test_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("HD2024.csv", "﻿unitid,Name\n1,\"a, b\"\n2\n")
        z.writestr("other.csv", "unitid\n9\n")
    assert sorted((r.UNITID, r.NAME) for r in readers.zipped_csv(spark, str(tmp_path / "r.zip"), "^hd", ["unitid", "name"], 1).collect()) == [("1", "a, b"), ("2", None)]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "v1", "fields": [{"id": "A.1"}, {"id": "A.2"}]}, indent=1))
    assert sorted(tuple(r) for r in readers.schema_fields(spark, str(tmp_path / "s.json")).collect()) == [("v1", "A.1"), ("v1", "A.2")]
    heads = spark.createDataFrame([(b"%PDF-1.7",), (b"PK\x03\x04zz",), (b" <HTML>",), (b"\xff\xfe",), (None,)], "b binary")
    assert [r[0] for r in heads.select(readers.format_of(F.col("b"))).collect()] == ["pdf", "zip", "html", "other", "other"]
    assert readers.guarded(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        readers.guarded(spark.range(4), 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 'say "x"', {"k": 1}), (2, "b", None, None)], "i int, s string, t string, m map<string,int>")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.write_csv(df, str(tmp_path / "c"), "s")
    back = {r.i: (r.s, r.t, r.m) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()}
    assert back == {"1": ("a", 'say "x"', '{"k":1}'), "2": ("b", None, None)}
    files.replace_partitions(df.select("i", "s"), str(tmp_path / "p"), ["s"])
    files.replace_partitions(spark.createDataFrame([(9, "b")], "i int, s string"), str(tmp_path / "p"), ["s"])
    assert sorted((r.i, r.s) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (9, "b")]
