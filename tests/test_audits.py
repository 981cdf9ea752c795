"""Audits on small corpora, the directory, survey metadata and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_workbooks import write_book

from cairnwork.functions import web
from cairnwork.operators import audits as A
from cairnwork.sinks import snapshots
from cairnwork.sources import directory as D
from cairnwork.sources import workbooks as W

NOW = dt.datetime(2024, 1, 10)


def test_answer_rates(spark):
    rows = [(1, "p", True, True, None, True, 100, 50, 10), (2, "p", False, True, False, False, 90, 40, None), (3, "q", True, None, True, None, None, 0, 5), (4, "q", None, False, False, False, 5, 8, 2), (5, "q", True, True, True, False, 7, 10, 5)]
    df = spark.createDataFrame(rows, "id int, producer string, answerable boolean, ed_offered boolean, ea_offered boolean, second_deadline boolean, applied int, admitted int, ed_admitted int")
    got = {r["slice"]: r.asDict() for r in A.answer_rates(df, "id", top=2).collect()}
    assert (got["all"]["rows"], got["all"]["answerable"], got["all"]["answerable_pct"], got["all"]["ed_offered"], got["all"]["ed_offered_answerable_pct"], got["all"]["early_offered"], got["all"]["early_offered_answerable"]) == (5, 3, 60.0, 3, 66.7, 4, 3)
    assert (got["top_2"]["rows"], got["top_2"]["answerable"], got["top_2"]["second_deadline_pct"]) == (2, 1, 50.0)
    assert {tuple(r) for r in A.answers_by(df, "producer").collect()} == {("p", 2, 1, 50.0), ("q", 3, 2, 66.7)}
    shares = A.early_shares(df).first()
    assert (shares["count"], shares.p25, shares.p50, shares.p90) == (2, 0.275, 0.35, 0.47)
    none = A.early_shares(df.where("id = 4")).first()
    assert none["count"] == 0 and none.p50 is None
    assert {tuple(r) for r in A.flag_counts(df, ["ea_offered"]).collect()} == {("ea_offered", "True", 2), ("ea_offered", "False", 2), ("ea_offered", "None", 1)}
    assert A.answer_rates(df.limit(0), "id").where("slice = 'all'").first().answerable_pct is None


def test_queues(spark):
    at = lambda h: NOW - dt.timedelta(hours=h)
    rows = [(1, "done", "ok", "auto", at(1), at(9), None, None), (2, "done", "ok", "auto", at(2), at(9), None, "e"), (3, "done", None, "auto", at(30), at(9), None, None), (4, "failed", None, "hand", at(3), at(9), None, None), (5, "ready", None, "auto", None, at(5), None, "x" * 300), (6, "processing", None, "auto", None, at(9), at(7), None)]
    df = spark.createDataFrame(rows, "id int, status string, last_outcome string, source string, processed_at timestamp_ntz, enqueued_at timestamp_ntz, claimed_at timestamp_ntz, last_error string")
    got = {(r.status, r.last_outcome, r.source): (r.n, r.last_processed) for r in A.queue_recent(df, F.lit(NOW).cast("timestamp_ntz"), 24).collect()}
    assert got == {("done", "ok", "auto"): (2, at(1)), ("failed", "(null)", "hand"): (1, at(3))}
    waiting = A.queue_open(df, "id").collect()
    assert [r.id for r in waiting] == [6, 5] and len(waiting[1].last_error) == 240
    after = df.withColumn("status", F.when(F.col("id") < 4, "failed").otherwise(F.col("status")))
    deltas = {r.status: (r.before, r.after, r.delta, r.plausible) for r in A.status_deltas(df, after, 0.4).collect()}
    assert deltas["done"] == (3, 0, -3, False) and deltas["failed"] == (1, 4, 3, False) and deltas["ready"] == (1, 1, 0, True)


def test_backlog_lists(spark):
    rows = [(f"d{k}", f"s{k % 3}", "pdf" if k % 2 else None, None if k % 3 else "school", NOW - dt.timedelta(hours=k), 5000 * k if k != 4 else None) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "id string, school_id string, source_format string, source_provenance string, created_at timestamp_ntz, size int")
    summary, lists = A.backlog(df, "id", "school_id", F.lit(NOW).cast("timestamp_ntz"), sample=2, groups=2)
    assert tuple(summary.first()) == (6, 6.0, NOW - dt.timedelta(hours=6))
    got = [tuple(r) for r in lists.orderBy("list", "place").collect()]
    assert got == [
        ("format", 1, "pdf", "3"), ("format", 2, "unknown", "3"), ("largest", 1, "d6", "30000"), ("largest", 2, "d5", "25000"), ("oldest", 1, "d6", "6.0"), ("oldest", 2, "d5", "5.0"),
        ("provenance", 1, "school", "2"), ("provenance", 2, "unknown", "4"), ("school_id", 1, "s0", "2"), ("school_id", 2, "s1", "2"),
    ]
    empty, none = A.backlog(df.limit(0), "id", "school_id", F.lit(NOW).cast("timestamp_ntz"))
    assert empty.first()["count"] == 0 and none.count() == 0


def test_rollup_completeness_and_storage(spark):
    frames = {n: spark.createDataFrame([(s,) for s in subs], "sub string") for n, subs in (("unchanged", ["a", "a", "b", "c"]), ("added", ["a"]), ("removed", ["b", "b"]), ("renamed", []))}
    assert {tuple(r) for r in A.rolled_up(frames, "sub").collect()} == {("a", 2, 1, 0, 0), ("b", 1, 0, 2, 0)}
    artifacts = spark.createDataFrame([("d1", "canonical", "old", 1, 9, {"a": "1"}), ("d1", "canonical", "new", 2, None, {"a": "1", "b": "2"}), ("d1", "raw", "x", 3, 99, {}), ("d2", "canonical", "p", 1, 7, None), ("d3", "canonical", "p", 1, None, None)], "document_id string, kind string, producer string, created_at int, populated int, values map<string,string>")
    quality = A.canonical_quality(artifacts)
    assert {tuple(r) for r in quality.collect()} == {("d1", "new", 2), ("d2", "p", 7), ("d3", "p", 0)}
    docs = spark.createDataFrame([("d1", "2023", "published", "extracted", "h"), ("d2", "2023", "published", "failed", ""), ("d3", "2024", "verified_absent", "extraction_pending", None), ("d4", "2022", None, None, None)], "document_id string, year string, participation_status string, extraction_status string, source_sha256 string")
    got = {r.year: tuple(r)[1:] for r in A.completeness(docs, quality, ["2023", "2024", "2025"], 7).collect()}
    assert got == {"2023": (7, 2, 2, 0, 1, 0, 1, 1, 2, 1, 1, 0), "2024": (7, 1, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1), "2025": (7, *[0] * 11)}
    service = next(iter(web.STORAGE))
    urls = [("a", "https://x.edu/", "https://docs.x.edu/a.pdf"), ("b", "https://x.edu/", "https://other.org/a.pdf"), ("c", "https://x.edu/", None)]
    stored = {r.k: r.storage for r in A.file_storage(spark.createDataFrame(urls, "k string, hint string, url string"), "k", "hint", "url", [service]).collect()}
    assert stored == {"a": "same_origin", "b": "unknown", "c": "unknown"}


def test_typed_fields_and_the_iis_leg(spark):
    docs = spark.createDataFrame([(1, {"A": "$1,200", "B": "☒", "C": "word", "D": " ", "E": "n/a"})], "doc int, values map<string,string>")
    kinds = spark.createDataFrame([("A", "number"), ("B", "boolean"), ("D", "number"), ("E", "number")], "field string, kind string")
    got = {r.field: (r.value_num, r.value_bool, r.value_kind, r.value_status) for r in A.typed_fields(docs, "doc", "values", kinds).collect()}
    assert got == {"A": (1200.0, None, "number", "reported"), "B": (None, True, "boolean", "reported"), "C": (None, None, "text", "reported"), "D": (None, None, "number", "missing"), "E": (None, None, "number", "parse_error")}
    sites = spark.createDataFrame([({"server": "Microsoft-IIS/10", "x-powered-by": "ASP.NET"}, "https://x.edu/_layouts/wp-content/a"), ({"server": "x"}, "https://x.edu/_layouts/wp-content/a")], "h map<string,string>, u string")
    assert [r[0] for r in sites.select(web.cms(F.col("h"), F.col("u"))).collect()] == ["sharepoint", "wordpress"]


def test_directory(spark):
    rows = [("100.0", "A", "NULL", "12.7", "1", "3", "1"), ("1234567", "B", "x", "5", "3", "3", "1"), ("7", "C", "", "PrivacySuppressed", "1", "3", "1"), ("8", "D", "", "5", "2", "1", None), ("9", "E", "", "5", "1", "4", "0"), ("-1", "F", "", "5", "1", "3", "1"), ("x", "G", "", "5", "1", "3", "1"), ("10", " ", "", "5", "1", "3", "1")]
    wide = spark.createDataFrame(rows, "UNITID string, INSTNM string, CITY string, UGDS string, ICLEVEL string, PREDDEG string, CURROPER string")
    got = {r.ipeds_id: (r.city, r.undergraduate_enrollment, r.in_scope, r.exclusion_reason) for r in D.directory_rows(wide, "2023").collect()}
    assert got == {"000100": (None, 12, True, None), "1234567": ("x", 5, False, "not_two_or_four_year"), "000007": (None, None, False, "no_undergraduate_enrollment"), "000008": (None, 5, False, "non_degree_predominant"), "000009": (None, 5, False, "closed")}


def test_survey_metadata(spark, tmp_path):
    write_book(tmp_path / "m.xlsx", [
        ("Tables", False, {"A1": "TableName", "B1": "TableNumber", "A2": "HD2023", "B2": 10, "B3": 11}),
        ("varTable", False, {"A1": "TableName", "B1": "varName", "C1": "multiRecord", "D1": "imputationvar", "A2": "HD2023", "B2": "unitid", "C2": "Y", "D2": "xunit", "A3": "HD2023"}),
        ("valuesets", False, {"A1": "TableName", "B1": "varName", "C1": "Codevalue", "D1": "valueLabel", "E1": "percent", "A2": "HD2023", "B2": "sector", "C2": 0, "D2": "Admin", "E2": 12.5, "A3": "HD2023", "B3": "sector", "D3": "no code"}),
    ])
    tables, columns, labels = D.survey_metadata(W.workbook_cells(spark, str(tmp_path / "*.xlsx")))
    assert [(r.table_name, r.table_number, r.description) for r in tables.collect()] == [("HD2023", 10, None)]
    assert [(r.var_name, r.multi_record, r.imputation_var) for r in columns.collect()] == [("UNITID", True, "XUNIT")]
    assert [(r.var_name, r.code_value, r.value_label, r.percent) for r in labels.collect()] == [("SECTOR", "0", "Admin", 12.5)]


def test_yaml_schools(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("schools:\n- id: a\n  name: A\n  sub_institutional: [x, {id: y}]\n- id: b\n- name: none\n")
    assert [(r.id, r.name, r.units) for r in D.yaml_schools(spark, str(tmp_path / "s.yaml")).orderBy("id").collect()] == [("a", "A", ["x", "y"]), ("b", None, [])]


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", 2024, 5, 0.5, "x\"y", None), ("a", "A", 2023, 9, 0.1, "z", True), ("b", "B", 2022, 1, None, None, False), ("", "C", 2024, 1, None, None, None)], "school_id string, school_name string, year int, applied int, rate double, note string, ok boolean")
    fields = [("applied", "Applied", "applied", "admissions"), ("rate", "Rate", "rate", "admissions"), ("note", "Note", "note", "text"), ("ok", "OK", "ok", "text")]
    facts = snapshots.latest_facts(rows, "school_id", "year", fields, ["school_id", "school_name", "year"], 2023)
    assert {(r.school_id, r.key): r.value for r in facts.collect()} == {("a", "applied"): "5", ("a", "rate"): "0.5", ("a", "note"): '"x\\"y"', ("a", "ok"): None}
    folder = str(tmp_path / "snap")
    made = snapshots.write_snapshot(folder, "2024-01-01", {"schools": rows.select("school_id"), "school_facts": facts, "sources": rows.limit(0).select("note")}, [{"key": "applied"}])
    assert [(f["name"], f["rows"]) for f in made["files"]] == [("schools.jsonl", 4), ("school_facts.jsonl", 4), ("sources.jsonl", 0), ("field_dictionary.json", 1)]
    assert json.loads((tmp_path / "snap" / "manifest.json").read_text()) == made
    assert {json.loads(x.value)["school_id"] for x in spark.read.text(f"{folder}/schools.jsonl").collect()} == {"a", "b", ""}
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(folder, "2024-01-01", {"schools": rows}, [])
