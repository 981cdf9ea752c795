"""A directory of institutions from a wide published table, the metadata of a survey's workbook, and targets from YAML files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.sources.workbooks import sheet_table

# Columns of the directory by their published name and type, and columns of the three sheets of a survey's workbook.
DIRECTORY = {
    "school_name": ("INSTNM", "string"), "city": ("CITY", "string"), "state": ("STABBR", "string"), "zip": ("ZIP", "string"), "website_url": ("INSTURL", "string"), "undergraduate_enrollment": ("UGDS", "int"), "control": ("CONTROL", "int"),
    "institution_level": ("ICLEVEL", "int"), "predominant_degree": ("PREDDEG", "int"), "highest_degree": ("HIGHDEG", "int"), "currently_operating": ("CURROPER", "boolean"), "main_campus": ("MAIN", "boolean"), "branch_count": ("NUMBRANCH", "int"),
    "latitude": ("LATITUDE", "double"), "longitude": ("LONGITUDE", "double"),
}
TABLES = {"table_name": "tablename", "survey_component": "survey", "year_coverage": "yearcoverage", "table_number": "tablenumber", "table_title": "tabletitle", "description": "description", "table_release": "release", "table_release_date": "release_date"}
COLUMNS = {
    "table_name": "tablename", "var_name": "varname", "survey_component": "survey", "table_number": "tablenumber", "table_title": "tabletitle", "var_number": "varnumber", "var_order": "varorder", "imputation_var": "imputationvar",
    "var_title": "vartitle", "data_type": "datatype", "field_width": "fieldwidth", "format": "format", "multi_record": "multirecord", "has_rv": "hasrv", "file_number": "filenumber", "section_number": "sectionnumber",
    "long_description": "longdescription", "var_source": "varsource", "file_title": "filetitle", "section_title": "sectiontitle",
}
LABELS = {"table_name": "tablename", "var_name": "varname", "code_value": "codevalue", "value_label": "valuelabel", "frequency": "frequency", "percent": "percent", "value_order": "valueorder", "var_title": "vartitle"}
INTEGERS = ("table_number", "var_number", "var_order", "field_width", "file_number", "section_number", "frequency", "value_order")


def published(value: Column, kind: str) -> Column:
    """A published cell by its type: blank, NULL and PrivacySuppressed are null, numbers may have a fraction that integers drop, truth values are numbers that aren't 0."""
    text = F.trim(value.cast("string"))
    text = F.when(~text.isin("", "NULL", "PrivacySuppressed"), text)
    if kind == "string":
        return text
    number = text.try_cast("double")
    return number if kind == "double" else number.try_cast("int") if kind == "int" else number.try_cast("int") != 0


def institution_id(value: Column) -> Column:
    """A positive number of any spelling in six digits or more; null for anything else."""
    number = F.trim(value.cast("string")).try_cast("double").try_cast("bigint")
    return F.when(number > 0, F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string")))


def directory_rows(wide: DataFrame, year: str) -> DataFrame:
    """``(ipeds_id, scorecard_data_year, directory_source, ..., in_scope, exclusion_reason)``: a row for each institution with an id and a name.

    The first reason that applies excludes: closed, without undergraduates, neither two- nor four-year, no degrees as a rule.
    """
    there = {c.upper() for c in wide.columns}
    made = {out: published(F.col(name), kind) if name in there else F.lit(None).cast(kind) for out, (name, kind) in DIRECTORY.items()}
    rows = wide.select(institution_id(F.col("UNITID")).alias("ipeds_id"), F.lit(year).alias("scorecard_data_year"), F.lit("scorecard").alias("directory_source"), *[v.alias(k) for k, v in made.items()])
    reason = (
        F.when(F.col("currently_operating") == F.lit(False), "closed").when(F.coalesce("undergraduate_enrollment", F.lit(0)) <= 0, "no_undergraduate_enrollment")
        .when(~F.coalesce(F.col("institution_level").isin(1, 2), F.lit(False)), "not_two_or_four_year").when(~F.coalesce(F.col("predominant_degree").isin(2, 3, 4), F.lit(False)), "non_degree_predominant")
    )
    return rows.where("ipeds_id IS NOT NULL AND school_name IS NOT NULL").withColumn("exclusion_reason", reason).withColumn("in_scope", F.col("exclusion_reason").isNull())


def survey_metadata(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, value labels) of a survey's workbook, from its sheets ``tables``, ``vartable`` and ``valuesets``.

    Names of variables are in upper case; numbers, and truth values by their first letter, are typed; rows without their names are left out.
    """

    def sheet(name: str, columns: dict[str, str], needed: list[str]) -> DataFrame:
        rows = sheet_table(cells, name, columns)
        made = {c: F.nullif(F.trim(c), F.lit("")) for c in columns}
        made |= {c: made[c].try_cast("double").try_cast("int") for c in columns if c in INTEGERS}
        made |= {c: F.upper(made[c]) for c in ("var_name", "imputation_var") if c in columns}
        made |= {c: made[c].try_cast("double") for c in ("percent",) if c in columns}
        made |= {c: F.lower(made[c]).isin("y", "yes", "true", "1", "t") for c in ("multi_record",) if c in columns}
        return rows.select("file", *[v.alias(c) for c, v in made.items()]).where(" AND ".join(f"{c} IS NOT NULL" for c in needed))

    return sheet("tables", TABLES, ["table_name"]), sheet("vartable", COLUMNS, ["table_name", "var_name"]), sheet("valuesets", LABELS, ["table_name", "var_name", "code_value"])


def yaml_schools(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, name, policy, units array<string>)`` of the lists under ``schools`` in YAML files, one file a task's row; needs PyYAML.

    ``units`` are the entries of ``sub_institutional``, empty if there are none. Entries without an id are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError as error:
            raise ImportError("yaml_schools needs PyYAML") from error
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                schools = (yaml.safe_load(content) or {}).get("schools") or []
                rows = [(file, str(s["id"]), s.get("name"), s.get("scrape_policy"), [str(u if not isinstance(u, dict) else u.get("id")) for u in s.get("sub_institutional") or []]) for s in schools if s.get("id")]
                yield pd.DataFrame(rows, columns=["file", "id", "name", "policy", "units"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id string, name string, policy string, units array<string>")
