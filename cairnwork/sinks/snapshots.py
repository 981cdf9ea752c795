"""Snapshots for readers outside: schools, facts, sources and a dictionary as JSON lines, and a manifest that comes last."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.operators.ranking import first_per_key
from cairnwork.sinks.files import write_jsonl
from cairnwork.sinks.versions import _Files


def latest_facts(rows: DataFrame, school: str, year: str, fields: Sequence[tuple[str, str, str, str]], carried: Sequence[str], since: int | None = None) -> DataFrame:
    """``(carried..., key, label, value, category)``: the facts of each school's latest row, one for each of ``fields`` (key, label, column, category), nulls too.

    Values are JSON text, so numbers, truth values and texts stay apart. Rows without a school and of years before ``since`` don't count; of one year the least row by ``carried`` does.
    """
    own = rows.where(F.col(school).isNotNull() & (F.col(school) != ""))
    own = own.where(F.col(year) >= since) if since is not None else own
    latest = first_per_key(own, [school], [F.desc(year), *[F.asc(c) for c in carried]])

    def value(name: str):
        return F.get_json_object(F.to_json(F.struct(F.col(name).alias("v"))), "$.v") if dict(rows.dtypes)[name] != "string" else F.substring(F.to_json(F.array(F.col(name))), F.lit(2), F.length(F.to_json(F.array(F.col(name)))) - 2)

    facts = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.when(F.col(c).isNotNull(), value(c)).alias("value"), F.lit(category).alias("category")) for k, label, c, category in fields])
    return latest.select(*carried, F.inline(facts))


def write_snapshot(folder: str, date: str, parts: dict[str, DataFrame], dictionary: Sequence[dict]) -> dict:
    """Writes each of ``parts`` as JSON lines under its name, the dictionary as one JSON file, and then the manifest, which it returns.

    A snapshot without a manifest is not finished. A folder that has one is not written again: that is an error.
    """
    spark = next(iter(parts.values())).sparkSession
    files = _Files(spark, folder)
    if "manifest.json" in files.names(""):
        raise FileExistsError(f"{folder} has a manifest")
    counts = {}
    for name, df in parts.items():
        write_jsonl(df, f"{folder}/{name}.jsonl")
        counts[name] = spark.read.text(f"{folder}/{name}.jsonl").count()
    files.remove("field_dictionary.json")
    files.write("field_dictionary.json", json.dumps({"fields": list(dictionary)}, ensure_ascii=False))
    manifest = {"schema_version": "v1", "snapshot_date": date, "files": [*({"name": f"{n}.jsonl", "format": "jsonl", "rows": c} for n, c in counts.items()), {"name": "field_dictionary.json", "format": "json", "rows": len(dictionary)}]}
    files.write("_manifest.json", json.dumps(manifest))
    files.put_in_place("_manifest.json", "manifest.json")
    return manifest
