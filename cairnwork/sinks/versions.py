"""Tables that are replaced by a pointer: versions in folders of their own, and a manifest that one rename puts in place.

A table at ``path`` has ``data/``, where each write leaves a new folder with one subfolder a bucket, and ``manifests/``, one
file a version, which names the folder of every bucket. A version exists once its manifest has been renamed from a
temporary name to its number, which fails if another writer took that number. So a write that fails leaves the
version before, a reader keeps the files of the version that it opened, and a frame may be
made of the table that it replaces. Replacing documents rewrites only the buckets that hold them. The
file system must rename without overwriting in one step, as HDFS does; on object stores use a table format.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    """One committed state of a table: where each bucket's files are, and what it was made of."""

    number: int
    schema: str
    key: str
    buckets: int
    folders: Mapping[str, str]
    rows: int
    sources: Mapping[str, int] = field(default_factory=dict)


class _Files:
    """What is needed of Hadoop's file systems under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        where = self.at(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_in_place(self, source: str, target: str) -> None:
        """Renames a file to a name that nothing has yet, in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(self.at(source), self.at(target), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def current(spark: SparkSession, path: str) -> Version | None:
    """The latest version, None if there is none."""
    numbers = versions(spark, path)
    return version(spark, path, numbers[-1]) if numbers else None


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _Files(spark, path).names("manifests") if n.endswith(".json")]


def version(spark: SparkSession, path: str, number: int) -> Version:
    return Version(**json.loads(_Files(spark, path).read(f"manifests/{number:012d}.json")))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is given; later commits don't change what the frame reads."""
    at = version(spark, path, number) if number is not None else current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no version at {path}")
    return _rows(spark, path, at, at.folders.values())


def _rows(spark: SparkSession, path: str, at: Version, folders: Sequence[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(at.schema))
    paths = [f"{path.rstrip('/')}/data/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(df: DataFrame, path: str, key: str, buckets: int = 16, expected: int | None = None, sources: Mapping[str, int] | None = None) -> Version:
    """Writes ``df`` as the next version of the whole table, dealt into buckets by ``key``.

    ``expected`` is the version that ``df`` was made from (0: none yet); if another one has come since, nothing
    changes and ``Conflict`` is raised. Null keys share a bucket.
    """
    base = current(df.sparkSession, path)
    return _committed(df, path, key, buckets, base, base.number if base and expected is None else expected or 0, {}, 0, sources or {})


def replace_documents(rows: DataFrame, path: str, required: Sequence[str] = ()) -> Version:
    """The next version of a table, in which the keys of ``rows`` have these rows and no others; buckets without such keys keep their files.

    Rows that lack a required value or the key are an error that says how many there are, and nothing changes.
    """
    spark = rows.sparkSession
    base = current(spark, path)
    if base is None:
        raise FileNotFoundError(f"no version at {path}")
    missing = rows.where(" OR ".join(f"`{c}` IS NULL" for c in dict.fromkeys([base.key, *required]))).count()
    if missing:
        raise ValueError(f"{missing} rows without {', '.join(dict.fromkeys([base.key, *required]))}")
    touched = sorted(r[0] for r in rows.select(_bucket(base.key, base.buckets)).distinct().collect())  # at most the buckets
    old = _rows(spark, path, base, [base.folders[str(b)] for b in touched if str(b) in base.folders])
    kept = old.join(rows.select(base.key).distinct(), base.key, "left_anti").select(*old.columns)
    kept_folders = {b: f for b, f in base.folders.items() if int(b) not in touched}
    untouched = _rows(spark, path, base, kept_folders.values()).count() if kept_folders else 0
    return _committed(kept.unionByName(rows.select(*old.columns)), path, base.key, base.buckets, base, base.number, kept_folders, untouched, base.sources)


def refresh_view(spark: SparkSession, view: str, sources: Sequence[str], build: Callable[..., DataFrame], key: str, buckets: int = 16) -> tuple[Version, bool]:
    """(the view's version, whether it was made anew): ``build`` of the sources' current versions, which the view's manifest names.

    A view that is already made of these versions is left as it is. Readers see the view before or after.
    """
    pinned = {s: current(spark, s) for s in sources}
    gone = [s for s, v in pinned.items() if v is None]
    if gone:
        raise FileNotFoundError(f"no version at {', '.join(gone)}")
    base, wanted = current(spark, view), {s: v.number for s, v in pinned.items()}
    if base and dict(base.sources) == wanted:
        return base, False
    made = build(*[_rows(spark, s, v, v.folders.values()) for s, v in pinned.items()])
    return commit(made, view, key, buckets, base.number if base else 0, wanted), True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes the manifests before the last ``keep`` versions and the folders that no kept one names; returns their names."""
    if keep < 1:
        raise ValueError("keep at least one version")
    files, numbers = _Files(spark, path), versions(spark, path)
    kept = [version(spark, path, n) for n in numbers[-keep:]]
    for number in numbers[:-keep]:
        files.remove(f"manifests/{number:012d}.json")
    used = {f.split("/")[0] for v in kept for f in v.folders.values()}
    # a folder of a write that is still under way has no manifest yet: its number is above the last version
    gone = [f for f in files.names("data") if f not in used and int(f.split("-")[0]) <= numbers[-1]]
    for name in gone:
        files.remove(f"data/{name}")
    return gone


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(BUCKET)


def _committed(df: DataFrame, path: str, key: str, buckets: int, base: Version | None, expected: int, folders: Mapping[str, str], rows: int, sources: Mapping[str, int]) -> Version:
    spark, files = df.sparkSession, _Files(df.sparkSession, path)
    if (base.number if base else 0) != expected:
        raise Conflict(f"version {base.number if base else 0} is there, made from {expected}")
    folder, counted = f"{expected + 1:012d}-{uuid.uuid4().hex}", Observation()
    try:
        dealt = df.select("*", _bucket(key, buckets)).repartition(BUCKET).observe(counted, F.count(F.lit(1)).alias("rows"))
        dealt.write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/data/{folder}")
    except PySparkException:
        files.remove(f"data/{folder}")
        raise
    written = {n.split("=")[1]: f"{folder}/{n}" for n in files.names(f"data/{folder}") if n.startswith(f"{BUCKET}=")}
    new = Version(expected + 1, df.schema.json(), key, buckets, {**folders, **written}, rows + counted.get["rows"], dict(sources))
    files.write(f"manifests/_{folder}", json.dumps(new.__dict__))
    try:
        files.put_in_place(f"manifests/_{folder}", f"manifests/{new.number:012d}.json")
    except Exception as error:
        files.remove(f"manifests/_{folder}")
        files.remove(f"data/{folder}")
        if new.number in versions(spark, path):
            raise Conflict(f"version {new.number} came meanwhile") from error
        raise
    return new
