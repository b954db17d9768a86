"""Parquet tables with atomic commits: data files never change, and a log of numbered entries tells which ones count.

A table is a folder. Each write puts its files in a folder of its own, `commit=<name>/`, with a folder for each value of
the partition column where there is one. When they are complete, one small entry is added to `_log/`: the schema and, for
each partition folder, the commits that hold its live files. The entry appears under its number by a rename that fails
where the number is taken, so a commit is there whole or not at all, and of two writers that started from the same entry
one has to start again. Readers follow the newest entry. A job that is lost half-way leaves files that no entry names.

Entries grow with the number of partitions, not of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import _file_system, children

LOG = "_log"
COMMIT = "commit"
#: Times that a commit starts again because another writer was faster.
ATTEMPTS = 10


class LostRace(RuntimeError):
    """Another writer has committed the next entry."""


@dataclass(frozen=True)
class Snapshot:
    """An entry: its number, schema, partition column, and for each partition folder ("" if none) its live commits.

    `batches` are the names of batches that have been appended once and for all.
    """

    path: str
    version: int
    schema: StructType
    partition: str | None
    live: dict[str, list[str]] = field(default_factory=dict)
    batches: tuple[str, ...] = ()

    def read(self, spark: SparkSession, folders: Sequence[str] | None = None) -> DataFrame:
        """The live rows, or those of some partition folders; columns that a file lacks are NULL."""
        names = [f"{self.path}/{COMMIT}={c}/{p}".rstrip("/") for p, commits in sorted(self.live.items()) if folders is None or p in folders for c in commits]
        if not names:
            return spark.createDataFrame([], self.schema)
        full = StructType([*self.schema.fields, StructField(COMMIT, StringType())])
        return spark.read.schema(full).option("basePath", self.path).parquet(*names).drop(COMMIT).select(*self.schema.fieldNames())

    def with_folders(self, spark: SparkSession) -> DataFrame:
        """The live rows' keys to work with: all columns and `_folder`, the partition folder a row lies in."""
        names = [f"{self.path}/{COMMIT}={c}/{p}".rstrip("/") for p, commits in sorted(self.live.items()) for c in commits]
        if not names:
            return spark.createDataFrame([], self.schema).withColumn("_folder", F.lit(""))
        full = StructType([*self.schema.fields, StructField(COMMIT, StringType())])
        stored = spark.read.schema(full).option("basePath", self.path).parquet(*names)
        place = F.regexp_extract("_metadata.file_path", f"/{COMMIT}=[^/]+/(?:(.+)/)?[^/]+$", 1)
        return stored.withColumn("_folder", place).drop(COMMIT)


def newest(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest entry of a table, or the one of a number; None where there is no table."""
    path = path.rstrip("/")
    numbers = [int(n.removesuffix(".json")) for n in children(spark, f"{path}/{LOG}") if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers or version is not None and version not in numbers:
        return None
    number = max(numbers) if version is None else version
    where, files = _file_system(spark, f"{path}/{LOG}/{number:012d}.json")
    stream = files.open(where)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    entry = json.loads(text)
    return Snapshot(path, number, StructType.fromJson(entry["schema"]), entry["partition"], entry["live"], tuple(entry["batches"]))


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table's rows as of its newest entry, or of an earlier one."""
    found = newest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no table at {path}" + (f" with an entry {version}" if version is not None else ""))
    return found.read(spark)


def write_files(df: DataFrame, path: str, partition: str | None) -> dict[str, list[str]]:
    """Write rows as a commit's files; nothing counts yet. Returns the partition folders and the commit's name."""
    name = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{COMMIT}={name}"
    if partition:
        df.hint("rebalance", partition).write.partitionBy(partition).parquet(folder)
        return {child: [name] for child in children(df.sparkSession, folder) if "=" in child}
    df.write.parquet(folder)
    return {"": [name]}


def publish(spark: SparkSession, entry: Snapshot) -> Snapshot:
    """Add an entry to the log under its number; `LostRace` if the number is taken."""
    text = json.dumps({"schema": entry.schema.jsonValue(), "partition": entry.partition, "live": entry.live, "batches": list(entry.batches)})
    target, files = _file_system(spark, f"{entry.path}/{LOG}/{entry.version:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{entry.path}/{LOG}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    qualified = files.makeQualified
    try:
        context.rename(qualified(draft), qualified(target), options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            raise LostRace(f"entry {entry.version} of {entry.path} is taken") from None
        raise
    return entry


def change(spark: SparkSession, path: str, make: Callable[[Snapshot | None], Snapshot | None]) -> Snapshot | None:
    """Commit what `make` builds on the newest entry, from the start again as often as another writer is faster.

    `make` writes files and returns the entry to add, without its number, or None if nothing is to change.
    """
    for _ in range(ATTEMPTS):
        before = newest(spark, path)
        entry = make(before)
        if entry is None:
            return before
        try:
            return publish(spark, replace(entry, version=before.version + 1 if before else 0))
        except LostRace:
            continue
    raise LostRace(f"{path}: {ATTEMPTS} commits in a row were too late")


def merged_schema(before: Snapshot | None, df: DataFrame) -> StructType:
    """The table's columns, then those of `df` that it lacks; all may be NULL."""
    fields = [*(before.schema.fields if before else []), *(f for f in df.schema.fields if before is None or f.name not in before.schema.fieldNames())]
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in fields])


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> Snapshot:
    """Replace a table's rows; a reader sees the old ones or the new ones."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = write_files(df, path, partition)
    return change(spark, path, lambda before: Snapshot(path, 0, merged_schema(None, df), partition, fresh, before.batches if before else ()))


def overwrite_folder(df: DataFrame, path: str, partition: str, folder: str) -> Snapshot:
    """Replace the rows of one partition folder, `df` having no others; other folders stay as they are."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = write_files(df, path, partition)
    if set(fresh) - {folder}:
        raise ValueError(f"rows of {sorted(set(fresh) - {folder})} beside those of {folder}")

    def make(before: Snapshot | None) -> Snapshot:
        kept = {p: c for p, c in (before.live if before else {}).items() if p != folder}
        return Snapshot(path, 0, merged_schema(before, df), partition, kept | fresh, before.batches if before else ())

    return change(spark, path, make)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a named batch to a table without partitions, once: a batch that is there already changes nothing.

    Returns whether this call has added it. Of two writers of one batch the first counts.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before = newest(spark, path)
    if before and batch in before.batches:
        return False
    fresh = write_files(df, path, None)[""]

    def make(before: Snapshot | None) -> Snapshot | None:
        if before and batch in before.batches:
            return None
        live = {"": [*(before.live.get("", []) if before else []), *fresh]}
        return Snapshot(path, 0, merged_schema(before, df), None, live, (*(before.batches if before else ()), batch))

    return fresh[0] in change(spark, path, make).live.get("", [])


def compact(spark: SparkSession, path: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> Snapshot | None:
    """Write the live rows anew as one commit, after `rows` (say, a sum by key); batch names stay known."""

    def make(before: Snapshot | None) -> Snapshot | None:
        if before is None:
            return None
        return replace(before, live=write_files(rows(before.read(spark)), path.rstrip("/"), before.partition))

    return change(spark, path, make)


def remove_unused(spark: SparkSession, path: str, keep: int = 10, older_than_hours: float = 24.0) -> list[str]:
    """Delete the files that none of the last `keep` entries names, and earlier entries. Returns the commits that went.

    Files younger than `older_than_hours` stay, as a running write may be about to commit them.
    """
    path = path.rstrip("/")
    now = newest(spark, path)
    if now is None:
        return []
    kept = [newest(spark, path, v) for v in range(max(0, now.version - keep + 1), now.version + 1)]
    named = {c for entry in kept if entry for commits in entry.live.values() for c in commits}
    gone = []
    root, files = _file_system(spark, path)
    youngest = spark._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{COMMIT}=") and name.partition("=")[2] not in named and status.getModificationTime() <= youngest:
            files.delete(status.getPath(), True)
            gone.append(name.partition("=")[2])
    for name in children(spark, f"{path}/{LOG}"):
        if name.endswith(".json") and int(name.removesuffix(".json")) < now.version - keep + 1:
            files.delete(_file_system(spark, f"{path}/{LOG}/{name}")[0], False)
    return gone


def decoded(folders: Sequence[str]) -> set[str]:
    """Folder names as they are on disk, from parts of file URIs."""
    return {unquote(f) for f in folders}
