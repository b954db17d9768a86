"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side already hashed on a subset of the join keys (ticker out of date+ticker) is not shuffled again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The JVM only interprets methods beyond 8000 bytes; wide factor rows are faster in split methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the Python call site of every column expression slows the building of wide plans.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}

_local_dirs: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(app: str = "quantloom", cpus: int | str = "*", memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own session and calls `configure`."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder stands in only for a local session, where one machine runs everything.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="quantloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh, unused location under the shared folder."""
    return f"{shared_dir(spark)}/quantloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system, which is that of the data wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, ascending; none where there is no such folder."""
    where, files = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove the shuffle files of what is run inside as soon as it ends, not when the driver next collects garbage."""
    before = spark.conf.get(RELEASE_KEY, None)
    spark.conf.set(RELEASE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE_KEY) if before is None else spark.conf.set(RELEASE_KEY, before)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` once and read it back.

    Several later passes then share one computation, a lost executor costs a re-read and not a re-run, and Spark
    knows the real size, so that its own threshold decides whether a join side is broadcast. The shuffle files of the
    write are removed with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove the files of tables returned by `materialize`, when all that is computed from them has been written."""
    for table in tables:
        where, files = _file_system(table.sparkSession, _written.pop(table))
        files.delete(where, True)
