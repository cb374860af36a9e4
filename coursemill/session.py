"""Session construction and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_fallback: dict[str, str] = {}
#: The lists of the runs that this thread is in, see own_writes().
_runs: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())


def build_session(master: str = "local[8]", app: str = "coursemill", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; extra settings override."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="coursemill-")
    return _fallback[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/coursemill/{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    for run in _runs.get():
        run.append(path)
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage at a copy that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def release(*stashed: DataFrame) -> None:
    """Remove what stash() wrote, once nothing will read it again."""
    for df in stashed:
        _remove(df.sparkSession, df.stash_path)


@contextmanager
def own_writes() -> Iterator[list[str]]:
    """The paths that this thread's new_path() gives inside; runs of other threads have lists of their own."""
    paths: list[str] = []
    mark = _runs.set((*_runs.get(), paths))
    try:
        yield paths
    finally:
        _runs.reset(mark)


def release_paths(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Remove what a run has written, but for ``keep``, which stash() wrote."""
    for path in paths:
        if path != keep.stash_path:
            _remove(spark, path)


class Bucketed:
    """A frame written once to the shared folder as a table bucketed by a column, so that steps which group by the column read it without moving it. ``kind``: a column whose values have files of their own, and can be removed one by one."""

    def __init__(self, df: DataFrame, label: str, by: str, buckets: int, kind: str | None = None):
        self.spark, self.path, self.kind = df.sparkSession, new_path(df.sparkSession, label), kind
        self.name = f"coursemill_{label}_{uuid.uuid4().hex}"
        writer = df.write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, by).format("parquet")
        (writer.partitionBy(kind) if kind else writer).saveAsTable(self.name)

    def remove(self, value: object) -> None:
        """Remove the rows of one kind, once nothing will read them again."""
        _remove(self.spark, f"{self.path}/{self.kind}={value}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table and remove its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _remove(self.spark, self.path)


#: A side of a join is broadcast up to so many narrow rows (some MB).
BROADCAST_ROWS = 300_000


def small_side(stashed: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stashed side of a join, marked for broadcast if its counted rows are few; beyond that the join shuffles."""
    return F.broadcast(stashed) if stashed.count() <= most else stashed


def large_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the students: it is shuffled and merged, however small its packed files or Spark's guess of it."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that Python functions can be imported there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="coursemill-ship-"), "coursemill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
