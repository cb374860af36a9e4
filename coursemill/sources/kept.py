"""Results kept under a fingerprint of the files and parameters that they come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coursemill.session import new_path, remove_at_exit, shared_dir, stash

#: A session setting: with ``true``, kept results outlive the driver and serve later ones too.
KEEP_SETTING = "spark.coursemill.keep"


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]] | None:
    """(path, bytes, time of change) of a file, or of all files of a folder, in order; None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    if system.getFileStatus(target).isFile():
        found = [system.getFileStatus(target)]
    else:
        files, found = system.listFiles(target, True), []
        while files.hasNext():
            found.append(files.next())
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def fingerprint(spark: SparkSession, label: str, paths: list[str], params: dict[str, object]) -> str | None:
    """A hash that changes when a file is added, removed, written anew or of another length, or when a parameter changes; None if a path does not exist."""
    files = [file_states(spark, p) for p in sorted(paths)]
    if None in files:
        return None
    state = [label, files, sorted((k, repr(v)) for k, v in params.items())]
    return hashlib.sha256(json.dumps(state).encode()).hexdigest()


def kept(spark: SparkSession, label: str, paths: list[str], build: Callable[[], DataFrame], **params: object) -> DataFrame:
    """What ``build`` gives, computed at the first call for the state of ``paths`` and these parameters, and read after that.

    It is written to the shared folder, and stands there once its _SUCCESS mark does, so that a driver
    that ends early leaves nothing that would be taken for a result. Two drivers that build the same
    at once write the same rows; the later one finds the earlier one's mark and reads that. Where a
    path does not exist, as the rows come from elsewhere, nothing is kept.
    """
    mark = fingerprint(spark, label, paths, params)
    if mark is None:
        return stash(build(), label)
    path = f"{shared_dir(spark)}/coursemill/kept/{label}-{mark}"
    if not _done(spark, path):
        df = build()
        if not _done(spark, path):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if spark.conf.get(KEEP_SETTING, "false") != "true":
            remove_at_exit(spark, path)
    return spark.read.parquet(path)


def _done(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def kept_model(spark: SparkSession, label: str, paths: list[str], fit: Callable[[], object | None], kind: type, **params: object) -> object | None:
    """A fitted Spark ML model, fitted at the first call for the state of ``paths`` and these parameters, and loaded after that.

    It is saved under a name of its own and then renamed, so that a path holds a whole model or none.
    kind: the model's class. What can't be fitted (None) isn't kept.
    """
    mark = fingerprint(spark, label, paths, params)
    if mark is None:
        return fit()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/coursemill/kept/{label}-{mark}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        model = fit()
        if model is None:
            return None
        saved = new_path(spark, label)
        model.save(saved)
        system.mkdirs(path.getParent())
        system.rename(jvm.org.apache.hadoop.fs.Path(saved), path)
        if spark.conf.get(KEEP_SETTING, "false") != "true":
            remove_at_exit(spark, path.toString())
    return kind.load(path.toString())
