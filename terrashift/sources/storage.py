"""Tables in the folder that all executors share, and results that are published whole or not at all."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COMPLETE = "COMPLETE"
VERSION = "version-"
STAGING = "_staging-"  # Spark's readers skip names that begin with an underscore


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrashift-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage is cut, and the optimiser knows its true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop's objects."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def _removed(spark: SparkSession, path: str) -> None:
    try:
        fs, where = _fs(spark, path)
        fs.delete(where, True)
    except Exception as err:  # at exit the session may be gone
        if "Connection refused" not in str(err) and "Py4J" not in type(err).__name__ and not isinstance(err, (AttributeError, AssertionError)):
            raise


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The names of the folders in ``path`` that begin with ``prefix``; none where there is no such path."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def is_complete(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/{COMPLETE}")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions below ``path``, the oldest first."""
    return [v for v in folders(spark, path, VERSION) if is_complete(spark, f"{path}/{v}")]


def current(spark: SparkSession, path: str, part: str = "") -> str:
    """The folder of the newest complete version, or of one of its parts; what was never finished is never seen."""
    if not (held := versions(spark, path)):
        raise FileNotFoundError(f"nothing complete is published at {path}")
    return f"{path}/{held[-1]}" + (f"/{part}" if part else "")


def marker(spark: SparkSession, path: str) -> dict:
    """What the marker of the newest complete version says."""
    return json.loads("\n".join(r.value for r in spark.read.text(f"{current(spark, path)}/{COMPLETE}").collect()))


def publish(spark: SparkSession, path: str, parts: dict[str, Callable[[str], None]], note: dict | None = None, keep: int = 2) -> str:
    """Write all ``parts`` (name -> a function that writes into a folder) as one new version of ``path``; return its folder.

    Parts are written aside. When all are there the folder is renamed to a
    version of its own, and its marker, with ``note`` and the parts' names, is
    created last. A failure at any point leaves the former version current, a
    rename that is no single step (an object store) too, as readers ask for the
    marker. The newest ``keep`` versions stay, so that readers of the former one
    can finish; what broken runs left goes.
    """
    for left in folders(spark, path, STAGING):
        _removed(spark, f"{path}/{left}")
    aside = f"{path}/{STAGING}{uuid.uuid4().hex}"
    try:
        for name, write in parts.items():
            write(f"{aside}/{name}")
    except BaseException:
        _removed(spark, aside)
        raise
    number = max([int(v[len(VERSION) :].split("-")[0]) for v in folders(spark, path, VERSION)], default=0) + 1
    folder = f"{path}/{VERSION}{number:08d}-{uuid.uuid4().hex[:8]}"
    fs, source = _fs(spark, aside)
    if not fs.rename(source, _fs(spark, folder)[1]):
        raise OSError(f"{aside} could not be renamed to {folder}")
    out = fs.create(_fs(spark, f"{folder}/{COMPLETE}")[1], False)
    try:
        out.write(bytearray(json.dumps({"parts": sorted(parts), **(note or {})}, sort_keys=True).encode()))
    finally:
        out.close()
    held = versions(spark, path)
    for old in folders(spark, path, VERSION):
        if old < held[-1] and old not in held[-max(1, keep) :]:
            _removed(spark, f"{path}/{old}")
    return folder
