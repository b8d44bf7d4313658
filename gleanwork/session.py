"""Session settings, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def session(app: str = "gleanwork", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; every other setting is the cluster's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def attach(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        # Spark itself serves the file to the executors; the driver alone reads this copy
        folder = tempfile.mkdtemp(prefix="gleanwork-")
        path = os.path.join(folder, "gleanwork.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as one of its own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, gone when the application ends. Where that is unset, in a temporary folder, but only for a
    driver that is its own executor: machines of a cluster share none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="gleanwork-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, where = filesystem(spark, path)
    fs.deleteOnExit(where)
    return path


def written(df, name: str):
    """df written to the scratch folder and read from there: what a write needs several times is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = filesystem(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, where = filesystem(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)
