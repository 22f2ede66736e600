"""Session helpers: table reading, the shared folder and tables written to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Gives the tasks this package, once a session, where neither PYTHONPATH nor the working folder has it."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == _PACKAGE.parent for p in places) or spark.conf.get("feedloom.shipped", "") == spark.sparkContext.applicationId:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-feedloom-')}/{_PACKAGE.name}", "zip", _PACKAGE.parent, _PACKAGE.name)
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("feedloom.shipped", spark.sparkContext.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; a missing folder is Spark's own error."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a
    temporary folder of this machine is made and kept for the session.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("feedloom.local.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-feedloom-")
        spark.conf.set("feedloom.local.dir", named)
    return named.rstrip("/")


def open_shared(path: str):
    """A file of the shared folder, opened for reading within a task."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(url.path))
    fs, where = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(where)


#: Paths made for each open ``scratch``, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written within, at its end: run the action, not only the query, inside it.

    Without it they stay in the shared folder, since a result may be read at any later time.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back: survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
