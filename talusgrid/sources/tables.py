"""Tables as CSV and JSON, and results that are made once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share.

    Without that setting a ``local`` session gets a temporary folder; on a
    cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talusgrid-")
    return f"{folder.rstrip('/')}/talusgrid/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: later reads start from the files.

    The files' path is added to ``paths``, for ``delete``.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """The files at and below ``path`` go; nothing happens if there are none."""
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def read_csv(spark: SparkSession, path: str, text: tuple[str, ...] = ("pk",)) -> DataFrame:
    """A CSV file with a header; types are inferred but for the columns of ``text``, which stay strings.

    Keys that are compared with entries of event lists have to be strings: a
    key read as a number would never equal one.
    """
    guessed = spark.read.csv(path, header=True, inferSchema=True).schema
    names = ", ".join(f"`{f.name}` {'string' if f.name in text else f.dataType.simpleString()}" for f in guessed)
    return spark.read.schema(names).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header below ``path``; nulls are empty."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines below ``path``; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; ``make`` runs and is written only if nothing complete is there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
