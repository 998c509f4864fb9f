"""Small files in the shared file system, through Hadoop's FileSystem so any scheme works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from nearfield.errors import CommitConflictError


def _open(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _open(spark, path)
    return fs.exists(location)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none if the folder is missing."""
    fs, location = _open(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, location = _open(spark, path)
    stream = fs.open(location)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, *, replace: bool) -> None:
    """Write under another name, then rename, so a reader sees all of it or none.

    Without ``replace`` the rename fails if the file is already there, which is how one of two
    writers that finish at once learns that it came second.
    """
    fs, location = _open(spark, path)
    part = location.suffix(f".{uuid.uuid4().hex}._writing")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(location), options)
    except Py4JJavaError as error:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass()):
            raise CommitConflictError(f"{path} was written by someone else") from error
        raise


def delete(spark: SparkSession, path: str) -> bool:
    fs, location = _open(spark, path)
    return fs.delete(location, True)
