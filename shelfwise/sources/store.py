"""Small files and folders on whatever file system a path lies on, through Spark's own Hadoop client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    if not exists(spark, path):
        return None
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over the old one, so a reader finds the old text or the new."""
    jvm, aside = spark._jvm, f"{path}-{uuid.uuid4().hex}"
    stream = _files(spark, path).create(_path(spark, aside), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _files(spark, path).getUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(_path(spark, aside), _path(spark, path), how)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path)) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files in a folder, without markers and checksums."""
    if not exists(spark, path):
        return []
    found = [s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path)) if s.isFile()]
    return sorted(name for name in found if name[0] not in "._")


def make(spark: SparkSession, path: str) -> None:
    """Make a folder if it is not there."""
    _files(spark, path).mkdirs(_path(spark, path))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder or file to a place that is free; the folder above it is made if need be."""
    target_path = _path(spark, target)
    fs = _files(spark, target)
    fs.mkdirs(target_path.getParent())
    if fs.exists(target_path) or not fs.rename(_path(spark, source), target_path):
        raise OSError(f"{source} could not be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
