"""Small files in any store that Spark reads, through the session's Hadoop configuration.

For bookkeeping on the driver only: commit records of a few kilobytes. Data is
read and written with DataFrames.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = _fs(spark, path), _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file sources name it."""
    return str(_fs(spark, path).makeQualified(_path(spark, path)).toString())


def matches(spark: SparkSession, pattern: str) -> int:
    """How many paths a pattern finds."""
    return len(_fs(spark, pattern).globStatus(_path(spark, pattern)) or ())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file with its whole content, or returns False because it is there already.

    The content goes to a file of its own first, which then takes the name. Of
    several writers one succeeds: a rename that does not overwrite is atomic in HDFS and
    the stores that keep to its rules; on a mounted file system a hard link is.
    """
    fs, target = _fs(spark, path), _path(spark, path)
    fs.mkdirs(target.getParent())
    draft = _path(spark, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.draft"))
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
            no_overwrite = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(draft, target, no_overwrite)
    except FileExistsError:
        return False
    except Exception as e:  # noqa: BLE001 -- the store's own way to say that the name is taken
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True
