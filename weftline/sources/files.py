"""Small files of any file system that Spark reaches, put in place whole: a reader sees a file as it was or as it is, never part of one."""

from __future__ import annotations

import contextlib
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, p = path_of(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Writes the text beside its place and renames it there. Without ``replace`` a file that is there stays, and the answer is False.

    Local files are renamed by the system and other file systems by their FileContext, which both replace in one step;
    on object stores without such a rename two writers may both be told that theirs is the file.
    """
    fs, target = path_of(spark, path)
    fs.mkdirs(target.getParent())
    if target.toUri().getScheme() == "file":
        return _put_local(unquote(urlparse(target.toUri().toString()).path), text, replace)
    temporary = path_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    if not replace and fs.exists(target):
        fs.delete(temporary, False)
        return False
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, options)
    except Exception:
        fs.delete(temporary, False)
        if replace or not fs.exists(target):
            raise
        return False
    return True


def _put_local(target: str, text: str, replace: bool) -> bool:
    folder, name = os.path.split(target)
    temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp")
    with open(temporary, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    try:
        if replace:
            with contextlib.suppress(FileNotFoundError):
                os.remove(os.path.join(folder, f".{name}.crc"))  # the checksum that Hadoop keeps of the old file
            os.replace(temporary, target)
            return True
        os.link(temporary, target)  # fails if the file is there
    except FileExistsError:
        return False
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(temporary)
    return True
