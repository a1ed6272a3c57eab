"""Files through Spark's file systems, so that paths may be in any store that Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames, over what the target held before.

    A file is replaced in one step. No file system does that for a folder: its old content is set aside first and
    deleted once the new one is in place, and ``recover`` puts it back if a crash came between.
    """
    src, fs = _path(spark, source)
    dst, _ = _path(spark, target)
    if dst.getParent() is not None:
        fs.mkdirs(dst.getParent())
    old = None
    if fs.exists(dst):
        if fs.getFileStatus(src).isFile() and fs.getFileStatus(dst).isFile() and _replace(spark, src, dst):
            return
        old, _ = _path(spark, f"{target}.old-{uuid.uuid4().hex}")
        fs.rename(dst, old)
    if not fs.rename(src, dst):
        if old is not None:
            fs.rename(old, dst)
        raise OSError(f"cannot move {source} to {target}")
    if old is not None:
        fs.delete(old, True)


def _replace(spark: SparkSession, src, dst) -> bool:
    """Renames a file over another in one step; False where the store can't."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    try:
        fs.FileContext.getFileContext(src.toUri(), sc._jsc.hadoopConfiguration()).rename(src, dst, how)
    except Py4JJavaError:
        return False
    return True


def recover(spark: SparkSession, path: str) -> None:
    """Where a folder is missing because a move was cut off, its old content takes its place again."""
    p, fs = _path(spark, path.rstrip("/"))
    if any(c in path for c in "*?[{,") or fs.exists(p) or not fs.exists(p.getParent()):
        return
    aside = [s.getPath() for s in fs.listStatus(p.getParent()) if s.getPath().getName().startswith(f"{p.getName()}.old-")]
    if len(aside) == 1:
        fs.rename(aside[0], p)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file beside the target, then renames it."""
    beside = f"{path}.new-{uuid.uuid4().hex}"
    p, fs = _path(spark, beside)
    out = fs.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()
    move(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    p, fs = _path(spark, path)
    try:
        stream = fs.open(p)
    except Py4JJavaError as error:
        if "FileNotFoundException" in error.java_exception.getClass().getName():
            return None
        raise
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    p, fs = _path(spark, folder)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Puts a whole file where none is; False, and nothing changed, if one is there. One step: of two writers one wins."""
    beside = f"{path}.new-{uuid.uuid4().hex}"
    p, fs = _path(spark, beside)
    target, _ = _path(spark, path)
    fs.mkdirs(target.getParent())
    out = fs.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()
    sc = spark.sparkContext
    try:
        if fs.getUri().getScheme() == "file":  # its rename may replace a file; a link can't
            paths = sc._jvm.java.nio.file.Paths
            own = [paths.get(sc._jvm.org.apache.hadoop.fs.Path(x).toUri().getPath(), sc._gateway.new_array(sc._jvm.java.lang.String, 0)) for x in (beside, path)]
            sc._jvm.java.nio.file.Files.createLink(own[1], own[0])
        else:
            how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(p, target, how)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(p):
            fs.delete(p, False)
    return True


def only_part(spark: SparkSession, folder: str) -> str:
    """The one data file that a single-task write left in a folder."""
    p, fs = _path(spark, folder)
    parts = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise OSError(f"{folder} holds {len(parts)} parts")
    return parts[0]
