"""Small text files in a shared folder that readers see whole or not at all (through Hadoop's FileContext).

A file is written under a name of its own and then renamed.  The rename is atomic on HDFS and on local disks; on object
stores without an atomic rename, name a store that has one (or a committer's staging folder) for such files.
"""

from __future__ import annotations

import uuid
from typing import List, Optional

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _context(spark: SparkSession, path):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = path.getFileSystem(conf).makeQualified(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf), qualified


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    jvm, target = spark.sparkContext._jvm, _path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not replace and fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    aside = _path(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context, source = _context(spark, aside)
    _, goal = _context(spark, target)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        context.rename(source, goal, options)
    except Exception:
        # Another writer was first; what it wrote stays.
        if replace or not fs.exists(target):
            raise
        fs.delete(aside, False)
        return False
    return True


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file; False, and nothing changed, where it exists already."""
    return _put(spark, path, text, replace=False)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Create the file or put it in the place of the old one; a reader sees the old text or the new, never part of it."""
    _put(spark, path, text, replace=True)


def read_text(spark: SparkSession, path: str) -> Optional[str]:
    """The file's text; None where there is no such file."""
    target = _path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> List[str]:
    """Names of the complete files in a folder, sorted; none where there is no folder."""
    target = _path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return sorted(name for s in fs.listStatus(target) if not (name := s.getPath().getName()).startswith("."))
