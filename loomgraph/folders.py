"""Small files next to tables, on any file system that Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def join(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def _fs(spark: SparkSession, path: str):
    there_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there_


def there(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file at once: written beside, then renamed over the old one."""
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Every file below a folder, by its path from there."""
    fs, p = _fs(spark, path)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        found.append(each.next().getPath().toUri().getPath().removeprefix(base))
    return sorted(found)
