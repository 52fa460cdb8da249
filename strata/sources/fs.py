"""Filesystem steps that a load needs between Spark writes (exists, rename, delete).

These go through the Hadoop FileSystem of the session, so they work the same on local
disk, HDFS or an object store, and never touch data rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if not fs.rename(s, d):
        raise IOError(f"rename {src} -> {dst} failed")


def siblings(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern (a handful of directory names, never data files)."""
    fs, p = _fs(spark, pattern)
    return sorted(str(f.getPath()) for f in (fs.globStatus(p) or ()))


def rename_new(spark: SparkSession, src: str, dst: str) -> None:
    """Renames a file to a name that is not taken yet; FileExistsError where it is."""
    _, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    sc = spark.sparkContext
    jvm, kind = sc._jvm, getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(s.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(s, d, sc._gateway.new_array(kind, 0))
    except Exception as e:
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
            raise FileExistsError(dst) from None
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
