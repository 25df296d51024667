"""Files on whatever file system their path names: local, HDFS or an object store, through Hadoop's own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _path(spark, path)
    return system.exists(at)


def status(spark: SparkSession, path: str) -> tuple[int, float]:
    """Bytes of a file, and the second it was last written."""
    system, at = _path(spark, path)
    found = system.getFileStatus(at)
    return found.getLen(), found.getModificationTime() / 1000.0


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the bytes, read as a stream beside the data."""
    system, at = _path(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes."""
    system, at = _path(spark, path)
    stream = system.open(at)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file whole; None where there is none."""
    system, at = _path(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str, temporary: str) -> None:
    """Writes a small file beside its place and renames it over the old one in one step."""
    system, at = _path(spark, path)
    _, beside = _path(spark, temporary)
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(beside), system.makeQualified(at), over)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _path(spark, path)
    system.delete(at, True)


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of a folder's files that end so, in order."""
    system, at = _path(spark, folder)
    return sorted(f.getPath().toString() for f in system.listStatus(at) if f.getPath().getName().endswith(suffix))
