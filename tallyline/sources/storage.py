"""Directories and small files on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def _children(spark: SparkSession, path: str) -> list:
    fs, hadoop_path = _file_system(spark, path)
    return list(fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def child_directories(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories directly below ``path``."""
    return sorted(s.getPath().getName() for s in _children(spark, path) if s.isDirectory())


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path``."""
    return sorted(s.getPath().getName() for s in _children(spark, path) if s.isFile())


def state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of what lies directly below ``path``."""
    fs, hadoop_path = _file_system(spark, path)
    found = fs.listStatus(hadoop_path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a batch write below ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def matching(spark: SparkSession, root: str, pattern: str) -> dict[str, int]:
    """What the pattern names below ``root``, each path relative to it with its time of change in
    milliseconds; one call for all of them."""
    fs, hadoop_pattern = _file_system(spark, f"{root}/{pattern}")
    depth = pattern.count("/") + 1
    found = fs.globStatus(hadoop_pattern) or []
    return {
        "/".join(s.getPath().toString().rsplit("/", depth)[1:]): s.getModificationTime() for s in found
    }


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a directory whose target does not exist yet, with the folders above it."""
    fs, from_ = _file_system(spark, source)
    _, to = _file_system(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(from_, to):
        raise OSError(f"cannot rename {source} to {target}")


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file; fails if it exists."""
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.create(hadoop_path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()
