"""Numbered files of a folder, each created once: the order in which writers have ended.

A number's file is created only where none is, so two writers can't both have it, and
its text is whole once it ends in a line end. Nothing is ever replaced: a reader finds
the state before or the one after.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Overtaken(RuntimeError):
    """Another writer has ended first."""


def hadoop(spark: SparkSession, path: str):
    """The file system and the path, as Hadoop has them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """All numbers taken, in order."""
    fs, target = hadoop(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n) for n in names if n.isdigit())


def read(spark: SparkSession, folder: str, number: int) -> str | None:
    """The text of a number; none if its writer has not ended, or never will."""
    fs, target = hadoop(spark, f"{folder}/{number}")
    opened = fs.open(target)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    opened.close()
    return text.removesuffix("\n") if text.endswith("\n") else None


def last(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The greatest number whose text is whole."""
    for n in reversed(numbers(spark, folder)):
        text = read(spark, folder, n)
        if text is not None:
            return n, text
    return None


def append(spark: SparkSession, folder: str, text: str, above: int | None = None) -> int:
    """Create the next number with ``text``; refused if a whole number is greater than ``above``, where that is given."""
    fs, _ = hadoop(spark, folder)
    while True:
        if above is not None and (last(spark, folder) or (0, ""))[0] != above:
            raise Overtaken(f"{folder}: {above} is not the last number any more")
        number = max(numbers(spark, folder), default=0) + 1
        try:
            out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            continue
        out.write(bytearray(f"{text}\n".encode()))
        out.close()
        return number
