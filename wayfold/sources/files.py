"""Folders with a log of commits: what a writer adds is seen once its entry has a number, and a number is given once.

Data files have names of their own and never change. An entry is written aside and then renamed to its number, which fails if another
writer had it first; file systems rename in one step (HDFS, local disks), so readers see whole entries.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer committed first what this one was based on."""


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def last_number(spark: SparkSession, folder: str) -> int:
    """The number of the last entry; 0 if there is none."""
    system, place = _place(spark, f"{folder}/log")
    found = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    return max((int(n) for n in found if n.isdigit()), default=0)


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    system, place = _place(spark, f"{folder}/log/{number:012d}")
    stream = system.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Write the entry with this number, or raise ``Conflict`` if there is one."""
    system, aside = _place(spark, f"{folder}/log/.{uuid.uuid4().hex}")
    stream = system.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log/{number:012d}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, target, spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        system.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
            raise Conflict(f"version {number} of {folder} was committed by another writer") from None
        raise


def deleted(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def own_name(folder: str, kind: str) -> str:
    """A path in the folder that nothing else has."""
    return f"{folder}/{kind}-{uuid.uuid4().hex}"
