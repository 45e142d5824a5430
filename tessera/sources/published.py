"""Write-once results: all rows or none, and never twice.

An attempt writes its rows to a folder of its own below the target, under a name that readers skip. Its marker is then moved to the target's
marker, which the file system refuses if there is one: that move is the publication. Readers go by the marker, so an attempt that was killed, or came
second, leaves nothing that they see; `clear` takes such leavings away. All through Spark and the Hadoop file system of the path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKER = "_PUBLISHED"


def _files(spark: SparkSession, path: str):
    """The path's file system, and how to make a Path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file to a name that nothing has; whether that was so."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(source).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(make(source), make(target), options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def is_published(spark: SparkSession, target: str) -> bool:
    fs, make = _files(spark, target)
    return fs.exists(make(f"{target}/{MARKER}"))


def publish(rows: DataFrame, target: str, note: dict | None = None, partition_by: list[str] | None = None) -> None:
    """Publishes rows, with a note, as the result of that name. FileExistsError if it has one already, before or after the rows are written."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    if is_published(spark, target):
        raise FileExistsError(target)
    folder = f"{target}/_attempts/{attempt}"
    rows.write.partitionBy(*partition_by or []).parquet(folder)
    fs, make = _files(spark, target)
    out = fs.create(make(f"{folder}.marker"), False)
    try:
        out.write(bytearray(json.dumps({"attempt": attempt, "schema": rows.schema.jsonValue(), "note": note or {}}).encode()))
    finally:
        out.close()
    if not _move(spark, f"{folder}.marker", f"{target}/{MARKER}"):
        clear(spark, target)
        raise FileExistsError(target)


def _marker(spark: SparkSession, target: str) -> dict:
    if not is_published(spark, target):
        raise FileNotFoundError(target)
    fs, make = _files(spark, target)
    stream = fs.open(make(f"{target}/{MARKER}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def note_of(spark: SparkSession, target: str) -> dict:
    return _marker(spark, target)["note"]


def read(spark: SparkSession, target: str) -> DataFrame:
    """The published rows. FileNotFoundError if there are none."""
    marker = _marker(spark, target)
    return spark.read.schema(StructType.fromJson(marker["schema"])).parquet(f"{target}/_attempts/{marker['attempt']}")


def clear(spark: SparkSession, target: str) -> None:
    """Deletes what attempts other than the published one have left. Not while one may still be at work."""
    fs, make = _files(spark, target)
    keep = _marker(spark, target)["attempt"] if is_published(spark, target) else None
    for f in fs.listStatus(make(f"{target}/_attempts")) if fs.exists(make(f"{target}/_attempts")) else []:
        if f.getPath().getName() != keep:
            fs.delete(f.getPath(), True)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, make = _files(spark, path)
    fs.delete(make(path), True)
