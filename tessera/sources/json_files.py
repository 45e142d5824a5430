"""JSON records in folders: a recursive scan with the file that each record comes from, and the catalogue of such folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of all JSON files below the folder with the columns of the schema, missing ones null, and `file`, relative to the folder.

    Files are found by Spark, links outside the folder included in none: the path has to lie below it.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    inside = F.substring_index("_metadata.file_path", folder.rstrip("/").rpartition(":")[2].lstrip("/") + "/", -1)
    return rows.select("*", inside.alias("file"))


def catalogue(records: DataFrame) -> DataFrame:
    """(run, files, records) for each folder that holds files."""
    run = F.regexp_replace("file", "/[^/]*$", "")
    return records.groupBy(run.alias("run")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("records"))
