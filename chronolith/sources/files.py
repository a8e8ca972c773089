"""Files of a working tree, with the identifiers that the version control gives their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blob_id(content: Column) -> Column:
    """The content-addressed name of a blob."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, blob, content) of the files below `root`; paths are relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")), f"^.*?{base.replace('.', '[.]')}/", "")
    return rows.select(path.alias("path"), blob_id(F.col("content")).alias("blob"), "content")


def imports_of(blobs: DataFrame, state: DataFrame) -> DataFrame:
    """(path, target): the import targets of each current file, from its content's metrics."""
    return state.select("path", "blob").join(blobs.select("blob", F.explode("imports").alias("target")), "blob").select("path", "target").distinct()
