"""SRC4: file inventory of clone folders.

``binaryFile`` lists files in parallel; selecting only ``path`` and
``length`` prunes the ``content`` column, so no file body is read.
Unreadable files are skipped via ``ignoreCorruptFiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_file_inventory(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("ignoreCorruptFiles", "true")
            .load(root)
            .select("path", "length"))
