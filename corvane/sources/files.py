"""Folders of text files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import EXTENSIONS
from corvane.functions.text import base_name, extension, glob_match

FILES = "rel string, ext string, file_hash string, text string, n_bytes long"


def scan_folder(spark: SparkSession, folder: str, glob: str = "*", extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """``(rel, ext, file_hash, text, n_bytes)`` of the folder's files, recursively.

    ``glob`` applies to base names, extensions to their lower-case suffix.  Bytes that aren't
    UTF-8 become U+FFFD.  Files that can't be read are passed over.  A missing folder or a file raises FileNotFoundError or NotADirectoryError.  Zero-length
    files, which Spark's binary source leaves out, have no chunk and aren't listed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)
    root = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    empty = not fs.listFiles(path, True).hasNext()
    if empty:
        return spark.createDataFrame([], FILES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    place = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    raw = raw.withColumn("rel", F.substr(place, F.lit(len(root) + 1))).withColumn("name", base_name("rel"))
    raw = raw.withColumn("ext", extension("name")).where(F.col("ext").isin(*extensions) & glob_match("name", glob))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select("rel", "ext", F.sha2("content", 256).alias("file_hash"), text.alias("text"), F.col("length").alias("n_bytes"))


def scan_table(df: DataFrame, rel: str, text: str, ext: str = ".txt") -> DataFrame:
    """The same columns from a table of texts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(rel).cast("string").alias("rel"), F.lit(ext).alias("ext"), F.sha2(t, 256).alias("file_hash"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
