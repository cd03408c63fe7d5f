"""Scans (A1 to A16).  Missing optional inputs give empty relations, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "novel STRING, title STRING, chapters STRUCT<start: BIGINT, end: BIGINT>, path STRING"
PARSER_CONFIG = (
    "ord INT, key STRING, title_selector STRING, para_class STRING, id_offset BIGINT, title_strip_prefix BOOLEAN, chapter_num_from_title BOOLEAN, flat_layout BOOLEAN"
)


def decode(raw: Column, policy: str = "replace") -> Column:
    """A1 ``replace``: UTF-8, bad bytes to U+FFFD.  A2 ``latin1``: UTF-8 if all of it is valid, else Latin-1 for the whole file.

    Line ends become line feeds.
    """
    if policy == "replace":
        text = F.make_valid_utf8(raw.cast("string"))
    elif policy == "latin1":
        text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return F.regexp_replace(text, r"\r\n?", "\n")


def documents(spark: SparkSession, *paths: str, policy: str = "replace") -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", decode(F.col("content"), policy).alias("content"))


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """A3: (link_id, title, ok) of ``link_id|title`` lines; blank lines are skipped, titles may hold the sign."""
    parts = F.split(F.trim("value"), r"\|", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(
        parts[0].alias("link_id"), F.when(F.size(parts) > 1, parts[1]).alias("title"), (F.size(parts) == 2).alias("ok")
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A4, A5: entries of a JSON catalogue; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], CATALOGUE)
    return spark.read.schema(CATALOGUE).json(path, multiLine=True)


def listed_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A5: entries of a catalogue that has to be there: an error if it is missing, and if it holds no entry."""
    if not exists(spark, path):
        raise FileNotFoundError(f"cannot load the catalogue {path}")
    entries = catalogue(spark, path)
    if entries.isEmpty():
        raise ValueError("the library has no entries yet")
    return entries


def files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False, content: bool = False) -> DataFrame:
    """Listing (path, length, modificationTime), with content only if asked for; an error if the directory is missing."""
    if not exists(spark, root):
        raise FileNotFoundError(f"directory not found: {root}")
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return got.select("path", "length", "modificationTime", *(["content"] if content else []))


def covers(spark: SparkSession, wanted: DataFrame, path: str = "path") -> DataFrame:
    """``wanted`` with the bytes of each file as ``content``: NULL, and ``missing`` true, where there is no such file.

    ``wanted`` names few files (one a book); absent ones are not read.
    """
    there = [r[0] for r in wanted.select(path).where(F.col(path).isNotNull()).distinct().toLocalIterator() if exists(spark, r[0])]
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    if not there:
        return wanted.withColumns({"content": F.lit(None).cast("binary"), "missing": F.lit(True)})
    found = spark.read.format("binaryFile").load(there).select(bare(F.col("path")).alias("_at"), "content")
    return wanted.join(found, bare(F.col(path)) == F.col("_at"), "left").drop("_at").withColumn("missing", F.col("content").isNull())


def parser_config(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The configuration dimension; absent keys are null, flags false."""
    names = [c.split(" ")[0] for c in PARSER_CONFIG.split(", ")]
    flags = {"title_strip_prefix", "chapter_num_from_title", "flat_layout"}
    data = [tuple({"ord": i, **r}.get(n, False if n in flags else None) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, PARSER_CONFIG)
