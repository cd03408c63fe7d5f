"""From rows in document order to sections, slices and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.scan import running, running_all


def sessionize(rows: DataFrame, keys: list[str], pos: str, boundary: Column) -> DataFrame:
    """Number of the section each row is in; rows before the first boundary are dropped.

    A boundary opens a section and belongs to it.  A null boundary is none.
    """
    out = running(rows, keys, pos, F.coalesce(boundary.cast("int"), F.lit(0)).cast("bigint"), "section")
    return out.where("section > 0")


def asof_before(rows: DataFrame, keys: list[str], pos: str, marker: Column, into: str) -> DataFrame:
    """Position of the closest marker strictly before each row, else the row's own."""
    found = running(rows, keys, pos, F.when(marker, F.col(pos)), "_before", how="max", inclusive=False)
    return found.withColumn(into, F.coalesce("_before", pos)).drop("_before")


def slices(anchors: DataFrame, keys: list[str], pos: str, end: Column) -> DataFrame:
    """Half-open slice from each anchor to the next, the last to ``end``.

    Anchors are few to a document (one a chapter).  Select wanted anchors afterwards:
    unwanted ones still end the slice before them (J2).
    """
    after = F.lead(pos).over(Window.partitionBy(*keys).orderBy(pos))
    return anchors.withColumn("slice_end", F.coalesce(after, end))


def chunks(rows: DataFrame, keys: list[str], pos: str, n: int) -> DataFrame:
    """Number of the chunk of ``n`` rows that each row is in, and its place from 1."""
    out = running(rows, keys, pos, F.lit(1).cast("bigint"), "place")
    return out.withColumn("chunk_no", F.floor((F.col("place") - 1) / n) + 1)


def chunk_labels(rows: DataFrame, keys: list[str], pos: str, number: str) -> DataFrame:
    """First and last number of each chunk by position, its label and file name.

    The label falls back to places if either end has no number, the file name end by end.
    """
    grouped = rows.groupBy(*keys, "chunk_no").agg(
        F.min_by(number, pos).alias("first_number"), F.max_by(number, pos).alias("last_number"),
        F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count(F.lit(1)).alias("n_chapters"),
    )
    both = F.col("first_number").isNotNull() & F.col("last_number").isNotNull()
    a, b = F.coalesce("first_number", "first_place"), F.coalesce("last_number", "last_place")
    return grouped.withColumns(
        {
            "label": F.when(both, F.format_string("Chapters %d - %d", "first_number", "last_number")).otherwise(F.format_string("Chapters %d - %d", "first_place", "last_place")),
            "file": F.format_string("index_%d_%d.html", a, b),
        }
    )


def first_wins(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Distinct keys with the position of the first, re-ranked from 1 in that order within the leading key."""
    firsts = rows.groupBy(*keys).agg(F.min(pos).alias("first_pos"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy("first_pos")))


def last_wins(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, pos).alias(value))


def drop_title_row(rows: DataFrame, keys: list[str], pos: str, text: str, title: str, has_element: Column) -> DataFrame:
    """The first row equal to the title is dropped, only where no title element was found."""
    equal = F.coalesce((F.col(text) == F.col(title)) & ~has_element, F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*keys, "_equal").orderBy(pos))
    return rows.withColumn("_equal", equal).withColumn("_nth", nth).where("not (_equal and _nth = 1)").drop("_equal", "_nth")


def timeline(rows: DataFrame, keys: list[str], pos: str, duration: Column) -> DataFrame:
    """Start and end of each part, and its element id from 0.  Null durations count as 0."""
    d = F.coalesce(duration, F.lit(0)).cast("bigint")
    out = running_all(rows.withColumn("_d", d), keys, pos, {"end_ms": (F.col("_d"), "sum", True), "_n": (F.lit(1).cast("bigint"), "sum", True)})
    return out.withColumns({"start_ms": F.col("end_ms") - F.col("_d"), "i": F.col("_n") - 1}).withColumn("element", F.format_string("ch%03d", "i")).drop("_d", "_n")


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], unpaired: bool = False) -> DataFrame:
    """Rows paired by position (the last of ``keys``); what has no partner is cut off, or kept with ``paired`` false."""
    if not unpaired:
        return left.join(right, keys)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full")
    return both.withColumn("paired", F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))).drop("_l", "_r")
