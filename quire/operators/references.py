"""Problem 4: references to files and chapters that do not exist (at the time they were seen).

Method: a broadcast Bloom filter of the parents' keys proves definite orphans; only
references that pass it are verified by exact join, with the parents' time spans.  Each
reference is resolved and probed once; what is known of it then is kept as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators import bloom
from quire.session import load, written

WRAPPER = "calibre_link-0"


def library_references(toc: DataFrame, hrefs: DataFrame, catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """All references into the library: (ref_table, ref_id, t, path, link), one row a key.

    Repeated rows are one reference.  Relative references of a file that is unknown
    keep a null path.  Values that are no references (see ``resolve_hrefs``) are left out.
    """
    base = files.where("doc_id is not null").groupBy("doc_id").agg(F.min("path").alias("_base"))
    own = (
        toc.select(
            F.lit("toc").alias("ref_table"), "ref_id", "doc_id", F.col("seen_at").alias("t"),
            paths.href_attribute(F.col("li_html")).alias("_href"),
        )
        .unionByName(
            hrefs.select(
                F.lit("hrefs").alias("ref_table"), "ref_id", "doc_id", F.col("seen_at").alias("t"), F.col("href").alias("_href")
            )
        )
        .join(base, "doc_id", "left")
    )
    own = (
        paths.resolve_hrefs(own, "_href", "_base", "_to")
        .where("_to is not null")
        .select("ref_table", "ref_id", "t", F.col("_to.path").alias("path"), F.col("_to.link").alias("link"))
    )
    listed = catalogue.select(
        F.lit("catalogue").alias("ref_table"), "ref_id", F.col("listed_at").alias("t"),
        paths.remove_dot_segments(F.translate(F.trim("path"), "\\", "/")).alias("path"),
        F.lit(None).cast("string").alias("link"),
    ).where("path is not null and path like '%.html'")
    return own.unionByName(listed).distinct()


def _there(t: Column, start: Column, end: Column) -> Column:
    return F.coalesce((start <= t) & (end.isNull() | (end > t)), F.lit(False))


def orphan_references(refs: DataFrame, files: DataFrame, sections: DataFrame, filter_mb: int = bloom.BROADCAST_MB) -> DataFrame:
    """References of ``refs`` whose parent is not there at their time: (ref_table, ref_id, t, reason).

    ``reason`` is ``never`` where the Bloom filter proves that no such file or chapter
    was ever known, ``not_then`` where the exact join finds none in its time span.
    A reference without a time or without a path is an orphan.  Removed and returning
    chapters have a span each; one that holds the moment is enough.
    """
    spans = files.select("path", F.col("doc_id").alias("_doc"), F.col("fetched_at").alias("_from"), F.col("removed_at").alias("_to"), F.lit(True).alias("_row")).distinct()
    stays = sections.select(F.col("doc_id").alias("_sdoc"), F.col("link_id").alias("_slink"), F.col("added_at").alias("_since"), F.col("removed_at").alias("_until")).distinct()
    need = F.when(F.col("link").isNotNull() & (F.col("link") != WRAPPER), F.col("link"))

    n_files, n_stays = bloom.blocks_for(files.count()), bloom.blocks_for(sections.count())
    file_filter = bloom.build(files.select("path"), F.col("path"), n_files)
    chapter_key = F.concat_ws("#", F.col("_sdoc").cast("string"), F.col("_slink"))
    chapter_filter = bloom.build(stays.where("_sdoc is not null and _slink is not null"), chapter_key, n_stays)

    key = ["ref_table", "ref_id", "t"]
    tested = bloom.probe(refs.withColumn("_link", need), F.col("path"), file_filter, n_files, "_maybe", filter_mb)
    tested = written(tested.select(*key, "path", "_link", "_maybe"))
    proven = tested.where("not _maybe").select(*key, F.lit("never").alias("reason"))
    held = (
        tested.where("_maybe")
        .join(spans, "path", "left")
        .withColumn("_known_file", F.coalesce("_row", F.lit(False)))
        .withColumn("_held", _there(F.col("t"), F.col("_from"), F.col("_to")))
        .withColumn("_chapter", F.when(F.col("_held"), F.col("_link")))
    )
    seen = bloom.probe(held, F.concat_ws("#", F.col("_doc").cast("string"), F.col("_chapter")), chapter_filter, n_stays, "_known", filter_mb)
    seen = written(seen.select(*key, "_doc", "_known_file", "_held", "_chapter", "_known"))
    # Only chapters that the filter lets pass meet the sections; the rest is decided already.
    asked = F.col("_chapter").isNotNull() & F.col("_known")
    by_file = seen.where(~asked).select(*key, "_known_file", (F.col("_held") & F.col("_chapter").isNull()).alias("_ok"))
    by_chapter = (
        seen.where(asked)
        .join(stays, (F.col("_doc") == F.col("_sdoc")) & (F.col("_chapter") == F.col("_slink")), "left")
        .select(*key, "_known_file", _there(F.col("t"), F.col("_since"), F.col("_until")).alias("_ok"))
    )
    judged = by_file.unionByName(by_chapter).groupBy(*key).agg(F.max("_ok").alias("_ok"), F.max("_known_file").alias("_file"))
    verified = judged.where("not _ok").select(*key, F.when(F.col("_file"), "not_then").otherwise("never").alias("reason"))
    return proven.unionByName(verified)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    files, sections = load(spark, d, "novel_files"), load(spark, d, "sections")
    refs = library_references(load(spark, d, "toc"), load(spark, d, "hrefs"), load(spark, d, "catalogue"), files)
    return orphan_references(refs, files, sections)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references: (ref_table, ref_id), each once."""
    return _orphans(spark, d).select("ref_table", "ref_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month: (ref_table, month STRING or NULL, orphans BIGINT)."""
    return (
        _orphans(spark, d)
        .select("ref_table", "ref_id", F.date_format("t", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy("ref_table", "month")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )
