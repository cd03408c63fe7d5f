"""Catalogue, configuration, selection, manifests and tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import paths
from quire.functions import text as S


def detect_config(files: DataFrame, config: DataFrame, default: str, override: str | None = None) -> DataFrame:
    """The first configuration, in its order, whose key the normalized path contains; else the default.

    ``config`` (ord, key) is a handful of rows, so its keys become one expression.
    """
    if override:
        return files.withColumn("config", F.lit(override))
    got = F.lit(default)
    for r in config.orderBy(F.desc("ord")).select("key").toLocalIterator():
        got = F.when(paths.normalize_path(F.col("path")).contains(r.key), r.key).otherwise(got)
    return files.withColumn("config", got)


def replace_entries(old: DataFrame, new: DataFrame, folder: str, title: str) -> DataFrame:
    """Old entries of this folder or title go, the new ones are appended.  Null keys stay."""
    first = F.split(F.coalesce("path", F.lit("")), "/")[0]
    kept = old.where((first != folder) & ~F.coalesce("novel", "title").eqNullSafe(F.lit(title)))
    return kept.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))


def sort_catalogue(entries: DataFrame, *ties: str) -> DataFrame:
    """O1: by novel and first chapter, ties by the given columns."""
    return entries.orderBy("novel", F.coalesce("chapters.start", F.lit(0)), *ties)


def entry_label(entry: str = "") -> Column:
    """``Chs a–b`` with an en dash, else the title."""
    return F.when(F.col("chapters").isNotNull(), F.concat(F.lit("Chs "), F.col("chapters.start").cast("string"), F.lit("–"), F.col("chapters.end").cast("string"))).otherwise(F.col("title"))


def group_library(entries: DataFrame, pos: str) -> DataFrame:
    """Parts per novel in their order, and whether the group is one card or pills."""
    key = S.falsy(F.col("novel"), F.col("title")).alias("grp")
    return entries.groupBy(key).agg(
        F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("n_parts"),
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), entry_label().alias("label")))).alias("_parts"),
    ).select("grp", "first_pos", "n_parts", F.array_join("_parts.label", "|").alias("labels"), F.when(F.col("n_parts") == 1, "card").otherwise("pills").alias("shown_as"))


def manifest(paragraphs: DataFrame, keys: list[str], chapter: Column, titles: DataFrame | None = None) -> DataFrame:
    """A row a sentence with its numbers from 1 and its file key, of paragraphs (keys, p, text).

    ``p`` is renumbered after decoration and notes are left out; gaps in ``s`` are kept.  A
    chapter's title of ``titles`` (keys, title) is read before its text, as sentence 0 of paragraph 0.
    """
    story = paragraphs.where(S.is_story(F.col("text")))
    numbered = story.withColumn("p_no", F.row_number().over(Window.partitionBy(*keys).orderBy("p")))
    cut = numbered.select(*keys, "p", "p_no", chapter.alias("chapter"), F.posexplode(S.sentences(F.col("text"))).alias("s0", "sentence"))
    rows = cut.withColumn("s", F.col("s0") + 1).drop("s0")
    if titles is not None:
        own = titles.where(S.strip(F.col("title")) != "").select(*keys, *(F.lit(0).alias(c) for c in ("p", "p_no")), chapter.alias("chapter"), F.col("title").alias("sentence"), F.lit(0).alias("s"))
        rows = rows.unionByName(own)
    return rows.withColumn("file", F.format_string("ch%03d_p%03d_s%03d.mp3", "chapter", "p_no", "s"))


def todo(work: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Work without an output of more than no bytes."""
    return work.join(outputs.where("length > 0").select(*on).distinct(), on, "left_anti")


def done(work: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Work whose output is there."""
    return work.join(outputs.where("length > 0").select(*on).distinct(), on, "left_semi")


def synthesize(work: DataFrame, speak: Callable[[str], bytes | None], parallel: int = 2, tries: int = 5, base: float = 1.0, wait: Callable[[float], None] | None = None) -> DataFrame:
    """(file, audio) of a manifest by a pluggable voice, on ``parallel`` tasks at a time.

    A voice that gives None has no audio for the text, and one that raises has failed; both
    are tried again after a doubling wait.  In the end a text without audio is skipped, and
    a failure is raised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        pause = wait or time.sleep
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                for k in range(1, tries + 1):
                    try:
                        audio = speak(r.sentence)
                    except Exception:
                        if k == tries:
                            raise
                        audio = None
                    if audio is not None:
                        break
                    if k < tries:
                        pause(base * 2 ** (k - 1))
                if audio is not None:
                    made.append((r.file, audio))
            yield pd.DataFrame(made, columns=["file", "audio"])

    return work.select("file", "sentence").repartition(parallel).mapInPandas(run, "file string, audio binary")


def concat_audio(parts: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """Ordered concatenation of bytes, null parts left out; a group without parts has no row."""
    return parts.groupBy(*keys).agg(F.expr(f"coalesce(listagg({content}) WITHIN GROUP (ORDER BY {order}), X'')").alias(content), F.count(F.lit(1)).alias("n_parts"))


def select_chapters(rows: DataFrame, chapter: str, one: int | None = None, span: tuple[int, int] | None = None, several: list[int] | None = None) -> DataFrame:
    """By one number, a span or a list; at most one of them.  A span whose end comes first is empty."""
    given = [x for x in (one, span, several) if x is not None]
    if len(given) > 1:
        raise ValueError("give one of one, span and several")
    c = F.col(chapter)
    if one is not None:
        return rows.where(c == one)
    if span is not None:
        return rows.where(c.between(*span))
    return rows.where(c.isin(several)) if several is not None else rows


def requested(available: DataFrame, chapter: str, a: int, b: int) -> DataFrame:
    """Numbers a to b asked for, in order, and whether each is available."""
    spark = available.sparkSession
    wanted = spark.range(a, max(a, b + 1)).select(F.col("id").alias("chapter"))
    there = available.select(F.col(chapter).alias("chapter")).where("chapter is not null").distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, "chapter", "left").select("chapter", F.coalesce("_there", F.lit(False)).alias("available")).orderBy("chapter")


def selection_report(rows: DataFrame, keys: list[str], chapter: str, wanted: list[int]) -> DataFrame:
    """What a selection finds in each group: (keys, first, last, found, missing, status).

    ``found`` and ``missing`` are the wanted numbers in order.  ``status`` is ``error`` if none
    is there, ``warning`` if some are missing, else ``ok``; an empty selection is an error.
    """
    asked = F.array(*[F.lit(n).cast("bigint") for n in sorted(set(wanted))]) if wanted else F.array().cast("array<bigint>")
    c = F.col(chapter).cast("bigint")
    got = rows.groupBy(*keys).agg(F.coalesce(F.min(c), F.lit(0)).alias("first"), F.coalesce(F.max(c), F.lit(0)).alias("last"), F.array_sort(F.collect_set(F.when(c.isin(wanted), c))).alias("found"))
    missing = F.array_except(asked, "found")
    status = F.when(F.size("found") == 0, "error").when(F.size("missing") > 0, "warning").otherwise("ok")
    return got.withColumn("missing", missing).withColumn("status", status)


def selected(rows: DataFrame, chapter: str, **choice) -> DataFrame:
    """``select_chapters``, or an error on the driver if nothing matches."""
    got = select_chapters(rows, chapter, **choice)
    if got.isEmpty():
        raise ValueError("no chapters matched")
    return got


@dataclass(frozen=True)
class TagMeta:
    """What all tracks of a book share; ``over`` puts arguments that are not empty in place of defaults."""

    album: str
    artist: str
    genre: str = "Audiobook"
    comment: str = ""
    cover: str | None = None

    def over(self, **given: str | None) -> "TagMeta":
        return replace(self, **{k: v for k, v in given.items() if v})

    def frames(self, number: Column) -> Column:
        """The text frames of a track."""
        n = number.cast("string")
        texts = {"TIT2": F.concat(F.lit("Chapter "), n), "TALB": F.lit(self.album), "TPE1": F.lit(self.artist), "TRCK": n, "TCON": F.lit(self.genre), "COMM": F.lit(self.comment)}
        return F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])


def chapter_frames(old: Column, chapters: Column) -> Column:
    """K7: a tag's frames with CHAP and CTOC frames of an ARRAY<STRUCT<element, title, start_ms, end_ms>>; old ones of these kinds go."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~(k.startswith("CHAP") | k.startswith("CTOC")))
    made = F.transform(chapters, lambda c: F.struct(F.concat(F.lit("CHAP:"), c["element"]), F.concat_ws("|", c["start_ms"].cast("string"), c["end_ms"].cast("string"), c["title"])))
    order = F.array(F.struct(F.lit("CTOC:toc"), F.array_join(F.transform(chapters, lambda c: c["element"]), "|")))
    return F.map_concat(kept, F.map_from_entries(F.concat(made, order)))


def upsert_tags(old: Column, new: Column, cover: Column) -> Column:
    """K8: text frames of seven kinds are deleted, the new ones set; the picture only if there is a cover."""
    # Kinds of frames.
    kinds = ["TIT2", "TALB", "TPE1", "TRCK", "TCON", "COMM", "APIC"]
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(kinds))
    picture = F.when(cover.isNotNull(), F.create_map(F.lit("APIC"), S.mime(cover))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(kept, new, picture)


def pick_tracks(listing: DataFrame) -> DataFrame:
    """Of each chapter directory the canonical file, else all that bear its number, sorted; other directories are left out.

    ``listing`` (path, length) -> (dir, chapter, path, canonical).  Directories are told apart by
    their whole path.  A candidate's name holds ``chapter_`` and the directory's number as it is spelled.
    """
    parts = listing.withColumn("_folder", paths.parent(F.col("path"))).withColumn("dir", paths.name(F.col("_folder"))).withColumn("name", paths.name(F.col("path")))
    digits = F.regexp_extract("dir", r"(?i)^chapter_(\d+)$", 1)
    numbered = parts.where(digits != "").withColumn("chapter", S.to_int(digits))
    named = numbered.withColumn("canonical", F.col("name") == F.concat("dir", F.lit(".mp3")))
    named = named.where(F.col("canonical") | (F.contains(F.col("name"), F.concat(F.lit("chapter_"), digits)) & F.col("name").endswith(".mp3")))
    best = F.max("canonical").over(Window.partitionBy("_folder"))
    return named.withColumn("_best", best).where(F.col("canonical") == F.col("_best")).select("dir", "chapter", "path", "canonical").orderBy("path")


def tracks_and_rejects(listing: DataFrame) -> DataFrame:
    """Every file with its chapter's number, and ``rejected`` where its name has none."""
    return listing.withColumn("number", S.file_number(paths.name(F.col("path")))).withColumn("rejected", F.col("number").isNull())
