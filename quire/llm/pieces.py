"""Problem 2: cut oversized items into pieces under a limit, at natural boundaries, with overlap.

Method: byte-range processing.  An item is a set of ranges; a worker sees one range and
its halos, never the whole item.

1. Each range finds its boundaries and, for every offset at which the previous range may
   hand over, where the chain of cuts leaves it again and how many cuts it holds.
2. The tables of hand-overs (not the text) are stitched in a tree: ``FAN`` neighbours become
   one table, level by level, until an item is one; then each level hands its real entries
   and first numbers (prefix sums of the counts) down to the one below.  No task sees more
   than ``FAN`` tables of an item.
3. Each range, now knowing its real entry and first number, emits its pieces by offset.

An item of one range needs no stitching and goes to step 3 at once.

Cuts: a piece ends at the last newline or sentence end that fits, else at the last clause
mark, else at the last space, else at the limit (never before a combining mark or inside
a joined sequence, if there is another place).  The next piece starts ``overlap``
characters before that end.  All lengths are in code points.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.session import checkpoint_dir, load, written
from quire.sources import readers, writers

RANGE = 4096  # code points of a range of a text
FILE_RANGE = 1 << 18  # bytes of a range of a file
FILE_LIMIT, FILE_OVERLAP = 20_000, 200  # characters of a file's piece and of what it repeats
FAN = 16  # tables that are stitched into one
LEFT_HALO = 64

_CLOSERS = "\"'”’»›)\\]}」』》〉】）"
_PAUSE = re.compile(rf"\n+|[.!?…]+[{_CLOSERS}]*(?=\s|$)|[。！？．।॥؟۔;；]+[{_CLOSERS}]*")
_CLAUSE = re.compile(rf"[,:،、，：—–]+[{_CLOSERS}]*")
_SPACE = re.compile(r"\s+")
_GLUE = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟऀ-ःऺ-ॏัิ-ฺ็-๎‌‍︀-️\U0001f3fb-\U0001f3ffᅠ-ᇿ]")


class RangeCutter:
    """The cuts that one range sees; offsets are those of the whole item."""

    def __init__(self, chunk: str, first: int, total: int, limit: int, overlap: int) -> None:
        """``chunk`` starts at offset ``first`` of an item of ``total`` characters."""
        self.first, self.total, self.chunk = first, total, chunk
        self.overlap = min(max(overlap, 0), limit - 1)
        self.limit, self.step = limit, limit - self.overlap
        self.levels = [[first + m.end() for m in p.finditer(chunk)] for p in (_PAUSE, _CLAUSE, _SPACE)]

    def next_cut(self, at: int) -> int:
        """The cut after the one at ``at`` (0: the start, where nothing is repeated yet)."""
        reach = at + (self.limit if at == 0 else self.step)
        if reach >= self.total:
            return self.total
        for least in (at + (reach - at) // 3, at):
            for level in self.levels:
                i = bisect.bisect_right(level, reach)
                if i and level[i - 1] > least:
                    return level[i - 1]
        cut = reach
        while cut > at + 1 and (_GLUE.match(self.chunk, cut - self.first) or self.chunk[cut - self.first - 1] == "‍"):
            cut -= 1
        return cut if cut > at + 1 else reach

    def chain(self, entry: int, end: int) -> list[int]:
        """The cuts at and after ``entry``, up to the first at or beyond ``end``."""
        cuts = [entry]
        while cuts[-1] < min(end, self.total):
            cuts.append(self.next_cut(cuts[-1]))
        return cuts


def _hand_overs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            cutter = RangeCutter(r.chunk, r.chunk_first, r.total, r.max_chars, r.overlap_chars)
            entries = [0] if r.lo == 0 else range(r.lo, min(r.lo + r.max_chars, r.hi))
            exits: dict[int, tuple[int, int]] = {}
            for e in reversed(entries):
                path, at = [], e
                while at < min(r.hi, r.total) and at not in exits:
                    path.append(at)
                    at = cutter.next_cut(at)
                leave, n = exits.get(at, (at, 0))
                for q in reversed(path):
                    n += 1
                    exits[q] = (leave, n)
            out.append([[exits[e][0] for e in entries], [exits[e][1] for e in entries]])
        frame = pdf[["item", "part", "lo", "hi"]].copy()
        for i, name in enumerate(("exits", "counts")):
            frame[name] = [row[i] for row in out]
        yield frame


def _follow(at: np.ndarray, n: np.ndarray, lo: int, exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains that are at ``at`` with ``n`` cuts, after the range that starts at ``lo``; one that is past it stays."""
    i = at - lo
    here = (i >= 0) & (i < len(exits))
    i = np.where(here, i, 0)
    return np.where(here, exits[i], at), n + np.where(here, counts[i], 0)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One table of neighbouring ones of an item."""
    pdf = pdf.sort_values("part")
    first = pdf.iloc[0]
    at, n = np.asarray(first.exits), np.asarray(first.counts)
    for r in pdf.iloc[1:].itertuples(index=False):
        at, n = _follow(at, n, r.lo, np.asarray(r.exits), np.asarray(r.counts))
    return pd.DataFrame({"item": [first["item"]], "part": [first.part // FAN], "lo": [first.lo], "hi": [pdf.hi.max()], "exits": [at], "counts": [n]})


def _descend(pdf: pd.DataFrame) -> pd.DataFrame:
    """Real entry and number of cuts before it of each of the tables under one; a table that no chain enters has none."""
    rows, at, n = [], None, None
    for r in pdf.sort_values("part").itertuples(index=False):
        if at is None:
            at, n = r.entry, r.before
        if r.lo <= at < r.hi:
            rows.append((r.item, r.part, at, n))
            at, n = (int(x) for x in _follow(np.int64(at), np.int64(n), r.lo, np.asarray(r.exits), np.asarray(r.counts)))
    return pd.DataFrame(rows, columns=["item", "part", "entry", "before"])


def stitch(tables: DataFrame) -> DataFrame:
    """Real entries of the ranges of all items: (item, part, entry, before), from their hand-overs."""
    levels = [written(tables)]
    while levels[-1].where("part > 0").limit(1).count():
        levels.append(written(levels[-1].groupBy("item", F.floor(F.col("part") / FAN)).applyInPandas(_compose, _HANDED)))
    entries = levels[-1].select("item", "part", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for below in reversed(levels[:-1]):
        above = entries.select("item", F.col("part").alias("_up"), "entry", "before")
        under = below.withColumn("_up", F.floor(F.col("part") / FAN)).join(above, ["item", "_up"])
        entries = under.groupBy("item", "_up").applyInPandas(_descend, _PLACED)
    return entries


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            cutter = RangeCutter(r.chunk, r.chunk_first, r.total, r.max_chars, r.overlap_chars)
            cuts = cutter.chain(r.entry, r.hi)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                start = a - cutter.overlap if a else 0
                rows.append((r.item, r.before + i + 1, start, b, r.chunk[start - r.chunk_first : b - r.chunk_first]))
        if rows:
            yield pd.DataFrame(rows, columns=["item", "piece", "start", "end", "text"])


_HANDED = "item string, part int, lo long, hi long, exits array<long>, counts array<long>"
_PLACED = "item string, part int, entry long, before long"
_PIECES = "item string, piece long, start long, end long, text string"


def cut_ranges(ranges: DataFrame) -> DataFrame:
    """Pieces of items given as ranges: (item, piece, start, end, text).

    ``ranges``: (item STRING, part INT, lo, hi, total, chunk_first BIGINT, chunk STRING,
    max_chars, overlap_chars INT).  A range owns the offsets lo to hi; its chunk also
    holds what lies up to ``LEFT_HALO`` + overlap before and max_chars after them.
    """
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("total"))
    alone = ranges.where(whole).withColumns({"entry": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    several = ranges.where(~whole)
    placed = stitch(several.mapInPandas(_hand_overs, _HANDED))
    return alone.unionByName(several.join(placed, ["item", "part"])).mapInPandas(_emit, _PIECES)


def text_ranges(items: DataFrame, size: int = RANGE) -> DataFrame:
    """Ranges of the texts of ``items`` (item, text, max_chars, overlap_chars); each row holds its own chunk only.

    A range is no shorter than a piece, so a chain of cuts enters every range within its first ``max_chars``.
    """
    left = F.col("overlap_chars") + LEFT_HALO
    total = F.length("text").cast("long")
    step = F.greatest(F.lit(size), F.col("max_chars")).cast("long")

    def part(i: Column) -> Column:
        lo = i.cast("long") * step
        hi, first = F.least(lo + step, total), F.greatest(lo - left, F.lit(0)).cast("long")
        chunk = F.substring("text", first.cast("int") + 1, (hi - first + F.col("max_chars")).cast("int"))
        return F.struct(i.alias("part"), lo.alias("lo"), hi.alias("hi"), total.alias("total"), first.alias("chunk_first"), chunk.alias("chunk"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((total - 1) / step).cast("int")), part)
    return items.select("item", "max_chars", "overlap_chars", F.explode(parts).alias("r")).select("item", "max_chars", "overlap_chars", "r.*")


def split_oversized(items: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """Pieces of all texts longer than their ``max_chars``.

    ``items`` has ``keys``, text, max_chars and overlap_chars.  Result: keys, piece from 1,
    start, end (code points, end exclusive), text.  Repeated rows count once.  Null and
    fitting texts give no rows, nor does a null or non-positive max_chars.  An overlap of
    max_chars or more is lowered to max_chars - 1, a null one is 0.
    """
    own = items.select(
        *keys, "text", F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("overlap_chars")
    ).where("max_chars > 0 and length(text) > max_chars")
    # The keys travel inside the item's name, so that nothing is joined back.
    name = F.to_json(F.struct(F.struct(*keys).alias("k"), F.md5("text").alias("t"), F.col("max_chars").alias("m"), F.col("overlap_chars").alias("o")))
    pieces = cut_ranges(text_ranges(own.select(name.alias("item"), "text", "max_chars", "overlap_chars").distinct(), size))
    kinds = dict(items.dtypes)
    schema = "k struct<" + ", ".join(f"`{k}`: {kinds[k]}" for k in keys) + ">"
    back = pieces.withColumn("_key", F.from_json("item", schema))
    return back.select(*[F.col("_key.k")[k].alias(k) for k in keys], "piece", "start", "end", "text")


def _opened(path: str):
    """A file on any file system that its URI names, to be read by ranges."""
    system, at = writers.opened(path)
    return system.open_input_file(at)


def file_ranges(files: DataFrame, max_chars: int, overlap_chars: int, size: int = FILE_RANGE) -> DataFrame:
    """Ranges of UTF-8 files, without loading a file whole: ``files`` (path STRING, bytes BIGINT), as a listing gives them.

    Ranges are cut in bytes; a first pass counts each range's code points, and a prefix
    sum of the counts gives the offsets.  Bad bytes become U+FFFD.  The item is the path.
    """
    size = max(size, 4 * max_chars)  # no range is shorter than a piece
    files = files.select(F.col("path").alias("item"), "path", F.col("bytes").cast("long").alias("bytes"))
    parts = (
        files.where("bytes > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size).cast("int"))))
        .withColumn("byte", F.col("part") * F.lit(size).cast("long"))
        .repartition("item", "part")
    )

    def whole(f, at: int, bytes_: int) -> int:
        """``at`` moved on to the start of a character."""
        f.seek(at)
        head = f.read(3)
        n = 0
        while n < len(head) and head[n] & 0xC0 == 0x80:
            n += 1
        return min(at + n, bytes_) if at else 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = []
            for r in pdf.itertuples(index=False):
                with _opened(r.path) as f:
                    a, b = whole(f, r.byte, r.bytes), whole(f, min(r.byte + size, r.bytes), r.bytes)
                    f.seek(a)
                    n.append(len(f.read(b - a).decode("utf-8", "replace")))
            yield pdf.assign(n=n)

    counted = parts.mapInPandas(count, T.StructType(list(parts.schema.fields)).add("n", "long"))
    before = Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumns(
        {"lo": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("item"))}
    ).withColumn("hi", F.col("lo") + F.col("n"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chunks, firsts = [], []
            for r in pdf.itertuples(index=False):
                with _opened(r.path) as f:
                    at = r.byte
                    a = whole(f, max(0, at - 4 * (overlap_chars + LEFT_HALO)), r.bytes)
                    mid, b = whole(f, at, r.bytes), whole(f, min(at + size + 4 * max_chars, r.bytes), r.bytes)
                    f.seek(a)
                    head = f.read(mid - a).decode("utf-8", "replace")
                    chunks.append(head + f.read(b - mid).decode("utf-8", "replace"))
                    firsts.append(r.lo - len(head))
            yield pdf.assign(chunk=chunks, chunk_first=firsts)

    filled = placed.mapInPandas(fill, T.StructType(list(placed.schema.fields)).add("chunk", "string").add("chunk_first", "long"))
    return filled.withColumns({"max_chars": F.lit(max_chars), "overlap_chars": F.lit(overlap_chars)})


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    voices = load(spark, d, "voices").select("lang", "max_chars", "overlap_chars")
    known = {r.lang: r for r in voices.collect()}  # 15 rows, fixed
    least = min((r.max_chars for r in known.values() if r.max_chars is not None), default=0)
    langs = load(spark, d, "novel_files").where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    long_ones = load(spark, d, "paragraphs").where(F.length("text") > least)
    und = known.get("und")
    limit, overlap = (F.coalesce(F.col(c), F.lit(getattr(und, c, None)).cast("int")).alias(c) for c in ("max_chars", "overlap_chars"))
    return long_ones.join(langs, "doc_id", "left").join(F.broadcast(voices), "lang", "left").select("doc_id", "sec", "p", "text", limit, overlap)


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the paragraphs that their file's voice can't take at once:
    (doc_id, sec, p, piece, start, end, text).  A language without a voice uses ``und``."""
    return split_oversized(_oversized(spark, d), ["doc_id", "sec", "p"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that had to be split: (doc_id, sec, p)."""
    return p2_pieces(spark, d).where("piece = 2").select("doc_id", "sec", "p").distinct()


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of novels as text files, cut by byte ranges: (doc_id, piece, start, end, text).

    Every novel's paragraphs are written as a file first, a line each, in order; a file that one
    piece can hold has no row.  The files are listed, and only ranges of them are read.
    """
    root = f"{checkpoint_dir(spark)}/novels-{uuid.uuid4().hex}"
    rows = load(spark, d, "paragraphs").select("doc_id", "sec", "p", "text").where("text is not null")
    writers.write_lines(rows.repartition("doc_id").distinct(), root, "doc_id", ["sec", "p", "text"], "text")
    files = readers.files(spark, root, "*.txt").select("path", F.col("length").alias("bytes"))
    ranges = file_ranges(files, FILE_LIMIT, FILE_OVERLAP).where("total > max_chars")
    pieces = cut_ranges(ranges)
    return pieces.select(F.regexp_extract("item", r"([0-9-]+)\.txt$", 1).cast("bigint").alias("doc_id"), "piece", "start", "end", "text")
