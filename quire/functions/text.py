"""Scalar text expressions (S1 to S29, P1, P2): built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"\s\p{Z}\x1c-\x1f\x{85}"
SPACE = f"[{_BLANKS}]"
# Where a pattern has a dot, (?d) keeps all but the line feed in it.
DECORATION = rf"^[~\-*=`{_BLANKS}]+$"  # one class, no group: a group recurses once a character
# C1 characters that leak from Windows-1252 and what they stand for.
LEAKED, MEANT = "\u0093\u0094\u0091\u0092\u0096\u0097\u0085", "“”‘’–—…"


def fix_encoding(text: Column) -> Column:
    """Leaked Windows-1252 quotation marks, dashes and ellipsis; null stays null."""
    return F.translate(text, LEAKED, MEANT)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_story(text: Column) -> Column:
    """Not empty, not decoration only, not a numbered line.  Null is not."""
    return F.coalesce((text != "") & ~text.rlike(DECORATION) & ~text.rlike(rf"^\p{{Nd}}+\.{SPACE}"), F.lit(False))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without a match or for an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def to_int(text: Column) -> Column:
    """BIGINT of digits, NULL for anything else."""
    return text.try_cast("bigint")


def link_number(link: Column) -> Column:
    """Number of a ``calibre_link-N``, else NULL."""
    return to_int(first_group(link, r"^calibre_link-(\d+)$"))


def strip_to_chapter(title: Column) -> Column:
    """Everything before the first ``Chapter`` goes, in any case of letters."""
    return F.regexp_replace(title, r"(?id)^.*?chapter\s", "Chapter ")


# How chapter numbers are written in titles, list items and file names (the four patterns below).
def title_number(title: Column) -> Column:
    """Chapter number of a title, ignoring case."""
    return to_int(first_group(title, r"(?i)chapter\s+(\d+)"))


def item_number(markup: Column) -> Column:
    """Chapter number of a list item; letter case counts."""
    return to_int(first_group(markup, r"Chapter\s+(\d+)"))


def file_number(name: Column) -> Column:
    """Chapter number of a file name: ``chapter_N``, ``chapter-N`` or ``chapterN``, else ``chN``."""
    return to_int(F.coalesce(first_group(name, r"(?i)chapter[_-]?(\d+)"), first_group(name, r"(?i)ch(\d+)")))


def chapter_index(title: Column, link: Column, offset: Column, from_title: Column) -> Column:
    """The title's number if the layout asks for it, else link number less offset, else 0."""
    return F.coalesce(F.when(from_title, title_number(title)), link_number(link) - offset, F.lit(0))


def trusted_title(inline: Column, listed: Column) -> Column:
    """The inline title if it names a chapter and a number, else the listed one, else ''."""
    return F.when(inline.rlike(r"(?id)\bchapter\b.*\d"), inline).otherwise(F.coalesce(listed, F.lit("")))


def falsy(text: Column, other: Column) -> Column:
    """``other`` for null and for empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def preview(text: Column, n: int = 80) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.concat(F.left(text, F.lit(n)), F.when(F.length(text) > n, "...").otherwise(""))


def padded(n: Column) -> Column:
    """At least three digits, never cut."""
    return F.format_string("%03d", n)


# Titles and initials before a name.
_GUARDED = "Dr|Mr|Mrs|Ms|Prof|St|Mt|Gen|Capt|No|vs|vol|Sr|Jr|[A-Z]"


def sentences(text: Column) -> Column:
    """S15 in the JVM: array of stripped sentences; splits after end marks before white space.

    A guard keeps titles and initials (``Dr.``, ``J.``) with what follows.  For exact
    boundaries in many scripts use the sequence model of the subpackage for text.
    """
    for _ in range(2):  # initials stand next to each other
        text = F.regexp_replace(text, rf"(^|[^A-Za-z])({_GUARDED})\.(\s)", "$1$2\u0002$3")
    cut = F.split(F.regexp_replace(text, "([.!?][\"”’]?)\\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: strip(F.translate(s, "\u0002", "."))), lambda s: s != "")


def mime(content: Column) -> Column:
    """PNG by its magic bytes, else JPEG."""
    return F.when(F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "image/png").otherwise("image/jpeg")


def to_ms(seconds: Column) -> Column:
    """Milliseconds, truncated toward zero."""
    return (seconds * 1000).cast("bigint")


def backoff(attempt: Column, base: float = 1.0) -> Column:
    """Seconds to wait after attempt k: base, doubling."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def tagless(markup: Column) -> Column:
    """H10 by pattern: text of markup, pieces joined by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " "))
