"""URL and path expressions on columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Back slashes to slashes, lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """All but the last component, '' if there is one only."""
    return F.regexp_replace(path, r"(?s)/?[^/]*$", "")


def stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name(path), r"(?s)(?<=.)\.[^.]*$", "")


def unescape_html(text: Column) -> Column:
    """Character references that attribute values use; ``&amp;`` last."""
    numbered = F.regexp_replace(text, r"&#0*39;|&#[xX]0*27;|&apos;", "'")
    numbered = F.regexp_replace(numbered, r"&#0*34;|&#[xX]0*22;|&quot;", '"')
    numbered = F.regexp_replace(numbered, r"&#0*32;|&#[xX]0*20;", " ")
    numbered = F.regexp_replace(numbered, r"&lt;|&#0*60;|&#[xX]0*3[cC];", "<")
    numbered = F.regexp_replace(numbered, r"&gt;|&#0*62;|&#[xX]0*3[eE];", ">")
    return F.regexp_replace(numbered, r"&amp;|&#0*38;|&#[xX]0*26;", "&")


def href_attribute(markup: Column) -> Column:
    """Value of the first href attribute: any case, either quote or none; NULL without one."""
    pattern = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    got = F.concat(*(F.regexp_extract(markup, pattern, g) for g in (1, 2, 3)))
    return unescape_html(F.when(markup.rlike(pattern), got))


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded, '+' kept; text with broken escapes is kept as it is."""
    decoded = F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def remove_dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' of a path without leading slash; '..' above the root is ignored."""
    return F.concat_ws(
        "/",
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda done, part: F.when((part == ".") | (part == ""), done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part))),
        ),
    )


def resolve_hrefs(df: DataFrame, href: str, base: str, into: str) -> DataFrame:
    """``df`` with a column ``into``: where each href leads, as a browser resolves it from the file ``base``.

    Result: STRUCT<path STRING, link STRING>, path from the library's root, link
    a ``calibre_link-N`` or NULL for the file as a whole.  NULL if it is no reference
    into the library: null or empty values, other schemes and hosts, other
    fragments, other file types.  Each step is a column of its own, so that no
    expression is repeated inside another.
    """
    authority = r"(?i)^(?:https?:)?//"
    steps = {
        "_clean": F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""),
        "_address": F.substring_index("_clean", "#", 1),
        "_fragment": F.nullif(percent_decode(F.when(F.col("_clean").contains("#"), F.regexp_replace("_clean", r"(?s)^[^#]*#", ""))), F.lit("")),
        "_plain": F.translate(F.substring_index("_address", "?", 1), "\\", "/"),
        "_absolute": F.col("_plain").rlike(authority),
        "_dotted": F.regexp_replace(F.when(F.col("_absolute"), F.regexp_replace("_plain", authority + "[^/]*", "")).otherwise(F.col("_plain")), r"(?i)%2e", "."),
        "_full": F.when(F.col("_absolute") | F.col("_dotted").startswith("/"), F.col("_dotted")).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), F.col("_dotted"))),
        "_target": F.when(F.col("_plain") == "", F.col(base)).otherwise(percent_decode(remove_dot_segments(F.col("_full")))),
        "_chapter": F.col("_fragment").rlike(r"^calibre_link-[0-9]+$"),
    }
    for name_, step in steps.items():
        df = df.withColumn(name_, step)
    ours = F.col("_plain").rlike(authority + r"library\.example(?::(?:80|443)?)?(?:/|$)")
    foreign_scheme = F.col("_plain").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
    here, queried = F.col("_plain") == "", F.col("_address").contains("?")
    is_reference = (
        F.when(F.col("_absolute"), ours).otherwise(~foreign_scheme)
        & (F.col("_fragment").isNull() | F.col("_chapter"))
        & F.when(here, F.coalesce("_chapter", F.lit(False)) | queried).otherwise(percent_decode(F.col("_plain")).endswith(".html"))
    )
    got = F.when(is_reference, F.struct(F.col("_target").alias("path"), F.col("_fragment").alias("link")))
    # A generator is a fence: a later filter on the result would otherwise be pushed
    # through every step and inline them all into one expression.
    return df.withColumn(into, F.explode_outer(F.array(got))).drop(*steps)
