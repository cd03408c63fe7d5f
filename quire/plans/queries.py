"""Queries over the reference's operators, each with equivalent SQL where SQL can say it.

Every query runs over its whole tables.  Repeated rows are one, as everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import paths
from quire.functions import text as S
from quire.operators import html as H
from quire.operators import library as L
from quire.operators import structure as W
from quire.session import checkpoint_dir, load, small, written
from quire.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


SPACE = S.SPACE
PARAGRAPHS = "(SELECT DISTINCT doc_id, sec, p, text FROM paragraphs WHERE text IS NOT NULL)"
SECTIONS = "(SELECT doc_id, sec, min(link_id) AS link_id, min(title) AS title, min(chapter) AS chapter FROM sections GROUP BY doc_id, sec)"
TOC = "(SELECT DISTINCT ref_id, doc_id, pos, link_id, title, li_html FROM toc)"
KEPT = rf"(text <> '' AND NOT regexp_matches(text, '{S.DECORATION}') AND NOT regexp_matches(text, '^\p{{Nd}}+\.{SPACE}'))"
_TRIMMED = "regexp_replace(title, '^ +| +$', '', 'g')"  # the reader strips lines of plain spaces
INTEGER = "try_cast(nullif({}, '') AS BIGINT)"


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that have a text, each once.  Chapters come together in the same shuffle, so that no window or group over them needs another."""
    return load(spark, d, "paragraphs").select("doc_id", "sec", "p", "text").where("text is not null").repartition("doc_id", "sec").distinct()


def paragraph_facts(spark: SparkSession, d: str, **facts: Column) -> DataFrame:
    """(doc_id, sec, p) with what is wanted of each text; repeated rows are told by a hash, and no text is shuffled."""
    rows = load(spark, d, "paragraphs").where("text is not null")
    return rows.select("doc_id", "sec", "p", F.md5("text").alias("_of"), *(c.alias(n) for n, c in facts.items())).distinct().drop("_of")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """One row a chapter, however often it was there."""
    return load(spark, d, "sections").groupBy("doc_id", "sec").agg(F.min("link_id").alias("link_id"), F.min("title").alias("title"), F.min("chapter").alias("chapter"))


def toc(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "toc").select("ref_id", "doc_id", "pos", "link_id", "title", "li_html").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "novel_files").select("doc_id", "path", "novel").distinct()


@query(
    f"SELECT doc_id, sec, p, md5(translate(text, chr(147)||chr(148)||chr(145)||chr(146)||chr(150)||chr(151)||chr(133), '“”‘’–—…')) AS fixed FROM {PARAGRAPHS}"
)
def fix_encoding(spark: SparkSession, d: str) -> DataFrame:
    """S1."""
    return paragraph_facts(spark, d, fixed=F.md5(S.fix_encoding(F.col("text"))))


@query(
    r"SELECT DISTINCT path, lower(replace(path, '\', '/')) AS normal, regexp_replace(path, '/?[^/]*$', '') AS parent, "
    r"regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM novel_files"
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """S2, S26, A16."""
    p = F.col("path")
    return files(spark, d).select("path", paths.normalize_path(p).alias("normal"), paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.stem(p).alias("stem")).distinct()


@query(
    "SELECT DISTINCT doc_id, path, CASE WHEN lower(path) LIKE '%ashen mask%' THEN 'ashen mask' WHEN lower(path) LIKE '%mask%' THEN 'mask' "
    "WHEN lower(path) LIKE '%chronicle%' THEN 'chronicle' ELSE 'omnibus' END AS config FROM novel_files"
)
def config_detect(spark: SparkSession, d: str) -> DataFrame:
    """J6, A12, A13, S3."""
    config = readers.parser_config(spark, [{"key": k} for k in ("ashen mask", "mask", "chronicle")])
    return L.detect_config(files(spark, d).select("doc_id", "path"), config, "omnibus")


@query(
    rf"SELECT ref_id, {INTEGER.format("regexp_extract(li_html, '#calibre_link-([0-9]+)', 1)")} AS link, "
    rf"{INTEGER.format(r"regexp_extract(li_html, 'Chapter\s+(\d+)', 1)")} AS number, "
    rf"trim(regexp_replace(regexp_replace(li_html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM {TOC}"
)
def toc_items(spark: SparkSession, d: str) -> DataFrame:
    """H2, H10, H15, S4, S13."""
    li = F.col("li_html")
    return toc(spark, d).select("ref_id", S.to_int(S.first_group(li, "#calibre_link-([0-9]+)")).alias("link"), S.item_number(li).alias("number"), S.tagless(li).alias("label"))


@query(
    rf"SELECT f.doc_id, coalesce(min(n), 0) AS first_link, coalesce(max(n), 0) AS last_link FROM (SELECT DISTINCT doc_id FROM novel_files) f "
    rf"LEFT JOIN (SELECT doc_id, {INTEGER.format("regexp_extract(link_id, '^calibre_link-([0-9]+)$', 1)")} AS n FROM toc) t ON f.doc_id = t.doc_id GROUP BY f.doc_id"
)
def toc_range(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2, S11."""
    n = toc(spark, d).select("doc_id", S.link_number(F.col("link_id")).alias("n"))
    own = files(spark, d).select("doc_id").distinct()
    return own.join(n, "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.min("n"), F.lit(0)).alias("first_link"), F.coalesce(F.max("n"), F.lit(0)).alias("last_link"))


@query(
    rf"SELECT doc_id, link_id, arg_max(regexp_replace(title, '(?i)^.*?chapter\s', 'Chapter '), pos) AS title FROM {TOC} WHERE link_id IS NOT NULL AND title IS NOT NULL GROUP BY doc_id, link_id"
)
def toc_title_map(spark: SparkSession, d: str) -> DataFrame:
    """G8, S6, D4."""
    rows = toc(spark, d).where("link_id is not null and title is not null").withColumn("title", S.strip_to_chapter(F.col("title")))
    return W.last_wins(rows, ["doc_id", "link_id"], "pos", "title")


@query(
    f"SELECT doc_id, link_id, first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS rank FROM "
    f"(SELECT doc_id, link_id, min(pos) AS first_pos FROM {TOC} WHERE link_id IS NOT NULL GROUP BY doc_id, link_id)"
)
def toc_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """G9, G10."""
    return W.first_wins(toc(spark, d).where("link_id is not null").select("doc_id", "link_id", "pos"), ["doc_id", "link_id"], "pos")


@query(f"SELECT doc_id, sec, p, coalesce({KEPT}, false) AS kept FROM {PARAGRAPHS}")
def story_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """P1."""
    return paragraph_facts(spark, d, kept=S.is_story(F.col("text")))


@query(
    f"SELECT doc_id, sec, p, row_number() OVER (PARTITION BY doc_id, sec ORDER BY p) AS p_no FROM {PARAGRAPHS} WHERE {KEPT}"
)
def paragraph_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers after filtering."""
    story = paragraph_facts(spark, d, kept=S.is_story(F.col("text"))).where("kept")
    return story.select("doc_id", "sec", "p", F.row_number().over(Window.partitionBy("doc_id", "sec").orderBy("p")).alias("p_no"))


def _lines_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Headings (p = 0) and paragraphs of each file in document order: (doc_id, pos BIGINT, heading); ``pos`` is sec * 2^32 + p, exact for all INTs."""
    place = lambda p: (F.col("sec").cast("bigint") * F.lit(1 << 32) + p).alias("pos")
    heads = sections(spark, d).select("doc_id", place(F.lit(0)), F.lit(True).alias("heading"))
    body = load(spark, d, "paragraphs").select("doc_id", "sec", "p").distinct()
    return heads.unionByName(body.select("doc_id", place(F.col("p")), F.lit(False).alias("heading")))


_LINES_SQL = (
    f"(SELECT doc_id, sec::BIGINT * 4294967296 AS pos, true AS heading FROM {SECTIONS} UNION ALL "
    "SELECT DISTINCT doc_id, sec::BIGINT * 4294967296 + p AS pos, false AS heading FROM paragraphs)"
)


@query(
    f"SELECT * FROM (SELECT doc_id, pos, heading, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM {_LINES_SQL}) WHERE section > 0"
)
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    """W1, W9, P5, H6."""
    return W.sessionize(_lines_in_order(spark, d), ["doc_id"], "pos", F.col("heading"))


@query(
    f"SELECT doc_id, pos, coalesce(max(CASE WHEN heading THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pos) AS separator FROM {_LINES_SQL}"
)
def asof_separator(spark: SparkSession, d: str) -> DataFrame:
    """J4, W3, O7 over headings."""
    return W.asof_before(_lines_in_order(spark, d), ["doc_id"], "pos", F.col("heading"), "separator").select("doc_id", "pos", "separator")


@query(
    "SELECT event_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) AS before FROM events"
)
def asof_events(spark: SparkSession, d: str) -> DataFrame:
    """J4 over events: the closest click before each event of a user."""
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type")
    return W.asof_before(rows, ["user_id"], "event_id", F.col("event_type") == "click", "before").select("event_id", "before")


@query(f"SELECT doc_id, sec, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY p)) AS body FROM {PARAGRAPHS} GROUP BY doc_id, sec")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Ordered text of each chapter."""
    ordered = F.array_sort(F.collect_list(F.struct("p", "text")))
    return paragraphs(spark, d).groupBy("doc_id", "sec").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("body"))


@query(f"SELECT doc_id, sec, count(*) AS n_parts, md5(string_agg(text, '' ORDER BY p)) AS content FROM {PARAGRAPHS} GROUP BY doc_id, sec")
def concat_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Ordered bytes."""
    parts = paragraphs(spark, d).select("doc_id", "sec", "p", F.encode("text", "UTF-8").alias("content"))
    return L.concat_audio(parts, ["doc_id", "sec"], "p", "content").select("doc_id", "sec", "n_parts", F.md5("content").alias("content"))


# Pages: one HTML file a document, made of its table of contents and its chapters.
HEAD = "<html><head><title>"
WRAPPER = '<div class="calibre" id="calibre_link-0">'


def _page_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of the pages that `pages` makes: (doc_id, novel, items), and (doc_id, sec, text) of the chapters."""
    items = toc(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id", "li_html"))), lambda x: x["li_html"]), "").alias("items"))
    body = paragraphs(spark, d).groupBy("doc_id", "sec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat(F.lit('<p class="calibre2">'), "text", F.lit("</p>")).alias("t")))), lambda x: x["t"]), "").alias("body")
    )
    part = F.concat(F.lit('<div class="calibre1"></div><h1 id="'), "link_id", F.lit('" class="calibre1">'), F.coalesce("title", F.lit("")), F.lit("</h1>"), F.coalesce("body", F.lit("")))
    chapters = sections(spark, d).join(body, ["doc_id", "sec"], "left").select("doc_id", "sec", part.alias("text"))
    return files(spark, d).select("doc_id", "novel").join(items, "doc_id", "left"), chapters


def _page_start() -> Column:
    return F.concat(
        F.lit(HEAD), F.coalesce("novel", F.lit("")), F.lit('</title></head><body>' + WRAPPER + '<nav role="doc-toc"><h2>Contents</h2><ol>'), F.coalesce("items", F.lit("")), F.lit("</ol></nav>")
    )


def _page_end() -> Column:
    return F.concat(F.lit("</div>"), F.when(F.col("doc_id") % 3 == 0, "</BODY>\n</HTML>").otherwise("</body></html>"))


def in_parts(chapters: DataFrame, start: DataFrame, end: Column) -> DataFrame:
    """(doc_id, part, html): pages as rows that are read in the order of ``part``, so that no page is held as a whole.

    ``chapters``: (doc_id, sec, text), a part each.  ``start``: (doc_id, text), what comes before; pages without it
    or without chapters have no row.  ``end`` comes after.
    """
    least, most = -(1 << 31), 1 << 31  # no section has a number beyond
    docs = written(start.select("doc_id").join(chapters.select("doc_id").distinct(), "doc_id", "left_semi").distinct())
    first = start.join(small(docs), "doc_id", "left_semi").select("doc_id", F.lit(least - 2).cast("bigint").alias("part"), F.col("text").alias("html"))
    inner = chapters.where("text is not null").join(small(docs), "doc_id", "left_semi").select("doc_id", F.coalesce(F.col("sec").cast("bigint"), F.lit(least - 1)).alias("part"), F.col("text").alias("html"))
    return first.unionByName(inner).unionByName(docs.select("doc_id", F.lit(most).cast("bigint").alias("part"), end.alias("html")))


def pages_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part, html): `pages`, a row a chapter."""
    whole, chapters = _page_rows(spark, d)
    return in_parts(chapters, whole.select("doc_id", _page_start().alias("text")), _page_end())


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, html).  A file is one row here, as it is one text for a browser."""
    whole, chapters = _page_rows(spark, d)
    joined = chapters.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "text"))), lambda x: x["text"]), "").alias("chapters"))
    return joined.join(whole, "doc_id").select("doc_id", F.concat(_page_start(), "chapters", _page_end()).alias("html"))


_PAGES_SQL = f"""(SELECT c.doc_id, '{HEAD}' || coalesce(f.novel, '') || '</title></head><body>{WRAPPER}<nav role="doc-toc"><h2>Contents</h2><ol>'
 || coalesce(i.items, '') || '</ol></nav>' || c.chapters || '</div>' || CASE WHEN c.doc_id % 3 = 0 THEN '</BODY>' || chr(10) || '</HTML>' ELSE '</body></html>' END AS html
 FROM (SELECT s.doc_id, string_agg('<div class="calibre1"></div><h1 id="' || s.link_id || '" class="calibre1">' || coalesce(s.title, '') || '</h1>' || coalesce(b.body, ''), '' ORDER BY s.sec) AS chapters
   FROM {SECTIONS} s LEFT JOIN (SELECT doc_id, sec, string_agg('<p class="calibre2">' || text || '</p>', '' ORDER BY p) AS body FROM {PARAGRAPHS} GROUP BY doc_id, sec) b
   ON s.doc_id = b.doc_id AND s.sec = b.sec GROUP BY s.doc_id) c
 JOIN (SELECT DISTINCT doc_id, novel FROM novel_files) f ON c.doc_id = f.doc_id
 LEFT JOIN (SELECT doc_id, string_agg(li_html, '' ORDER BY pos, ref_id) AS items FROM {TOC} GROUP BY doc_id) i ON c.doc_id = i.doc_id)"""


@query(
    f"""SELECT doc_id, coalesce(nullif(regexp_extract(html, '(?i)<title>(.*?)</title>', 1), ''), '') AS page_title, len(regexp_extract(html, '(?is)^(.*?)</body', 1)) AS body_end,
 len(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*?role="doc-toc"[^>]*>(.*?)</nav>', 1), '(?s)<li[^>]*>(.*?)</li>', 1)) AS n_items,
 regexp_extract(html, '(?i)</body>\\s*</html>') AS footer, len(html) AS n_chars FROM {_PAGES_SQL}"""
)
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """H3, H15, H17, H19, H20."""
    h = F.col("html")
    return pages(spark, d).select(
        "doc_id", H.title(h).alias("page_title"), H.body_end(h).cast("bigint").alias("body_end"), F.greatest(F.size(H.list_items(F.coalesce(H.toc_block(h), F.lit("")))), F.lit(0)).cast("bigint").alias("n_items"),
        H.footer(h).alias("footer"), F.length(h).cast("bigint").alias("n_chars"),
    )


@query(
    f"""SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - n AS start_pos, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS end_pos, md5(piece) AS slice
 FROM (SELECT doc_id, i, piece, len(piece)::BIGINT AS n FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(list_transform(l, lambda x, k: CASE WHEN k = 1 THEN x ELSE '<h1 id="calibre_link-' || x END)) AS piece
 FROM (SELECT doc_id, string_split(regexp_replace(html, '(?is)</body.*$', ''), '<h1 id="calibre_link-') AS l FROM {_PAGES_SQL})))
 QUALIFY i > 0"""
)
def slice_between_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Slices from heading to heading, the last to the end of the body."""
    h = F.substring(F.col("html"), F.lit(1), H.body_end(F.col("html")))
    cut = pages(spark, d).select("doc_id", F.posexplode(F.split(h, '(?=<h1 id="calibre_link-)')).alias("i", "piece")).withColumn("n", F.length("piece").cast("bigint"))
    end = F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("end_pos", end).where("i > 0").select("doc_id", F.col("i").cast("bigint").alias("i"), (F.col("end_pos") - F.col("n")).alias("start_pos"), "end_pos", F.md5("piece").alias("slice"))


TARGET = "<body>" + WRAPPER


@query(
    f"""SELECT doc_id, n_items, md5(replace(html, '{TARGET}', '{TARGET}' || chr(10) || nav)) AS html FROM (SELECT p.doc_id, p.html, t.n_items,
 '      <nav type="toc" id="toc_main" role="doc-toc">' || chr(10) || '        <h2 class="calibre1">Table of Contents</h2>' || chr(10) || '        <ol class="calibre2">' || chr(10) || t.items || chr(10) || '        </ol>' || chr(10) || '      </nav>' AS nav
 FROM {_PAGES_SQL} p JOIN (SELECT doc_id, count(*) AS n_items, string_agg('          <li class="calibre3">' || chr(10) || '            <a href="#' || link_id || '">' || title || '</a>' || chr(10) || '          </li>', chr(10) ORDER BY pos, ref_id) AS items
 FROM {TOC} WHERE link_id IS NOT NULL AND title IS NOT NULL GROUP BY doc_id) t ON p.doc_id = t.doc_id)"""
)
def insert_toc(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a table of contents built and inserted; pages without the target have none."""
    navs = toc(spark, d).where("link_id is not null and title is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("pos", "ref_id", "link_id", "title"))).alias("rows")
    )
    return pages(spark, d).join(navs, "doc_id").select("doc_id", "n_items", F.md5(H.insert_after(F.col("html"), TARGET, H.toc_nav(F.col("rows")))).alias("html"))


_CHUNKS_SQL = f"(SELECT *, (place - 1) // 5 + 1 AS chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS place FROM {SECTIONS}))"


@query(
    f"""SELECT doc_id, chunk_no::BIGINT AS chunk_no, a AS first_number, b AS last_number, n AS n_chapters,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'Chapters ' || a || ' - ' || b ELSE 'Chapters ' || x || ' - ' || y END AS label, 'index_' || coalesce(a, x) || '_' || coalesce(b, y) || '.html' AS file
 FROM (SELECT doc_id, chunk_no, arg_min_null(chapter, sec) AS a, arg_max_null(chapter, sec) AS b, min(place) AS x, max(place) AS y, count(*) AS n FROM {_CHUNKS_SQL} GROUP BY doc_id, chunk_no)"""
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """W7, G12, S16, S17, S25."""
    rows = W.chunks(sections(spark, d).withColumn("pos", F.col("sec").cast("bigint")), ["doc_id"], "pos", 5)
    return W.chunk_labels(rows, ["doc_id"], "pos", "chapter").select("doc_id", "chunk_no", "first_number", "last_number", "n_chapters", "label", "file")


def entries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "catalogue").dropDuplicates(["ref_id"])


_ENTRIES_SQL = "(SELECT DISTINCT ref_id, novel, title, chapters, path FROM catalogue)"


@query(
    f"""SELECT novel, title, chapters['start'] AS a, chapters['end'] AS b, path FROM {_ENTRIES_SQL} WHERE split_part(coalesce(path, ''), '/', 1) <> 'the ashen mask' AND coalesce(novel, title) IS DISTINCT FROM 'The Ashen Mask'
 UNION ALL SELECT 'The Ashen Mask', 'The Ashen Mask Chs ' || a || '-' || b, a, b, path FROM (SELECT DISTINCT path, try_cast(nullif(regexp_extract(path, 'index_(\\d+)_(\\d+)', 1), '') AS BIGINT) AS a,
 try_cast(nullif(regexp_extract(path, 'index_(\\d+)_(\\d+)', 2), '') AS BIGINT) AS b FROM novel_files WHERE novel = 'the ashen mask')"""
)
def catalogue_replace(spark: SparkSession, d: str) -> DataFrame:
    """U4, P13, P18, S18, O1."""
    old = entries(spark, d).select("novel", "title", "chapters", "path")
    ends = [S.to_int(S.first_group(F.col("path"), r"index_(\d+)_(\d+)", g)) for g in (1, 2)]
    new = (
        files(spark, d).where("novel = 'the ashen mask'").select("path").distinct()
        .select("path", F.struct(ends[0].alias("start"), ends[1].alias("end")).alias("chapters"))
        .select(F.lit("The Ashen Mask").alias("novel"), F.format_string("The Ashen Mask Chs %d-%d", "chapters.start", "chapters.end").alias("title"), "chapters", "path")
    )
    merged = L.sort_catalogue(L.replace_entries(old, new, "the ashen mask", "The Ashen Mask"), "_new", "path")
    return merged.select("novel", "title", F.col("chapters.start").alias("a"), F.col("chapters.end").alias("b"), "path")


@query(
    f"""SELECT grp, min(ref_id) AS first_pos, count(*) AS n_parts, string_agg(label, '|' ORDER BY ref_id) AS labels, CASE WHEN count(*) = 1 THEN 'card' ELSE 'pills' END AS shown_as
 FROM (SELECT ref_id, coalesce(nullif(novel, ''), title) AS grp, CASE WHEN chapters IS NOT NULL THEN 'Chs ' || chapters['start'] || '–' || chapters['end'] ELSE title END AS label FROM {_ENTRIES_SQL}) GROUP BY grp"""
)
def library_groups(spark: SparkSession, d: str) -> DataFrame:
    """G4, G6, G11, S19, S21, D16, K11."""
    return L.group_library(entries(spark, d), "ref_id")


@query(f"SELECT ref_id, novel, title, chapters['start'] AS a, chapters['end'] AS b, path FROM {_ENTRIES_SQL}")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries through their JSON text."""
    text = F.to_json(F.struct("novel", "title", "chapters", "path"))
    back = entries(spark, d).select("ref_id", F.from_json(text, readers.CATALOGUE).alias("e"))
    return back.select("ref_id", "e.novel", "e.title", F.col("e.chapters.start").alias("a"), F.col("e.chapters.end").alias("b"), "e.path")


@query(
    f"""SELECT doc_id, sec, p, row_number() OVER w - 1 AS i, sum(d) OVER w - d AS start_ms, sum(d) OVER w AS end_ms, format('ch{{:03d}}', row_number() OVER w - 1) AS element
 FROM (SELECT doc_id, sec, p, (length(text) * 60)::BIGINT AS d FROM {PARAGRAPHS}) WINDOW w AS (PARTITION BY doc_id, sec ORDER BY p ROWS UNBOUNDED PRECEDING)"""
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Start and end of each paragraph when read at 60 ms a character."""
    rows = paragraph_facts(spark, d, n=F.length("text")).withColumn("pos", F.col("p").cast("bigint"))
    return W.timeline(rows, ["doc_id", "sec"], "pos", S.to_ms(F.col("n") * F.lit(0.06).cast("decimal(4,2)"))).select("doc_id", "sec", "p", "i", "start_ms", "end_ms", "element")


_GUARD = r"'(^|[^A-Za-z])(" + S._GUARDED + r")\.(\s)', '\1\2' || chr(2) || '\3', 'g'"
_SENTENCES_SQL = (
    f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, {_GUARD}), {_GUARD}), '([.!?][\"”’]?)\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    f"lambda x: regexp_replace(translate(x, chr(2), '.'), '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"
)


@query(
    f"""SELECT doc_id, sec, 0 AS p, 0 AS p_no, 0 AS s, title AS sentence, format('ch{{:03d}}_p000_s000.mp3', sec) AS file FROM {SECTIONS} WHERE regexp_replace(title, '^{SPACE}+|{SPACE}+$', '', 'g') <> ''
 UNION ALL SELECT doc_id, sec, p, p_no, unnest(range(1, len(l) + 1))::INT AS s, unnest(l) AS sentence, format('ch{{:03d}}_p{{:03d}}_s{{:03d}}.mp3', sec, p_no, unnest(range(1, len(l) + 1))) AS file
 FROM (SELECT doc_id, sec, p, p_no, {_SENTENCES_SQL} AS l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY p) AS p_no FROM {PARAGRAPHS} WHERE {KEPT}))"""
)
def sentence_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Titles and sentences to be read."""
    return L.manifest(paragraphs(spark, d), ["doc_id", "sec"], F.col("sec"), sections(spark, d)).select("doc_id", "sec", "p", "p_no", "s", "sentence", "file")


@query(
    f"""SELECT doc_id, n_chars, len({_SENTENCES_SQL}) AS n_sentences, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL"""
)
def document_preview(spark: SparkSession, d: str) -> DataFrame:
    """S20, K13, G3."""
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", "n_chars", F.size(S.sentences(F.col("text"))).cast("bigint").alias("n_sentences"), S.preview(F.col("text")).alias("preview"))


_WORK_SQL = "(SELECT DISTINCT doc_id, sec, p FROM paragraphs)"


def _work(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Work, and a made listing of outputs: every third paragraph has a file, those of odd chapters an empty one."""
    work = load(spark, d, "paragraphs").select("doc_id", "sec", "p").distinct()
    return work, work.where("p % 3 = 0").withColumn("length", F.when(F.col("sec") % 2 == 0, 10).otherwise(0))


@query(f"SELECT doc_id, sec, p FROM {_WORK_SQL} WHERE NOT (p % 3 = 0 AND sec % 2 = 0)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    """J8, T1, A8."""
    return L.todo(*_work(spark, d), ["doc_id", "sec", "p"])


@query(f"SELECT doc_id, sec, p FROM {_WORK_SQL} WHERE p % 3 = 0 AND sec % 2 = 0")
def resume_done(spark: SparkSession, d: str) -> DataFrame:
    """J7, J9."""
    return L.done(*_work(spark, d), ["doc_id", "sec", "p"])


@query(f"SELECT doc_id, sec, chapter FROM {SECTIONS} WHERE chapter BETWEEN 5 AND 8")
def select_range(spark: SparkSession, d: str) -> DataFrame:
    """P8, P7, O5."""
    return L.select_chapters(sections(spark, d).select("doc_id", "sec", "chapter"), "chapter", span=(5, 8))


@query(f"SELECT doc_id, sec, chapter FROM {SECTIONS} WHERE chapter IN (1, 7, 1780)")
def select_list(spark: SparkSession, d: str) -> DataFrame:
    """P9."""
    return L.select_chapters(sections(spark, d).select("doc_id", "sec", "chapter"), "chapter", several=[1, 7, 1780])


@query("SELECT r AS chapter, r IN (SELECT chapter FROM sections WHERE chapter IS NOT NULL) AS available FROM range(1, 2501) t(r)")
def requested_chapters(spark: SparkSession, d: str) -> DataFrame:
    """U1, U2, U3, O2, O4."""
    return L.requested(load(spark, d, "sections"), "chapter", 1, 2500)


@query(
    f"""SELECT doc_id, sec, coalesce(try_cast(nullif(regexp_extract(title, '(?i)chapter\\s+(\\d+)', 1), '') AS BIGINT), n - 1, 0) AS by_title, coalesce(n - 1, 0) AS by_link
 FROM (SELECT *, {INTEGER.format("regexp_extract(link_id, '^calibre_link-([0-9]+)$', 1)")} AS n FROM {SECTIONS})"""
)
def chapter_index(spark: SparkSession, d: str) -> DataFrame:
    """S12, S11, S25."""
    title, link = F.col("title"), F.col("link_id")
    return sections(spark, d).select(
        "doc_id", "sec", S.chapter_index(title, link, F.lit(1), F.lit(True)).alias("by_title"), S.chapter_index(title, link, F.lit(1), F.lit(False)).alias("by_link")
    )


@query(
    f"""SELECT * FROM (SELECT s.doc_id, s.sec, CASE WHEN regexp_matches(s.title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])chapter($|[^\\p{{L}}\\p{{N}}_]).*\\d') THEN s.title ELSE coalesce(t.title, '') END AS title FROM {SECTIONS} s
 LEFT JOIN (SELECT doc_id, link_id, arg_max(title, pos) AS title FROM {TOC} WHERE title IS NOT NULL GROUP BY doc_id, link_id) t ON s.doc_id = t.doc_id AND s.link_id = t.link_id) WHERE title <> ''"""
)
def trusted_titles(spark: SparkSession, d: str) -> DataFrame:
    """P2, P3, J1."""
    listed = W.last_wins(toc(spark, d).where("title is not null"), ["doc_id", "link_id"], "pos", "title").withColumnRenamed("title", "listed")
    joined = sections(spark, d).join(listed, ["doc_id", "link_id"], "left")
    return joined.select("doc_id", "sec", S.trusted_title(F.col("title"), F.col("listed")).alias("title")).where("title <> ''")


@query(
    f"""SELECT doc_id, sec, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, e ORDER BY p) AS n FROM (SELECT p.*, coalesce(p.text = f.first_text, false) AS e
 FROM {PARAGRAPHS} p JOIN (SELECT doc_id, sec, arg_min(text, p) AS first_text FROM {PARAGRAPHS} GROUP BY doc_id, sec) f ON p.doc_id = f.doc_id AND p.sec = f.sec)) WHERE NOT (e AND n = 1)"""
)
def drop_title_row(spark: SparkSession, d: str) -> DataFrame:
    """The chapter's first text stands for its title; its first repetition, itself, goes."""
    rows = paragraphs(spark, d)
    firsts = rows.groupBy("doc_id", "sec").agg(F.min_by("text", "p").alias("title"))
    return W.drop_title_row(rows.join(firsts, ["doc_id", "sec"]), ["doc_id", "sec"], "p", "text", "title", F.lit(False)).select("doc_id", "sec", "p")


@query(
    f"""SELECT doc_id, sec, 'Chapter ' || coalesce(chapter, sec) AS tit2, 'APIC|COMM|TALB|TCON|TIT2|TPE1|TRCK|XTRA' AS frames, 'album/artist' AS shared, CASE WHEN sec % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM {SECTIONS}"""
)
def tag_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K8, K9, S22, S27, A13, D13, D15."""
    meta = L.TagMeta("default", "artist", "genre", "note").over(album="album", artist="")
    old = F.create_map(F.lit("TIT2"), F.lit("old"), F.lit("XTRA"), F.lit("kept"))
    new = meta.frames(F.coalesce("chapter", "sec"))
    cover = F.when(F.col("sec") % 2 == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.unhex(F.lit("FFD8FF")))
    tags = sections(spark, d).select("doc_id", "sec", L.upsert_tags(old, new, cover).alias("t"))
    return tags.select("doc_id", "sec", F.col("t")["TIT2"].alias("tit2"), F.array_join(F.array_sort(F.map_keys("t")), "|").alias("frames"), F.concat_ws("/", F.col("t")["TALB"], F.col("t")["TPE1"]).alias("shared"), F.col("t")["APIC"].alias("mime"))


@query("SELECT k, pow(2, k - 1)::DOUBLE AS wait_s, sum(pow(2, k - 1)) OVER (ORDER BY k)::DOUBLE AS waited_s FROM range(1, 6) t(k)")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Waits after each of five tries."""
    return spark.range(1, 6).select(F.col("id").alias("k"), S.backoff(F.col("id")).alias("wait_s")).withColumn("waited_s", F.lit(2.0) * F.col("wait_s") - 1)


@query(
    f"""SELECT doc_id, sec, 'Chapter - ' || (n + 1) AS label FROM (SELECT *, {INTEGER.format("regexp_extract(link_id, '^calibre_link-([0-9]+)$', 1)")} AS n FROM {SECTIONS})"""
)
def browser_labels(spark: SparkSession, d: str) -> DataFrame:
    """H25."""
    return sections(spark, d).select("doc_id", "sec", H.label(F.col("link_id")).alias("label"))


@query(f"SELECT doc_id, sec, link_id || '|' || title AS line, link_id, title FROM {SECTIONS} WHERE title IS NOT NULL")
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written and split again, once."""
    line = sections(spark, d).where("title is not null").select("doc_id", "sec", F.concat_ws("|", "link_id", "title").alias("line"))
    parts = F.split("line", r"\|", 2)
    return line.select("doc_id", "sec", "line", parts[0].alias("link_id"), parts[1].alias("title"))


@query(
    f"""SELECT 'chapter_' || sec AS dir, sec::BIGINT AS chapter, path, canonical FROM (SELECT DISTINCT sec, CASE WHEN sec % 2 = 0 THEN 'audio/chapter_' || sec || '/chapter_' || sec || '.mp3' ELSE 'audio/chapter_' || sec || '/take' || k || '_chapter_' || sec || '.mp3' END AS path, sec % 2 = 0 AS canonical
 FROM sections, range(1, 3) t(k))"""
)
def track_listing(spark: SparkSession, d: str) -> DataFrame:
    """Over a listing made of the chapters' numbers."""
    base = load(spark, d, "sections").select("sec").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    folder = F.concat(F.lit("audio/chapter_"), "sec", F.lit("/"))
    take = F.concat(folder, F.lit("take"), F.col("k").cast("string"), F.lit("_chapter_"), "sec", F.lit(".mp3"))
    made = base.select(take.alias("path")).unionByName(base.where("k = 1 and sec % 2 = 0").select(F.concat(folder, F.lit("chapter_"), "sec", F.lit(".mp3")).alias("path")))
    other = made.select(F.regexp_replace("path", "audio/chapter_", "audio/extra_").alias("path"))
    return L.pick_tracks(made.unionByName(other))


@query(
    f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM novel_files)) AS n_files, (SELECT count(*) FROM {SECTIONS}) AS n_chapters, (SELECT count(*) FROM {PARAGRAPHS}) AS n_paragraphs,
 (SELECT count(DISTINCT ref_id) FROM toc) AS n_toc, (SELECT count(DISTINCT ref_id) FROM catalogue) AS n_entries"""
)
def counts(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts, without a cross join."""
    parts = {"n_files": load(spark, d, "novel_files").select("doc_id"), "n_chapters": load(spark, d, "sections").select("doc_id", "sec"), "n_paragraphs": paragraphs(spark, d), "n_toc": load(spark, d, "toc").select("ref_id"), "n_entries": load(spark, d, "catalogue").select("ref_id")}
    rows = None
    for name, df in parts.items():
        one = df.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in parts])


@query(
    f"""SELECT doc_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_nodes, len(regexp_extract_all(html, '<h1 id="calibre_link-')) AS n_headings, len(regexp_extract_all(html, '<p class="calibre2">')) AS n_paragraphs,
 len(regexp_extract_all(html, '<h1 id="calibre_link-')) AS headings_in_wrapper, 0 AS n_divs, 'flat' AS layout FROM {_PAGES_SQL}"""
)
def dom_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Element counts of each page, its layout and what the wrapper holds directly."""
    # The elements are read twice, the pages once.
    nodes = written(H.html_nodes(pages_in_parts(spark, d), texts=False).select("doc_id", "pos", "parent_pos", "tag", "id", "classes"))
    wrapper = nodes.where(H.is_wrapper()).select("doc_id", "pos")
    inside = H.children(nodes, wrapper).groupBy("doc_id").agg(F.sum(H.is_heading().cast("int")).alias("headings_in_wrapper"))
    seen = nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(H.is_heading().cast("int")).alias("n_headings"), F.sum((H.has_class("calibre2") & (F.col("tag") == "p")).cast("int")).alias("n_paragraphs"),
        F.sum(H.is_chapter_div().cast("int")).alias("n_divs"),
    )
    return seen.join(inside, "doc_id", "left").withColumn("layout", F.when(F.col("n_divs") > 0, "div").otherwise("flat"))


@query(
    f"""SELECT doc_id, coalesce(min(chapter), 0) AS first, coalesce(max(chapter), 0) AS last, array_to_string(list_sort(coalesce(list(DISTINCT chapter) FILTER (chapter BETWEEN 5 AND 9), [])), ',') AS found,
 array_to_string(list_filter(range(5, 10), lambda x: NOT list_contains(coalesce(list(DISTINCT chapter) FILTER (chapter BETWEEN 5 AND 9), []), x)), ',') AS missing,
 CASE count(DISTINCT chapter) FILTER (chapter BETWEEN 5 AND 9) WHEN 0 THEN 'error' WHEN 5 THEN 'ok' ELSE 'warning' END AS status FROM {SECTIONS} GROUP BY doc_id"""
)
def selection_report(spark: SparkSession, d: str) -> DataFrame:
    """What a selection of chapters 5 to 9 finds in each file."""
    got = L.selection_report(sections(spark, d), ["doc_id"], "chapter", list(range(5, 10)))
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("found", "missing")})


@query(
    """SELECT path, try_cast(coalesce(nullif(regexp_extract(name, '(?i)chapter[_-]?([0-9]+)', 1), ''), nullif(regexp_extract(name, '(?i)ch([0-9]+)', 1), '')) AS BIGINT) AS number,
 NOT regexp_matches(name, '(?i)ch(apter[_-]?)?[0-9]') AS rejected FROM (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM (SELECT CASE sec % 4 WHEN 0 THEN 'a/chapter_' || sec || '.mp3' WHEN 1 THEN 'a/CHAPTER-' || sec || '.mp3' WHEN 2 THEN 'b/x_ch' || sec || '_p000.mp3' ELSE 'chapter_1/note' || sec || '.mp3' END AS path FROM sections))"""
)
def track_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Chapter numbers of files by name, and the files without one."""
    n = F.col("sec").cast("string")
    path = F.when(F.col("sec") % 4 == 0, F.concat(F.lit("a/chapter_"), n)).when(F.col("sec") % 4 == 1, F.concat(F.lit("a/CHAPTER-"), n)).when(F.col("sec") % 4 == 2, F.concat(F.lit("b/x_ch"), n, F.lit("_p000"))).otherwise(F.concat(F.lit("chapter_1/note"), n))
    return L.tracks_and_rejects(load(spark, d, "sections").select(F.concat(path, F.lit(".mp3")).alias("path")).distinct())


@query(
    f"""SELECT doc_id, 2 + count(*) AS n_frames, md5(string_agg('CHAP:' || element || '=' || start_ms || '|' || end_ms || '|' || title, chr(10) ORDER BY i)) AS chapters, string_agg(element, '|' ORDER BY i) AS toc
 FROM (SELECT doc_id, i, title, format('ch{{:03d}}', i) AS element, sum(d) OVER w - d AS start_ms, sum(d) OVER w AS end_ms FROM (SELECT doc_id, sec, coalesce(title, '') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS i, 1000 + coalesce(chapter, 0) AS d FROM {SECTIONS}) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) GROUP BY doc_id"""
)
def chapter_frames(spark: SparkSession, d: str) -> DataFrame:
    """Chapter frames of a book of each file; frames of these kinds that were there go, others stay."""
    rows = sections(spark, d).withColumn("pos", F.col("sec").cast("bigint"))
    timed = W.timeline(rows, ["doc_id"], "pos", F.lit(1000) + F.coalesce("chapter", F.lit(0)))
    books = timed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "element", F.coalesce("title", F.lit("")).alias("title"), "start_ms", "end_ms"))).alias("c"))
    old = F.create_map(F.lit("CHAP:ch000"), F.lit("old"), F.lit("CTOC:old"), F.lit("old"), F.lit("TIT2"), F.lit("kept"))
    frames = books.select("doc_id", "c", L.chapter_frames(old, F.col("c")).alias("f"))
    own = F.transform("c", lambda x: F.concat(F.lit("CHAP:"), x["element"], F.lit("="), F.col("f")[F.concat(F.lit("CHAP:"), x["element"])]))
    return frames.select("doc_id", F.size("f").cast("bigint").alias("n_frames"), F.md5(F.array_join(own, "\n")).alias("chapters"), F.col("f")["CTOC:toc"].alias("toc"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""SELECT doc_id, sec, md5(replace(replace(string_agg(text, chr(10) ORDER BY p), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content FROM {PARAGRAPHS} GROUP BY doc_id, sec"""
)
def written_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters written as files of their own names, listed, and read again."""
    root = _folder(spark, "chapters")
    body = paragraphs(spark, d).groupBy("doc_id", "sec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("html"))
    writers.write_named(body.select(F.format_string("%d/%d.html", "doc_id", "sec").alias("path"), "html"), root)
    files_ = readers.files(spark, root, "*.html", recursive=True, content=True)
    place = F.split(paths.parent(F.col("path")), "/")
    return files_.select(F.element_at(place, -1).cast("bigint").alias("doc_id"), paths.stem(F.col("path")).cast("int").alias("sec"), F.md5(readers.decode(F.col("content"), "latin1")).alias("content"))


@query(f"SELECT link_id, md5(title) AS title, true AS ok, count(*) AS n FROM (SELECT link_id, {_TRIMMED} AS title FROM {SECTIONS} WHERE link_id IS NOT NULL AND title IS NOT NULL AND NOT contains(title, chr(10)) AND NOT contains(title, chr(13))) GROUP BY ALL")
def written_headers(spark: SparkSession, d: str) -> DataFrame:
    """K2, A3: header lines written and read again; a title may hold the sign between."""
    root = _folder(spark, "headers")
    rows = sections(spark, d).where("link_id is not null and title is not null and not contains(title, '\n') and not contains(title, '\r')")
    writers.header_lines(rows.withColumn("pos", F.struct("doc_id", "sec")), root)
    return readers.header_lines(spark, root).groupBy("link_id", F.md5("title").alias("title"), "ok").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT novel, title, chapters['start'] AS a, chapters['end'] AS b, path, count(*) AS n FROM {_ENTRIES_SQL} GROUP BY ALL")
def written_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """K4, A4, A5: the catalogue written as one indented array and read again."""
    path = f"{_folder(spark, 'library')}/library.json"
    writers.catalogue(L.sort_catalogue(entries(spark, d), "ref_id"), path)
    return readers.listed_catalogue(spark, path).groupBy("novel", "title", F.col("chapters.start").alias("a"), F.col("chapters.end").alias("b"), "path").agg(F.count(F.lit(1)).alias("n"))
