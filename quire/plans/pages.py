"""Queries over HTML pages: chapters of both layouts, slices, split files, labels.

The tables hold no markup, so pages are made of them first, as a converter would write them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as S
from quire.operators import chapters as C
from quire.operators import html as H
from quire.operators import structure as W
from quire.plans.queries import _PAGES_SQL, INTEGER, PARAGRAPHS, SECTIONS, SPACE, TOC, WRAPPER, in_parts, pages, pages_in_parts, paragraphs, query, sections, toc
from quire.session import written

FLAT = {"para_class": "calibre2", "flat_layout": True, "chapter_num_from_title": True}
DIV = {"para_class": "calibre4", "title_selector": "div.head p.name", "id_offset": 1, "title_strip_prefix": True}


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _page(spark: SparkSession, d: str, chapter: Column, para: str, before: str = "") -> DataFrame:
    """(doc_id, part, html): pages whose chapters are ``chapter`` around ``_body``, after ``before`` and a table of contents; a row a chapter."""
    item = F.concat(F.lit('<li><a href="#'), "link_id", F.lit('"><b>'), _escaped(F.col("title")), F.lit("</b></a></li>"))
    items = toc(spark, d).where("link_id is not null and title is not null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id", item.alias("t")))), lambda x: x["t"]), "").alias("items"))
    text = F.concat(F.lit(f'<p class="x {para}">'), _escaped(F.col("text")), F.lit("</p>"))
    body = paragraphs(spark, d).groupBy("doc_id", "sec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))), lambda x: x["t"]), "").alias("_body"))
    made = sections(spark, d)
    start = made.select("doc_id").distinct().join(items, "doc_id", "left").select("doc_id", F.concat(F.lit(f'<html><body>{before}<nav role="doc-toc"><ol>'), F.coalesce("items", F.lit("")), F.lit("</ol></nav>")).alias("text"))
    return in_parts(made.join(body, ["doc_id", "sec"], "left").select("doc_id", "sec", chapter.alias("text")), start, F.lit("</body></html>"))


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_FIXED = "translate({}, chr(147)||chr(148)||chr(145)||chr(146)||chr(150)||chr(151)||chr(133), '“”‘’–—…')"
_STORY = rf"(text <> '' AND NOT regexp_matches(text, '{S.DECORATION}') AND NOT regexp_matches(text, '^\p{{Nd}}+\.{SPACE}'))"
_PAGE_ROWS = f"(SELECT doc_id, sec, p, {_stripped(_FIXED.format('text'))} AS text FROM {PARAGRAPHS})"
_PAGE_HEADS = f"(SELECT doc_id, sec, link_id, {_stripped(_FIXED.format("coalesce(title, '')"))} AS title FROM {SECTIONS})"
_TITLE_NUMBER = INTEGER.format(r"regexp_extract(title, '(?i)chapter\s+(\d+)', 1)")
_LINK_NUMBER = INTEGER.format("regexp_extract(link_id, '^calibre_link-([0-9]+)$', 1)")


@query(
    f"""SELECT s.doc_id, s.link_id, md5(s.title) AS title, coalesce({_TITLE_NUMBER.replace('title', 's.title')}, {_LINK_NUMBER.replace('link_id', 's.link_id')}, 0) AS chapter,
 row_number() OVER (PARTITION BY s.doc_id, s.link_id ORDER BY p.p) AS p, md5(p.text) AS text FROM {_PAGE_HEADS} s JOIN {_PAGE_ROWS} p ON s.doc_id = p.doc_id AND s.sec = p.sec WHERE s.title <> '' AND {_STORY.replace('text', 'p.text')}"""
)
def chapters_flat(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of pages that headings divide."""
    heading = F.concat(F.lit('<div class="calibre1"></div><h1 id="'), "link_id", F.lit('" class="calibre1">'), _escaped(F.coalesce("title", F.lit(""))), F.lit("</h1>"), F.coalesce("_body", F.lit("")))
    return C.parse_chapters(_page(spark, d, heading, FLAT["para_class"], WRAPPER), FLAT).select("doc_id", "link_id", F.md5("title").alias("title"), "chapter", "p", F.md5("text").alias("text"))


_LISTED = f"""(SELECT doc_id, link_id, arg_max(title, (pos, ref_id)) AS listed FROM (SELECT doc_id, pos, ref_id, link_id, regexp_replace({_stripped(_FIXED.format('title'))}, '(?i)^.*?chapter\\s', 'Chapter ') AS title
 FROM {TOC} WHERE regexp_matches(link_id, '^calibre_link-[0-9]+$') AND title IS NOT NULL) GROUP BY doc_id, link_id)"""
_DIV_TITLES = f"""(SELECT h.doc_id, h.sec, h.link_id, h.sec % 2 = 0 AS element, CASE WHEN h.sec % 2 = 0 AND regexp_matches(h.title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])chapter($|[^\\p{{L}}\\p{{N}}_]).*\\d') THEN h.title ELSE coalesce(l.listed, '') END AS title
 FROM {_PAGE_HEADS} h LEFT JOIN {_LISTED} l ON h.doc_id = l.doc_id AND h.link_id = l.link_id)"""


@query(
    f"""SELECT doc_id, link_id, md5(title) AS title, coalesce({_LINK_NUMBER} - 1, 0) AS chapter, row_number() OVER (PARTITION BY doc_id, link_id ORDER BY p) AS p, md5(text) AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, e ORDER BY p) AS n FROM (SELECT t.doc_id, t.sec, t.link_id, t.title, r.p, r.text, (NOT t.element AND r.text = t.title) AS e
 FROM {_DIV_TITLES} t JOIN {_PAGE_ROWS} r ON t.doc_id = r.doc_id AND t.sec = r.sec WHERE t.title <> '')) WHERE NOT (e AND n = 1) AND {_STORY}"""
)
def chapters_div(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of pages that divisions divide; every other one has a title element."""
    title = F.concat(F.lit('<div class="head"><p class="name calibre4">'), _escaped(F.coalesce("title", F.lit(""))), F.lit("<i> </i></p></div>"))
    chapter = F.concat(F.lit('<div class="y calibre" id="'), "link_id", F.lit('">'), F.when(F.col("sec") % 2 == 0, title).otherwise(""), F.coalesce("_body", F.lit("")), F.lit("</div>"))
    return C.parse_chapters(_page(spark, d, chapter, DIV["para_class"]), DIV).select("doc_id", "link_id", F.md5("title").alias("title"), "chapter", "p", F.md5("text").alias("text"))


_IDS_SQL = f"(SELECT doc_id, html, list_distinct_first AS ids FROM (SELECT doc_id, html, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_first FROM (SELECT doc_id, html, regexp_extract_all(html, 'href=\"#calibre_link-([0-9]+)\"', 1) AS l FROM {_PAGES_SQL})))"
_PART = """'<div class="calibre1"></div><h1 id="' || s.link_id || '" class="calibre1">' || coalesce(s.title, '') || '</h1>' || coalesce(b.body, '')"""
# The made pages are flat: chapters are what stands between separators, and the last has the wrapper's end.  If
# the table of contents links to the wrapper, that is the only division, and all of the page is its.
_SEGMENTS_SQL = f"""(SELECT c.doc_id, c.cid, CASE WHEN c.cid = '0' THEN regexp_replace(regexp_extract(i.html, '(?s)<div class="calibre" id="calibre_link-0">.*$'), '(?is)</body.*$', '') ELSE c.html END AS html FROM
 (SELECT doc_id, regexp_extract(link_id, '([0-9]+)$', 1) AS cid, part || CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY sec DESC) = 1 THEN '</div>' ELSE '' END AS html
  FROM (SELECT s.doc_id, s.sec, s.link_id, {_PART} AS part FROM {SECTIONS} s LEFT JOIN (SELECT doc_id, sec, string_agg('<p class="calibre2">' || text || '</p>', '' ORDER BY p) AS body FROM {PARAGRAPHS} GROUP BY doc_id, sec) b ON s.doc_id = b.doc_id AND s.sec = b.sec)
  UNION ALL SELECT DISTINCT doc_id, '0', '' FROM {SECTIONS}) c
 JOIN {_IDS_SQL} i ON c.doc_id = i.doc_id WHERE list_contains(i.ids, c.cid) AND (c.cid = '0' OR NOT list_contains(i.ids, '0')))"""


@query(f"SELECT doc_id, cid, len(html) AS n_chars, md5(html) AS html FROM {_SEGMENTS_SQL}")
def chapter_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each chapter's slice of its page."""
    return C.segments(written(pages(spark, d))).select("doc_id", "cid", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html"))


_SPLIT_SQL = f"""SELECT doc_id, chunk_no, first_number, last_number, label, file, n_segments, n_items, md5('<html>' || '<head>' || chr(10) || '    <meta charset="utf-8">' || chr(10) || '    <meta name="viewport" content="width=device-width, initial-scale=1.0">' || chr(10)
 || '    <title>' || title || '</title>' || chr(10) || '    <link rel="stylesheet" href="../../assets/style.css">' || chr(10) || '    <script src="../../assets/chapter.js"></script>' || chr(10) || '</head>' || chr(10) || '<body>'
 || chr(10) || '<div class="calibre" id="calibre_link-0">' || chr(10) || t1 || chr(10) || '      <h2>' || label || '</h2>' || chr(10) || '      <ul style="list-style: none; padding: 0;">' || chr(10) || '        ' || array_to_string(lis, chr(10) || '        ')
 || chr(10) || '      </ul>' || chr(10) || '    ' || '</nav>' || chr(10) || '</div>' || chr(10) || chr(10) || coalesce(body, '') || chr(10) || footer) AS html
 FROM (SELECT *, CASE WHEN first_number IS NOT NULL AND last_number IS NOT NULL THEN 'Chapters ' || first_number || ' - ' || last_number ELSE 'Chapters ' || a || ' - ' || b END AS label,
  'index_' || coalesce(first_number, a) || '_' || coalesce(last_number, b) || '.html' AS file FROM (SELECT c.*, {INTEGER.format(r"regexp_extract(lis[1], 'Chapter\s+(\d+)', 1)")} AS first_number, {INTEGER.format(r"regexp_extract(lis[-1], 'Chapter\s+(\d+)', 1)")} AS last_number,
  coalesce(g.n, 0)::INT AS n_segments, g.body FROM (SELECT doc_id, k::INT AS chunk_no, (k - 1) * 4 + 1 AS a, least(k * 4, len(ids)) AS b, items[(k - 1) * 4 + 1 : k * 4] AS lis, len(items)::INT AS n_items, t1, title, footer
   FROM (SELECT doc_id, ids, regexp_extract(html, '(?s)(<nav[^>]*?role="doc-toc"[^>]*>)', 1) AS t1, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*?role="doc-toc"[^>]*>(.*?)</nav>', 1), '(?s)(<li[^>]*>.*?</li>)', 1) AS items,
    regexp_extract(html, '(?i)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)</body>\\s*</html>') AS footer FROM {_IDS_SQL} WHERE len(ids) > 0), unnest(range(1, (len(ids) + 3) // 4 + 1)) u(k)) c
  LEFT JOIN (SELECT i.doc_id, (i.k - 1) // 4 + 1 AS chunk_no, count(*) AS n, string_agg(s.html, '' ORDER BY i.k) AS body FROM (SELECT doc_id, unnest(ids) AS cid, unnest(range(1, len(ids) + 1)) AS k FROM {_IDS_SQL}) i JOIN {_SEGMENTS_SQL} s ON i.doc_id = s.doc_id AND i.cid = s.cid GROUP BY 1, 2) g
  ON c.doc_id = g.doc_id AND c.chunk_no = g.chunk_no))"""


@query(_SPLIT_SQL)
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Split files of four chapters each."""
    return C.split_pages(written(pages_in_parts(spark, d)), 4).withColumn("html", F.md5("html"))


@query(
    f"""SELECT doc_id, unnest(regexp_extract_all(html, '<h1 id="(calibre_link-\\d+)" class="calibre1">(.*?)</h1>', 1)) AS link_id, unnest(regexp_extract_all(html, '<h1 id="(calibre_link-\\d+)" class="calibre1">(.*?)</h1>', 2)) AS title FROM {_PAGES_SQL}"""
)
def page_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headings of pages by pattern."""
    return pages(spark, d).select("doc_id", F.explode(H.headers(F.col("html"))).alias("h")).select("doc_id", "h.link_id", "h.title")


@query(
    f"""SELECT doc_id, {_LINK_NUMBER}::BIGINT AS link, k AS place, CASE WHEN k = 0 THEN link_id ELSE 'Chapter - ' || ({_LINK_NUMBER} + 1) END AS text FROM (SELECT doc_id, link_id FROM {SECTIONS} WHERE link_id IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 'calibre_link-0' FROM {SECTIONS}), range(2) t(k)"""
)
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Divisions and their labels, interleaved."""
    chapter = F.concat(F.lit('<div class="y calibre" id="'), "link_id", F.lit('"></div>'))
    html = _page(spark, d, chapter, "calibre2", '<div class="calibre" id="calibre_link-0"></div><div class="calibre1" id="calibre_link-9"></div>')
    rows = C.label_rows(H.html_nodes(html, texts=False)).withColumn("id", F.max(F.when(F.col("place") == 0, F.col("text"))).over(W.Window.partitionBy("doc_id", "pos")))
    return rows.select("doc_id", S.link_number(F.col("id")).alias("link"), F.col("place").cast("bigint").alias("place"), "text")


@query(
    f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.k, b.k) AS k, a.item, b.cid, a.k IS NOT NULL AND b.k IS NOT NULL AS paired FROM (SELECT doc_id, md5(li_html) AS item, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ref_id) AS k FROM {TOC}) a
 FULL JOIN (SELECT doc_id, unnest(ids) AS cid, unnest(range(1, len(ids) + 1)) AS k FROM {_IDS_SQL}) b ON a.doc_id = b.doc_id AND a.k = b.k"""
)
def toc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """List items and ids of a table of contents by place; what has no partner is kept and told."""
    rows = W.chunks(toc(spark, d).withColumn("_p", F.struct("pos", "ref_id")).withColumn("order", F.col("pos").cast("bigint")), ["doc_id"], "order", 1)
    items = rows.select("doc_id", F.col("place").alias("k"), F.md5("li_html").alias("item"))
    ids = C.toc_ids(pages(spark, d)).select("doc_id", F.posexplode("ids").alias("k", "cid")).withColumn("k", F.col("k").cast("bigint") + 1)
    return W.zip_rows(items, ids, ["doc_id", "k"], unpaired=True).select("doc_id", "k", "item", "cid", "paired")
