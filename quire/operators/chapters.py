"""Chapters from HTML in both layouts, and files split by the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as S
from quire.operators import html as H
from quire.operators import structure as W
from quire.session import small, written

# The markup that chapters and separators are told by, and the wrapper of a table of contents.
DIV_ANCHOR = r'<div\s[^>]*class="calibre"[^>]*id="calibre_link-(\d+)"[^>]*>'
H1_ANCHOR = r'<h1[^>]*\bid="calibre_link-(\d+)"[^>]*>'
SEPARATOR = r'<div\s[^>]*class="calibre\d+"[^>]*>\s*</div>'
TOC_LINK = r'href="#calibre_link-(\d+)"'
TOC_WRAPPER = '<div class="calibre" id="calibre_link-0">'


def _titles(nodes: DataFrame, strip_prefix: bool) -> DataFrame:
    """(doc_id, link_id, listed) of the table of contents; the last entry of a link counts."""
    links = H.toc_links(nodes).withColumn("link_id", S.first_group(F.col("href"), r"(calibre_link-\d+)")).where("link_id is not null")
    title = S.strip_to_chapter(F.col("joined")) if strip_prefix else F.col("joined")
    return W.last_wins(links.withColumn("listed", title), ["doc_id", "link_id"], "pos", "listed")


def flat_chapters(nodes: DataFrame, para_class: str) -> DataFrame:
    """(doc_id, link_id, title, pos, text) of headings and paragraphs that stand directly in the wrapper.

    Paragraphs before the first heading belong to none.
    """
    wrapper = nodes.where(H.is_wrapper()).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    inside = H.children(nodes, wrapper).where(H.is_heading() | ((F.col("tag") == "p") & H.has_class(para_class)))
    rows = W.sessionize(inside.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "id", "text", "joined", H.is_heading().alias("heading")), ["doc_id"], "pos", F.col("heading"))
    heads = rows.where("heading").select("doc_id", "section", F.col("id").alias("link_id"), F.col("joined").alias("title"))
    return heads.join(rows.where("not heading").select("doc_id", "section", "pos", "text"), ["doc_id", "section"]).drop("section")


def div_chapters(nodes: DataFrame, para_class: str, title_selector: str | None, strip_prefix: bool) -> DataFrame:
    """(doc_id, link_id, title, pos, text) of chapters that are a division each.

    The title is the selected element's own text (all of its text if it has none), if it names
    a chapter and a number, else the listed one.  The element itself is no paragraph; without
    one, the first paragraph equal to the title isn't.
    """
    divs = nodes.where(H.is_chapter_div()).select("doc_id", F.col("pos").alias("top"), F.col("id").alias("link_id"))
    named = divs.join(_titles(nodes, strip_prefix), ["doc_id", "link_id"], "left")
    if title_selector:
        first = H.select_first(nodes, divs.withColumnRenamed("top", "pos"), title_selector).select("doc_id", "top", F.col("pos").alias("_element"), H.own_text(F.col("direct"), F.col("joined")).alias("_inline"))
        named = named.join(first, ["doc_id", "top"], "left")
    else:
        named = named.withColumns({"_element": F.lit(None).cast("int"), "_inline": F.lit(None).cast("string")})
    named = named.withColumn("title", S.trusted_title(F.col("_inline"), F.col("listed"))).where("title <> ''")
    inside = H.descendants(nodes.where((F.col("tag") == "p") & H.has_class(para_class)), divs.withColumnRenamed("top", "pos")).select("doc_id", "top", F.col("pos").cast("bigint").alias("pos"), "text")
    rows = named.join(inside, ["doc_id", "top"]).where(F.col("_element").isNull() | (F.col("pos") != F.col("_element")))
    rows = W.drop_title_row(rows, ["doc_id", "top"], "pos", "text", "title", F.col("_element").isNotNull())
    return rows.select("doc_id", "link_id", "title", "pos", "text")


def parse_chapters(pages: DataFrame, config: dict) -> DataFrame:
    """Paragraphs of all chapters: (doc_id, link_id, title, chapter, pos, p, text).

    ``pages``: (doc_id, html), or (doc_id, part, html) as `html.html_nodes` takes it, of one configuration: para_class, and flat_layout, title_selector,
    id_offset, title_strip_prefix and chapter_num_from_title where they differ from none.
    Chapters without a title or without a paragraph that tells the story have no row.
    """
    told = {"h1", "p", "a", *(part.partition(".")[0] for part in (config.get("title_selector") or "").split()[-1:])}
    texts = True if "" in told else frozenset(told)
    nodes = H.html_nodes(pages.withColumn("html", S.fix_encoding(F.col("html"))), texts=texts)
    # The nodes are read several times, the pages once.  A paragraph's text is written once, not in its three forms.
    if config.get("flat_layout"):
        titled = H.is_heading()
        nodes = nodes.where(H.is_wrapper() | H.is_heading() | ((F.col("tag") == "p") & H.has_class(config["para_class"]))).drop("attrs", "ancestors", "depth", "direct")
    else:
        titled = (F.col("tag") == "a") | (H.matches(config["title_selector"].split()[-1]) if config.get("title_selector") else F.lit(False))
        nodes = nodes.withColumns({"attrs": F.when(F.col("tag").isin("nav", "a"), F.col("attrs")), "direct": F.when(titled, F.col("direct"))}).drop("depth")
    nodes = written(nodes.withColumn("joined", F.when(titled, F.col("joined"))))
    if config.get("flat_layout"):
        rows = flat_chapters(nodes, config["para_class"])
    else:
        rows = div_chapters(nodes, config["para_class"], config.get("title_selector"), bool(config.get("title_strip_prefix")))
    story = rows.where((F.col("title") != "") & S.is_story(F.col("text")))
    number = S.chapter_index(F.col("title"), F.col("link_id"), F.lit(config.get("id_offset", 0)), F.lit(bool(config.get("chapter_num_from_title"))))
    return story.withColumns({"chapter": number, "p": F.row_number().over(Window.partitionBy("doc_id", "link_id").orderBy("pos"))})


def toc_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, ids): numbers of the links in a table of contents, the first of each, in order."""
    return pages.select("doc_id", F.array_distinct(F.regexp_extract_all("html", F.lit(TOC_LINK), F.lit(1))).alias("ids"))


def _in_parts(pages: DataFrame) -> DataFrame:
    return pages if "part" in pages.columns else pages.withColumn("part", F.lit(0).cast("bigint"))


def toc_rows(parts: DataFrame) -> DataFrame:
    """(doc_id, k, cid): numbers of the links in a page's parts, the first of each, numbered from 1 in order."""
    links = parts.select("doc_id", "part", F.posexplode(F.regexp_extract_all("html", F.lit(TOC_LINK), F.lit(1))).alias("at", "cid"))
    first = links.groupBy("doc_id", "cid").agg(F.min(F.struct("part", "at")).alias("_first"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")).alias("k"), "cid")


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, cid, html) of each chapter that the table of contents names.

    A page has divisions if one of them is in its table of contents, else headings.  A heading's
    chapter starts at the closest separator before it, or at the heading.  Chapters run to
    the next start, whether that one is named or not, the last to the end of the body.  Of
    headings after one separator the last has all of the text.  Of a repeated id the last counts.

    ``pages``: (doc_id, html), or (doc_id, part, html): a page's rows in the order of the integer ``part``,
    cut where no mark is cut.  Pages are cut into pieces at every mark, so a page's text is moved once, not once a chapter.
    """
    pages = _in_parts(pages)
    body = F.substring(F.col("html"), F.lit(1), H.body_end(F.col("html")))
    marks = rf"(?={DIV_ANCHOR}|{H1_ANCHOR}|{SEPARATOR})"
    cut = pages.select("doc_id", "part", F.col("html").rlike("(?i)</body").alias("_ends"), F.posexplode(F.split(body, marks)).alias("pos", "piece"))
    # A part has less than 2^31 pieces.
    cut = cut.withColumn("pos", F.col("part").cast("bigint") * (1 << 31) + F.col("pos"))
    seen = cut.withColumns(
        {
            "_div": S.first_group(F.col("piece"), f"^{DIV_ANCHOR}"),
            "_h1": S.first_group(F.col("piece"), f"^{H1_ANCHOR}"),
            "_separator": F.col("piece").rlike(f"^{SEPARATOR}"),
        }
    )
    seen = written(seen)  # read several times, while pages are cut once
    ends = seen.where("_ends").groupBy("doc_id").agg(F.min("part").alias("_end"))
    seen = seen.join(small(written(ends)), "doc_id", "left").where("_end is null or part <= _end").drop("part", "_ends", "_end")
    named = toc_rows(pages).select("doc_id", "cid")
    divided = seen.where("_div is not null").join(named, (seen.doc_id == named.doc_id) & (seen._div == named.cid), "left_semi").select("doc_id").distinct().withColumn("_divided", F.lit(True))
    rows = seen.join(divided, "doc_id", "left").withColumn("_divided", F.coalesce("_divided", F.lit(False)))
    rows = W.asof_before(rows, ["doc_id"], "pos", F.col("_separator"), "_from")
    own = F.when(F.col("_divided"), F.col("_div")).otherwise(F.col("_h1"))
    anchors = rows.withColumn("cid", own).where("cid is not null").select("doc_id", "cid", "pos", F.when(F.col("_divided"), F.col("pos")).otherwise(F.col("_from")).alias("start"))
    last = Window.partitionBy("doc_id", "start").orderBy(F.desc("pos"))
    anchors = anchors.withColumn("_last", F.row_number().over(last) == 1)
    starts = anchors.select("doc_id", F.col("start").alias("pos"), F.lit(True).alias("_start")).distinct()
    pieces = W.sessionize(rows.select("doc_id", "pos", "piece").join(starts, ["doc_id", "pos"], "left"), ["doc_id"], "pos", F.col("_start"))
    texts = pieces.groupBy("doc_id", "section").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_parts"))
    texts = texts.select("doc_id", "start", F.array_join("_parts.piece", "").alias("_text"))
    chapters = anchors.join(texts, ["doc_id", "start"]).withColumn("html", F.when(F.col("_last"), F.col("_text")).otherwise(""))
    latest = W.last_wins(chapters, ["doc_id", "cid"], "pos", "html")
    return latest.join(named, ["doc_id", "cid"], "left_semi")


def toc_heading(inner: Column) -> Column:
    """STRUCT<open, close> of the tags of the first heading in a table of contents, NULL without one."""
    head = r"(?s)(<h2[^>]*>)(.*?)(</h2>)"
    return F.when(inner.rlike(head), F.struct(F.regexp_extract(inner, head, 1).alias("open"), F.regexp_extract(inner, head, 3).alias("close")))


def chunk_toc(tag: Column, heading: Column, end_tag: Column, items: Column, label: Column) -> Column:
    """The table of contents of a split file: the first heading is replaced by the label, the list holds its items."""
    title = F.concat(F.coalesce(heading["open"], F.lit("<h2>")), label, F.coalesce(heading["close"], F.lit("</h2>")))
    # Indents and list style.
    return F.concat(
        tag, F.lit("\n      "), title, F.lit('\n      <ul style="list-style: none; padding: 0;">\n        '), F.array_join(items, "\n        "), F.lit("\n      </ul>\n    "), end_tag
    )


def split_pages(pages: DataFrame, n: int) -> DataFrame:
    """Files of ``n`` chapters each.

    Result: (doc_id, chunk_no, first_number, last_number, label, file, n_segments, n_items, html).  Chapters
    are taken by the order of ids, list items by their place; ``n_items`` differs from the
    ids' number where the two do not pair.  Pages without ids in a table have no row.  Pages may be in
    parts, as for `segments`; a table of contents, a title and a footer stand in one part each.
    """
    block = r'(?s)(<nav[^>]*?role="doc-toc"[^>]*>)(.*?)(</nav>)'
    pages = _in_parts(pages)
    h = F.col("html")
    ids = written(toc_rows(pages).withColumn("chunk_no", F.floor((F.col("k") - 1) / n).cast("int") + 1))

    def first(value: Column, there: Column) -> Column:
        return F.min(F.when(there, F.struct("part", value.alias("v"))))["v"]

    def group(g: int) -> Column:
        return F.regexp_extract(h, block, g)

    has_title, has_footer, has_toc = h.rlike(H.TITLE), h.rlike(H.FOOTER), h.rlike(block)
    # Of a table of contents, what is in every file of the page; its items are rows.
    heads = pages.where(has_title | has_footer | has_toc).groupBy("doc_id").agg(
        first(H.title(h), has_title).alias("_title"), first(H.footer(h), has_footer).alias("_footer"), first(F.struct(group(1).alias("t1"), group(3).alias("t3"), toc_heading(group(2)).alias("h")), has_toc).alias("_toc")
    )
    place = pages.where(has_toc).groupBy("doc_id").agg(F.min("part").alias("part"))
    items = pages.join(place, ["doc_id", "part"]).select("doc_id", F.posexplode(F.regexp_extract_all(group(2), F.lit(r"(?s)(<li[^>]*>.*?</li>)"), F.lit(1))).alias("k", "li"))
    items = written(items)
    lists = items.groupBy("doc_id", (F.floor(F.col("k") / n).cast("int") + 1).alias("chunk_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "li"))), lambda x: x["li"]).alias("_lis"))
    counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_items"))
    chunk = ids.groupBy("doc_id", "chunk_no").agg(F.min("k").alias("_a"), F.max("k").alias("_b")).join(heads, "doc_id", "left").join(counts, "doc_id", "left").join(lists, ["doc_id", "chunk_no"], "left")
    chunk = chunk.withColumns({"_lis": F.coalesce("_lis", F.array().cast("array<string>")), "n_items": F.coalesce("n_items", F.lit(0)), "_title": F.coalesce("_title", F.lit(H.NO_TITLE)), "_footer": F.coalesce("_footer", F.lit(H.NO_FOOTER))})
    chunk = chunk.withColumns({"first_number": S.item_number(F.get("_lis", F.lit(0))), "last_number": S.item_number(F.get("_lis", F.size("_lis") - 1))})
    both = F.col("first_number").isNotNull() & F.col("last_number").isNotNull()
    label = F.when(both, F.format_string("Chapters %d - %d", "first_number", "last_number")).otherwise(F.format_string("Chapters %d - %d", "_a", "_b"))
    chunk = chunk.withColumns({"label": label, "file": F.format_string("index_%d_%d.html", F.coalesce("first_number", "_a"), F.coalesce("last_number", "_b"))})
    parts = (
        ids.select("doc_id", "chunk_no", F.col("k").alias("_k"), "cid")
        .join(segments(pages).withColumnRenamed("html", "_segment"), ["doc_id", "cid"])
        .groupBy("doc_id", "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "_segment"))).alias("_parts"))
    )
    joined = chunk.join(parts, ["doc_id", "chunk_no"], "left")
    toc = chunk_toc(F.col("_toc.t1"), F.col("_toc.h"), F.col("_toc.t3"), F.col("_lis"), F.col("label"))
    wrapped = F.when(F.col("_toc").isNotNull(), F.concat(F.lit(f"\n{TOC_WRAPPER}\n"), toc, F.lit("\n</div>\n"))).otherwise("")
    html = F.concat(F.lit("<html>"), H.clean_head(F.col("_title")), F.lit("\n<body>"), wrapped, F.lit("\n"), F.coalesce(F.array_join("_parts._segment", ""), F.lit("")), F.lit("\n"), F.col("_footer"))
    return joined.select(
        "doc_id", "chunk_no", "first_number", "last_number", "label", "file",
        F.when(F.col("_parts").isNull(), 0).otherwise(F.size("_parts")).alias("n_segments"), "n_items", html.alias("html"),
    )


def label_rows(nodes: DataFrame) -> DataFrame:
    """Chapter divisions in a page with their labels after them: (doc_id, pos, place, text), to be sorted by pos and place.

    Every division with a link's id counts, the wrapper too.
    """
    kept = nodes.where((F.col("tag") == "div") & F.col("id").startswith("calibre_link-") & H.has_class("calibre") & F.col("id").rlike(r"^calibre_link-\d"))
    text = F.concat(F.lit("Chapter - "), (S.to_int(F.regexp_extract("id", r"calibre_link-(\d+)", 1)) + 1).cast("string"))
    both = F.array(F.struct(F.lit(0).alias("place"), F.col("id").alias("text")), F.struct(F.lit(1).alias("place"), text.alias("text")))
    return kept.select("doc_id", "pos", F.explode(both).alias("_r")).select("doc_id", "pos", "_r.*")
