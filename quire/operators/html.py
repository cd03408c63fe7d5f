"""HTML structure (H1 to H25): a table function for exact trees, patterns where the text is regular."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as S

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODES = (
    "pos INT, parent_pos INT, depth INT, tag STRING, id STRING, classes ARRAY<STRING>, attrs MAP<STRING,STRING>, "
    "text STRING, joined STRING, direct STRING, ancestors ARRAY<INT>"
)
PORTION = 1 << 18  # characters of a page's parts that are parsed at a time
NODES_AT_ONCE = 4096  # elements of a batch that leaves Python


class _Tree(HTMLParser):
    """Elements, each handed over in ``done`` once nothing can be added to it; an end tag closes the nearest open element of its name, or nothing.

    A page may be fed in parts; a text that goes on in the next part is one text.
    """

    def __init__(self, texts: bool | frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.texts = texts
        self.n = 0
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.in_text = self.goes_on = False

    def feed(self, data: str) -> None:
        self.goes_on = self.in_text
        super().feed(data)

    def close(self) -> None:
        self.goes_on = self.in_text
        super().close()
        self._finish(0)

    def _finish(self, k: int) -> None:
        self.done += [n for n in self.open[k:] if n["told"]]
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.in_text = self.goes_on = False
        told = self.texts is True or bool(self.texts) and tag in self.texts
        own = {k: v or "" for k, v in attrs}
        node = {"pos": self.n, "parent_pos": self.open[-1]["pos"] if self.open else -1, "depth": len(self.open), "tag": tag, "id": own.get("id"), "classes": own.get("class", "").split(), "attrs": own, "told": told, "pieces": [], "own": [], "ancestors": [n["pos"] for n in self.open]}
        self.n += 1
        if tag not in VOID:
            self.open.append(node)
        if tag in VOID or not told:
            self.done.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._finish(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.in_text = self.goes_on = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                self._finish(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.texts:
            return
        for n in self.open:
            if n["told"]:
                if self.goes_on:
                    n["pieces"][-1] += data
                else:
                    n["pieces"].append(data)
        if self.open and self.open[-1]["told"]:
            self.open[-1]["own"].append(data)
        self.in_text, self.goes_on = True, False

    def handle_comment(self, data: str) -> None:
        self.in_text = self.goes_on = False
        if self.open and self.open[-1]["told"]:
            self.open[-1]["own"].append(data)

    def handle_decl(self, decl: str) -> None:
        self.in_text = self.goes_on = False

    handle_pi = unknown_decl = handle_decl

    def taken(self) -> list[dict]:
        """The elements that are done and were not yet taken, in document order."""
        out, self.done = sorted(self.done, key=lambda n: n["pos"]), []
        for n in out:
            pieces = [p for p in (x.strip() for x in n.pop("pieces")) if p]
            own = "".join(n.pop("own")).strip()
            n["text"], n["joined"], n["direct"] = (" ".join(pieces), "".join(pieces), own) if n["told"] else (None, None, None)
        return out


def parse(html: str | None, texts: bool | frozenset[str] = True) -> list[dict]:
    """H1: nodes of a document; none for null or empty text.  ``texts`` names the elements whose text is wanted, if not that of all or of none.

    ``text`` joins the stripped pieces of all text below by a space (H10), ``joined`` by
    nothing (H11), ``direct`` is the node's own text with comments (H8).
    """
    if not html:
        return []
    tree = _Tree(texts)
    tree.feed(html)
    tree.close()
    return tree.taken()


def _value(v: object, kind: str) -> object:
    """A value as it was before it became a number of pandas: nulls and integers beside nulls are floats there."""
    if v is pd.NaT or isinstance(v, float) and v != v and kind not in ("float", "double"):
        return None
    return int(v) if isinstance(v, float) and kind in ("tinyint", "smallint", "int", "bigint") else v


def html_nodes(docs: DataFrame, html: str = "html", texts: bool | frozenset[str] = True, key: str = "doc_id") -> DataFrame:
    """H1: one row an element, with the other columns of the document.

    An element's text holds that of all below it, so name the elements whose ``texts`` are read, or none.
    A document is a row, or, with a column ``part``, its rows of the same ``key`` in the order of ``part``,
    read as one text.  Such a document is never held as a whole: parts are fed to the parser as they come,
    and elements leave it as they end.
    """
    parts = "part" in docs.columns
    keep = [c for c in docs.columns if c not in (html, "part")]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [NODES])
    names = [c.split(" ")[0] for c in NODES.replace("MAP<STRING,STRING>", "MAP").split(", ")]

    def frame(rows: list[tuple[list, list[dict]]]) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([own[i] for own, nodes in rows for _ in nodes], dtype="object") for i, c in enumerate(keep)})
        for name in names:
            out[name] = [n[name] for _, nodes in rows for n in nodes]
        return out

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[dict]]]:
        """(columns kept, elements that are done), a document once or more often."""
        tree, at, own, held, chars = None, None, [], [], 0
        for pdf in batches:
            for *row, text in zip(*(pdf[c].tolist() for c in keep), pdf[html]):
                row = [_value(v, kinds[c]) for c, v in zip(keep, row)]
                now = row[keep.index(key)] if parts else None
                if tree is not None and not (parts and now == at):
                    tree.feed("".join(held))
                    tree.close()
                    yield own, tree.taken()
                    tree = None
                if tree is None:
                    tree, at, own, held, chars = _Tree(texts), now, row, [], 0
                if text:
                    held.append(text)
                    chars += len(text)
                if chars >= PORTION:
                    tree.feed("".join(held))
                    held, chars = [], 0
                    yield own, tree.taken()
        if tree is not None:
            tree.feed("".join(held))
            tree.close()
            yield own, tree.taken()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for own, nodes in documents(batches):
            for i in range(0, len(nodes), NODES_AT_ONCE):
                some = nodes[i : i + NODES_AT_ONCE]
                out.append((own, some))
                n += len(some)
                if n >= NODES_AT_ONCE:
                    yield frame(out)
                    out, n = [], 0
        if n:
            yield frame(out)

    if parts:
        docs = docs.repartition(key).sortWithinPartitions(key, "part").select(*keep, html)
    return docs.mapInPandas(rows, schema)


def has_class(name: str) -> Column:
    """Class token of a node."""
    return F.array_contains("classes", name)


def is_chapter_div() -> Column:
    """Div of a chapter: class token and link id, the wrapper left out."""
    return (F.col("tag") == "div") & has_class("calibre") & F.col("id").startswith("calibre_link-") & (F.col("id") != "calibre_link-0")


def is_wrapper() -> Column:
    """H4: the file's wrapper."""
    return (F.col("tag") == "div") & has_class("calibre") & (F.col("id") == "calibre_link-0")


def is_heading() -> Column:
    """P5: boundary of a section."""
    return (F.col("tag") == "h1") & F.col("id").startswith("calibre_link-")


def children(nodes: DataFrame, parents: DataFrame, key: str = "doc_id") -> DataFrame:
    """H6: direct children of ``parents`` (key, pos), elements in order of ``pos``."""
    up = parents.select(F.col(key).alias("_key"), F.col("pos").alias("_pos"))
    return nodes.join(up, (nodes[key] == F.col("_key")) & (F.col("parent_pos") == F.col("_pos")), "left_semi")


def descendants(nodes: DataFrame, tops: DataFrame, key: str = "doc_id") -> DataFrame:
    """H9: nodes below ``tops`` with the nearest one's ``top``; a nested top's nodes count for each."""
    above = nodes.withColumn("top", F.explode("ancestors"))
    up = tops.select(F.col(key).alias("_key"), F.col("pos").alias("_pos"))
    return above.join(up, (above[key] == F.col("_key")) & (F.col("top") == F.col("_pos")), "left_semi")


def matches(part: str) -> Column:
    """One step of a selector: ``tag``, ``tag.class`` or ``.class``."""
    tag, _, cls = part.partition(".")
    return (F.col("tag") == tag if tag else F.lit(True)) & (has_class(cls) if cls else F.lit(True))


def select_first(nodes: DataFrame, tops: DataFrame, selector: str, key: str = "doc_id") -> DataFrame:
    """H7: first match of a selector below each top: (key, top, pos, text, joined, direct).

    Steps are ``tag``, ``tag.class`` and ``.class``, any number of them, each below the one
    before.  Only the last has to stand below the top; the others may be above it, as in
    browsers.
    """
    *outer, last = selector.split()
    chosen = None
    for part in outer:
        hit = nodes if chosen is None else descendants(nodes, chosen, key).drop("top")
        chosen = hit.where(matches(part)).select(key, "pos").distinct()
    found = descendants(nodes.where(matches(last)), tops, key)
    if chosen is not None:
        up = chosen.select(F.col(key).alias("_k"), F.col("pos").alias("_p"))
        inner = nodes.where(matches(last)).select(key, "pos", F.explode("ancestors").alias("_up"))
        inner = inner.join(up, (inner[key] == up["_k"]) & (inner["_up"] == up["_p"]), "left_semi").select(key, "pos").distinct()
        found = found.join(inner, [key, "pos"], "left_semi")
    return found.groupBy(key, "top").agg(F.min_by(F.struct("pos", "text", "joined", "direct"), "pos").alias("_n")).select(key, "top", "_n.*")


def own_text(direct: Column, joined: Column) -> Column:
    """H8: an element's own text, or all of it where it has none of its own."""
    return S.falsy(direct, joined)


def toc_links(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """H2: links inside a table of contents: (key, pos, href, joined)."""
    nav = nodes.where("tag = 'nav' and attrs['role'] = 'doc-toc'")
    return descendants(nodes, nav, key).where("tag = 'a' and attrs['href'] is not null").select(key, "pos", F.col("attrs")["href"].alias("href"), "joined").distinct()


TITLE, NO_TITLE = r"(?id)<title>(.*?)</title>", "Unknown"
FOOTER, NO_FOOTER = r"(?i)</body>\s*</html>", "</body></html>"


def title(html: Column) -> Column:
    """First title element, as it is even if empty; ``Unknown`` without one."""
    return F.when(html.rlike(TITLE), F.regexp_extract(html, TITLE, 1)).otherwise(NO_TITLE)


def clean_head(name: Column) -> Column:
    """Head of a split file.  Fixed values: its lines."""
    before = '<head>\n    <meta charset="utf-8">\n    <meta name="viewport" content="width=device-width, initial-scale=1.0">\n    <title>'
    after = '</title>\n    <link rel="stylesheet" href="../../assets/style.css">\n    <script src="../../assets/chapter.js"></script>\n</head>'
    return F.concat(F.lit(before), name, F.lit(after))


def footer(html: Column) -> Column:
    """End of body and file, as it is or by default."""
    return F.when(html.rlike(FOOTER), F.regexp_extract(html, FOOTER, 0)).otherwise(NO_FOOTER)


def body_end(html: Column) -> Column:
    """Offset of the body's end tag, in any case of letters, else the length."""
    # Not regexp_instr, which counts a character beyond the basic plane as two.
    return F.length(F.split(html, "(?i)</body", 2)[0])


def toc_block(html: Column) -> Column:
    """H3: inside of the first table of contents with double-quoted role, NULL without one."""
    return S.first_group(html, r'(?s)<nav[^>]*?role="doc-toc"[^>]*>(.*?)</nav>')


def list_items(markup: Column) -> Column:
    """Array of the insides of list items."""
    return F.regexp_extract_all(markup, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))


def headers(html: Column) -> Column:
    """Array of STRUCT<link_id, title> of headings on one line; the inside is kept raw."""
    pattern = F.lit(r'(?d)<h1 id="(calibre_link-\d+)" class="calibre1">(.*?)</h1>')
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("b")),
        lambda x: F.struct(x["a"].alias("link_id"), x["b"].alias("title")),
    )


def toc_nav(rows: Column) -> Column:
    """A table of contents of an ARRAY<STRUCT<link_id, title>>, in its order.  Fixed values: its lines and indents."""
    head = '      <nav type="toc" id="toc_main" role="doc-toc">\n        <h2 class="calibre1">Table of Contents</h2>\n        <ol class="calibre2">\n'
    item = lambda r: F.concat(F.lit('          <li class="calibre3">\n            <a href="#'), r["link_id"], F.lit('">'), r["title"], F.lit("</a>\n          </li>\n"))
    return F.concat(F.lit(head), F.array_join(F.transform(rows, item), ""), F.lit("        </ol>\n      </nav>"))


def insert_after(html: Column, target: str, block: Column) -> Column:
    """``block`` on a new line after every ``target``; NULL if there is none.  Not idempotent."""
    return F.when(F.contains(html, F.lit(target)), F.replace(html, F.lit(target), F.concat(F.lit(target + "\n"), block)))


def label(link: Column) -> Column:
    """Label of a chapter division: number of its link plus one."""
    return F.concat(F.lit("Chapter - "), (S.link_number(link) + 1).cast("string"))
