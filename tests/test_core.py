"""Small fixtures for the core: scans, structure, references, library and HTML."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import paths
from quire.functions import text as S
from quire.operators import bloom
from quire.operators import chapters as C
from quire.operators import html as H
from quire.operators import library as L
from quire.operators import references as R
from quire.operators import structure as W
from quire.plans.scan import running
from quire.session import once
from quire.sources import audio, readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_equals_one_window_across_blocks(spark):
    data = [(k, i, (i * 7) % 5 if i % 3 else None) for k in ("hot", None) for i in range(50)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    got = {(r.k, r.pos): (r.a, r.b) for r in running(running(df, ["k"], "pos", F.col("v"), "a", block=7), ["k"], "pos", F.col("v"), "b", how="max", inclusive=False, block=7).collect()}
    for key in ("hot", None):
        total, top = None, None
        for k, i, v in [x for x in data if x[0] == key]:
            total = total if v is None else (total or 0) + v
            assert got[key, i] == (total, top)
            top = top if v is None else max(v, top if top is not None else v)


def test_sessions_drop_rows_before_the_first_boundary(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, None), (1, 3, True), (1, 4, False)], "d int, pos long, b boolean")
    assert [(p, s) for _, p, _, s in rows(W.sessionize(df, ["d"], "pos", F.col("b")))] == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert W.sessionize(df.limit(0), ["d"], "pos", F.col("b")).count() == 0


def test_asof_is_strict_and_falls_back_to_itself(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 6, True), (1, 9, False)], "d int, pos long, m boolean")
    assert [(p, s) for _, p, _, s in rows(W.asof_before(df, ["d"], "pos", F.col("m"), "s"))] == [(5, 5), (6, 5), (9, 6)]


def test_slices_end_at_unwanted_anchors_too(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "x", 7), (1, "b", 9)], "d int, cid string, pos int")
    got = W.slices(df, ["d"], "pos", F.lit(12)).where("cid <> 'x'")
    assert rows(got.select("cid", "pos", "slice_end")) == [("a", 3, 7), ("b", 9, 12)]


def test_chunks_of_two_over_five_with_mixed_numbers(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([1780, None, None, 3, 9])], "d int, pos long, n long")
    got = W.chunk_labels(W.chunks(df, ["d"], "pos", 2), ["d"], "pos", "n").orderBy("chunk_no").select("label", "file", "n_chapters")
    assert [tuple(r) for r in got.collect()] == [("Chapters 1 - 2", "index_1780_2.html", 2), ("Chapters 3 - 4", "index_3_3.html", 2), ("Chapters 9 - 9", "index_9_9.html", 1)]


def test_timeline_is_contiguous(spark):
    df = spark.createDataFrame([(1, 1, 1000), (1, 2, 2500), (1, 3, 10), (1, 4, None)], "d int, pos long, ms long")
    got = W.timeline(df, ["d"], "pos", F.col("ms")).orderBy("pos").select("start_ms", "end_ms", "element")
    assert [tuple(r) for r in got.collect()] == [(0, 1000, "ch000"), (1000, 3500, "ch001"), (3500, 3510, "ch002"), (3510, 3510, "ch003")]


def test_title_row_goes_once_and_only_without_element(spark):
    df = spark.createDataFrame([(1, 1, "T", "T"), (1, 2, "x", "T"), (1, 3, "T", "T")], "d int, p int, text string, title string")
    assert [r.p for r in W.drop_title_row(df, ["d"], "p", "text", "title", F.lit(False)).orderBy("p").collect()] == [2, 3]
    assert W.drop_title_row(df, ["d"], "p", "text", "title", F.lit(True)).count() == 3


def test_story_filter(spark):
    df = spark.createDataFrame([(t,) for t in ["~~ -- ==", "1. note", "1.note", '"..."', "", " *", None]], "t string")
    assert [r.t for r in df.where(S.is_story(F.col("t"))).collect()] == ["1.note", '"..."']


def test_scalars(spark):
    one = spark.createDataFrame([("chapter_1780.mp3", "x\x93y\x94", "5")], "n string, e string, i string")
    got = one.select(S.file_number(F.col("n")), S.fix_encoding(F.col("e")), S.padded(F.lit(1780)), S.padded(F.lit(7)), S.backoff(F.lit(4)), S.to_ms(F.lit(1.2349))).first()
    assert tuple(got) == (1780, "x“y”", "1780", "007", 8.0, 1234)
    parts = spark.createDataFrame([("Dr. Drey met J. R. Vale. “Run!” Enough!",)], "t string").select(S.sentences(F.col("t")).alias("s")).first().s
    assert parts == ["Dr. Drey met J. R. Vale.", "“Run!”", "Enough!"]


def test_decode_policies(spark):
    df = spark.createDataFrame([(bytearray(b"a\xc2\x93b\r\nc"),), (bytearray(b"a\x93b"),)], "raw binary")
    got = [tuple(r) for r in df.select(readers.decode(F.col("raw"), "replace"), readers.decode(F.col("raw"), "latin1")).collect()]
    assert got == [("a\x93b\nc", "a\x93b\nc"), ("a�b", "a\x93b")]


def test_catalogue_files(spark, tmp_path):
    assert readers.catalogue(spark, f"{tmp_path}/none.json").count() == 0
    df = spark.createDataFrame([("n", "t", (1, 2), "p"), (None, "u", None, "q")], readers.CATALOGUE)
    writers.catalogue(df, f"{tmp_path}/c.json")
    assert rows(readers.catalogue(spark, f"{tmp_path}/c.json")) == rows(df)


def test_named_files_and_header_lines(spark, tmp_path):
    writers.write_named(spark.createDataFrame([("a/x.html", "<p>"), ("b.html", None)], "path string, html string"), str(tmp_path / "o"))
    assert (tmp_path / "o/a/x.html").read_text() == "<p>" and (tmp_path / "o/b.html").read_text() == ""
    (tmp_path / "h.txt").write_text("calibre_link-1|A | B\n\nbad\n")
    assert rows(readers.header_lines(spark, str(tmp_path / "h.txt"))) == [("bad", None, False), ("calibre_link-1", "A | B", True)]


def test_catalogue_replacement_keeps_null_keys(spark):
    old = spark.createDataFrame([("N", "N Chs 1-2", None, "novels/n/a.html"), (None, "Old", None, None), ("M", "M", None, "n/x.html")], readers.CATALOGUE)
    new = spark.createDataFrame([("N", "new", None, "p")], readers.CATALOGUE)
    assert [r[1] for r in rows(L.replace_entries(old, new, "n", "N").select("path", "title"))] == ["Old", "new"] or rows(L.replace_entries(old, new, "n", "N").select("title")) == [("Old",), ("new",)]


def test_selection_and_requests(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "ch long")
    assert L.select_chapters(df, "ch", span=(5, 1)).count() == 0 and L.select_chapters(df, "ch", one=2).count() == 2
    with pytest.raises(ValueError):
        L.select_chapters(df, "ch", one=1, several=[1])
    assert [tuple(r) for r in L.requested(df, "ch", 2, 3).collect()] == [(2, True), (3, False)] and L.requested(df, "ch", 3, 2).count() == 0
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", None), ("d", 9)], "g string, ch long")
    got = {r.g: (r["first"], r["last"], r.found, r.missing, r.status) for r in L.selection_report(groups, ["g"], "ch", [2, 1, 2]).collect()}
    assert got == {"a": (1, 2, [1, 2], [], "ok"), "b": (2, 2, [2], [1], "warning"), "c": (0, 0, [], [1, 2], "error"), "d": (9, 9, [], [1, 2], "error")}
    assert L.selection_report(groups, ["g"], "ch", []).where("status <> 'error'").count() == 0
    with pytest.raises(ValueError):
        L.selected(df, "ch", one=77)


def test_manifest_resume_and_voice(spark):
    df = spark.createDataFrame([(1, 1, 1, "***"), (1, 1, 2, "One. Two!"), (1, 1, 3, None)], "doc_id int, sec int, p int, text string")
    work = L.manifest(df, ["doc_id", "sec"], F.col("sec"))
    assert [r.file for r in work.orderBy("s").collect()] == ["ch001_p001_s001.mp3", "ch001_p001_s002.mp3"]
    out = spark.createDataFrame([("ch001_p001_s001.mp3", 0), ("ch001_p001_s002.mp3", 5)], "file string, length int")
    assert [r.file for r in L.todo(work, out, ["file"]).collect()] == ["ch001_p001_s001.mp3"]
    spoken = L.synthesize(work, lambda t: None if t == "One." else t.encode(), parallel=1, base=0.0)
    assert [(r.file, bytes(r.audio)) for r in spoken.collect()] == [("ch001_p001_s002.mp3", b"Two!")]
    titled = L.manifest(df, ["doc_id", "sec"], F.col("sec"), spark.createDataFrame([(1, 1, "T"), (1, 2, " "), (1, 3, None)], "doc_id int, sec int, title string"))
    assert sorted(r.file for r in titled.collect()) == ["ch001_p000_s000.mp3", "ch001_p001_s001.mp3", "ch001_p001_s002.mp3"]


def test_voice_is_tried_again_before_a_text_is_skipped(spark, tmp_path):
    calls = tmp_path / "calls"

    def speak(text):
        with open(calls, "a") as f:
            f.write(text + "\n")
        n = calls.read_text().split("\n").count(text)
        if text == "late":
            return b"x" if n == 3 else None
        if text == "never":
            return None
        raise OSError("down")

    df = spark.createDataFrame([("a", "late"), ("b", "never")], "file string, sentence string")
    assert [(r.file, bytes(r.audio)) for r in L.synthesize(df, speak, parallel=1, base=0.0).collect()] == [("a", b"x")]
    assert calls.read_text().split("\n").count("never") == 5
    with pytest.raises(Exception, match="down"):
        L.synthesize(spark.createDataFrame([("c", "broken")], "file string, sentence string"), speak, parallel=1, base=0.0).collect()


def test_tags_drop_the_old_picture(spark):
    one = spark.createDataFrame([({"APIC": "old", "XTRA": "1"}, None)], "old map<string,string>, cover binary")
    assert one.select(L.upsert_tags(F.col("old"), F.create_map(F.lit("TIT2"), F.lit("t")), F.col("cover")).alias("t")).first().t == {"XTRA": "1", "TIT2": "t"}


HTML = """<body><div class="calibre" id="calibre_link-0"><nav role="doc-toc"><ol><li><a href="#calibre_link-1">One</a></li></ol></nav>
<h1 id="calibre_link-1" class="calibre1">Chapter <b>1</b></h1><p class="calibre2 x">a <i>b</i><br>c</p></div></div><!-- end --></body>"""


def test_html_nodes(spark):
    nodes = H.html_nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "")], "doc_id int, html string"))
    assert [r.tag for r in H.children(nodes, nodes.where(H.is_wrapper())).orderBy("pos").collect()] == ["nav", "h1", "p"]
    p = nodes.where("tag = 'p'").first()
    assert (p.text, p.joined, p.direct, p.classes) == ("a b c", "abc", "a c", ["calibre2", "x"])
    assert [(r.href, r.joined) for r in H.toc_links(nodes).collect()] == [("#calibre_link-1", "One")]
    assert H.select_first(nodes, nodes.where(H.is_wrapper()), "h1 b").first().text == "1"
    assert H.select_first(nodes, nodes.where("tag = 'h1'"), "div.calibre h1 b").first().text == "1"
    assert H.select_first(nodes, nodes.where("tag = 'h1'"), "p.calibre2 b").count() == 0
    bare = H.html_nodes(spark.createDataFrame([(1, HTML)], "doc_id int, html string"), texts=False)
    assert bare.count() == nodes.count() and bare.where("text is not null or direct is not null").count() == 0


def test_pages_in_parts_are_read_as_one_text(spark):
    html = "<p>a &amp; b</p><div><p>one<!-- c --> two<br>three <b>x</b></p><p class='k'>loose<p>nested</div><script>if (a < b) '</p>'</script>&lt;end"
    whole = [(r.pos, r.parent_pos, r.depth, r.tag, r.text, r.joined, r.direct, r.ancestors) for r in H.html_nodes(spark.createDataFrame([(7, html)], "doc_id int, html string")).orderBy("pos").collect()]
    for step in (1, 3, 10):
        cut = [(7, i, html[i : i + step]) for i in range(0, len(html), step)][::-1] + [(8, 0, "<i>"), (8, 1, "other</i>"), (9, 0, None)]
        rows = H.html_nodes(spark.createDataFrame(cut, "doc_id int, part int, html string")).orderBy("doc_id", "pos").collect()
        assert [(r.pos, r.parent_pos, r.depth, r.tag, r.text, r.joined, r.direct, r.ancestors) for r in rows if r.doc_id == 7] == whole
        assert [(r.doc_id, r.tag, r.text) for r in rows if r.doc_id != 7] == [(8, "i", "other")]


def test_elements_of_a_long_page_leave_the_parser_early():
    tree = H._Tree(frozenset({"p"}))
    for k in range(1000):
        tree.feed(f"<p>{k}</p>" if k else "<body><p>0</p>")
        assert len(tree.done) <= 2 and len(tree.open) == 1
        assert tree.taken()[-1]["text"] == str(k)
    tree.close()
    assert tree.taken() == []


def test_split_layout_leaves_the_wrapper_without_headings(spark):
    html = '<div class="calibre" id="calibre_link-0"><nav></nav></div><h1 id="calibre_link-5">C</h1>'
    nodes = H.html_nodes(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    assert H.children(nodes, nodes.where(H.is_wrapper())).where(H.is_heading()).count() == 0


def test_toc_insertion_needs_its_target(spark):
    df = spark.createDataFrame([("aXbX",), ("ab",)], "h string")
    assert [r[0] for r in df.select(H.insert_after(F.col("h"), "X", F.lit("T"))).collect()] == ["aX\nTbX\nT", None]


CASES = [
    ("#calibre_link-3", ("novels/a b/i.html", "calibre_link-3")), ("../c%20d/x.html?v=2#calibre%5Flink-1", ("novels/c d/x.html", "calibre_link-1")),
    ("..\\e\\y.html", ("novels/e/y.html", None)), ("https://LIBRARY.example/n/z.html#calibre_link-0", ("n/z.html", "calibre_link-0")), ("//library.example/q.html", ("q.html", None)),
    ("/../../r.html", ("r.html", None)), ("#top", None), ("", None), (None, None), ("mailto:a@b", None), ("https://other.example/x.html", None), ("x.css", None), ("x.html#top", None), ("javascript:void(0)", None), (" ./s.html ", ("novels/a b/s.html", None)),
]


def test_href_resolution(spark):
    df = spark.createDataFrame([(i, h, "novels/a b/i.html") for i, (h, _) in enumerate(CASES)], "i int, h string, b string")
    got = {r.i: None if r.to is None else tuple(r.to) for r in paths.resolve_hrefs(df, "h", "b", "to").collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 500), max_size=60))
def test_bloom_filter_never_denies_a_parent(spark, present):
    blocks = bloom.blocks_for(max(1, len(present)))
    parents = spark.createDataFrame([(str(x),) for x in present] + [(None,)], "k string")
    refs = spark.createDataFrame([(str(x),) for x in range(520)] + [(None,)], "k string")
    built = bloom.build(parents, F.col("k"), blocks)
    got = {r.k: r.maybe for r in bloom.probe(refs, F.col("k"), built, blocks, "maybe").collect()}
    assert all(got[str(x)] for x in present) and got[None] is False
    assert sum(got[str(x)] for x in range(520)) - len(present) <= 40
    shuffled = {r.k: r.maybe for r in bloom.probe(refs, F.col("k"), built, blocks, "maybe", broadcast_mb=0).collect()}
    assert shuffled == got


def test_orphans_follow_time_spans(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    files = spark.createDataFrame([(1, "a.html", t(2), t(20))] * 2 + [(2, "b.html", t(1), None)], "doc_id long, path string, fetched_at timestamp_ntz, removed_at timestamp_ntz")
    sections = spark.createDataFrame([(1, "calibre_link-7", t(3), t(5)), (1, "calibre_link-7", t(9), None)], "doc_id long, link_id string, added_at timestamp_ntz, removed_at timestamp_ntz")
    refs = [("a.html", "calibre_link-7", 4), ("a.html", "calibre_link-7", 6), ("a.html", "calibre_link-7", 10), ("a.html", "calibre_link-7", 21), ("a.html", "calibre_link-0", 3), ("a.html", None, 1), ("b.html", "calibre_link-7", 4), ("c.html", None, 4), ("b.html", None, None), (None, None, 4)]
    df = spark.createDataFrame([("toc", i, t(n) if n else None, p, l) for i, (p, l, n) in enumerate(refs)], "ref_table string, ref_id long, t timestamp_ntz, path string, link string")
    assert sorted(r.ref_id for r in R.orphan_references(df, files, sections).collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert R.orphan_references(df.limit(0), files, sections).count() == 0
    assert R.orphan_references(df, files.limit(0), sections.limit(0)).count() == len(refs)


def test_story_filter_takes_very_long_decoration(spark):
    df = spark.createDataFrame([("*" * 100_000,), ("* 　" * 50_000,), ("*" * 100_000 + "x",)], "t string")
    assert [len(r.t) for r in df.where(S.is_story(F.col("t"))).collect()] == [100_001]


def test_once_drops_repeated_rows_only(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None), (2, None)], "k int, t string")
    assert rows(once(df, ["k"])) == [(1, "a"), (1, "b"), (2, None), (None, None)] and once(df.limit(0), ["k"]).count() == 0


def _page(toc, body, end="</body></html>"):
    return "<html><body>" + "".join(f'<a href="#calibre_link-{i}">x</a>' for i in toc) + body + end


def test_segments_of_headings(spark):
    sep, h1 = '<div class="calibre3" id="s"> </div>', lambda n: f'<h1 class="calibre1" id="calibre_link-{n}">C{n}</h1>'
    pages = [
        (1, _page([1, 2, 3], h1(1) + "a😀" + sep + h1(2) + "b" + sep + h1(9) + "no" + sep + h1(3) + "c", "</BODY></html>tail")),
        (2, _page([1, 2], "x" + sep + h1(1) + h1(2) + "both")),
        (3, _page([4], "no chapters")), (4, None), (5, ""),
        (6, _page([7, 8], h1(7) + "end", "")),
    ]
    got = {(r.doc_id, r.cid): r.html for r in C.segments(spark.createDataFrame(pages, "doc_id int, html string")).collect()}
    assert got == {(1, "1"): h1(1) + "a😀", (1, "2"): sep + h1(2) + "b", (1, "3"): sep + h1(3) + "c", (2, "1"): "", (2, "2"): sep + h1(1) + h1(2) + "both", (6, "7"): h1(7) + "end"}
    assert C.segments(spark.createDataFrame([], "doc_id int, html string")).count() == 0


def test_segments_of_divisions(spark):
    div = lambda n: f'<div\n x="1" class="calibre" id="calibre_link-{n}">'
    html = _page([2, 1, 2], div(0) + div(1) + "a</div>" + div(5) + "skip</div>" + div(2) + '<h1 id="calibre_link-1">b</h1></div>')
    got = {r.cid: r.html for r in C.segments(spark.createDataFrame([(1, html)], "doc_id int, html string")).collect()}
    assert got == {"1": div(1) + "a</div>", "2": div(2) + '<h1 id="calibre_link-1">b</h1></div>'}


def test_split_pages_rebuild_their_table(spark):
    items = "".join(f'<li><a href="#calibre_link-{i}">Chapter {i + 100}: T</a></li>' for i in (1, 2)) + '<li><a href="#calibre_link-3">Epilogue</a></li>'
    html = f'<html><title>N</title><body><nav role="doc-toc"><h2 class="x">All</h2><ol>{items}</ol></nav>' + "".join(f'<h1 id="calibre_link-{i}">{i}</h1>t{i}' for i in (1, 2, 3)) + "</body>\n</html>"
    got = C.split_pages(spark.createDataFrame([(1, html), (2, "<body>none</body>")], "doc_id int, html string"), 2).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.label, r.file, r.n_segments, r.n_items) for r in got] == [(1, "Chapters 101 - 102", "index_101_102.html", 2, 3), (2, "Chapters 3 - 3", "index_3_3.html", 1, 3)]
    assert got[0].html.startswith('<html><head>\n    <meta charset="utf-8">') and '<h2 class="x">Chapters 101 - 102</h2>' in got[0].html and got[0].html.endswith('<h1 id="calibre_link-2">2</h1>t2\n</body>\n</html>')
    assert "Epilogue" in got[1].html and "Chapter 101" not in got[1].html


def test_chapters_of_both_layouts(spark):
    nav = '<nav role="doc-toc"><a href="#calibre_link-1">Book - Chapter 1: A</a><a href="#calibre_link-2">Chapter 2</a><a href="#calibre_link-2">Chapter 2: B</a></nav>'
    flat = f'<div class="calibre" id="calibre_link-0">{nav}<p class="calibre2">before</p><h1 id="calibre_link-1">Chapter <b>7</b></h1><p class="x calibre2">one <i>two</i></p><p class="calibre2">***</p><p>other</p><h1 id="calibre_link-2"></h1><p class="calibre2">lost</p></div>'
    df = lambda h: spark.createDataFrame([(1, h), (2, None)], "doc_id int, html string")
    got = C.parse_chapters(df(flat), {"para_class": "calibre2", "flat_layout": True, "chapter_num_from_title": True})
    assert rows(got.select("link_id", "title", "chapter", "p", "text")) == [("calibre_link-1", "Chapter7", 1, 1, "one two")]
    div = nav + '<div class="calibre" id="calibre_link-1"><p class="t c4">Chapter 1<!-- x -->: A<i>!</i></p><p class="c4">a</p><p class="c4">1. note</p></div><div class="calibre" id="calibre_link-2"><p class="c4">Chapter 2: B</p><p class="c4">b</p><p class="c4">Chapter 2: B</p></div><div class="calibre" id="calibre_link-3"><p class="c4">untitled</p></div>'
    got = C.parse_chapters(df(div), {"para_class": "c4", "title_selector": "p.t", "id_offset": 1, "title_strip_prefix": True})
    assert rows(got.select("link_id", "title", "chapter", "p", "text")) == [("calibre_link-1", "Chapter 1 x : A", 0, 1, "a"), ("calibre_link-2", "Chapter 2: B", 1, 1, "b"), ("calibre_link-2", "Chapter 2: B", 1, 2, "Chapter 2: B")]


def test_split_pages_in_parts(spark):
    toc = "".join(f'<li><a href="#calibre_link-{k}">Chapter {k}</a></li>' for k in range(1, 6))
    head = f'<html><head><title>T</title></head><body><nav role="doc-toc"><h2 class="x">C</h2>{toc}</nav>'
    parts = [head, *(f'<div class="calibre1"></div><h1 id="calibre_link-{k}">Chapter {k}</h1><p>{k}</p>' for k in range(1, 7)), "late</BODY>\n</html>", '<h1 id="calibre_link-1">after</h1></body></html>']
    whole = C.split_pages(spark.createDataFrame([(1, "".join(parts))], "doc_id int, html string"), 2)
    cut = C.split_pages(spark.createDataFrame([(1, i, t) for i, t in enumerate(parts)][::-1], "doc_id int, part int, html string"), 2)
    rows = sorted(map(tuple, cut.collect()))
    assert rows == sorted(map(tuple, whole.collect())) and [r[6] for r in rows] == [2, 2, 1]
    assert rows[0][-1].endswith("<p>2</p>\n</BODY>\n</html>") and '<h2 class="x">Chapters 1 - 2</h2>' in rows[0][-1]


@pytest.mark.parametrize("config", [{"para_class": "c", "flat_layout": True}, {"para_class": "c", "title_selector": "p.t"}])
def test_chapters_of_pages_in_parts(spark, config):
    flat = "flat_layout" in config
    head = '<body><div class="calibre" id="calibre_link-0">' if flat else "<body>"
    start = (lambda k: f'<h1 id="calibre_link-{k}">Chapter {k}</h1>') if flat else (lambda k: f'</div><div class="calibre" id="calibre_link-{k}"><p class="t">Chapter {k}</p>')
    parts = [head, *(start(k) + "".join(f'<p class="c">{k} &amp;amp; {i}</p>' for i in range(3)) for k in range(1, 6)), "</body>"]
    rows = [(1, i, t) for i, t in enumerate(parts)][::-1] + [(2, 0, head + start(9) + '<p class="c">other</p>')]
    got = C.parse_chapters(spark.createDataFrame(rows, "doc_id int, part int, html string"), config).select("doc_id", "chapter", "p", "title", "text").collect()
    assert sorted(map(tuple, got)) == [(1, k, i + 1, f"Chapter {k}", f"{k} &amp; {i}") for k in range(1, 6) for i in range(3)] + [(2, 9, 1, "Chapter 9", "other")]


def test_labels_stand_after_their_divisions(spark):
    html = '<div class="calibre" id="calibre_link-0"></div><div class="x calibre" id="calibre_link-4"><div class="calibre1" id="calibre_link-5"></div></div><p class="calibre" id="calibre_link-6"></p>'
    got = C.label_rows(H.html_nodes(spark.createDataFrame([(1, html)], "doc_id int, html string"), texts=False)).orderBy("pos", "place")
    assert [r.text for r in got.collect()] == ["calibre_link-0", "Chapter - 1", "calibre_link-4", "Chapter - 5"]


def test_rows_are_paired_by_place(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(0, "p"), (2, "q")], "k int, b string")
    assert rows(W.zip_rows(a, b, ["k"])) == [(0, "x", "p")]
    assert sorted((r.k, r.paired) for r in W.zip_rows(a, b, ["k"], unpaired=True).collect()) == [(0, True), (1, False), (2, False)]


def _frame(version=3, bitrate=9, rate=0):
    head = bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | 1, bitrate << 4 | rate << 2, 0])
    size = 144 * audio.BITRATES[1][bitrate] * 1000 // audio.RATES[version][rate]
    return head + b"\0" * (size - 4)


def test_durations_and_tags_from_bytes(spark):
    text = lambda kind, body: kind.encode() + len(body).to_bytes(4, "big") + b"\0\0" + body
    frames = text("TIT2", b"\3Chapter 7") + text("COMM", b"\0eng\0note") + text("TALB", "\1".encode("latin-1") + "Bük".encode("utf-16")) + text("APIC", b"\0image")
    tag = b"ID3\3\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames
    data = [(1, tag + _frame() * 100), (2, _frame() * 10 + b"TAG" + b"x" * 125), (3, b"no audio"), (4, b""), (5, None)]
    df = spark.createDataFrame(data, "k int, content binary")
    got = {r.k: (r.ms, r.tags) for r in df.select("k", audio.mp3_duration_ms(F.col("content")).alias("ms"), audio.id3_frames(F.col("content")).alias("tags")).collect()}
    assert got[1] == (2612, {"TIT2": "Chapter 7", "COMM": "note", "TALB": "Bük", "APIC": ""}) and got[2] == (261, {})
    assert got[3] == got[4] == got[5] == (None, {})


def test_chapter_frames_replace_old_ones(spark):
    df = spark.createDataFrame([({"CHAP:x": "o", "CTOC": "o", "TIT2": "t"}, [("ch000", "A", 0, 5)]), (None, [])], "old map<string,string>, c array<struct<element:string,title:string,start_ms:long,end_ms:long>>")
    got = [r.f for r in df.select(L.chapter_frames(F.col("old"), F.col("c")).alias("f")).collect()]
    assert got == [{"TIT2": "t", "CHAP:ch000": "0|5|A", "CTOC:toc": "ch000"}, {"CTOC:toc": ""}]


def test_tracks_of_equal_directories_are_apart(spark):
    listing = ["/a/chapter_1/chapter_1.mp3", "/a/chapter_1/x_chapter_1.mp3", "/b/chapter_1/x_chapter_1.mp3", "/b/Chapter_02/old_chapter_02_b.mp3", "/b/chapter_3/chapter_1.mp3", "/b/notes/chapter_9.mp3"]
    got = L.pick_tracks(spark.createDataFrame([(p,) for p in listing], "path string")).collect()
    assert [r.path for r in got] == ["/a/chapter_1/chapter_1.mp3", "/b/Chapter_02/old_chapter_02_b.mp3", "/b/chapter_1/x_chapter_1.mp3"]


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "c.png").write_bytes(b"x")
    wanted = spark.createDataFrame([("a", str(tmp_path / "c.png")), ("b", str(tmp_path / "none.png")), ("c", None)], "book string, path string")
    assert {r.book: (r.content and bytes(r.content), r.missing) for r in readers.covers(spark, wanted).collect()} == {"a": (b"x", False), "b": (None, True), "c": (None, True)}
    assert readers.covers(spark, wanted.where("book = 'b'")).first().missing
    with pytest.raises(FileNotFoundError):
        readers.files(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        readers.listed_catalogue(spark, str(tmp_path / "none.json"))
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.listed_catalogue(spark, str(tmp_path / "e.json"))


def test_lines_are_streamed_into_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "z"), ("a", 2, "two"), ("a", 1, "one"), ("a", 3, None)], "name string, pos int, text string")
    writers.write_lines(df, str(tmp_path / "o"), "name", ["pos"], "text")
    assert (tmp_path / "o/a.txt").read_text() == "one\ntwo\n\n" and (tmp_path / "o/b.txt").read_text() == "z\n"
