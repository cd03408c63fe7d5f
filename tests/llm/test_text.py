"""Small fixtures for the text operators: brute force, round trips, nulls, empties, ties and long texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe, boilerplate, encoding, lookalike, mixing, pieces, residue, sentences, simhash, tokens
from quire.llm.components import connected_components

BASE = [
    "Íñigo Ruán guardó el mapa en la caja, señora.", "L'épée rouillée dort là où naît la brume.", "Die müde Köchin zählte die Münzen für größere Nöte.", "Старый сторож помнит забытое имя под холодным дождём.",
    "少年はためらわずに錆びた剣を抜いた。", "白发长老默默地拔出生锈的长剑。", "도서관 사서는 마지막 등불을 켰다.", "หอคอยสูงมาก เขาเดินข้ามสะพานร้าง", "She said “Run!” and he ran — far away…",
]
STORY = random.Random(1).sample(BASE * 40, 360)


@pytest.fixture(scope="module")
def cost():
    return encoding.GarblingCost.fit(STORY)


def test_bpe_equals_the_public_library_and_decodes():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    dice = random.Random(3)
    texts = ["", " ", "a" * 3000, "<|endoftext|>", "it's  fine\r\n\t x", "дождём 白发长老 도서관"] + ["".join(dice.choice("ab cdE'sé中\n 1文") for _ in range(dice.randint(1, 80))) for _ in range(300)]
    e = bpe.encoder()
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert e.encode(text) == want.ids and e.decode(want.ids) == text


def test_token_queries_define_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.n) for r in df.select("doc_id", tokens.token_ids(F.col("text")).alias("ids"), tokens.token_count(F.col("text")).alias("n")).collect()}
    assert got[1] == ([], 0) and got[2] == ([], 0) and got[3][1] == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. ,\ń👍", min_size=1, max_size=300), st.integers(5, 60), st.integers(0, 20), st.integers(7, 50))
def test_ranges_give_the_cuts_of_the_whole(text, limit, overlap, size):
    whole = pieces.RangeCutter(text, 0, len(text), limit, overlap)
    cuts = whole.chain(0, len(text))
    assert cuts[-1] == len(text) and all(0 < b - (a - whole.overlap if a else 0) <= limit for a, b in zip(cuts, cuts[1:]))
    at, got = 0, [0]
    for lo in range(0, len(text), size):
        hi = min(lo + size, len(text))
        first = max(0, lo - whole.overlap - pieces.LEFT_HALO)
        part = pieces.RangeCutter(text[first : hi + limit], first, len(text), limit, overlap)
        if lo <= at < hi:
            got += part.chain(at, hi)[1:]
            at = got[-1]
    assert got == cuts


def test_split_oversized_rows(spark):
    df = spark.createDataFrame([(1, "x" * 25, 10, 3), (1, "x" * 25, 10, 3), (2, "fits", 10, 3), (3, None, 10, 3), (4, "word " * 9, 10, None), (5, "abcdef", None, 1)], "k int, text string, max_chars int, overlap_chars int")
    out = pieces.split_oversized(df, ["k"]).toPandas()
    assert set(out.k) == {1, 4} and out[out.k == 1].sort_values("piece").text.str.len().tolist() == [10, 10, 10, 4]
    assert pieces.split_oversized(df.limit(0), ["k"]).count() == 0


def test_file_ranges_equal_the_text(spark, tmp_path):
    text = "Ein Satz. Über größere Wege… 白发长老。 " * 60
    (tmp_path / "f.txt").write_text(text, encoding="utf-8")
    (tmp_path / "g.txt").write_bytes(b"")
    listing = [(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("f.txt", "g.txt")]
    files = spark.createDataFrame(listing, "path string, bytes long")
    got = pieces.cut_ranges(pieces.file_ranges(files, 80, 9, size=301)).toPandas().sort_values("piece")
    assert got.end.tolist() == pieces.RangeCutter(text, 0, len(text), 80, 9).chain(0, len(text))[1:] and all(text[a:b] == t for a, b, t in zip(got.start, got.end, got.text))


@pytest.mark.parametrize("right, wrong", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("gb18030", "latin-1"), ("cp932", "latin-1"), ("cp949", "gbk")])
def test_repair_is_a_round_trip(cost, right, wrong):
    done = 0
    for text in BASE:
        bad = encoding.garble(text, right, wrong)
        if bad and len(bad) > 8 and "�" not in bad:
            found, fixed = encoding.repair(bad, cost)
            done += found and fixed == text
    assert done >= 1


def test_honest_text_is_left_alone(spark, cost):
    assert not any(encoding.repair(t, cost)[0] for t in [*BASE, "║ Status ║ Level 12 ║ Mana 3/12 ║", "Twisted Аbасuѕ", "Тovin Аsh carried it"])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "lost � sign"), (4, "lost � sign"), (5, BASE[0])], "id int, text string")
    assert [r.id for r in encoding.repair_texts(df, spark.sparkContext.broadcast(cost)).collect()] == [4, 4]


def test_ordinary_characters():
    same = ["“Quoted…” — fine", "第40話　ゲート！（略）", "👨‍👩‍👧 🗡️", "क्‍ष", "rune Ж and мир", "ทำลาย", "two  spaces\ttab", "ㅋㅋ", ""]
    assert [lookalike.ordinary(t) for t in same] == same
    pairs = {"ｗｉｄｅ１２": "wide12", "ﾕｳﾄ ｶﾞ": "ユウト ガ", "café": "café", "w​or­d": "word", "a b　c": "a b c", "reﬆ ﬂoor": "rest floor", "𝗆𝖺𝗌𝗄": "mask", "⼭⾬": "山雨", "lа соdеx": "la codex", "간".encode().decode(): "간", "간": "간"}
    assert {k: lookalike.ordinary(k) for k in pairs} == pairs


def test_unify_gives_equal_looking_texts_one_form(spark):
    df = spark.createDataFrame([(1, "ｃafé"), (2, "café"), (3, "café"), (4, None), (5, ""), (2, "café")], "id int, text string")
    assert sorted((r.id, r.form) for r in lookalike.unify(df).collect()) == [(1, "café"), (2, "café")]
    # An ordinary row that the collation takes for equal joins its class too.
    twins = spark.createDataFrame([(1, "ab\u0007c"), (2, "abc"), (3, "abd")], "id int, text string")
    assert [(r.id, r.form, r.mapped == r.text) for r in lookalike.unify(twins).collect()] in ([(1, "abc", True)], [(2, "ab\u0007c", True)])
    assert lookalike.unify(df.limit(0)).count() == 0


def test_line_forms():
    assert boilerplate.forms_of(["Page 12!", "  page—7", "pаge", "***", ""]) == ["page", "page", "page", "", ""]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_residue(spark):
    found = ["{{ title }}\nby %author%", "404 Not Found", "Please enable JavaScript to view this chapter.", "Dear #{name}, thank you for reading.", "Story.\nError 503: Quota exceeded", "Страница не найдена. Ошибка 404.", "lorem ipsum dolor sit amet", "<h1>410</h1>\n<p>Gone.</p>"]
    kept = [None, "", "  ", "“Error 404,” the golem intoned, “soul not found.” She did not laugh.", "He typed {{title}} into the terminal and explained that the braces would be replaced by the real one.", "[STATUS WINDOW] Class: {Hidden}", "12% of the %TAX% column in the ledger, she noted, was ink spilled by the fox.", "Глава 404. Старый маяк", "She had failed the lesson on lorem ipsum twice."]
    df = spark.createDataFrame(list(enumerate(found + kept)), "doc_id long, text string")
    assert sorted({r.doc_id for r in residue.find_residue(df).collect()}) == list(range(len(found)))


def test_poisson_counts_and_shares(spark):
    assert mixing.expected(mixing.mean_for(1.3, 4), 4) == pytest.approx(1.3, abs=1e-6) and mixing.mean_for(4, 4) == mixing.FULL
    docs = [(i, "a" if i % 3 else "b", "some words of a story " * (1 + i % 5)) for i in range(600)] + [(9000, "a", None), (9001, None, "x"), (9002, "z", "x"), (1, "a", "some words of a story some words of a story ")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.replicate(df, targets)
    shares = {r.source: (r.actual_share, r.max_used) for r in report.collect()}
    assert shares["a"][0] == pytest.approx(1 / 3, abs=0.03) and shares["b"][0] == pytest.approx(2 / 3, abs=0.03) and shares["none"] == (0.0, 0)
    assert shares["a"][1] <= 1 and shares["b"][1] <= 3 and mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


SPLITS = [
    "Dr. Quorne met Mr. Vale near Mt. Kessar.| Why now?", "The ferry left at 9 p.m.| One old fox ran.", "“Is it over?” Dessa asked softly.| Enough!", "He waited... and nothing came.", "Could she forget it?|The gate opened.",
    "“快走！”老掌柜低声喊道。|太迟了！", "「逃げろ！」と少年は叫んだ。|もう遅い！", "หอคอยสูง 12.5 เมตร| สายเกินไปแล้ว", "Am 10. Mai kam Dr. Ruhland.| Zu spät!", "В 194 г. до н. э. здесь стоял храм.| Поздно!", "—¡Corre! —gritó ella.| ¡Tarde!",
    "Ο κ. Βέρινος ήρθε στις 6 π.μ. με το πλοίο.| Ήταν ψέμα;| Ναι.", "The note read: “Sold to Capt. Orrel, approx. 5.2 oz. of dust.”| Dessa slept.", "12. See the glossary",
]


@pytest.fixture(scope="module")
def model():
    """Trained on generated lines in several scripts, none of which is in SPLITS."""
    return sentences.SentenceModel.train(generated_lines(1))


def generated_lines(seed):
    dice = random.Random(seed)
    pick = lambda *x: dice.choice(x)
    made = [
        lambda: f"{pick('Dr.', 'Mr.', 'Capt.', 'Mt.')} {pick('Ondo', 'Hexley', 'Tane')} {pick('slept', 'ran home', 'came at 6 p.m.')}. {pick('One', 'The', 'Why')} {pick('fox', 'bell')} rang{pick('.', '!', '?')}",
        lambda: f"“{pick('Run', 'Is it late', 'Stop')}{pick('!', '?')}” {pick('she', 'Mira')} {pick('said', 'asked', 'whispered')}. {pick('Late', 'Enough')}!",
        lambda: f"He {pick('slept', 'paused')}... and {pick('ran', 'left')}. The gate of 12.{dice.randint(1, 9)} feet opened.",
        lambda: f"「{pick('逃げろ', '待て')}！」と{pick('少年', '王')}は叫んだ。{pick('もう遅い', '雨が降る')}！",
        lambda: f"“{pick('快走', '等等')}！”{pick('老人', '她')}说道。{pick('太迟了', '下雨了')}！{pick('少年', '老人')}拔出{dice.randint(2, 99)}把剑。他{pick('走', '来')}了。",
        lambda: f"Am {dice.randint(1, 28)}. {pick('Mai', 'Juni')} kam {pick('Dr.', 'Prof.')} {pick('Abel', 'Kern')}. {pick('Zu spät', 'Genug')}!",
        lambda: f"В {dice.randint(100, 900)} г. до н. э. {pick('здесь', 'там')} {pick('был', 'стоял')} {pick('мост', 'дом')}. {pick('Поздно', 'Пора')}!",
        lambda: f"—¡{pick('Corre', 'Ven')}! —{pick('gritó', 'dijo')} {pick('ella', 'él')}. ¡{pick('Tarde', 'Basta')}!",
        lambda: f"Ο κ. {pick('Νίκος', 'Άρης')} ήρθε στις {dice.randint(1, 9)} π.μ. με {pick('πλοίο', 'τρένο')}. Ήταν {pick('νύχτα', 'μέρα')};",
        lambda: f"The note read: “Sold to {pick('Capt.', 'Mr.')} {pick('Vale', 'Rho')}, approx. {dice.randint(2, 9)}.{dice.randint(1, 9)} oz. of {pick('salt', 'ash')}.”",
        lambda: f"Could {pick('she', 'he')} {pick('forget it', 'go home')}?{pick('The', 'One')} gate opened.",
        lambda: f"{dice.randint(1, 40)}. See the {pick('map', 'index')}",
        lambda: f"{pick('หอคอยสูง', 'เขาเดิน')} {dice.randint(2, 99)} {pick('เมตร', 'ก้าว')} {pick('สายเกินไป', 'ฝนตก')}",
    ]
    return [dice.choice(made)() for _ in range(3000)]


def test_training_decides_the_tags():
    dice = random.Random(2)
    held = sentences.training_chains(generated_lines(2), dice)
    right = {}
    for name, model in (("untrained", sentences.SentenceModel()), ("trained", sentences.SentenceModel.train(generated_lines(1)))):
        pairs = [(a, b) for f, gold in held for a, b in zip(model.decode(f), gold)]
        right[name] = sum(a == b for a, b in pairs) / len(pairs)
    assert right["trained"] > 0.99 and right["untrained"] < 0.6


def test_time_grows_with_the_line(model):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        for part in ("word. Next ", "(a” b.” “c ", "a.a", ". ", "ที่ "):
            model.spans(part * (n // len(part)))
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0]


@pytest.mark.parametrize("marked", SPLITS)
def test_sentence_boundaries(marked, model):
    text = marked.replace("|", "")
    assert [text[a:b] for a, b in model.spans(text)] == [s.strip() for s in marked.split("|")]


def test_sentences_of_odd_rows(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "*** 12 ***"), (4, "One. Two!"), (4, "One. Two!"), (5, "a\n\nb")], "k int, text string")
    got = sentences.split_sentences(df, ["k"], model).select("k", "s", "s_start", "s_end")
    assert sorted(map(tuple, got.collect())) == [(4, 1, 0, 4), (4, 2, 5, 9), (5, 1, 0, 1), (5, 2, 3, 4)]


def test_filler_is_told_by_its_words_at_any_length(spark):
    dice = random.Random(5)
    words = "lorem ipsum velim quessa ustrat cordi sicca fastim odarat origa arnum tavere".split()
    long = ["Lorem ipsum " + " ".join(dice.choice(words) for _ in range(60)) + "." for _ in range(6)] + ["Chapter 3\n" + " ".join(dice.choice(words[2:]) for _ in range(50))]
    kept = [f"At school, {n} had failed the lesson on lorem ipsum, the printers' sham Latin, twice." for n in ("Ilvane", "Nima", "Orrin")] + ["The spell began with velim odarat, and Ketter feared the quessa that must follow.", "The lesson at school was long and the printers had failed."]
    df = spark.createDataFrame(list(enumerate([*long, *kept, None, ""])), "doc_id long, text string")
    assert sorted({r.doc_id for r in residue.find_residue(df).collect()}) == list(range(len(long)))


def test_repair_mends_every_stretch(cost):
    text = "El guardián guardó el mapa en la caja grande, señora. " * 20
    found, fixed = encoding.repair(encoding.garble(text, "utf-8", "cp1252") + "� " + encoding.garble(text, "utf-8", "cp1252"), cost)
    assert found and fixed == text + "� " + text


def test_problem_6_leaves_out_what_problem_3_reports(spark, cost):
    texts = [t.replace(" ", " ", 1) for t in BASE if " " in t] + [encoding.garble(BASE[0], "utf-8", "cp1252"), "lost � sign"]
    alone = [bool(cost.suspects(*encoding.code_points([t]))[0]) for t in texts]
    assert cost.suspects(*encoding.code_points(texts)).tolist() == alone and not all(alone) and any(alone)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    shared = spark.sparkContext.broadcast(cost)
    found = {r.id for r in encoding.repair_texts(df, shared).collect()}
    assert {r.id for r in lookalike.scan(df, shared).where("garbled").collect()} <= found


def test_simhash_equals_one_text_at_a_time_and_tables_find_near_pairs(spark):
    dice = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdgkst" for b in ("ar", "el", "im", "on") for c in ("na", "ro", "te")]
    texts = {"", "ab", "abcd", "x" * 700, "文" * 300}
    for _ in range(60):
        line = [dice.choice(words) for _ in range(dice.randint(8, 40))]
        texts.add(" ".join(line))
        for n in (1, 1, 2):
            texts.add(" ".join(dice.choice(words) if i in dice.sample(range(len(line)), n) else w for i, w in enumerate(line)))
    texts = sorted(texts)
    signs = simhash.simhashes(texts)
    assert signs.tolist() == [int(simhash.simhashes([t])[0]) for t in texts] == [int(simhash.simhashes(["zz", t])[1]) for t in texts]
    bands = simhash.minhash_bands(texts, 3, 2)
    assert bands.tolist() == [simhash.minhash_bands(["q", t], 3, 2)[1].tolist() for t in texts]
    df = spark.createDataFrame([(i, t, int(s)) for i, (t, s) in enumerate(zip(texts, signs))], "id long, form string, sig long")
    lines = df.select(F.col("id").cast("string").alias("id"), "form", "sig")
    found = {(int(r.a), int(r.b)) for r in residue.near_lines(lines, lines, 0.8).collect()}
    want = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and simhash.similarity(texts[a], texts[b]) >= 0.8}
    assert found <= want and len(found) >= 0.9 * len(want) > 100


def _sites(spark, texts, chapters):
    p = spark.createDataFrame(texts, "doc_id long, sec int, p int, text string")
    site = spark.createDataFrame([(1, "s"), (2, None)], "doc_id long, site string")
    return boilerplate.site_lines(boilerplate.lines_of(p, site), spark.createDataFrame(chapters, "site string, doc_id long, sec int"))


def test_repeated_lines_by_brute_force(spark):
    chapters = [("s", 1, c) for c in range(10)] + [(None, 2, c) for c in range(4)]
    texts = [(1, c, 1, f"Story {'abcdefghij'[c] * 3} goes on\nRead at SITE {c}!") for c in range(10) if c % 4 == 0] + [(2, c, 1, "rare" if c else "other") for c in range(4)] + [(1, 3, 2, None), (1, 3, 3, "")]
    seen, hot = _sites(spark, texts + texts[:2], chapters)
    assert sorted((r.site or "", r.form, r.df, r.cluster_df, r.n) for r in hot.collect()) == [("", "rare", 3, 3, 4), ("s", "readatsite", 3, 3, 10)]
    assert sorted((r.doc_id, r.sec, r.i) for r in seen.join(hot, "node").select("doc_id", "sec", "i").distinct().collect()) == [(1, 0, 1), (1, 4, 1), (1, 8, 1), (2, 1, 0), (2, 2, 0), (2, 3, 0)]
    assert _sites(spark, texts[:0], chapters)[1].count() == 0


def test_clusters_of_near_lines_decide_together(spark):
    names = ["Mirela", "Ondo", "Tamsin", "Quorne", "Hexley", "Veyl", "Drey", "Ruhland", "Sable", "Kiro"]
    texts = [(1, c, 1, f"A tale of its own number {'abcdefghijklmnopqrst'[c] * 9}\nThis chapter was translated for the readers of the open lantern library by {names[c % 10]}") for c in range(20)]
    _, hot = _sites(spark, texts, [("s", 1, c) for c in range(20)])
    rows = hot.collect()
    assert len(rows) == 10 and {r.df for r in rows} == {2} and {r.cluster_df for r in rows} == {20} and len({r.cluster for r in rows}) == 1


def test_p5_clean_by_brute_force(spark, tmp_path):
    line = "Read on at the lantern"
    texts = [(1, c, 1, f"Story {'abcd'[c] * 9}\n{line.upper()} {c}\n\nEnd {'abcd'[c] * 7}") for c in range(4)] + [(1, 4, 1, line), (1, 4, 2, None), (1, 4, 3, ""), (9, 1, 1, line), (1, 0, 1, f"Story aaaaaaaaa\n{line.upper()} 0\n\nEnd aaaaaaa")]
    spark.createDataFrame(texts, "doc_id long, sec int, p int, text string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    spark.createDataFrame([(1, "s")], "doc_id long, site string").write.parquet(f"{tmp_path}/novel_files.parquet")
    spark.createDataFrame([(1, c) for c in range(5)], "doc_id long, sec int").write.parquet(f"{tmp_path}/sections.parquet")
    got = sorted(map(tuple, boilerplate.p5_clean(spark, str(tmp_path)).collect()), key=repr)
    want = [(1, c, 1, f"Story {'abcd'[c] * 9}\n\nEnd {'abcd'[c] * 7}") for c in range(4)] + [(1, 4, 2, None), (1, 4, 3, ""), (9, 1, 1, line)]
    assert got == sorted(want, key=repr)


def test_trusted_lines_are_weak_and_labels_reach_any_line(spark):
    lines = ["Too many requests.", "The reader is down.", "Paste chapter text", "Không tìm thấy trang", "FORBIDDEN", "BAD GATEWAY", "Your Session Has Expired", "NaN", "nan / null", "<p>503 quota</p>", "[404 gone away]", "that page can’t be found", "Whoops! It broke [12]", "(CODE 12)", "HTTP 500", "자바스크립트를 켜 주세요"]
    search = residue._searcher(frozenset())
    for line in map(residue.clean, lines):
        assert residue.trusted(line) and residue.weak(line, line.lower(), any(True for _ in search.iter(line.lower()))), line
    base = "The requested chapter 12 could not be found in the library of this old house, and nobody who keeps its long shelves can tell where it went"
    near = base.replace("could", "kould").replace("library", "libbary").replace("nobody", "nobuddy")
    far = near.replace("house", "hoose").replace("shelves", "shelfes").replace("went", "whent")
    assert simhash.similarity(base, far) < 0.8 < min(simhash.similarity(base, near), simhash.similarity(near, far))
    docs = [(1, base), (2, near), (3, far), (4, "A story of an old house and its library, with rain.")]
    found = {r.doc_id: (r.how, r["class"]) for r in residue.find_residue(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: how for k, (how, _) in found.items()} == {1: "trusted", 2: "spread", 3: "spread"} and len({c for _, c in found.values()}) == 1


def test_residue_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "xxxx " * 20_000), (5, "asdf " * 20_000 + "x" * 40_000), (6, "404 Not Found"), (6, "404 Not Found")], "doc_id long, text string")
    assert {r.doc_id for r in residue.find_residue(df).collect()} == {4, 5, 6}
    assert residue.find_residue(df.limit(0)).count() == 0


def test_stitching_in_a_tree_equals_the_whole(spark):
    dice = random.Random(4)
    texts = [(k, "".join(dice.choice("ab. ,文") for _ in range(dice.choice((40, 700, 4000)))), dice.randint(8, 60), dice.randint(0, 9)) for k in range(12)]
    df = spark.createDataFrame(texts, "k int, text string, max_chars int, overlap_chars int")
    got = {}
    for r in pieces.split_oversized(df, ["k"], size=11).orderBy("k", "piece").collect():
        got.setdefault(r.k, []).append((r.piece, r.end, r.text))
    for k, text, limit, overlap in texts:
        cuts = pieces.RangeCutter(text, 0, len(text), limit, overlap).chain(0, len(text))
        overlap = min(overlap, limit - 1)
        want = [(i + 1, b, text[max(0, a - overlap) : b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert got.get(k, []) == (want if len(text) > limit else []), k


def test_neighbours_are_counted_over_all_rows(spark):
    df = spark.createDataFrame([("é1é",), ("é2é",), ("plain",), (None,), ("é�",), ("né\né",)], "text string")
    counted, total = encoding.count_neighbours(df)
    assert counted == {"é0": 2, "0é": 2, "né": 1} and total == 5


def test_extra_columns_of_clashing_names(spark, cost, model):
    shared = spark.sparkContext.broadcast(cost)
    df = spark.createDataFrame([(1, encoding.garble(BASE[0], "utf-8", "cp1252"), "x", "y", "z", 4)], "id int, text string, repaired string, mapped string, form string, _t int")
    assert encoding.repair_texts(df, shared).select("id", "repaired", "mapped").first().repaired == BASE[0]
    wide = df.withColumn("text", F.lit("ｗｉｄｅ"))
    assert lookalike.unify(wide).select("id", "form", "repaired").collect() == [(1, "wide", "x")]
    items = spark.createDataFrame([(1, 2, "word " * 9, 10, 2, "x", 3, 4)], "part int, lo int, text string, max_chars int, overlap_chars int, item string, piece int, total int")
    assert pieces.split_oversized(items, ["part", "lo"]).where("part = 1 and lo = 2").count() > 3
    rows = spark.createDataFrame([(1, "One. Two!", "x", 5)], "s_start0 int, text string, _text string, extra int")
    assert sentences.split_sentences(rows, ["s_start0"], model).count() == 2
    docs = spark.createDataFrame([(1, "404 Not Found", "x", "y", True)], "doc_id long, text string, form string, id string, trusted boolean")
    assert residue.find_residue(docs).count() == 1
    corpus = spark.createDataFrame([(1, "a", "some words", 3, 0.5)], "doc_id long, source string, text string, n_tokens int, u double")
    assert mixing.replicate(corpus, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))[0].count() == 1


def test_repair_goes_through_all_layers(cost):
    text = bad = "El guardián guardó el mapa en la caja grande, señora."
    for _ in range(5):
        bad = encoding.garble(bad, "utf-8", "latin-1")
    assert encoding.repair(bad, cost) == (True, text)


def test_p5_forms_differ_in_no_letter_case():
    lines = ["Straße frei", "STRASSE FREI", "ΛΟΓΟΣ", "λόγος", "λογος", "İstanbul", "istanbul", "ΐ", ""]
    forms = boilerplate.forms_of(lines)
    assert lines[0] == "Straße frei" and forms[0] == forms[1] and forms[2] == forms[4] != forms[3] and forms[5] == forms[6] and forms[-1] == ""
