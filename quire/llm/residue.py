"""Problem 9: documents that show the machinery of a site in place of text.

Method: every line of every document is masked (digits, ids, placeholders) and signed with
SimHash.  Lines that are residue beyond doubt, by whole-line patterns that no prose has, are
trusted.  Their near-duplicates among all lines are found through partitioned SimHash tables
and verified, by Hamming distance of the signatures and then by similarity of the texts, and
so are theirs, until no line is new.  The links' connected components are the classes, and
each class that holds a trusted line is residue.  An exact check takes out prose: a
quotation, a sentence that goes on around the sign, a narrated name.

Filler has no fixed wording, so no two texts of it are near.  It is told by its words, at any
length: those of the printers' text and those that the corpus has mostly where a line opens
with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.components import connected_components
from quire.llm.simhash import HAMMING, hamming, in_tables, simhashes, text_similarity
from quire.session import load, small, written

_NAME = r"[A-Za-z][\w.]*(?: ?\| ?\w+)?"
# Placeholder notations around a variable's name, with or without inner spaces.
PLACEHOLDER = "|".join(
    p.replace("N", _NAME)
    for p in (
        r"\{\{ ?N ?\}\}", r"\{% ?N ?%\}", r"<%=? ?N ?%>", r"<# ?N ?#>", r"\[\[ ?N ?\]\]", r"@@ ?N ?@@", r"__N?__",
        r"[$#]\{ ?N ?\}", r"&lt; ?N ?&gt;", r"\$N\$", r"%N%", r"\[N HERE\]", r"\(insert N\)", r"\{(?:[a-z][\w.]*(?: ?\| ?\w+)?|[A-Z_]{3,})\}",
    )
).replace("__" + _NAME + "?__", r"__[A-Za-z][\w. |]*?__")

# Messages of error pages, notices that scripts are needed, filler.
_ERRORS = r"""(?:internal )?server error|bad gateway|gateway time-?out|not found|forbidden|access denied|service (?:temporarily )?unavailable|too many requests|request blocked by|quota exceeded|upstream .{1,20}timed out|login required|(?:the )?reader is down|could not connect to|error establishing a database|fatal error: |traceback \(most recent|keyerror: |stack trace: ?#|your session has expired|that page can.t be found|this chapter is not available in your region|chapter removed at|you do not have permission to view|checking your browser before|the requested (?:chapter|page|url) .{0,20}could not be found|page introuvable|seite nicht gefunden|página que buscas no existe|página no encontrada|страница не найдена|页面不存在|服务器繁忙|ページは見つかりません|エラー番号|페이지를 찾을 수 없|الصفحة غير موجودة|không tìm thấy trang|ไม่พบหน้า"""
_SCRIPTS = r"""(?:enable|turn on|activate) javascript|javascript is disabled|uses scripts to load|browser may be blocking scripts|noscript|activer (?:les scripts|javascript)|включите javascript|启用 ?javascript|javascriptを有効|자바스크립트를 켜|activa javascript|ative o javascript|aktivieren sie javascript|bật javascript|เปิดใช้งาน javascript"""
_FILLER = r"""lorem ipsum dolor|dolor sit amet|text goes here|type your chapter|paste chapter text|sample post|placeholder|здесь будет текст|正文待补充|ここに本文|본문을 입력|(?:xxxx ?){1,}|(?:test ){2,}.*|(?:asdf ?){2,}.*|\[object object\]|undefined|nan(?: / null)?|null"""
_STATUS = r"""(?:error|http) [45]\d\d\b.{0,60}|[45]\d\d [a-z][a-z '’-]{2,60}|.{0,60}\((?:code|error|错误代码|오류|ошибка) ?\d+.*|whoops!.*\[\d+\]"""

# Literals in lower case: a trusted line has at least one, a placeholder or a status, so the patterns are tried on such lines only.
_SIGNS = ["script", "error", "шибк", "エラー", "错误", "오류", "fehler", "erreur", "orem ipsum", "dolor sit", "rowser", "erver", "http ", "ateway", "orbidden", "ot found", "imed out", "ops!", "todo", "test test", "asdf", "session has", "etry", "navailable", "ot available", "aintenance", "ccess denied", "xceeded", "imited", "ogin required", "ould not", "hapter removed", "ermission", "loading", "checking", "traceback", "race: ", "nicht gefunden", "ntrouvable", "ncontrada", "no existe", "не найден", "不存在", "繁忙", "启用", "有効", "見つかりません", "켜야", "찾을 수 없", "غير موجود", "không tìm thấy", "ไม่พบ", "goes here", "our chapter here", "ample post", "laceholder", "xxxx", "undefined", "[object", "будет текст", "待补", "ここに", "본문을", "locked by", "<h1>", "null", "too many requests", "reader is down", "t be found", "your chapter", "paste chapter", "(code", "자바스크립트", "establishing a database"]

_PROSE = re.compile(r"""^[“"«„「‘'—–].*[”"»“」’'].*[^\W\d_]{2}|[“"«„「].{3,}[”"»“」]|\b(?:he|she|they)\b .*\b(?:said|had|was|wrote|typed)\b|^\[(?:System|STATUS|system|status window)""")
_ENDS = re.compile("[\n\r\u0085\u2028\u2029]+")
_STARTS = re.compile(r"[{<\[@_$#&%(]")
_HELD = re.compile(PLACEHOLDER, re.ASCII)
_CODE = re.compile(r"[45]\d\d [a-z]")
_NAN = re.compile(r"(?:^|>)[^\w\n]*nan\b")
_HEADING = re.compile(r"<h1>\s*([45]\d\d)\s*</h1>")
_TAGS = re.compile(r"</?(?:p|h[1-6]|div|span|body|title|b|i|br)\b[^>]*>")
_MESSAGES = [
    re.compile(p, re.IGNORECASE)
    for p in (rf"^[\W_]*(?:{_FILLER})[\W_]*$", rf"^[\[(*~\s-]*(?:{_STATUS})[\])*~\s.!-]*$", rf"{_ERRORS}|{_SCRIPTS}", r"lorem ipsum dolor|dolor sit amet|text goes here|type your chapter|paste chapter text|^sample post|^\[placeholder|здесь будет текст|正文待补充")
]
_DIGITS = re.compile(r"\d(?:[\da-f]{3,}\b|\d*)")
_MARK = "\u0001"  # what a placeholder is masked by

_SHAM = frozenset("""lorem ipsum dolor dolore sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt ut et labore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum xxxx asdf qwer test""".split())  # and what hands type
_OPENING = r"(?i)^\W*lorem ipsum\b"
_LETTERS = re.compile(r"[^\W\d_]+")
FILLER = 0.7  # share of a line's words that are filler's, from which it is filler
FILLER_WORDS = 3  # that a line has at least, to be told by its words
SEEDED = 0.25  # share of a word's documents that open a line with the printers' text, from which it is filler's
TELLING = 4  # letters of a word that can be learned as filler's; a filler line has such a word
MESSAGE = 160  # characters of a message at most: longer lines tell of one
BROADCAST_FORMS = 20_000  # labelled forms whose table keys (TABLES rows of 40 bytes each) are broadcast; more are shuffled


def clean(line: str) -> str:
    """The line without tags of markup and outer white space."""
    if "<" in line:
        line = _TAGS.sub("", _HEADING.sub(r"error \1", line))
    return line.strip()


def prose(line: str) -> bool:
    """Whether a line tells of such a thing instead of being it."""
    return bool(_PROSE.search(line)) and _MARK not in line and not _HELD.search(line)


def masked(line: str) -> str:
    """Form of a line: placeholders, ids and numbers by one sign each, lower case."""
    if _STARTS.search(line):
        line = _HELD.sub(_MARK, line)
    return _DIGITS.sub("0", line.lower())


def trusted(line: str) -> bool:
    """Whether a clean line is residue beyond doubt, by itself."""
    if _STARTS.search(line) and _HELD.search(line):
        rest = _HELD.sub(" ", line)
        if len([w for w in re.split(r"\W+", rest) if w]) <= 6 and not re.search("[“”«»„]", rest):
            return True
    return len(line) <= MESSAGE and any(p.search(line) for p in _MESSAGES) and not prose(line)


def weak(line: str, low: str, signed: bool) -> bool:
    """Whether the patterns are to be tried: every trusted line is weak.  ``signed``: one of the literals is in ``low``."""
    return signed or bool(_CODE.search(low)) or ("nan" in low and bool(_NAN.search(low))) or bool(_STARTS.search(line) and _HELD.search(line))


@lru_cache(maxsize=4)
def _searcher(words: frozenset[str]):
    """Aho-Corasick automaton of the literals (1), of words that may be filler's (2) and of what is both (3)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words.union(_SIGNS):
        found.add_word(w, (w in _SIGNS) + 2 * (w in words))
    found.make_automaton()
    return found


def seeded_words(docs: DataFrame, key: str) -> dict[str, int]:
    """Words of lines that open with the printers' text, with the number of their documents.

    They stand in a hundredth of such documents at least, so they are few at any size.
    """
    lines = docs.where(F.lower("text").contains("lorem ipsum")).select(key, F.explode(F.split("text", _ENDS.pattern)).alias("line"))
    words = lines.where(F.col("line").rlike(_OPENING)).select(key, F.explode(F.split(F.lower("line"), r"[^\p{L}]+")).alias("word"))
    seeds = written(words.where(F.length("word") >= TELLING).distinct())
    least = 0.01 * seeds.select(key).distinct().count()
    return {r.word: r["count"] for r in seeds.groupBy("word").count().where(F.col("count") >= least).collect()}


def signed_lines(docs: DataFrame, words: frozenset[str], key: str = "doc_id") -> DataFrame:
    """Every line of every text: (key, id, form, sig, trusted, held, n_words).

    ``id`` is a 128-bit hash of the form.  ``held`` are the line's words that are the printers'
    or among ``words``, NULL where none of four letters is; ``n_words`` counts all then.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words | _SHAM)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = sent.value
        search = _searcher(frozenset(w for w in known if len(w) >= TELLING)).iter
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["text"]):
                for line in set(_ENDS.split(text)):
                    line = clean(line)
                    if not line:
                        continue
                    low = line.lower()
                    kinds = {kind for _, kind in search(low)}
                    held, n = None, None
                    if kinds and max(kinds) > 1:
                        own = _LETTERS.findall(low)
                        held, n = [w for w in own if w in known], len(own)
                    form = masked(line)
                    rows.append((k, xxhash.xxh3_128_hexdigest(form), form, weak(line, low, bool(kinds & {1, 3})) and trusted(line), held, n))
            if rows:
                out = pd.DataFrame(rows, columns=[key, "id", "form", "trusted", "held", "n_words"])
                out["n_words"] = out["n_words"].astype("Int32")
                out["sig"] = simhashes(out["form"].tolist())
                yield out

    rows = docs.where("text is not null").select(key, "text")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, id string, form string, trusted boolean, held array<string>, n_words int, sig bigint"
    return rows.mapInPandas(cut, schema)


def filler_lines(lines: DataFrame, inside: dict[str, int], key: str) -> DataFrame:
    """The lines that are filler by their words; a word's documents are counted over the whole corpus."""
    telling = lines.where("held is not null")
    counts = telling.select(key, F.explode("held").alias("word")).where(F.col("word").isin(list(inside))).distinct().groupBy("word").count().collect() if inside else []
    words = sorted(_SHAM | {r.word for r in counts if inside[r.word] >= SEEDED * r["count"]})
    n = F.size(F.filter("held", lambda w: w.isin(words)))
    return telling.where((F.col("n_words") >= FILLER_WORDS) & (n >= FILLER * F.col("n_words")))


@F.pandas_udf(T.BooleanType())
def _is_prose(forms: pd.Series) -> pd.Series:
    return forms.map(prose).astype(bool)


def near_lines(lines: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """Links from forms of ``lines`` to near ones of ``of`` (id, form, sig): (a, form, sig, b).

    Forms that share a key of a SimHash table are candidates; Hamming distance of the
    signatures and similarity of the texts verify them.  Prose is linked to nothing.
    """
    few = of.count() <= BROADCAST_FORMS
    slots = in_tables(of.select(F.col("id").alias("b"), F.col("sig").alias("_sig")), "_sig")
    slots = F.broadcast(slots) if few else slots
    met = (
        in_tables(lines.select(F.col("id").alias("a"), "sig"), "sig")
        .join(slots, ["mask", "key"])
        .where((hamming("sig", "_sig") <= HAMMING) & (F.col("a") != F.col("b")))
        .select("a", "b")
        .distinct()
    )
    met = written(met)
    wanted = small(written(met.select(F.col("a").alias("id")).distinct()))
    texts = lines.join(wanted, "id", "left_semi").groupBy(F.col("id").alias("a")).agg(F.min("form").alias("form"), F.min("sig").alias("sig"))
    pairs = met.join(texts, "a").join(of.select(F.col("id").alias("b"), F.col("form").alias("_form")), "b")
    return pairs.where((text_similarity("form", "_form") >= least) & ~_is_prose("form")).select("a", "form", "sig", "b")


def residue_classes(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """Forms of residue: (id, class, how), ``how`` being ``trusted`` or ``spread``; ``class`` is the least id of the form's class.

    Only classes that hold a trusted form can be residue, so links are looked for from
    trusted forms outwards, round by round, until none is new; components of the links decide.
    """
    seeds = written(lines.where("trusted").groupBy("id").agg(F.min("form").alias("form"), F.min("sig").alias("sig")))
    known, fresh = seeds.select("id"), seeds
    links = lines.sparkSession.createDataFrame([], "a string, b string")
    while not fresh.isEmpty():
        met = written(near_lines(lines, fresh, least))
        links = links.union(met.select("a", "b"))
        fresh = written(met.join(known, met.a == known.id, "left_anti").groupBy(F.col("a").alias("id")).agg(F.min("form").alias("form"), F.min("sig").alias("sig")))
        known = known.union(fresh.select("id"))
    member = connected_components(links)
    classes = known.join(member, known.id == member.node, "left").select("id", F.coalesce("component", "id").alias("class"))
    marked = classes.join(seeds.select("id", F.lit(True).alias("_seed")), "id", "left")
    labelled = marked.where("_seed").select("class").distinct()
    return marked.join(labelled, "class", "left_semi").select("id", "class", F.when(F.col("_seed"), "trusted").otherwise("spread").alias("how"))


def find_residue(docs: DataFrame, key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """Residue lines of documents: (key, form, class, how): ``trusted``, ``spread`` or ``filler``.

    Null, empty and blank texts have none.  Every line of every text is looked at; lines
    end at any line end, and a line that stands twice in a document counts once.
    """
    inside = seeded_words(docs, key)
    lines = written(signed_lines(docs, frozenset(inside), key))
    filler = filler_lines(lines, inside, key).select(key, "form", F.col("id").alias("class"), F.lit("filler").alias("how"))
    return lines.join(small(written(residue_classes(lines, least))), "id").select(key, "form", "class", "how").union(filler).distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue: (doc_id)."""
    return find_residue(load(spark, d, "documents").select("doc_id", "text")).select("doc_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left: all columns of those without residue."""
    docs = load(spark, d, "documents")
    return docs.join(p9_found(spark, d), "doc_id", "left_anti")
