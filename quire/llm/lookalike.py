"""Problem 6: text that looks alike but consists of different characters.

Method: values are mapped to their ordinary look, grouped by the mapped value under an
accent-sensitive Unicode collation in SQL, and each class gets one deterministic member,
which is joined back.  Classes are made of all rows, ordinary ones too.  A hash of the value
without what the collation ignores is counted first, so that texts are shuffled and collated
only where there are several spellings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.encoding import GarblingCost, code_points, fit_cost, repair, texts_and_titles
from quire.session import small, written



def _set(ranges: str) -> str:
    """Character class body of code point ranges written in hexadecimal."""
    out = []
    for r in ranges.split():
        lo, _, hi = r.partition("-")
        out.append(re.escape(chr(int(lo, 16))) + (f"-{re.escape(chr(int(hi, 16)))}" if hi else ""))
    return "".join(out)


# Characters that may stand in for an ordinary one, by kind.
_WIDE = _set("FF10-FF19 FF21-FF3A FF41-FF5A FF65-FF9F FFA1-FFDC")
_DECOMPOSED = _set("0300-034E 0350-036F 3099 309A 1100-1112 1161-1175 11A8-11C2")
_INVISIBLE = _set("00AD 034F 061C 115F 1160 17B4 17B5 180B-180E 200B-200F 202A-202E 2060-2064 2066-206F FE00-FE0F FEFF")
_SPACES = _set("00A0 1680 2000-200A 202F 205F 3000")
_STYLED = _set("00AA 00BA 0132 0133 013F 0140 0149 017F 01C4-01CC 01F1-01F3 1D2C-1D61 2071 207F 2090-209C 2102 210A-2113 2115 2119-211D 2124 2126 2128 212A-212D 212F-2131 2133-2139 2160-217F 24B6-24E9 FB00-FB06 FB13-FB17 FB20-FB28 FB50-FBB1 FBD3-FD3D FE70-FEFC 1D400-1D7FF 1F130-1F149")
_IDEOGRAPHS = _set("2E80-2E99 2E9B-2EF3 2F00-2FD5 F900-FAD9 2F800-2FA1D")
_LATIN = _set("0041-005A 0061-007A 00C0-00D6 00D8-00F6 00F8-024F 1E00-1EFF")
_GREEK = _set("0370-0373 0376-037D 037F 0386 0388-03FF 1F00-1FFF")
_CYRILLIC = _set("0400-0481 048A-052F")
_ARMENIAN = _set("0531-0556 0561-0587")
_OTHERS = _GREEK + _CYRILLIC + _ARMENIAN

SUSPECT = f"[{_WIDE}{_DECOMPOSED}{_INVISIBLE}{_SPACES}{_STYLED}{_IDEOGRAPHS}]|[{_LATIN}][{_OTHERS}]|[{_OTHERS}][{_LATIN}]|[{_GREEK}][{_CYRILLIC}]|[{_CYRILLIC}][{_GREEK}]"

# Letters of the same look, Latin with their Cyrillic, Greek and Armenian doubles.
_DOUBLES = [
    ("a", "а", "α", ""), ("b", "Ь", "", ""), ("c", "с", "ϲ", ""), ("d", "ԁ", "", ""), ("e", "е", "", ""), ("h", "һ", "", "հ"), ("i", "і", "ι", ""),
    ("j", "ј", "ϳ", ""), ("k", "к", "κ", ""), ("l", "ӏ", "", ""), ("n", "п", "η", "ո"), ("o", "о", "ο", "օ"), ("p", "р", "ρ", ""), ("q", "ԛ", "", "զ"),
    ("r", "г", "", ""), ("s", "ѕ", "", "ѕ"), ("t", "т", "τ", ""), ("u", "", "υ", "ս"), ("v", "ѵ", "ν", ""), ("w", "ԝ", "ω", ""), ("x", "х", "χ", ""), ("y", "у", "γ", ""),
    ("A", "А", "Α", ""), ("B", "В", "Β", ""), ("C", "С", "Ϲ", ""), ("E", "Е", "Ε", ""), ("H", "Н", "Η", ""), ("I", "І", "Ι", ""), ("J", "Ј", "Ϳ", ""), ("K", "К", "Κ", ""),
    ("M", "М", "Μ", ""), ("N", "", "Ν", ""), ("O", "О", "Ο", "Օ"), ("P", "Р", "Ρ", ""), ("S", "Ѕ", "", "Տ"), ("T", "Т", "Τ", ""), ("V", "Ѵ", "", ""), ("W", "Ԝ", "", ""),
    ("X", "Х", "Χ", ""), ("Y", "Ү", "Υ", ""), ("Z", "", "Ζ", ""),
]
_SCRIPTS = [re.compile(f"[{s}]") for s in (_LATIN, _CYRILLIC, _GREEK, _ARMENIAN)]
_TO = [{row[j]: row[i] for row in _DOUBLES if row[i] for j in range(4) if j != i and row[j]} for i in range(4)]

_WORD = re.compile(f"[{_LATIN}{_OTHERS}]+")
_MIXED = re.compile("|".join(f"[{a}][{b}]" for a, b in ((_LATIN, _OTHERS), (_OTHERS, _LATIN), (_GREEK, _CYRILLIC), (_CYRILLIC, _GREEK))))
_VARIANT = re.compile(f"[{_WIDE}{_STYLED}{_IDEOGRAPHS}]+")
_APART = re.compile(f"[^{_DECOMPOSED}]?[{_DECOMPOSED}]+")
_GHOST = re.compile(f"[{_INVISIBLE}]+")
_BLANK = re.compile(f"[{_SPACES}]")
_EAST = re.compile(f"[{_set('2E80-2FFF 3001-30FF 3100-312F 3190-31FF 3400-4DBF 4E00-9FFF F900-FAFF FF01-FF9F 20000-3FFFF')}]")
_EMOJI = re.compile(f"[{_set('0023 002A 0030-0039 00A9 00AE 203C 2049 2122 2139 2194-21FF 2300-27BF 2934 2935 2B00-2BFF 3030 303D 3297 3299 1F000-1FAFF')}]")
_VIRAMA = re.compile(f"[{_set('094D 09CD 0A4D 0ACD 0B4D 0BCD 0C4D 0CCD 0D4D 0DCA')}]")


# Characters that the collation ignores, and that ``ordinary`` may leave: controls and joiners.
_IGNORED = re.compile(f"[{_INVISIBLE}{_set('0000-0008 000E-001F 007F-0084 0086-009F')}]")


def core(text: str) -> str:
    """What is left of a text without ignored characters, composed: equal for texts that the collation takes for equal."""
    return unicodedata.normalize("NFC", _IGNORED.sub("", text))


def _ghosts(m: re.Match) -> str:
    """Invisible characters are dropped, but for joiners and selectors that belong to what they follow."""
    text, kept = m.string, []
    before = text[m.start() - 1 : m.start()]
    after = text[m.end() : m.end() + 1]
    for c in m.group():
        if c in "\ufe0e\ufe0f" and not kept and _EMOJI.match(before):
            kept.append(c)
        elif c == "\u200d" and kept[-1:] != [c] and _EMOJI.match(before) and _EMOJI.match(after):
            kept.append(c)
        elif c in "\u200c\u200d" and len(m.group()) == 1 and _VIRAMA.match(before):
            kept.append(c)
    return "".join(kept)


def _blank(m: re.Match) -> str:
    """An ordinary space, but for the ideographic space beside Chinese or Japanese."""
    text, a, b = m.string, m.start(), m.end()
    if m.group() == "\u3000":
        while a and text[a - 1] == "\u3000":
            a -= 1
        while b < len(text) and text[b] == "\u3000":
            b += 1
        if _EAST.match(text[a - 1 : a] if a else "") or _EAST.match(text[b : b + 1]):
            return "\u3000"
    return " "


def _one_script(m: re.Match) -> str:
    """A word of mixed scripts in the one of its letters that have no double, else in that of the text around.

    Letters without a double in that script stay.
    """
    word = m.group()
    if not _MIXED.search(word):
        return word
    plain = "".join(w for w in _WORD.findall(m.string) if not _MIXED.search(w))
    counts = [len(s.findall(plain)) if s.search(word) else -1 for s in _SCRIPTS]
    sure = [sum(1 for c in s.findall(word) if not any(c in t for t in _TO)) for s in _SCRIPTS]
    main = max(range(4), key=lambda i: (sure[i], counts[i], -i))
    return "".join(_TO[main].get(c, c) for c in word)


def ordinary(text: str) -> str:
    """``text`` in ordinary characters of the same look.

    Kept as they are: typographic punctuation, full-width punctuation, the ideographic
    space beside Chinese or Japanese, joiners in emoji and after an Indic virama, words
    and single letters of another script, plain spaces and tabs.
    """
    text = _GHOST.sub(_ghosts, text)
    text = _BLANK.sub(_blank, text)
    text = _VARIANT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _APART.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
    return _WORD.sub(_one_script, text)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it may stand in by itself, and the script of a letter that may be mixed."""
    alone = np.zeros(0x110000, dtype=bool)
    script = np.zeros(0x110000, dtype=np.uint8)
    for body, mark in ((_WIDE + _DECOMPOSED + _INVISIBLE + _SPACES + _STYLED + _IDEOGRAPHS, 0), (_LATIN, 1), (_CYRILLIC, 2), (_GREEK, 3), (_ARMENIAN, 4)):
        for lo, hi in re.findall(r"(?s)\\?(.)(?:-\\?(.))?", body):
            span = slice(ord(lo), ord(hi or lo) + 1)
            if mark:
                script[span] = mark
            else:
                alone[span] = True
    return alone, script


def suspicious(codes: np.ndarray) -> np.ndarray:
    """Marks of characters that may stand in for others, or meet a letter of another script; the same test as ``SUSPECT``."""
    alone, script = _tables()
    kinds = script[codes]
    marks = alone[codes]
    mixed = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
    marks[1:] |= mixed
    return marks


def scan(df: DataFrame, cost: Broadcast[GarblingCost] | None = None, text: str = "text") -> DataFrame:
    """All non-null rows of ``df`` with ``mapped``, the text in ordinary characters, its ``core``, and ``garbled``: one pass, tested in bulk.

    ``garbled`` tells whether the text was decoded wrongly; it is False without a ``cost``, and
    where the text is in ordinary characters already, as nothing is done to it then.
    Plain ASCII rows stay in the JVM.  Columns of these names are replaced.
    """
    df = df.drop("mapped", "core", "garbled")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            if not texts:
                continue
            codes, starts = code_points(texts)
            mapped, bad = list(texts), [False] * len(texts)
            tried = None
            for i in np.flatnonzero(np.logical_or.reduceat(suspicious(codes), starts)).tolist():
                mapped[i] = ordinary(texts[i])
                if cost and mapped[i] != texts[i]:
                    tried = cost.value.suspects(codes, starts) if tried is None else tried
                    bad[i] = bool(tried[i]) and repair(texts[i], cost.value)[0]
            yield pdf.assign(mapped=mapped, core=[core(m) for m in mapped], garbled=bad)

    plain = F.octet_length(text) == F.char_length(text)
    fields = [*df.schema.fields, T.StructField("mapped", T.StringType()), T.StructField("core", T.StringType()), T.StructField("garbled", T.BooleanType())]
    wide = df.where(~plain).mapInPandas(rows, T.StructType(fields))
    return wide.unionByName(df.where(plain).withColumns({"mapped": F.col(text), "core": F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f]", ""), "garbled": F.lit(False)}))


def unify(df: DataFrame, cost: Broadcast[GarblingCost] | None = None, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose ``text`` is not its class' one form, with ``mapped`` and ``form``.

    Texts are of one class if their mapped values are equal under accent-sensitive Unicode
    collation; the least mapped value in binary order stands for all.  A text that is its
    own form has no row here.  Null and empty texts have none, nor, with a ``cost``, have
    garbled ones.  Repeated rows are one.  Columns named as the new ones are replaced.
    """
    df = df.drop("form", "_a", "_b", "_t", "_changed", "_own", "_class")
    rows = scan(df, cost, text).where(~F.col("garbled") & (F.col(text) != "")).withColumns({"_a": F.xxhash64("core"), "_b": F.xxhash64("core", F.lit(1)), "_t": F.xxhash64(text), "_changed": F.col("mapped") != F.col(text)})
    rows = written(rows.drop("garbled", "core"))
    spellings = rows.groupBy("_a", "_b").agg(F.min("_t").alias("_least"), F.max("_t").alias("_most"), F.max("_changed").alias("_any"))
    several = small(written(spellings.where(F.col("_any") | (F.col("_least") != F.col("_most"))).select("_a", "_b")))
    members = written(rows.join(several, ["_a", "_b"], "left_semi").drop("_a", "_b", "_t", "_changed").distinct())
    classes = members.select(F.collate("mapped", "UNICODE").alias("_class"), "mapped").groupBy("_class").agg(F.min("mapped").alias("form"))
    own = members.withColumn("_own", F.collate("mapped", "UNICODE"))
    return own.join(classes, F.col("_own") == F.col("_class")).where(F.col(text) != F.col("form")).drop("_own", "_class")


def _unified(spark: SparkSession, d: str) -> DataFrame:
    rows = texts_and_titles(spark, d)
    return unify(rows, spark.sparkContext.broadcast(fit_cost(rows)))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and titles (p = 0) that are not in their class' one form, with it: (doc_id, sec, p, text, form).

    Wrongly decoded records are left out: they are to be restored first.
    """
    return _unified(spark, d).drop("mapped")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and titles (p = 0) with a stand-in character: (doc_id, sec, p).

    Of the rows that are not their class' form these are the ones in other than ordinary characters.
    """
    return _unified(spark, d).where("text <> mapped").select("doc_id", "sec", "p").distinct()
