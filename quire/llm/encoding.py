"""Problem 3: text decoded with the wrong character encoding.

Method: round-trip repair.  A stretch of text is encoded again under a candidate legacy
encoding and strictly decoded as an intended one, layer by layer, and the result is
accepted where a garbling cost drops.

The cost is learned: log odds of neighbouring characters between text as it stands in the
corpus and the same text garbled on purpose under every pair of encodings, fitted on a
bounded sample of rows (``SAMPLE_ROWS``, of at most ``sample.LONGEST`` characters each), and
how common neighbours are in the whole corpus, counted over all rows.  Every row is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.sample import sample_texts
from quire.session import load, written

SAMPLE_ROWS = 20_000  # rows that the cost is fitted on
BITS = 18  # of the hashed tables
PASSES = 3  # spans that a wide character is in while a text is repaired, at most on average
WINDOW = 4  # neighbouring characters that are summed up
SUSPECT = 2.5  # summed log odds from which a stretch is tried
GARBLED_SHARE = 12  # each pair of encodings garbles one in so many rows of the sample
DROP = 1.5  # least drop of the mean surprise
UNSEEN = 14.0  # surprise of neighbours that the sample never has
UTF8_BONUS = 6.0  # bytes of other encodings are hardly ever valid UTF-8 by chance
HONEST = 8.0  # neighbours that surprise less are left alone
ODD = 10.2  # what a few characters must surprise by to be taken for others
HOPELESS = 2.2  # mean log odds from which a stretch is garbled though nothing repairs it

# Encodings that text was meant in, and those it was taken for.
INTENDED = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "gb18030", "big5", "cp932", "euc_jp", "cp949", "cp874", "cp1253", "cp1256", "cp1250", "mac_roman")
TAKEN_FOR = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "gbk", "big5", "cp932", "cp949", "cp874", "cp1256")

_NUMBER = re.compile(r"[0-9]")
_BROKEN_WORD = re.compile(r"(?:^|\s)[–—…•†‡]\w|\w[„“«]\w")  # what no author writes
_NEVER = re.compile("[\x80-\x9f\ufffd\u2500-\u259f\ue000-\uf8ff]")  # what no repair may give
# Cyrillic and Greek letters that look like Latin ones, and where such a letter stands in a Latin word.
_DOUBLES = frozenset("асԁеһіјӏорԛѕуԝхкАВСЕНІЈКМОРЅТХҮαικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_MIXED = re.compile("(?<=[A-Za-z])[\u0370-\u052f]+|[\u0370-\u052f]+(?=[A-Za-z])")
_FOREIGN_WORD = re.compile(r"[^\W\d_\u0000-\u024f]{2}")
_KEPT = re.compile("[^\ufffd]+")
_LOST = re.compile("[\x80-\x84\x86-\x9f�]")


@lru_cache(maxsize=1)
def _back() -> dict[str, dict[int, bytes]]:
    """For each single-byte encoding, its characters' bytes; undefined bytes are C1 controls."""
    out = {}
    for name in TAKEN_FOR:
        if name in ("gbk", "big5", "cp932", "cp949"):
            continue
        table = {}
        for b in range(256):
            raw = bytes([b])
            try:
                table[ord(raw.decode(name))] = raw
            except UnicodeDecodeError:
                table[b] = raw
        out[name] = table
    return out


def to_bytes(text: str, encoding: str) -> bytes | None:
    """Bytes that ``encoding`` shows as ``text``; None if it can't."""
    table = _back().get(encoding)
    if table is None:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    try:
        return b"".join([table[ord(c)] for c in text])
    except KeyError:
        return None


def garble(text: str, intended: str, taken_for: str) -> str | None:
    """``text`` as it looks when bytes in one encoding are decoded as another."""
    try:
        raw = text.encode(intended)
    except UnicodeEncodeError:
        return None
    if taken_for in _back():
        chars = {b[0]: chr(c) for c, b in _back()[taken_for].items()}
        got = "".join(chars[b] for b in raw)
    else:
        got = raw.decode(taken_for, "replace")
    return None if got == text else got


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line end, and where each starts."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of each character with its predecessor, and of the character alone."""
    codes = codes.astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    before = np.concatenate([[np.uint64(10)], codes[:-1]])
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (codes * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    alone = codes * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64), (alone >> np.uint64(64 - BITS)).astype(np.int64)


class GarblingCost:
    """What garbling costs: two measures, both fitted on a sample.

    ``odds`` are log odds of garbled against honest text, by neighbouring characters and by
    character, in hashed tables for scoring in bulk.  ``surprise`` is the mean negative log
    probability of neighbours in honest text, for comparing a stretch with its repairs.
    """

    def __init__(self, pair: np.ndarray, single: np.ndarray, known: dict[str, float]) -> None:
        self.pair, self.single, self.known = pair, single, known

    def surprise(self, text: str) -> float:
        """Mean surprise of neighbours that are not both plain ASCII; 0 if there are none."""
        if text.isascii():
            return 0.0
        get, total, n = self.known.get, 0.0, 0
        text = _NUMBER.sub("0", text)
        before = "0"
        for c in text:
            if c > "\x7f" or before > "\x7f":
                total += get(before + c, UNSEEN)
                n += 1
            before = c
        return total / n

    def familiar(self, text: str) -> bool:
        """Whether the sample has all neighbours of ``text`` that are not plain ASCII."""
        text = _NUMBER.sub("0", text)
        return all(a + b in self.known for a, b in zip(text, text[1:]) if a > "\x7f" or b > "\x7f")

    @classmethod
    def fit(cls, sample: list[str], counted: dict[str, int] | None = None, total_pairs: int = 0) -> "GarblingCost":
        """Cost from ``sample``, with the corpus' counts of neighbours; without them, the sample's own."""
        size = 1 << BITS
        counts = np.zeros((4, size))

        def add(texts: list[str], rows: tuple[int, int], weight: float) -> None:
            if not texts:
                return
            codes, _ = code_points(texts)
            wide = (codes > 126) | (np.concatenate([[10], codes[:-1]]) > 126)
            two, one = _slots(codes)
            counts[rows[0]] += weight * np.bincount(two[wide], minlength=size)
            counts[rows[1]] += weight * np.bincount(one[codes > 126], minlength=size)

        honest = [t for t in sample if not _LOST.search(t)]
        add(honest, (0, 1), 1.0)
        total = counts[0].sum()
        wide = [t for t in honest if not t.isascii()]
        pairs = [(a, b) for a in INTENDED for b in TAKEN_FOR if a != b]
        made = [[g for t in wide[k % GARBLED_SHARE :: GARBLED_SHARE] if (g := garble(t, a, b))] for k, (a, b) in enumerate(pairs)]
        for texts in made:
            if len(texts) >= 5:
                codes, _ = code_points(texts)
                share = total / (len(made) * max(1, (codes > 126).sum()))
                add(texts, (2, 3), min(1.0, 40 * share))
        add([g for t in wide[::4] if (g := garble(t, "utf-8", "cp1252")) and (g := garble(g, "utf-8", "cp1252"))], (2, 3), 0.05)
        odds = []
        for good, bad in ((counts[0], counts[2]), (counts[1], counts[3])):
            p = (good + 0.3) / (good.sum() + 0.3 * size)
            q = (bad + 0.3) / (bad.sum() + 0.3 * size)
            odds.append(np.clip(np.log(q / p), -8, 8).astype(np.float32))
        if counted is None:
            seen: Counter[str] = Counter()
            for t in honest:
                t = _NUMBER.sub("0", t)
                seen.update(two for two in map("".join, zip(t, t[1:])) if not two.isascii())
            counted, total_pairs = seen, sum(seen.values())
        return cls(*odds, {two: min(UNSEEN, float(-np.log(k / total_pairs))) for two, k in counted.items()})

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Cost of each character; 0 for plain ASCII after plain ASCII."""
        wide = (codes > 126) | (np.concatenate([[10], codes[:-1]]) > 126)
        out = np.zeros(len(codes), dtype=np.float32)
        if wide.any():
            two, one = _slots(codes)
            out[wide] = 0.7 * self.pair[two[wide]] + np.where(codes[wide] > 126, 0.5 * self.single[one[wide]], 0)
        return out

    def mean(self, text: str) -> float:
        """Mean cost of the characters that are not plain ASCII; 0 if there are none."""
        codes, _ = code_points([text])
        codes = codes[:-1]
        n = int((codes > 126).sum())
        return float(self.of(codes).sum()) / n if n else 0.0

    def peaks(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Highest sum over neighbouring characters in each text."""
        run = np.cumsum(np.maximum(self.of(codes), -4).astype(np.float64))
        # A window ends at the start of its text, so a text has the same peak in any batch.
        first = np.repeat(starts, np.diff(np.append(starts, len(codes))))
        run = np.concatenate([[0.0], run])
        sums = run[1:] - run[np.maximum(np.arange(len(codes)) + 1 - WINDOW, first)]
        return np.maximum.reduceat(sums, starts)

    def suspects(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each text is to be taken apart: a high peak or a lost character.  One test for problems 3 and 6."""
        lost = np.maximum.reduceat(((codes >= 0x80) & (codes < 0xA0)) | (codes == 0xFFFD), starts)
        return (self.peaks(codes, starts) >= SUSPECT) | lost


_WORD_GAP = 6


def _stretches(text: str, cost: GarblingCost) -> list[tuple[int, int]]:
    """Spans of ``text`` that look garbled, joined over small gaps, widest first."""
    codes, _ = code_points([text])
    c = cost.of(codes)[:-1]
    hot = np.flatnonzero((c > 0.8) | ((codes[:-1] >= 0x80) & (codes[:-1] < 0xA0)) | (codes[:-1] == 0xFFFD))
    spans: list[list[int]] = []
    for i in hot.tolist():
        if spans and i - spans[-1][1] <= _WORD_GAP:
            spans[-1][1] = i + 1
        else:
            spans.append([max(0, i - 1), i + 1])
    out = [(a, b) for a, b in spans]
    if len(out) > 1:
        out.insert(0, (out[0][0], out[-1][1]))
    return out


def _grow(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A span, wider ones up to the borders of words and of the text, narrower ones, and what stands between lost characters."""
    left, right = a, b
    while left and not text[left - 1].isspace():
        left -= 1
    while right < len(text) and not text[right].isspace():
        right += 1
    wide_l, wide_r = a, b
    while wide_l and text[wide_l - 1] > "~":
        wide_l -= 1
    while wide_r < len(text) and text[wide_r] > "~":
        wide_r += 1
    outside = sum(c > "~" for c in text[:left]) + sum(c > "~" for c in text[right:])
    spans = [(0, len(text))] if outside == 0 else []
    spans += [(left, right), (wide_l, wide_r), (a, b), (wide_l, min(wide_r + 1, len(text))), (a + 1, b)]
    if "\ufffd" in text[left:right]:
        spans += [(left + m.start(), left + m.end()) for m in _KEPT.finditer(text[left:right])]
    yield from (s for s in dict.fromkeys(spans) if s[1] > s[0])


def _allowed(piece: str, got: str, left: str, right: str, open_quote: bool, utf8: bool, wide_wrong: bool, start: float) -> bool:
    """Whether there is enough of ``piece`` to tell: a sign or two may be anything."""
    n = sum(c > "~" for c in piece)
    if utf8:
        # A capital with tilde or circumflex before a closing quote is no two-byte sequence.
        closes = n == 2 and piece.rstrip()[-1:] in "”’»" and open_quote
        return n >= (3 if wide_wrong else 2) and not closes
    foreign = [c for c in got if c > "\u024f" and c.isalpha()]
    if foreign:  # letters of an alphabet stand in words, not alone like signs
        return n >= 4 and (max(foreign) > "\u2e7f" or bool(_FOREIGN_WORD.search(got)))
    return start >= ODD and not wide_wrong and not _BROKEN_WORD.search(left + got + right)


def _quoted(text: str, x: int) -> bool:
    """Whether a quotation is open before ``text[x]``."""
    return any(text.count(o, 0, x) > text.count(c, 0, x) for o, c in ("“”", "‘’", "«»"))


def _doubled(text: str, piece: str) -> bool:
    """Whether ``piece`` is one of several look-alikes in Latin words: letters put in on purpose, not garbled."""
    if not all(c in _DOUBLES for c in piece if c > "~"):
        return False
    mixed = "".join(_MIXED.findall(text))
    return len(mixed) > 1 and all(c in _DOUBLES for c in mixed)


def _repair_span(text: str, x: int, y: int, cost: GarblingCost) -> str | None:
    """The strict round trip of ``text[x:y]`` that surprises least, if it does so by much less.

    Layers below the first are tried under UTF-8 only: text is garbled twice by programs
    that write UTF-8.  The neighbours of the stretch count too.
    """
    left, right_ = text[max(0, x - 1) : x], text[y : y + 1]
    start = cost.surprise(left + text[x:y] + right_)
    if start < HONEST:
        return None
    wide = sum(c > "~" for c in text[x:y])
    doubled = _doubled(text, text[x:y])
    quoted = _quoted(text, x)
    best, best_cost = None, start - DROP
    frontier, bonus = [text[x:y]], 0.0
    while frontier:  # a layer has fewer characters than the one above it, so they end
        tried: set[bytes] = set()
        found: set[str] = set()
        deeper = []
        for piece in frontier:
            for wrong in TAKEN_FOR:
                raw = to_bytes(piece, wrong)
                if raw is None or raw.isascii() or raw in tried:
                    continue
                tried.add(raw)
                wide_wrong = wrong not in _back()
                for right in INTENDED if bonus == 0 else ("utf-8",):
                    try:
                        got = raw.decode(right)
                    except UnicodeDecodeError:
                        continue
                    utf8 = right == "utf-8"
                    passing = bool(_NEVER.search(got))  # no repair itself, but another layer may be below it
                    if got == piece or got in found or passing and not utf8:
                        continue
                    found.add(got)
                    if not _allowed(piece, got, left, right_, quoted, utf8, wide_wrong, start):
                        continue
                    if not utf8 and (doubled or wide == 1 and not cost.familiar(left + got + right_)):
                        continue
                    price = cost.surprise(left + got + right_) - bonus - UTF8_BONUS * utf8
                    if price < best_cost and not passing:
                        best, best_cost = got, price
                    if utf8:
                        deeper.append(got)
                        break
        frontier = [g for g in deeper if not g.isascii()]
        bonus += UTF8_BONUS
    return best


def repair(text: str, cost: GarblingCost) -> tuple[bool, str]:
    """Whether ``text`` is garbled, and the text with every stretch repaired that can be."""
    garbled = bool(_LOST.search(text))
    done = text
    hopeless: set[tuple] = set()  # spans with what their repair depends on
    # Each pass repairs a wide character at least, through all of its layers.
    for _ in range(PASSES * sum(c > "~" for c in text)):
        spans = _stretches(done, cost)
        shift, end, changed = 0, 0, False
        for k, (a, b) in enumerate(spans):
            a, b = a + shift, b + shift
            if b <= end:
                continue
            for x, y in _grow(done, max(a, end), b):
                if x < end:
                    continue
                key = (done[max(0, x - 1) : x], done[x:y], done[y : y + 1], _quoted(done, x))
                if key in hopeless:
                    continue
                if (fixed := _repair_span(done, x, y, cost)) is None:
                    hopeless.add(key)
                    continue
                done, changed, garbled = done[:x] + fixed + done[y:], True, True
                shift, end = shift + len(fixed) - (y - x), x + len(fixed)
                break
            if changed and k == 0:
                break  # the one over all of them: the rest is found anew
        if not changed:
            break
    if not garbled:
        for a, b in _stretches(text, cost):
            piece = text[a:b]
            if len({c for c in piece if c > "~"}) >= 4 and cost.mean(piece) >= HOPELESS:
                garbled = True
                break
    return garbled, done


def count_neighbours(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """How often each two neighbours that aren't both plain ASCII stand in all rows without lost characters, and how many there are.

    Neighbours rarer than ``UNSEEN`` allows are left out, so at most exp(UNSEEN) are sent.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t for t in pdf[text] if not _LOST.search(t)]
            if not texts:
                continue
            codes, _ = code_points(texts)
            codes = np.where((codes >= 48) & (codes <= 57), 48, codes).astype(np.int64)
            pairs = (codes[:-1] << 21) | codes[1:]
            wide = ((codes[:-1] > 127) | (codes[1:] > 127)) & (codes[:-1] != 10) & (codes[1:] != 10)
            found, n = np.unique(pairs[wide], return_counts=True)
            yield pd.DataFrame({"two": found, "n": n})

    wide = df.where(F.octet_length(text) != F.char_length(text)).select(text)
    counts = written(wide.mapInPandas(count, "two long, n long").groupBy("two").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= total * math.exp(-UNSEEN)).collect()
    return {chr(r.two >> 21) + chr(r.two & 0x1FFFFF): r.n for r in kept}, total


def fit_cost(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> GarblingCost:
    """Garbling cost from a sample of at most ``rows`` distinct texts and the neighbours in all of them."""
    return GarblingCost.fit(sample_texts(df, text, rows), *count_neighbours(df, text))


def repair_texts(df: DataFrame, cost: "Broadcast[GarblingCost]", text: str = "text") -> DataFrame:
    """Rows whose ``text`` is garbled, with a column ``repaired``.

    Null and empty texts never are.  Text that can't be restored, or not wholly, keeps what
    is lost as it is.  Plain ASCII rows stay in the JVM; the rest is scored in bulk, and
    only suspects are taken apart.  A column named ``repaired`` is replaced.
    """
    df = df.drop("repaired")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cost.value
        for pdf in batches:
            texts = pdf[text].tolist()
            if not texts:
                continue
            codes, starts = code_points(texts)
            suspects = np.flatnonzero(model.suspects(codes, starts))
            kept, fixed = [], []
            for i in suspects.tolist():
                garbled, done = repair(texts[i], model)
                if garbled:
                    kept.append(i)
                    fixed.append(done)
            if kept:
                yield pdf.iloc[kept].assign(repaired=fixed)

    wide = df.where(F.col(text).isNotNull() & (F.octet_length(text) != F.char_length(text)))
    return wide.mapInPandas(scan, T.StructType([*wide.schema.fields, T.StructField("repaired", T.StringType())]))


def texts_and_titles(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and section titles (p = 0) in one relation: (doc_id, sec, p, text)."""
    titles = load(spark, d, "sections").select("doc_id", "sec", F.lit(0).alias("p"), F.col("title").alias("text"))
    return load(spark, d, "paragraphs").select("doc_id", "sec", "p", "text").unionByName(titles)


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled paragraphs and titles, repaired where it is possible: (doc_id, sec, p, text, repaired).  Each once."""
    rows = texts_and_titles(spark, d)
    cost = spark.sparkContext.broadcast(fit_cost(rows))
    return repair_texts(rows, cost).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and titles (p = 0) that were decoded wrongly, wholly or in part: (doc_id, sec, p)."""
    return p3_repaired(spark, d).select("doc_id", "sec", "p").distinct()
