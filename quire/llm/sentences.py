"""Problem 1: sentences of text in many languages and scripts.

Method: a linear-chain model tags characters as boundary or inside, and Viterbi decoding
picks the best sequence of tags.  Only characters that could end a sentence are tagged (end
marks with their closing signs, and spaces in or beside scripts without end marks); all
others are inside.  Each carries features of the text around it.

All weights start at zero and are learned (averaged structured perceptron with a margin) from
a bounded sample.  No boundary is marked in the data, so the training tags come from

- lines put together: where one ends and the next begins is a boundary for certain;
- labelling rules, on the sample's own lines: a table of what speaks for and against a
  boundary (``RULES``).  The rules tag the sample only; decoding knows the weights alone;
- for scripts without end marks, sentences of scripts that write without spaces, stripped
  of their punctuation and put together with spaces.

A text takes time linear in its length.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.sample import sample_texts
from quire.session import load, once

SAMPLE_ROWS = 20_000  # texts that the model is trained on, of at most sample.LONGEST characters each
EPOCHS = 4
MARGIN = 4.0  # by which the right tag of each candidate has to win in training
OFTEN = 200  # times that a feature should be seen in an epoch: chains with rarer ones are repeated
LOOK_BACK = 40  # characters of a word before a mark that are looked at: no abbreviation is longer

# Abbreviations before a name, others, months, verbs of speech.
_TITLES = set("""dr mr mrs ms mx prof st mt ft gen capt col lt sgt maj cmdr adm rev hon pres gov sen rep fr sr jr messrs
sra srta dra d dña av avda ing lic no nos vol vols fig figs ch chap chaps p pp sec art cf vs approx aprox ca núm num nr mme mmes mlle mlles mgr me
hr fr frau dipl ths ts pgs gs bs tp q kts κ κα δρ καθ г ул д кв стр им акад проф тов гр डॉ प्रो श्री नं कु د أ م
""".split()) - {"no", "d", "г", "д", "ch", "art", "sec", "me"}
_NUMBERED = set("no nos nr núm num vol vols p pp fig figs chap chaps ch art sec stk kap cap § n°".split())
_OTHER = set("""etc oz lb lbs ft in yd mi kg km cm mm hr hrs min a.m p.m e.g i.e u.s u.k jr sr inc ltd co corp dept est al ed eds usw bzw z.b d.h u.a ggf
т.д т.п т.е н.э г гг в вв руб коп др пр см c.-à-d p.ej ej ss v.gr π.μ μ.μ π.χ κ.λπ κ.ά v.v v.d""".split())
_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
_SPEECH = re.compile(
    r"\b(?:said|says|asked|asks|answered|replied|whispered|shouted|cried|laughed|muttered|murmured|called|sighed|added|yelled|snapped|growled|hissed|intoned|breathed|"
    r"nói|hỏi|đáp|hét|kêu|thì thầm|gọi|thốt)\b|외쳤|말했|물었|속삭|중얼|대답|소리쳤|चिल्ला|कहा|बोल|पूछ|फुसफुसा|صاح|صرخ|قال|سأل|همس|أجاب|道|说|說|问|問|喊|自语|自語|回答|叫|言|聞|つぶや|ささや|答え"
)

_END = ".!?…。！？．｡।॥؟۔;;։።‽⁇⁈⁉"
_CLOSE = "\"'”’»›)]}」』》〉】）〕〗"
_OPEN = "\"'“‘«‹([{「『《〈【（〔〖„‚¡¿—–-*~_"
_NO_MARK = re.compile("[฀-๿຀-໿က-႟ក-៿]")  # Thai, Lao, Burmese, Khmer
_EAST = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_INDIC = re.compile("[ऀ-෿]")
_CANDIDATE = re.compile(rf"[{re.escape(_END)}]+[{re.escape(_CLOSE)}]*")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"\w+")
_LINE_ENDS = re.compile("(\r\n|[\n\r\x0b\x0c\u2028\u2029])")
_MARK = re.compile(rf"[{re.escape(_END)}]")
_QUOTES = "\"“”„‘’‚«»‹›「」『』"
_QUOTE = re.compile(f"[{_QUOTES}]")
_OPENS = {"”": "“„", "’": "‘‚", "»": "«", "›": "‹", "」": "「", "』": "『", "“": "„"}


class _Line:
    """What the features of a line's candidates need, read once from left to right."""

    def __init__(self, line: str) -> None:
        self.line = line
        self.cased = any(map(str.isupper, line))
        self.quotes = [(m.start(), m.group()) for m in _QUOTE.finditer(line)]
        self.seen, self.last, self.straight = 0, {}, 0
        self.depth, self.counted = 0, 0

    def opening(self, close_at: int) -> int:
        """Offset of the quotation mark that the one at ``close_at`` closes; -1 if there is none.  Offsets must grow."""
        while self.seen < len(self.quotes) and self.quotes[self.seen][0] < close_at:
            at, c = self.quotes[self.seen]
            self.last[c] = at
            self.straight += c == '"'
            self.seen += 1
        close = self.line[close_at]
        if close == '"':
            return self.last['"'] if self.straight % 2 else -1
        return max((self.last.get(o, -1) for o in _OPENS.get(close, "")), default=-1)

    def bracketed(self, at: int) -> bool:
        """Whether a bracket is open before ``at``.  Offsets must grow."""
        self.depth += self.line.count("(", self.counted, at) - self.line.count(")", self.counted, at)
        self.counted = at
        return self.depth > 0

    def start_after(self, at: int) -> int:
        """Offset of the first character from ``at`` on that is neither space nor opening sign."""
        while at < len(self.line) and (self.line[at].isspace() or self.line[at] in _OPEN):
            at += 1
        return at

    def word_before(self, at: int) -> str:
        line, start, least = self.line, at, max(0, at - LOOK_BACK)
        while start > least and not _EAST.match(line[start - 1]) and (line[start - 1].isalnum() or line[start - 1] in ".-'’" or "̀" <= line[start - 1] <= "ͯ" or _INDIC.match(line[start - 1])):
            start -= 1
        return line[start:at]


def candidates(line: str) -> list[tuple[int, list[str]]]:
    """Offsets after which a sentence may end, each with its features; the line's end is not among them."""
    seen, out = _Line(line), []
    for m in _CANDIDATE.finditer(line):
        marks = m.group().rstrip(_CLOSE)
        out.append((m.end(), _mark_features(seen, m.start(), marks, m.group()[len(marks) :], m.end())))
    if _NO_MARK.search(line):
        since = 0
        for m in _SPACE.finditer(line):
            if m.start() and m.end() < len(line):
                a, b = line[m.start() - 1], line[m.end()]
                if (_NO_MARK.match(a) or _NO_MARK.match(b)) and a not in _END and a not in _CLOSE:
                    out.append((m.start(), _space_features(a, b, m.start() - since)))
            since = m.end()
        out.sort()
    end = len(line.rstrip())
    last = next((i for i in range(end - 1, -1, -1) if line[i].isalpha()), -1) if out else -1
    kept, letter = [], _LETTER.search(line)
    for at, features in out:
        if at < end and at <= last and letter and letter.start() < at:
            kept.append((at, features))
            letter = _LETTER.search(line, at)
    return kept


def _kind(c: str) -> str:
    return "digit" if c.isdigit() else "script" if _NO_MARK.match(c) or _EAST.match(c) else "letter" if c.isalpha() else "sign"


def _space_features(a: str, b: str, run: int) -> list[str]:
    """Features of a space in or beside a script without end marks; ``run`` characters stand since the space before it."""
    return ["space", f"space:{_kind(a)}|{_kind(b)}", f"run:{min(run, 12) // 4}"]


def _mark_features(seen: _Line, at: int, marks: str, closers: str, end: int) -> list[str]:
    line = seen.line
    mark = "…" if marks.startswith("...") or "…" in marks else marks[-1]
    spaced = end < len(line) and line[end].isspace()
    start = seen.start_after(end)
    first = line[start : start + 1]
    kind = (
        "none" if not first else "digit" if first.isdigit() else "east" if _EAST.match(first) else "upper" if first.isupper() or first.istitle()
        else "lower" if first.islower() and seen.cased else "uncased" if first.islower() else "caseless" if first.isalpha() else "sign"
    )
    f = [f"mark:{mark}", f"next:{kind}{'' if spaced else '|tight'}", f"mark:{mark}|{kind}"]
    word = seen.word_before(at)
    before = line[at - 1 : at]
    if mark == ".":
        low = word.lower().strip("-'’")
        tail = low.rsplit(".", 1)[-1]
        if 0 < len(tail) <= 6:
            f.append(f"word:{tail}")
        if tail in _TITLES or low in _TITLES:
            f.append("title")
        if (low in _NUMBERED or tail in _NUMBERED) and kind == "digit":
            f.append("numbered")
        if low in _OTHER or tail in _OTHER or ("." in low and len(tail) < 4):
            f.append("abbreviation" + ("|upper" if kind in ("upper", "sign", "uncased") else ""))
        if len(tail) == 1 and tail.isalpha() and not closers:
            f.append("initial" if word[-1:].isupper() or "." not in low else "initial|lower")
        if before.isdigit() and (after := _WORD.match(line, start)) and after.group().lower() in _MONTHS:
            f.append("ordinal")
        if before and _INDIC.match(before):
            f.append("indic")
        if not spaced and not closers:
            own = word.rsplit(".", 1)[-1].rsplit("-", 1)[-1]
            after = _WORD.match(line, start)
            caps = own.isupper() or bool(after and len(after.group()) > 1 and after.group().isupper())
            word_ends = own.isalpha() and (len(own) >= 2 and own.islower() or len(own) >= 4 and own[1:].islower())
            f += ["tight:new"] if kind == "upper" and word_ends and not caps else ["tight:inside", "tight:caps"] if caps else ["tight:inside"]
    elif mark in ";;":
        f.append("greek" if before and _GREEK.match(before) and kind not in ("lower",) else "semicolon")
    elif not spaced and mark in "!?" and kind != "east" and not closers:
        f.append("tight:new" if kind == "upper" else "tight:inside" if kind in ("lower", "digit") else "tight:sign")
    between = line[end:start]
    quote = next((i for i, c in enumerate(closers) if c in "\"”’»“」』"), None)
    if quote is not None:
        f.append("closed")
        o = k = seen.opening(end - len(closers) + quote)
        while k > 0 and line[k - 1].isspace():
            k -= 1
        lead = ":" if o < 0 else line[k - 1] if k else ""
        first_in = not lead or lead in _END or (lead in _CLOSE and lead not in "》〉") or lead in _OPEN
        after = _MARK.search(line, end)
        if o >= 0 and first_in and not any(c in "“«「『„\"" for c in between) and _SPEECH.search(line, end, after.start() if after else len(line)):
            f.append("said")
        if o >= 0 and first_in and not spaced and kind in ("east", "caseless"):
            f.append("quote|tight")
        if line[end : end + 1] in ("と", "라", "이", "하", ",", "，", "、"):
            f.append("goes on")
    elif kind == "lower" and between.strip() and all(c in "—–-" for c in between.strip()):
        f.append("goes on")
    if line[end : end + 1] and line[end : end + 1] in ",，、:：;；":
        f.append("goes on")
    if closers[:1] in (")", "]") and ("abbreviation" in f or "abbreviation|upper" in f):
        f.append("listed")
    if mark == "…" and (kind in ("east", "caseless") or (_EAST.match(before or " ") and not closers)):
        f.append("pause")
    if seen.bracketed(end):
        f.append("bracketed")
    return f


# Labelling rules: what each feature says for (positive) or against a boundary, for tagging the sample.
RULES = {
    "next:upper": 3, "next:upper|tight": 2, "next:digit": 1, "next:east": 3, "next:east|tight": 2, "next:caseless": 3, "next:uncased": 3, "next:sign": 2, "next:sign|tight": 1, "tight:new": 1, "greek": 1,
    "space:script|script": 5, "space:script|letter": 5, "space:letter|script": 5, "space:script|sign": 5, "space:sign|script": 5,
    **{
        against: -30
        for against in (
            "next:lower", "next:lower|tight", "next:digit|tight", "next:none", "title", "numbered", "initial", "ordinal", "indic", "tight:inside", "tight:caps", "semicolon", "said", "quote|tight", "goes on", "pause", "listed",
            "space:digit|script", "space:script|digit", "space:digit|letter", "space:letter|digit",
        )
    },
    "abbreviation": -2, "abbreviation|upper": 0,
}


def ruled(features: list[list[str]]) -> list[bool]:
    """The tags that the labelling rules give."""
    return [sum(RULES.get(x, 0) for x in f) > 0 for f in features]


class SentenceModel:
    """Linear-chain weights and their Viterbi decoder.  Without weights nothing is a boundary."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = dict(weights or {})

    def decode(self, features: list[list[str]], gold: list[bool] | None = None) -> list[bool]:
        """Best tags of a chain of candidates: True is a boundary.  With ``gold``, for training, wrong tags have ``MARGIN`` for them."""
        get = self.weights.get
        stay, again, bias = get("I|B", 0.0), get("B|B", 0.0), get("bias", 0.0)
        inside, bound, back = 0.0, 0.0, []
        for k, f in enumerate(features):
            score = bias + sum(get(x, 0.0) for x in f)
            if gold is not None:
                score += -MARGIN if gold[k] else MARGIN
            to_b = (bound + again, True) if k == 0 or bound + again >= inside + stay else (inside + stay, False)
            to_i = (bound, True) if k == 0 or bound >= inside else (inside, False)
            back.append((to_i[1], to_b[1]))
            inside, bound = to_i[0], to_b[0] + score
        tags, tag = [], bound > inside
        for from_i, from_b in reversed(back):
            tags.append(tag)
            tag = from_b if tag else from_i
        return tags[::-1]

    @classmethod
    def train(cls, texts: list[str], epochs: int = EPOCHS) -> "SentenceModel":
        """Averaged structured perceptron with a margin; the order is fixed by a seed."""
        dice = random.Random(7)
        return cls.learn(training_chains(texts, dice), dice, epochs)

    @classmethod
    def learn(cls, chains: list[tuple[list[list[str]], list[bool]]], dice: random.Random, epochs: int = EPOCHS) -> "SentenceModel":
        model, owed, step = cls(), defaultdict(float), 0
        seen = Counter(x for features, _ in chains for f in features for x in f if not x.startswith("word:"))
        rarest = [min((seen[x] for f in features for x in f if x in seen), default=OFTEN) for features, _ in chains]
        chains = [chain for chain, n in zip(chains, rarest) for _ in range(max(1, min(OFTEN // n, 50)))]
        for _ in range(epochs):
            dice.shuffle(chains)
            for features, gold in chains:
                step += 1
                guess = model.decode(features, gold)
                if guess == gold:
                    continue
                for tags, sign in ((gold, 1.0), (guess, -1.0)):
                    last = True
                    for f, tag in zip(features, tags):
                        if tag:
                            for x in [*f, "bias", "B|B" if last else "I|B"]:
                                model.weights[x] = model.weights.get(x, 0.0) + sign
                                owed[x] += sign * step
                        last = tag
        # The mean of the weights over all steps.
        return cls({x: w - owed[x] / (step + 1) for x, w in model.weights.items()})

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Sentences of a text: (start, end) in code points, without outer white space."""
        out, base = [], 0
        for line in _LINE_ENDS.split(text):
            if _LETTER.search(line):
                cuts = candidates(line)
                tags = self.decode([f for _, f in cuts])
                ends = [at for (at, _), tag in zip(cuts, tags) if tag] + [len(line)]
                start = 0
                for end in ends:
                    piece = line[start:end]
                    a = start + len(piece) - len(piece.lstrip())
                    b = start + len(piece.rstrip())
                    if b > a:
                        out.append((base + a, base + b))
                    start = end
            base += len(line)
        return out


def training_chains(texts: list[str], dice: random.Random) -> list[tuple[list[list[str]], list[bool]]]:
    """Chains of candidates with their tags: lines as they are, lines put together, and stripped ones."""
    return [*ruled_chains(texts), *joined_chains(texts, dice), *stripped_chains(texts, dice)]


def _lines(texts: list[str]) -> list[str]:
    return [line for text in texts for line in map(str.strip, text.split("\n")) if _LETTER.search(line)]


def ruled_chains(texts: list[str]) -> list[tuple[list[list[str]], list[bool]]]:
    """The sample's lines, tagged by the labelling rules."""
    found = [[f for _, f in candidates(line)] for line in _lines(texts)]
    return [(f, ruled(f)) for f in found if f]


def _script(line: str) -> str:
    return "bare" if _NO_MARK.search(line) else "east" if _EAST.search(line) else "indic" if _INDIC.search(line) else "greek" if _GREEK.search(line) else "other"


def joined_chains(texts: list[str], dice: random.Random) -> list[tuple[list[list[str]], list[bool]]]:
    """Lines of one script put together by threes: their ends are boundaries; inside a line the rules tag.

    A line that ends in no end mark, or in an ellipsis, is left out: the same signs stand
    inside sentences too, and its end is known by the line's end alone.
    """
    by_script: dict[str, list[str]] = defaultdict(list)
    for line in _lines(texts):
        bare = line.rstrip(_CLOSE)
        script = _script(line)
        if script == "bare" or (bare[-1:] in _END and not bare.endswith(("…", "...", ";", ";"))):
            by_script[script].append(line)
    chains = []
    for script, lines in sorted(by_script.items()):
        dice.shuffle(lines)
        for i in range(0, len(lines) - 2, 3):
            group, joined, ends = lines[i : i + 3], "", set()
            if script == "bare" and any(line[-1].isdigit() or line[0].isdigit() for line in group):
                continue
            for line in group:
                joined += line
                ends.add(len(joined))
                joined += "" if script == "east" and (line[-1] > "⺀" or line.rstrip(_CLOSE)[-1:] > "⺀") else " "
            cuts = candidates(joined.rstrip())
            tags = ruled([f for _, f in cuts])
            if cuts:
                chains.append(([f for _, f in cuts], [at in ends or tag for (at, _), tag in zip(cuts, tags)]))
    return chains


def stripped_chains(texts: list[str], dice: random.Random) -> list[tuple[list[list[str]], list[bool]]]:
    """Sentences without their punctuation, put together with spaces, as scripts without end marks write.

    Chinese and Japanese lines serve, cut by the rules: they have no spaces of their own.
    Around numbers stand spaces that end nothing.
    """
    bare = []
    for line in _lines(texts):
        if _script(line) != "east":
            continue
        cuts = candidates(line)
        ends = [0, *[at for (at, _), tag in zip(cuts, ruled([f for _, f in cuts])) if tag], len(line)]
        for a, b in zip(ends, ends[1:]):
            piece = re.sub(r"[^\w.]|(?<!\d)\.|\.(?!\d)", "", line[a:b])
            if piece and not piece[0].isdigit() and not piece[-1].isdigit():
                bare.append(re.sub(r"\d[\d.]*", lambda m: f" {m.group()} ", piece))
    dice.shuffle(bare)
    chains = []
    for i in range(0, len(bare) - 3, 4):
        joined, ends = "", set()
        for piece in bare[i : i + 4]:
            joined += piece
            ends.add(len(joined))
            joined += " "
        features, tags, since = [], [], 0
        for m in _SPACE.finditer(joined.rstrip()):
            features.append(_space_features(joined[m.start() - 1], joined[m.end()], m.start() - since))
            tags.append(m.start() in ends)
            since = m.end()
        chains.append((features, tags))
    return chains


def fit_model(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> SentenceModel:
    """Model trained on a sample of at most ``rows`` distinct texts."""
    return SentenceModel.train(sample_texts(df, text, rows))


def split_sentences(df: DataFrame, keys: list[str], model: SentenceModel, text: str = "text") -> DataFrame:
    """One row a sentence: keys, s from 1, s_start, s_end (code points, end exclusive), sentence.

    Null texts and texts without a letter have none.  A line's end ends a sentence, and a
    line without an end mark is one.  Repeated rows count once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = once(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")), keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = shared.value.spans
        for pdf in batches:
            texts = pdf["_text"].tolist()
            found = [spans(t) for t in texts]
            out = pdf[keys].loc[pdf.index.repeat([len(f) for f in found])].reset_index(drop=True)
            out["s"] = [i + 1 for f in found for i in range(len(f))]
            out["s_start"] = [a for f in found for a, _ in f]
            out["s_end"] = [b for f in found for _, b in f]
            out["sentence"] = [t[a:b] for t, f in zip(texts, found) for a, b in f]
            if len(out):
                yield out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["s int", "s_start int", "s_end int", "sentence string"])
    return rows.mapInPandas(cut, schema)


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all paragraphs: (doc_id, sec, p, s, s_start, s_end, sentence)."""
    rows = load(spark, d, "paragraphs")
    return split_sentences(rows, ["doc_id", "sec", "p"], fit_model(rows))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the chapters in sentence_sample: (doc_id, sec, p, s_start, s_end)."""
    rows = load(spark, d, "paragraphs")
    asked = load(spark, d, "sentence_sample").select("doc_id", "sec").distinct()
    return split_sentences(rows.join(asked, ["doc_id", "sec"]), ["doc_id", "sec", "p"], fit_model(rows)).select("doc_id", "sec", "p", "s_start", "s_end")
