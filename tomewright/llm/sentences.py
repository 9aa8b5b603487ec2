"""Sentence boundaries in texts of several scripts, by a maximum-entropy classifier."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE
from ..storage import checkpointed

#: Buckets that the words before marks are hashed to, so that the features are bounded and no word is left out.
WORD_BUCKETS = 4096
#: Marks that the counts of the training sets are scaled down to where there are more.
TRAINED_MARKS = 20_000

# English abbreviations, by what follows them.
TITLES = set("mr mrs ms dr prof st rev gen col capt lt sgt hon pres gov sen rep messrs mt ft".split())
BEFORE_NUMBERS = set("no nos vol ver v p pp fig figs sec art ch ed approx ca c vs cf r rr para".split())
INSIDE = set("e.g i.e eg ie viz al".split())
EITHER = set("etc jr sr a.m p.m am pm inc ltd co corp bros dept est min max mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k ph.d".split())
PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "｢": "｣", "“": "”", "‘": "’", "【": "】", "〈": "〉", "《": "》", "〔": "〕", "«": "»"}
ROUND = "(（[［"
MARKS = ".!?。！？｡．…‥‼⁇⁈⁉"
#: What goes on with a Japanese sentence after a quotation.
PARTICLES = "とはがをにのでもやへ"

_CLOSERS = {b: a for a, b in PAIRS.items()}
_SPECIAL = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + "\"'") + "]")
_MARK_RUN = re.compile(f"[{re.escape(MARKS)}][{re.escape(MARKS)}{INVISIBLE}]*")
_BREAK = re.compile(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_LIST_NUMBER = re.compile(r"\s*\(?(?:\d{1,3}|[a-zA-Z])[.．]?$")
_BEFORE = re.compile(r"[^\s\"'“”‘’()（）「」『』、。｡！？!?,;:]{1,24}$")
_PAUSE = re.compile(r"^(?:\.{2,}|[…‥]+)$")
_FINAL = re.compile(f"[{re.escape(MARKS)}]")


def _spans(line: str) -> list[tuple[int, int]]:
    """The outermost bracketed or quoted stretches of a line, as [start, end); an opener without its closer is none."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    straight = line.count('"')
    for m in _SPECIAL.finditer(line):
        ch, at = m[0], m.start()
        if ch in ('"', "'"):
            before, after = line[at - 1 : at], line[at + 1 : at + 2]
            if ch == "'" and before.isalnum() and after.isalnum() or ch == '"' and straight == 1:
                continue
            at_open = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == ch), None)
            if at_open is not None:
                found.append((stack[at_open][1], at + 1))
                del stack[at_open:]
            elif ch == '"' or not before.isalnum() and after and not after.isspace():
                stack.append((ch, at))
        elif ch in PAIRS:
            stack.append((ch, at))
        else:
            at_open = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == _CLOSERS[ch]), None)
            if at_open is not None:
                found.append((stack[at_open][1], at + 1))
                del stack[at_open:]
    found.sort()
    outer: list[tuple[int, int]] = []
    for s, e in found:
        if not outer or s >= outer[-1][1]:
            outer.append((s, e))
    return outer


def _kind(ch: str) -> str:
    """Case, digit or script of a character, as far as boundaries depend on it."""
    if not ch:
        return "end"
    if ch.isdigit():
        return "digit"
    o = ord(ch)
    if 0x3041 <= o <= 0x309F:
        return "hira"
    if 0x30A0 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return "kata"
    if 0x2E80 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xAC00 <= o <= 0xD7AF:
        return "han"
    if ch.isalpha():
        return "upper" if ch.isupper() else "lower" if ch.islower() else "letter"
    return "open" if ch in PAIRS or ch in "\"'" else "other"


def _candidates(line: str, following: str) -> Iterator[tuple[int, int | None, list[str]]]:
    """Possible boundaries in a line: end, label where a rule is reliable enough to train on (1, 0, else None), features.

    ``following`` is the first visible character of the next line, for what a boundary at this line's end is like.
    """
    spans = _spans(line)
    inside = iter(spans)
    span = next(inside, None)
    ends: list[tuple[int, int, bool]] = []  # start of the marks, end, whether a quotation or bracket closes there
    for m in _MARK_RUN.finditer(line):
        while span and span[1] <= m.start():
            span = next(inside, None)
        if not (span and span[0] <= m.start()):
            ends.append((m.start(), m.end(), False))
    ends += [(e - 1, e, True) for s, e in spans if e - s > 2 and line[e - 2] in MARKS and line[e : e + 1] not in MARKS[:8]]
    for start, end, closing in sorted(ends):
        rest = line[end:].lstrip()
        nxt = rest.lstrip(INVISIBLE)[:1]
        last, kind = not rest, _kind(nxt or following)
        mark = _HIDDEN.sub("", line[start:end])
        m = _BEFORE.search(_HIDDEN.sub("", line[max(0, start - 40) : start]))
        token = unicodedata.normalize("NFKC", m[0]).lower().strip(".") if m else ""
        glued = not last and rest == line[end:]
        label: int | None = None
        pause = bool(_PAUSE.match(mark)) and len(mark) + (mark[0] in "…‥") > 1
        dot = mark in (".", "．")
        listed = dot and bool(_LIST_NUMBER.match(line[:start])) and not last
        if last or any(c in "。｡" for c in mark):
            label = 1
        elif nxt in "、,;；:：)）]］」』”’%％" + MARKS or listed:
            label = 0
        elif kind == "lower" and not (glued and not dot and not closing):
            label = 0
        elif closing and kind == "hira" and nxt in PARTICLES:
            label = 0
        elif pause and kind in ("hira", "kata", "han"):
            label = 0
        elif dot and glued and (kind == "digit" or kind in ("upper", "letter", "han", "hira", "kata") and re.fullmatch(r"(?:\w\.)*[^\W\d_]", token) and _kind(token[-1:]) not in ("han", "hira", "kata")):
            label = 0
        elif dot and (token in INSIDE or token in TITLES and kind == "upper" or token in BEFORE_NUMBERS and kind == "digit"):
            label = 0
        elif dot and glued and kind == "upper" and len(token) > 4 and token.isalpha() and token.islower():
            label = 1
        family = "title" if token in TITLES else "number" if token in BEFORE_NUMBERS else "inside" if token in INSIDE else "either" if token in EITHER else "letters" if re.fullmatch(r"(?:\w\.)+\w", token) else "word"
        shape = _kind(token[-1:]) + ("a" if "." in token else "1" if len(token) == 1 else "s" if len(token) <= 3 else "l")
        what = "pause" if pause else "close" if closing else "list" if listed else unicodedata.normalize("NFKC", mark)[:2]
        around = f"{what}|{'glued' if glued else 'apart'}|{kind}{'|initials' if dot and (len(token) == 1 or family == 'letters') else ''}"  # a line's end is as good as a space
        features = [
            f"mark={what}", f"next={kind}", f"before={shape}", f"around={around}", f"abbreviation={family if dot else 'none'}", f"both={family if dot else 'none'}|{kind}", f"shape={shape}|{kind}", f"shaped={shape}|{around}",
            f"first={nxt or following}" if kind in ("hira", "han", "other", "open") else "first=_", f"closed={nxt}|{what}" if closing or kind == "other" else "closed=_", f"word={zlib.crc32(token.encode('utf-8', 'surrogatepass')) % WORD_BUCKETS if dot else '_'}",
        ]
        yield end, label, features


def _lines(text: str) -> Iterator[tuple[int, str, str]]:
    at = 0
    pieces: list[tuple[int, str]] = []
    for m in _BREAK.finditer(text):
        pieces.append((at, text[at : m.start()]))
        at = m.end()
    pieces.append((at, text[at:]))
    pieces = [(a, p) for a, p in pieces if p.strip()]
    for i, (a, p) in enumerate(pieces):
        yield a, p, pieces[i + 1][1].lstrip()[:1] if i + 1 < len(pieces) else ""


def _sure(text: str) -> list[tuple[list[str], int]]:
    return [(f, label) for _, line, following in _lines(text) for _, label, f in _candidates(line, following) if label is not None]


def split_text(text: str, weights: dict[str, float] | None) -> list[tuple[int, int]]:
    """[start, end) of each sentence; ``weights`` has the classifier's weight per feature and its intercept under ''.

    The classifier decides every mark but the last of a line, which ends a sentence by definition. Without weights
    the reliable rules decide, and where there is none a mark ends a sentence.
    """
    found = []
    for at, line, following in _lines(text):
        begin = 0
        cuts = {}
        for end, label, features in _candidates(line, following):
            if not line[end:].strip():
                cuts[end] = True
            elif weights is None:
                cuts[end] = label != 0
            else:
                cuts[end] = weights.get("", 0.0) + sum(weights.get(f, 0.0) for f in features) > 0
        for s, e in _spans(line):  # a bracket between sentences is one of its own
            if line[s] in ROUND:
                before = line[:s].rstrip()
                after = line[e:].lstrip()
                own = not before or cuts.get(len(before), False)
                if own and after[:1] not in ("",) and after[0] not in MARKS + "、,;:" and _kind(after[0]) != "lower" and (_FINAL.match(line[e - 2]) or _kind(after[0]) != "hira"):
                    cuts[e] = True
        for end in [*sorted(k for k, v in cuts.items() if v), len(line)]:
            piece = line[begin:end]
            left = len(piece) - len(piece.lstrip())
            if piece.strip():
                found.append((at + begin + left, at + begin + len(piece.rstrip())))
            begin = end
    return found


def train_boundaries(texts: DataFrame) -> dict[str, float] | None:
    """Weights of the maximum-entropy classifier, from the reliable boundaries and non-boundaries of all texts (column text).

    Reliable are: line ends, ideographic full stops, and full stops between a long word and a capital; and, against, marks before lower case, inside numbers and
    acronyms, of list numbers, after titles and such abbreviations. They are counted by feature set before the
    fit, which runs on Spark, so that the model's input grows with the sets and not with the texts. Counts are
    scaled to a fixed number of marks, so the same mix of texts gives the same model however often it recurs. With
    fewer than two classes (as in an empty table) there are no weights.
    """

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter(("\t".join(features), label) for text in batch["text"] for features, label in _sure(text))
            yield pd.DataFrame([(k, float(label), n) for (k, label), n in counts.items()], columns=["features", "label", "n"])

    counted = texts.select("text").dropna().mapInPandas(sure, "features string, label double, n long").groupBy("features", "label").agg(F.sum("n").cast("double").alias("n"))
    counted = checkpointed(counted.select(F.split("features", "\t").alias("terms"), "label", "n"))
    about = counted.select("label", "n", F.posexplode("terms").alias("pos", "term")).agg(F.count_distinct("label").alias("labels"), F.count_distinct("term").alias("terms"), F.sum(F.when(F.col("pos") == 0, F.col("n"))).alias("marks")).first()
    if about["labels"] < 2:
        return None
    terms = CountVectorizer(inputCol="terms", outputCol="vector", vocabSize=about["terms"], binary=True).fit(counted)
    # counts are damped: a template that recurs a million times is no million kinds of evidence; unscaled, many texts would damp common sets to the weight of rare ones
    share = min(1.0, TRAINED_MARKS / about["marks"])
    model = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=0.002, maxIter=60, standardization=False).fit(terms.transform(counted.withColumn("weight", F.log1p(F.col("n") * share))))
    return {"": float(model.intercept)} | {t: float(w) for t, w in zip(terms.vocabulary, model.coefficients.toArray(), strict=True) if w}


def sentences(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence of ``text``: the keys, start_pos and end_pos in code points, without white space at the edges.

    Null, empty and blank texts have no sentences; a text repeated with its keys counts once, one repeated under
    other keys each time. A text of any length is split whole. Columns other than the keys are dropped.
    """
    weights = train_boundaries(texts)
    schema = ", ".join([*(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys), "start_pos int", "end_pos int"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, s, e) for *key, text in batch[[*keys, "text"]].itertuples(index=False) for s, e in split_text(text, weights)]
            yield pd.DataFrame(rows, columns=[*keys, "start_pos", "end_pos"])

    return texts.select(*keys, "text").dropna(subset=["text"]).distinct().mapInPandas(split, schema)
