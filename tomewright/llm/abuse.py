"""Scores for abusive, hateful and sexual text: a factorization machine over hashed terms of sentences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import INVISIBLE
from .lookalikes import LATIN_LIKE

KINDS = ("abusive", "hateful", "sexual")
#: Labelled documents the model is fitted on at most, with a kind and without each: those with the lowest hash of the id.
MAX_LABELS = 2_500
#: Terms whose buckets a task keeps in mind.
REMEMBERED = 200_000
#: Sentences scored at once; their terms' vectors are what a task holds.
TOGETHER = 1_000
#: Scored sentences that a task keeps in mind.
SENTENCES = 100_000
#: Buckets terms are hashed to, and length of their interaction vectors.
BUCKETS, FACTORS = 1 << 20, 6
#: A term is known if so many labelled documents hold it, however many there are; the fit's regularization weighs rare ones.
MIN_DOCUMENTS = 2
#: A document is of a kind if one of its sentences scores this much.
THRESHOLD = 0.5
ROUNDS, EPOCHS = 3, 50

_DROP = re.compile(f"[{INVISIBLE}]+")
_FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13ff\u0251-\u0279]")
_FOLD = {ord(c): group[0].lower() if group[0].isupper() else group[0] for group in LATIN_LIKE.split() for c in group[1:]}
_KANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}
_KATAKANA = re.compile("[ァ-ヶ]+")
#: Digits and signs that stand for letters inside a word (fixed values).
_LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_WORD = re.compile(r"(?<![\w@$])(?!\d+[a-z]?(?![\w@$]))(?=[a-z0-9@$!]*[a-z])(?=[a-z0-9@$!]*[0134578@$!][a-z0-9@$]*[a-z]|[@$])[a-z0-9@$!]{2,}(?<!!)")
_SPACED = re.compile(r"(?<!\w)(?:[a-z][ .\-_*]){2,}[a-z](?!\w)")
_GAP = re.compile(r"[ .\-_*]")
_LAUGH = re.compile("w{2,}")
_REPEAT = re.compile(r"([a-zぁ-んー])\1{2,}")
_MASKED = re.compile(r"[*○●◯〇＊]+")
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[vV]s\.)(?<!\b[ie]\.[eg]\.)(?<!\b[nN]o\.)(?=[\s\u3040-鿿>])|(?<=[。！？])|\n{2,}")
_MENTION = re.compile(r"(?<!\w)@\w{3,}")
_WORD = re.compile(r"[a-z']+|[\u3040-ヿ㐀-鿿々]+|[가-힣]+|[^\W\d_a-z]+")
_CJK = re.compile(r"[\u3040-ヿ㐀-鿿々]")
_CARD = re.compile(r"《[^》]*》")
#: What stands between sentences that are spelled together.
_END = "\0"


def pieces(text: str | None) -> list[str]:
    """The text's sentences as stored, but for width, look-alikes, invisible characters and names."""
    if not text:
        return []
    text = text.replace(_END, " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _DROP.sub("", text))
        if _FOREIGN.search(text):
            text = text.translate(_FOLD)
    text = _CARD.sub("《》", _MENTION.sub("", text))
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def plain_sentences(sentences: list[str]) -> list[str]:
    """Sentences in one spelling: case and kana folded, laughs, letters repeated and spacing inside words gone."""
    text = _END.join(sentences).lower()
    if not text.isascii():
        text = _KATAKANA.sub(lambda m: m[0].translate(_KANA), text)
        if "ww" in text:
            text = _END.join(_LAUGH.sub("", s) if "ww" in s and _CJK.search(s) else s for s in text.split(_END))
    text = _SPACED.sub(lambda m: _GAP.sub("", m[0]), text)
    text = _LEET_WORD.sub(lambda m: m[0].translate(_LEET), text)
    return _REPEAT.sub(r"\1", _MASKED.sub("", text)).split(_END)


def terms(sentence: str) -> set[str]:
    """Words and word pairs of alphabetic scripts, character pairs and triples of Japanese."""
    found: set[str] = set()
    before = ""
    for w in _WORD.findall(sentence):
        if "\u3040" <= (c := w[0]) <= "ヿ" or "㐀" <= c <= "鿿" or c == "々":
            found.update([c for c in w if c > "ヿ"])
            found.update(map(add, w, w[1:]))
            found.update(map(add, map(add, w, w[1:]), w[2:]))
            before = ""
        else:
            found.add(w)
            if before:
                found.add(f"{before} {w}")
            before = w
    return found


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class _Known(dict):
    """Rows of terms met lately; a new one is looked up by its bucket, -1 if no labelled text has it."""

    def __init__(self, rows: dict[int, int]) -> None:
        super().__init__()
        self.rows = rows

    def __missing__(self, term: str) -> int:
        row = self[term] = self.rows.get(bucket(term), -1)
        return row


@dataclass
class Machine:
    """A factorization machine per kind: bias, linear weights and interaction vectors of the buckets in ``rows``."""

    rows: dict[int, int]
    bias: np.ndarray  # (kinds,)
    linear: np.ndarray  # (buckets, kinds)
    factors: np.ndarray  # (buckets, kinds, FACTORS)

    def encode(self, sentences: list[str], known: _Known) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the known terms of all sentences in a row, and where each sentence starts."""
        ids: list[int] = []
        starts = []
        for s in sentences:
            starts.append(len(ids))
            found = set(map(known.__getitem__, terms(s)))
            found.discard(-1)
            ids.extend(found)
        if len(known) > REMEMBERED:
            known.clear()
        return np.array(ids, dtype=np.int64), np.array([*starts, len(ids)], dtype=np.int64)

    def raw(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(starts)
        scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        lin = _sums(self.linear[ids], starts) * scale[:, None]
        v = self.factors[ids]
        s = _sums(v, starts)
        inter = 0.5 * ((s**2).sum(-1) - _sums((v**2).sum(-1), starts)) * (scale**2)[:, None]
        return self.bias + lin + inter, s, scale

    def scores(self, sentences: list[str], known: _Known | None = None) -> np.ndarray:
        """Probability per sentence and kind."""
        if not sentences:
            return np.zeros((0, len(KINDS)))
        known = _Known(self.rows) if known is None else known
        parts = [self.raw(*self.encode(sentences[i : i + TOGETHER], known))[0] for i in range(0, len(sentences), TOGETHER)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30)))


class Scorer:
    """Scores texts by a machine: each its highest sentence. Sentences scored lately are kept, as many recur from text to text."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known = machine, _Known(machine.rows)
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(KINDS)))

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of each kind per text; a text without sentences has 0."""
        out = np.zeros((len(texts), len(KINDS)))
        held: list[list[str]] = []
        first = 0
        for i, text in enumerate(texts):
            held.append(pieces(text))
            if i + 1 == len(texts) or sum(map(len, held)) >= TOGETHER:
                self._score(held, out[first : i + 1])
                held, first = [], i + 1
        return out

    def _score(self, held: list[list[str]], out: np.ndarray) -> None:
        if len(self.row) > SENTENCES:
            self.row, self.table = {}, self.table[:0]
        fresh = [s for s in dict.fromkeys(x for own in held for x in own) if s not in self.row]
        self.row.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
        self.table = np.concatenate([self.table, self.machine.scores(plain_sentences(fresh) if fresh else [], self.known)])
        owners = [i for i, own in enumerate(held) if own]
        if owners:
            places = np.array([self.row[s] for own in held for s in own])
            starts = np.cumsum([0, *(len(held[i]) for i in owners[:-1])])
            out[owners] = np.maximum.reduceat(self.table[places], starts, axis=0)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches between starts; an empty stretch has 0."""
    if not len(values):
        return np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    total = np.add.reduceat(values, np.minimum(starts[:-1], len(values) - 1), axis=0)
    total[starts[1:] == starts[:-1]] = 0
    return total


def _fit(machine: Machine, ids: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int) -> None:
    """Adam on the weighted logistic loss of all sentences at once; target and weight are (sentences, kinds)."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(ids, kind="stable")
    bounds = np.searchsorted(ids[order], np.arange(len(machine.linear) + 1))
    by_term = owner[order]
    params = [machine.bias, machine.linear, machine.factors]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = np.maximum(weight.sum(0), 1)
    for step in range(1, epochs + 1):
        z, s, scale = machine.raw(ids, starts)
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total * len(KINDS)).astype(np.float32)
        lin = g * scale[:, None]
        pair = lin * scale[:, None]
        # the gradient of a term's vector is that of its sentences' sums, less its own part
        gf = _sums((pair[:, :, None] * s)[by_term], bounds) - _sums(pair[by_term], bounds)[:, :, None] * machine.factors
        grads = [g.sum(0), _sums(lin[by_term], bounds) + 1e-5 * machine.linear, gf + 1e-4 * machine.factors]
        for i, (p, d) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            p -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)


def _start(vocabulary: list[int]) -> Machine:
    rng = np.random.default_rng(1)
    n = len(vocabulary)
    return Machine({b: i for i, b in enumerate(vocabulary)}, np.full(len(KINDS), -3, np.float32), np.zeros((n, len(KINDS)), np.float32), rng.normal(0, 0.02, (n, len(KINDS), FACTORS)).astype(np.float32))


def fit(labelled: list[tuple[str | None, frozenset[str]]]) -> Machine:
    """A machine fitted on texts with the kinds their reviewers gave ("none" for none).

    A label belongs to a text of many sentences, so the sentences that earned it are found along the way: first
    by how much more common their terms are under the label than elsewhere, then by the machine itself, in
    rounds. What else a text of some kind holds is left out where it scores for any kind, as further kinds go
    unlabelled; so is a labelled text no sentence of which stands out, and a sentence of a text labelled none
    that scores high, as a few labels are wrong. A sentence is of the kind most of its texts are labelled with.
    """
    docs = [(list(dict.fromkeys(plain_sentences(p))), kinds) for t, kinds in labelled if (p := pieces(t))]
    hashed = [[{bucket(t) for t in terms(x)} for x in s] for s, _ in docs]
    seen = Counter(b for d in hashed for b in set().union(*d))
    machine = _start(sorted(b for b, n in seen.items() if n >= MIN_DOCUMENTS))
    clean = [d for d, (_, k) in enumerate(docs) if not k & set(KINDS)]
    if not clean or len(clean) == len(docs):
        return machine

    unique: dict[tuple[int, ...], int] = {}
    units = [list(dict.fromkeys(unique.setdefault(tuple(sorted(machine.rows[b] for b in x if b in machine.rows)), len(unique)) for x in d)) for d in hashed]
    rows = [np.array(r, dtype=np.int64) for r in unique]
    ids = np.concatenate(rows)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    clean_units = Counter(u for d in clean for u in units[d])

    unlabelled = np.array([clean_units.get(u, 0) for u in range(len(rows))])
    n_terms = len(machine.rows)
    df, n_docs = np.zeros((n_terms, len(KINDS) + 1)), np.zeros(len(KINDS) + 1)
    for d, (_, kinds) in enumerate(docs):
        held = np.unique(np.concatenate([rows[u] for u in units[d]]))
        for i in [KINDS.index(k) for k in kinds if k in KINDS] or [len(KINDS)]:
            df[held, i] += 1
            n_docs[i] += 1
    share = (df + 0.5) / (n_docs + 1)
    others = [(share[:, -1] + share[:, [j for j in range(len(KINDS)) if j != i]].mean(1)) / 2 for i in range(len(KINDS))]
    odds = np.clip(np.log(share[:, :-1]) - np.log(np.stack(others, 1)), -3, 3)
    score = _sums(odds[ids], starts) / np.maximum(np.diff(starts), 4)[:, None]

    for turn in range(ROUNDS):
        votes = np.zeros((len(rows), len(KINDS)))
        for d, (_, kinds) in enumerate(docs):
            for i in [KINDS.index(k) for k in kinds if k in KINDS]:
                own = np.array(units[d])
                lead = score[own, i] - 0.5 * np.delete(score[own], i, 1).max(1)
                best = int(own[lead.argmax()])
                if score[best, i] >= (0.2 if turn else 0.5):
                    votes[best, i] += 1
        votes[votes.sum(1) <= unlabelled] = 0
        kind = np.where(votes.max(1) > 0, (votes + 0.1 * score * (score > 0)).argmax(1), -1)
        if turn:
            sure = (score.max(1) > 0.7) & (kind < 0) & (unlabelled == 0)
            kind[sure] = score[sure].argmax(1)
        target, weight = np.zeros(votes.shape, np.float32), np.zeros(votes.shape, np.float32)
        positive = kind >= 0
        target[positive, kind[positive]] = 1
        weight[positive] = 1
        for u, n in clean_units.items():
            if not positive[u] and not (turn and score[u].max() > 0.9 and n < 3):
                weight[u] = min(n, 3)
        for d, (_, kinds) in enumerate(docs):
            if turn and kinds & set(KINDS):
                own = np.array(units[d])
                calm = own[(score[own].max(1) < 0.2) & ~positive[own]]
                weight[calm] = np.maximum(weight[calm], 1)
        gain = (weight * (1 - target)).sum(0) / np.maximum((weight * target).sum(0), 1) * 0.05
        last = turn == ROUNDS - 1
        fresh = _start(list(machine.rows))
        machine.bias, machine.linear, machine.factors = fresh.bias, fresh.linear, fresh.factors
        _fit(machine, ids, starts, target, weight * np.where(positive[:, None], np.maximum(gain, 1) * np.where(target > 0, 1, 0.5), 1).astype(np.float32), EPOCHS if last else EPOCHS // 2)
        score = 1 / (1 + np.exp(-np.clip(machine.raw(ids, starts)[0], -30, 30)))
    return machine


def labelled_texts(documents: DataFrame, labels: DataFrame) -> list[tuple[str | None, frozenset[str]]]:
    """The texts of labelled documents with their kinds, at most MAX_LABELS with a kind and as many without; the same label twice counts once."""
    kinds = labels.select("doc_id", "kind").dropna().groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    some = F.arrays_overlap("kinds", F.array(*map(F.lit, KINDS)))
    parts = [kinds.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS) for which in (some, ~some)]
    bounded = parts[0].unionByName(parts[1])
    rows = documents.select("doc_id", "text").join(bounded, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "kinds")).alias("r")).orderBy("doc_id").select("r.*")
    return [(r["text"], frozenset(r["kinds"])) for r in rows.toLocalIterator()]


_SCORES = StructType([StructField(k, DoubleType()) for k in KINDS])


def scored(documents: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """The documents with a score column per kind: the highest of their sentences.

    Null, empty and blank texts score 0; without labels of any kind, or of none, every text scores low. Repeated
    rows are scored each. The machine is fitted on a bounded sample of labelled rows and then read by all tasks;
    every document is scored over its whole text.
    """
    machine = machine or fit(labelled_texts(documents, labels))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(machine)
        for texts in batches:
            yield pd.DataFrame(np.round(scorer.best(texts.tolist()), 6), columns=list(KINDS))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return documents.withColumn("scores", pandas_udf(score, _SCORES)("text")).select("*", "scores.*").drop("scores")


def found_kinds(scores: DataFrame) -> DataFrame:
    """doc_id and kind of the documents found, without repeats."""
    kinds = F.array(*(F.when(F.col(k) >= THRESHOLD, F.lit(k)) for k in KINDS))
    return scores.select("doc_id", F.explode(F.array_compact(kinds)).alias("kind")).where("doc_id is not null").distinct()


def rates(scores: DataFrame) -> DataFrame:
    """Documents and documents found of each kind per source, and their share; a null source is a source."""
    counts = scores.groupBy("source").agg(F.count("*").alias("n_documents"), *(F.count_if(F.col(k) >= THRESHOLD).alias(k) for k in KINDS))
    return counts.unpivot(["source", "n_documents"], list(KINDS), "kind", "n_found").withColumn("rate", F.round(F.col("n_found") / F.col("n_documents"), 6))
