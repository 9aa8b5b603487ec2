"""Defective question and answer pairs: empty, truncated, refused, copied, or in another language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..storage import checkpointed
from .lookalikes import consistent, look
from .minhash import clusters
from .sentences import split_text

#: Characters of an answer's opening that are clustered.
OPENING = 24
#: A cluster of openings is a refusal template if it recurs over so many prompts, no stretch of which is in so many of them, and so many of its answers say nothing of their prompt.
MIN_PROMPTS, SAME_PROMPTS, MIN_UNRELATED = 3, 0.8, 0.8
#: Letters below which a recurring answer may be a verdict as well ("It does."), and letters a continuation needs to be clustered.
MIN_LETTERS = 8
#: A piece without its final mark is broken off where its last words are followed by more in the other texts, and end a sentence in less than this share.
MIN_FINAL_SHARE = 0.1

# What stands for no answer.
PLACEHOLDERS = set(
    """tbd tba todo n/a na none null nil nan undefined empty blank pending placeholder xxx tobedetermined tobeadded tobeannounced noanswer notavailable notapplicable
    未記入 未定 未回答 未入力 未作成 空欄 該当なし 回答なし 記入予定 準備中 後日記入 後日追記 要記入 要確認 作成中 調査中 ここに回答を記入 回答を入力してください""".split()
)
# Yes and no, which answer any prompt without taking up its words.
VERDICT = re.compile(r"^\W*(?:はい|ええ|いいえ|いや|yes|no|sí|si|oui|non|ja|nein|sì|sim|não|да|нет|네|예|아니요|아니오|是的?|不是|可以|不可以|能|不能|对|不)\s*(?:[^\w\s'’]|$)", re.I)
# What may stand around a copied question.
FRAMING = re.compile(
    r"^(?:ご?質問|問い?|お尋ね|question|q|the question is|you asked|お答えします|回答|answer|a)+|(?:とのご?質問です(?:ね)?|というご?質問です(?:ね)?|とのことです(?:ね)?|というお尋ねです(?:ね)?|についてですね|ですね|という質問|とのこと)+$", re.I
)
# Words that tell languages in Latin letters apart.
WORDS = {
    "en": "the a an is are was were be been it its this that of to in on at by with for from and or not no yes does do can cannot may must will would if when while because since than only both any other each still also works ends player",
    "es": "el la los las un una es son no sí de del al en con por para y o que se su durante esta este puede puntos fase rival porque cuando",
    "fr": "le la les un une est sont ne pas oui non de du des au aux en dans avec pour et ou que qui se sa son cette jusqu'à l'adversaire reste points fin zone",
    "de": "der die das ein eine ist sind nicht ja nein von vom zum zur im in mit für und oder dass bleibt bis ende gegner zahlt punkte wird kann weil wenn",
    "it": "il lo la gli le un una è sono non sì di del al in con per e o che si sua durante questa questo può punti fase",
    "pt": "o a os as um uma é são não sim de do da ao em com por para e ou que se sua durante esta este pode pontos fase",
}
_VOTES: dict[str, set[str]] = {}
for _lang, _words in WORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, set()).add(_lang)
FUNCTION_WORDS = set("the a an of to in on at by with for from and or not if when while because since than only any other each as that which who whose until unless its their his her your into onto over under after before during but so is are was were be can may must will would does do it".split())

_NAMES = re.compile(r"《[^》]*》|『[^』]*』|「[^」]*」|\([^()]*\)")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ']*")
_MASK = [(re.compile(r"《[^》]*》"), "《》"), (re.compile(r"\d+"), "0"), (re.compile(r"\b[A-Z][a-z]{4,}\b"), "Name")]
_PARTICULAR = re.compile("|".join(pattern.pattern for pattern, _ in _MASK))
_ENDED = re.compile(r"[.!?。！？][\"'”’)\]）」』》]*$")
_CLAUSE = re.compile(r"[、。，．,.!！?？:：]+\s*")
_OPEN = re.compile(r"[《「『（(\[【“][^》」』）)\]】”]*$")
#: How a Japanese sentence can end: the polite and plain forms of verbs, adjectives and the copula, and final particles.
_JA_FINAL = re.compile(r"(?:です|ます|ません|でした|ました|だ|である|ない|た|[うくぐすつぬぶむる]|[かよねわぞ]|い|ん|こと|ください)$")


def bare(text: str) -> str:
    """Letters and digits only, by their looks, lower case."""
    return re.sub(r"[\W_]+", "", look(text) or "").lower()


def is_empty(text: str | None) -> bool:
    """Missing, blank, only punctuation or symbols, or a placeholder."""
    letters = re.sub(r"[\W_]+", "", consistent(text) or "").lower()
    return not letters or letters in PLACEHOLDERS or re.sub(r"\s+", "", consistent(text) or "").lower() in PLACEHOLDERS


def language(text: str) -> str | None:
    """The language of a text by script and common words; None where names alone are left or nothing tells."""
    form = consistent(text) or ""
    plain = _NAMES.sub(" ", form)
    if not re.search(r"\w", plain):
        plain = form
    hira, hangul = len(re.findall("[ぁ-ゖ]", plain)), len(re.findall("[가-힣]", plain))
    han, kata = len(re.findall("[一-鿿]", plain)), len(re.findall("[ァ-ヺ]", plain))
    words = _LATIN.findall(plain)
    if hangul:
        return "ko"
    if hira >= 2 or hira and hira + han + kata >= sum(map(len, words)):
        return "ja"
    if han >= 5:
        return "zh" if not kata else "ja"
    if len(re.findall("[А-яЁё]", plain)) > 3:
        return "ru"
    votes: dict[str, float] = {}
    for w in words:
        langs = _VOTES.get(w.lower(), ())
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1 / len(langs)
    if votes and not han + kata > sum(map(len, words)):
        return max(sorted(votes, key=lambda x: x != "en"), key=votes.__getitem__)
    return "ja" if han + kata + hira and not words else None


def copies(question: str, asked: str, said: str) -> bool:
    """The conclusion is the question or its last sentence, once or more, apart from framing; asked and said are the bare question and conclusion."""
    if len(asked) < 3 or asked[-3:] not in said:  # both end alike
        return False
    ends = split_text(question, None)
    for whole in (asked, bare(question[ends[-1][0] :]) if ends else asked):
        if len(whole) >= 3 and whole in said and not FRAMING.sub("", FRAMING.sub("", said.replace(whole, ""))):
            return True
    return False


def related(form: str, asked: str, said: str) -> bool:
    """The conclusion takes up something of the question: a name, or a stretch of four letters (eight in Latin ones) that is more than grammar.

    ``form`` is the question's consistent form; asked and said are the bare question and conclusion.
    """
    if any(bare(n) in said for n in re.findall(r"《([^》]+)》|\b([A-Z][a-z]{5,})\b", form) for n in n if n):
        return True
    width = 8 if said.isascii() else 4
    return any((p := said[i : i + width]) in asked and not re.fullmatch("[ぁ-ゖ]+", p) for i in range(len(said) - width + 1))


def stretches(asked: str) -> set[str]:
    """The stretches of a bare question that tell what it asks, as in ``related``."""
    width = 8 if asked.isascii() else 4
    return {p for i in range(max(1, len(asked) - width + 1)) if (p := asked[i : i + width]) and not re.fullmatch("[ぁ-ゖ]+", p)}


def masked(text: str) -> str:
    form = consistent(text) or ""
    for pattern, to in _MASK:
        form = pattern.sub(to, form)
    return form


def ending(form: str) -> str:
    """What a masked text ends with, as counted over all texts: two words in Latin letters, else four characters."""
    words = re.findall(r"[A-Za-z']+|\d+", form)
    return " ".join(words[-2:]).lower() if form[-1:].isascii() and words else form[-4:]


def openings(conclusion: str) -> list[str]:
    """The masked opening of an answer, and that of what follows its first clause, as an apology or greeting may come first."""
    form = masked(conclusion)
    rest = form[m.end() :] if (m := _CLAUSE.search(form)) else ""
    return [form[:OPENING], *([rest[:OPENING]] if len(re.sub(r"[\W_]+", "", rest)) >= MIN_LETTERS else [])]


def broken_off(form: str) -> str:
    """yes, no, or unsure: whether a piece breaks off inside a sentence, by its own looks."""
    if re.search(r"(?:\.{2,}|…|‥)[\"'”’)\]）」』》]*$", form):
        return "yes"
    if _ENDED.search(form) or re.search("(?:です|ます|ません|でした|ました)か[」』\"”’]*$", form):
        return "no"
    return "yes" if _OPEN.search(form) or re.search(r"[、,;:・\-–—/]$", form) else "unsure"


def grammatical_end(form: str) -> bool:
    if form[-1:].isascii():
        words = form.lower().split()
        return bool(words) and words[-1] not in FUNCTION_WORDS
    return bool(_JA_FINAL.search(form))


@lru_cache(1 << 14)
def stated_fact(text: str) -> tuple[str | None, str | None]:
    """The masked form and the language of a key fact; no form if it is empty. Facts recur, so lately seen ones are kept."""
    return (None, None) if is_empty(text) else (masked(text).rstrip(), language(text))


_SIGNS = StructType(
    [StructField(n, BooleanType()) for n in ("empty", "copied", "verdict", "unrelated", "foreign")] + [StructField(n, StringType()) for n in ("asked", "particulars")] + [StructField(n, ArrayType(StringType())) for n in ("openings", "forms")]
)


@pandas_udf(_SIGNS)
def signs_udf(question: pd.Series, conclusion: pd.Series, facts: pd.Series) -> pd.DataFrame:
    rows = []
    for q, c, k in zip(question, conclusion, facts, strict=True):
        stated = [f for x in (k if k is not None else []) if x and (f := stated_fact(x))[0]]
        no_answer = is_empty(c)
        form, said = ("", "") if no_answer else (consistent(c) or "", bare(c))
        asked = bare(q) if q else ""
        lang = language(q) if q else None
        foreign = bool(lang) and (not no_answer and (x := language(c)) is not None and x != lang or bool(stated) and all(x is not None and x != lang for _, x in stated))
        unrelated = not no_answer and not (q and related(consistent(q) or "", asked, said))
        verdict = bool(VERDICT.search(form)) or len(said) < MIN_LETTERS
        forms = [x for x, _ in stated] + ([] if no_answer else [masked(c).rstrip()])
        rows.append((no_answer or not stated, bool(q) and not no_answer and copies(q, asked, said), verdict, unrelated, foreign, asked or None, " ".join(_PARTICULAR.findall(form)), [] if no_answer else openings(c), forms))
    return pd.DataFrame(rows, columns=_SIGNS.names)


@pandas_udf(ArrayType(StringType()))
def stretches_udf(asked: pd.Series) -> pd.Series:
    return asked.map(lambda q: sorted(stretches(q)))


_PIECE = StructType([StructField(n, StringType()) for n in ("state", "tail", "word")] + [StructField("grammatical", BooleanType())])


@pandas_udf(_PIECE)
def piece_udf(forms: pd.Series) -> pd.DataFrame:
    rows = []
    for form in forms:
        end = form.rstrip("」』\"”’)") or form
        word = re.search(r"[a-zà-öø-ÿ']+$", form.lower())
        rows.append((broken_off(form), ending(end), word[0] if word and word[0] != "name" else None, grammatical_end(end)))
    return pd.DataFrame(rows, columns=_PIECE.names)


def _continued(form: str) -> set[tuple[str, str]]:
    """Endings inside a form: final where a final mark follows, inner where the text goes on; and its whole words, those that something follows."""
    out = set()
    for m in re.finditer(r"(?:[A-Za-z']+|\d+)", form):
        rest = form[m.end() :]
        if rest:
            out.add(("final" if rest[0] in ".!?。！？" and not rest.startswith("..") else "inner", ending(form[: m.end()])))
    for i in range(4, len(form)):
        if not form[i - 1].isascii() and not form[i].isspace():
            out.add(("final" if form[i] in ".!?。！？" and not form.startswith("...", i) else "inner", form[i - 4 : i]))
    out.update(("word", m[0].lower()) for m in _LATIN.finditer(form) if m.end() < len(form))
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each batch of forms holds, counted before it leaves the task."""
    for batch in batches:
        seen = Counter(x for form in batch["form"] for x in _continued(form))
        yield pd.DataFrame([(kind, what, n) for (kind, what), n in seen.items()], columns=["kind", "what", "n"])


def truncated_ids(pieces: DataFrame) -> DataFrame:
    """ids with a piece (id, form: its text with names and numbers masked) that breaks off inside a sentence.

    A piece with neither a final mark nor an obvious break is judged by all the forms: where its ending is
    followed by more in others and hardly ever closes a sentence, or its last word is whole in no other, or, unless
    such endings close sentences, it can't end one by grammar, it is broken off. Each distinct form is judged, and
    counts, once.
    """
    forms = checkpointed(pieces.select("form").distinct())
    judged = checkpointed(forms.select("form", piece_udf("form").alias("p")).select("form", "p.*").where("state != 'no'"))
    counts = forms.mapInPandas(_counted, "kind string, what string, n long").groupBy("what").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("final", "inner", "word")))
    counts = checkpointed(counts)
    shares, words = counts.select(F.col("what").alias("tail"), "final", "inner"), counts.select(F.col("what").alias("word"), F.col("word").alias("texts"))
    known = judged.where("state = 'unsure'").join(shares, "tail", "left").join(words, "word", "left").na.fill(0, ["final", "inner", "texts"])
    share = F.col("final") / F.greatest(F.col("final") + F.col("inner"), F.lit(1))
    cut = F.when(F.col("final") > 0, share < MIN_FINAL_SHARE).otherwise((F.col("inner") > 0) | ~F.col("grammatical") | F.col("word").isNotNull() & (F.col("texts") == 0))
    broken = judged.where("state = 'yes'").select("form").unionByName(known.where(cut).select("form"))
    return pieces.join(broken, "form", "left_semi").select("id").distinct()


def templates(answers: DataFrame) -> DataFrame:
    """The openings that belong to refusal templates, from answers (opening, asked, verdict, unrelated, particulars).

    Distinct openings of answers that take up nothing of their prompt are clustered by verified MinHash, and a
    cluster is judged as a whole, with all answers that have its openings, and by no list of phrases: it recurs over
    three prompts or more that have no stretch in common, most of its answers take up nothing of them, it says the same to all (no names or figures that change from answer to answer), and it is no
    verdict (yes, no, or too few letters to tell). Prompts are distinct questions by their looks. Answers are
    counted by opening before they meet the clusters, so an opening that a third of all answers share is a few rows.
    """
    n = F.count("*").alias("n")
    by_opening = answers.groupBy("opening", "asked", "particulars").agg(n, *(F.count_if(c).alias(c) for c in ("verdict", "unrelated")))
    apart = answers.where("unrelated and not verdict").select(F.col("opening").alias("text"))
    grouped = checkpointed(by_opening.join(clusters(apart), F.col("opening") == F.col("text")))
    judged = grouped.groupBy("cluster").agg(F.count_distinct("asked").alias("prompts"), F.count_distinct("particulars").alias("particulars"), *(F.sum(c).alias(c) for c in ("n", "verdict", "unrelated")))
    same = checkpointed(judged.where((F.col("prompts") >= MIN_PROMPTS) & (F.col("unrelated") >= MIN_UNRELATED * F.col("n")) & (F.col("verdict") * 2 < F.col("n")) & (F.col("particulars") * 2 <= F.col("prompts"))).select("cluster", "prompts"))
    asked = grouped.where("asked is not null").join(same, "cluster").select("cluster", "prompts", "asked").distinct()
    common = asked.select("cluster", "prompts", F.explode(stretches_udf("asked")).alias("stretch")).groupBy("cluster", "stretch").agg(F.count("*").alias("held"), F.first("prompts").alias("prompts"))
    alike = common.where(F.col("held") >= SAME_PROMPTS * F.col("prompts")).select("cluster")
    return grouped.join(same.join(alike, "cluster", "left_anti"), "cluster", "left_semi").select("opening").distinct()


def defective_pairs(questions: DataFrame) -> DataFrame:
    """id and defect of every question and answer pair that is broken; a pair may have several.

    ``questions`` has id, question, expected_answer (conclusion, key_facts). A record loaded again counts once.
    A null answer, conclusion or list of facts, or one of blanks and placeholders alone, is an empty answer; what
    is empty itself has no other defect. A null question is compared with nothing. Rows without an id are left out.

    Refusals come from ``templates`` alone: the openings of all conclusions, and of what follows their first
    clause, are clustered, and a template is judged as a whole: then all answers with its openings are refusals.
    Copies, languages and endings are checked pair by pair.
    """
    pairs = questions.where("id is not null").select("id", "question", F.col("expected_answer.conclusion").alias("conclusion"), F.col("expected_answer.key_facts").alias("facts")).distinct()
    signed = checkpointed(pairs.select("id", signs_udf("question", "conclusion", "facts").alias("s")).select("id", "s.*"))
    answers = signed.select("id", "asked", "verdict", "unrelated", "particulars", F.explode("openings").alias("opening"))
    refused = answers.join(templates(answers), "opening", "left_semi")
    parts = [("empty_answer", signed.where("empty")), ("copies_question", signed.where("copied")), ("wrong_language", signed.where("foreign")), ("refusal", refused), ("truncated_answer", truncated_ids(signed.select("id", F.explode("forms").alias("form"))))]
    return reduce(DataFrame.unionByName, [rows.select("id", F.lit(defect).alias("defect")) for defect, rows in parts]).distinct()
