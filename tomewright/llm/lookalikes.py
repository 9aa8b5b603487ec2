"""One consistent form for text that looks the same but is stored as different characters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import INVISIBLE
from ..storage import checkpointed

# Characters of different scripts that look alike, one group a word, the first being the prototype.
LATIN_LIKE = """
AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ FϜ GԌᏀ HНΗᎻ IІΙӀᏆ JЈᎫ KКΚᏦ LᏞ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ RᏒ SЅՏᏚ TТΤᎢ UՍ VѴᏙ WԜᎳ XХΧ YҮΥᎩ ZΖᏃ
aаαɑ bЬᏏ cсϲᴄ dԁᏧ eе gɡց hһհᏂ iіιɩ jјϳ kκк lӏ nոռ oоοօσᴏ pрρ qԛզ rгᴦ sѕꜱ uυսᴜ vνѵᴠ wԝᴡ xхχ yуγү zᴢ
"""
KANA_LIKE = "ロ口囗 ト卜 ー一 ハ八 カ力 タ夕 ニ二 エ工 チ千 オ才 へヘ べベ ぺペ リり ミ三 ム厶 ヌ又 メ乄 ノ丿"

#: Kana that a kanji or the other kana resembles too loosely to be the same look; named so that the choice can be seen. Between katakana り and 乄, which are no words there, are taken for リ and メ.
LOOSE = set("チ千 オ才 リり ミ三 ヌ又 メ乄".replace(" ", ""))
_AMONG_KANA = {"り": "リ", "乄": "メ"}

#: Members of a class that one task pairs with the whole class.
SHARE = 10_000

_PROTOTYPE: dict[str, str] = {}
for _group in (LATIN_LIKE + KANA_LIKE).split():
    for _ch in _group:
        if _ch not in LOOSE:
            _PROTOTYPE[_ch] = _group[0]
_OF_PROTOTYPE: dict[str, list[str]] = {}
for _ch, _p in _PROTOTYPE.items():
    _OF_PROTOTYPE.setdefault(_p, []).append(_ch)

_HIDDEN = re.compile(f"[{INVISIBLE}\ufe00-\ufe0f]+")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[\w\u3099\u309a\u0300-\u036f]+")
_KANA_RUN = re.compile("[ァ-ヺーヽヾ" + "".join(c for p, g in _OF_PROTOTYPE.items() if p not in "へべぺ" and not p.isascii() for c in g) + "]+")
_LONE = re.compile("(?<=[ァ-ヺー])[り乄](?=[ァ-ヺー])")
_TO_PROTOTYPE = str.maketrans(_PROTOTYPE)

JAPANESE = frozenset({"Hani", "Hira", "Kana"})


@lru_cache(1 << 15)
def scripts_of(ch: str) -> frozenset[str] | None:
    """The scripts that ``ch`` can be read in, resolved: Han, hiragana and katakana each stand for Japanese too; None where any."""
    o = ord(ch)
    if 0x3041 <= o <= 0x3096 or 0x309D <= o <= 0x309F:
        return frozenset({"Hira", "Jpan"})
    if 0x30A1 <= o <= 0x30FA or 0x30FD <= o <= 0x30FF:
        return frozenset({"Kana", "Jpan"})
    if ch == "ー":
        return frozenset({"Hira", "Kana", "Jpan"})
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF or ch in "々〆":
        return frozenset({"Hani", "Jpan", "Kore"})
    if 0xAC00 <= o <= 0xD7A3:
        return frozenset({"Kore"})
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").partition(" ")[0]
    return frozenset({name.title()}) if name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "HEBREW", "ARABIC", "THAI", "HANGUL") else None


def _readings(ch: str) -> list[tuple[str, frozenset[str]]]:
    return [(c, s) for c in _OF_PROTOTYPE.get(_PROTOTYPE.get(ch, ch), [ch]) if (s := scripts_of(c))] or ([(ch, s)] if (s := scripts_of(ch)) else [])


def spell_token(token: str) -> str:
    """The token in the one script that all its letters share or can be written in.

    The resolved script sets of the letters are intersected. Empty means a mixed-script token: each letter may
    then stand for its look-alikes, and the script that all of them reach is chosen (most letters as stored, then
    Latin first). One that is whole in another script, but can be written in Latin letters throughout, is a
    whole-script confusable and becomes Latin. Inside Japanese, a kanji that looks like a kana is that kana where
    both or the only neighbours that are no look-alikes are katakana (口 in コント口ール), and the other way round.
    """
    sets = [s for ch in token if (s := scripts_of(ch))]
    if not sets:
        return token
    shared = frozenset.intersection(*sets)
    if "Jpan" not in shared and (not shared or shared != {"Latin"}):
        options = [_readings(ch) for ch in token]
        reach = [frozenset().union(*(s for _, s in o)) for o in options if o]
        common = frozenset.intersection(*reach) if reach else frozenset()
        if common and (not shared or "Latin" in common):
            kept = {script: sum(script in (scripts_of(ch) or ()) for ch in token) for script in common}
            best = "Latin" if "Latin" in common and (shared or kept["Latin"] * 2 >= max(kept.values())) else max(sorted(common), key=lambda s: kept[s])
            return "".join(next((c for c, s in o if best in s), ch) if o and best not in (scripts_of(ch) or {best}) else ch for ch, o in zip(token, options, strict=True))
        if not shared:  # runs of letters inside Japanese text: each run by itself
            runs = re.findall(r"[\u3040-ヿ㐀-鿿豈-\ufaff々〆]+|[^\u3040-ヿ㐀-鿿豈-\ufaff々〆]+", token)
            if len(runs) > 1:
                return "".join(map(spell_token, runs))
    if "Jpan" in (shared or ()) and any(ch in _PROTOTYPE or ch in _AMONG_KANA for ch in token):
        return _spell_japanese(token)
    return token


def _spell_japanese(token: str) -> str:
    """Runs of katakana and kanji that look like katakana, each in one script.

    A run with a katakana and more than one letter is katakana, but for a kanji at its end that touches another
    kanji; a lone look-alike beside a kanji is a kanji. へ, べ and ぺ follow the letters around them.
    """

    def respell(m: re.Match[str]) -> str:
        run, before, after = m[0], token[m.start() - 1 : m.start()], token[m.end() : m.end() + 1]
        beside = [bool(x) and "Hani" in (scripts_of(x) or ()) for x in (before, after)]
        kana = any("Kana" in (scripts_of(ch) or ()) for ch in run)
        if len(run) == 1 and run != "ー":
            return _as_script(run, "Hani") if any(beside) and _PROTOTYPE.get(run) == run else run
        if not kana:
            return run
        keep = {0 if beside[0] else None, len(run) - 1 if beside[1] else None}
        return "".join(ch if i in keep and "Hani" in (scripts_of(ch) or ()) else _as_script(ch, "Kana") for i, ch in enumerate(run))

    token = _LONE.sub(lambda m: _AMONG_KANA[m[0]], token)
    token = _KANA_RUN.sub(respell, token)
    spelled = []
    for i, ch in enumerate(token):
        if ch in "へべぺヘベペ":
            sides = [scripts_of(x) or frozenset() for x in (token[i - 1 : i] if i else "", token[i + 1 : i + 2]) if x]
            kata = sum("Kana" in s and "Hira" not in s for s in sides)
            ch = _as_script(ch, "Kana" if kata * 2 > len(sides) or kata and "Kana" in sides[0] else "Hira")
        spelled.append(ch)
    return "".join(spelled)


def _as_script(ch: str, script: str) -> str:
    return next((c for c in _OF_PROTOTYPE.get(_PROTOTYPE.get(ch, ch), [ch]) if script in (scripts_of(c) or ())), ch)


@lru_cache(1 << 15)
def _known_token(token: str) -> str:
    return spell_token(token)


@lru_cache(32)
def consistent(text: str | None) -> str | None:
    """``text`` in its one consistent form; null stays null.

    Invisible characters go, white space of any kind and amount is one space, width forms and compatibility
    ideographs are plain, marks are composed, and each token is spelled in one script. Case, words and digits stay.
    """
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", _HIDDEN.sub("", text)))
        text = _TOKEN.sub(lambda m: m[0] if m[0].isascii() else _known_token(m[0]) if len(m[0]) <= 64 else spell_token(m[0]), text)
    return _SPACE.sub(" ", text).strip()


def look(text: str | None) -> str | None:
    """A key that two texts share exactly if they read the same to the eye: the consistent form by prototypes, without spaces' amount."""
    form = consistent(text)
    return None if form is None else form.translate(_TO_PROTOTYPE)


def either_runs(form: str) -> list[str]:
    """The runs of katakana and its look-alikes in a consistent form that hold a letter of which there is a look-alike."""
    return [] if form.isascii() else [r for r in dict.fromkeys(_KANA_RUN.findall(form)) if len(r) > 1 and any(ch in _PROTOTYPE for ch in r)]


_FORM = StructType([StructField("form", StringType()), StructField("runs", ArrayType(StringType()))])


@pandas_udf(_FORM)
def form_udf(texts: pd.Series) -> pd.DataFrame:
    forms = [consistent(t) for t in texts]
    return pd.DataFrame({"form": forms, "runs": [either_runs(f or "") for f in forms]})


@pandas_udf(StringType())
def as_kana_udf(forms: pd.Series, runs: pd.Series) -> pd.Series:
    """The forms with the runs given spelled in katakana."""
    return pd.Series([_KANA_RUN.sub(lambda m: m[0].translate(_TO_PROTOTYPE) if m[0] in known else m[0], f) for f, r in zip(forms, runs, strict=True) for known in (set(r),)], dtype=object)


@pandas_udf(ArrayType(StringType()))
def prototypes_udf(runs: pd.Series) -> pd.Series:
    return runs.map(lambda listed: [r.translate(_TO_PROTOTYPE) for r in listed])


def spelled(texts: DataFrame) -> DataFrame:
    """stored and its consistent form for the distinct texts (stored); null stays null.

    Tokens are spelled by themselves first (``consistent``). A run that is made of look-alikes alone (八一卜), or
    whose last look-alike touches a kanji (サイコ口等), has nothing in its token that tells its script; it is katakana if
    the same run stands in katakana anywhere in the texts (ハート, サイコロ), else it stays as it is. Runs meet by their
    prototype spelling, each distinct one once.
    """
    forms = checkpointed(texts.select("stored").distinct().select("stored", form_udf("stored").alias("f")).select("stored", "f.form", "f.runs"))
    runs = forms.where("size(runs) > 0").select("stored", F.explode(F.arrays_zip("runs", prototypes_udf("runs").alias("kana"))).alias("r")).select("stored", "r.*")
    unsure = runs.where("runs != kana")
    in_kana = runs.where("runs = kana").select("kana").distinct()
    sure = unsure.select("kana").distinct().join(in_kana, "kana", "left_semi")
    found = unsure.join(sure, "kana", "left_semi").groupBy(F.col("stored").alias("_of")).agg(F.collect_set("runs").alias("found"))
    return forms.join(found, forms.stored == F.col("_of"), "left").select("stored", "form", F.coalesce("found", F.array().cast("array<string>")).alias("found")).select("stored", F.when(F.size("found") > 0, as_kana_udf(F.coalesce("form", F.lit("")), "found")).otherwise(F.col("form")).alias("form"))


def normalized(records: DataFrame) -> DataFrame:
    """source_table, key, stored text, consistent form and whether it differs, one row per distinct record (source_table, key, stored); null text stays null."""
    rows = records.select("source_table", "key", "stored").distinct()
    forms = spelled(rows.dropna(subset=["stored"])).withColumnRenamed("stored", "_stored")
    return rows.join(forms, F.col("stored") == F.col("_stored"), "left").select("source_table", "key", "stored", F.col("form").alias("consistent"), (~F.col("stored").eqNullSafe(F.col("form"))).alias("altered"))


def _digest(text: Column) -> Column:
    """Stands for a text in joins and counts, so that texts are moved once and not with each of them."""
    return F.unhex(F.sha2(text, 256))


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct records (with text, as digest), the form of each text, and the records of classes: source_table, key, text, form (digests), spellings, members, links."""
    rows = checkpointed(records.select("source_table", "key", "stored").dropna().withColumn("text", _digest(F.col("stored"))).distinct())
    forms = spelled(rows).where("form != ''").select(_digest(F.col("stored")).alias("text"), "form", _digest(F.col("form")).alias("class"))
    forms = checkpointed(forms)
    counted = rows.groupBy("source_table", "text").agg(F.count("*").alias("same"))
    formed = checkpointed(counted.join(forms.select("text", "class"), "text"))
    classes = formed.groupBy("source_table", "class").agg(F.count("*").alias("spellings"), F.sum("same").alias("members")).where("spellings > 1")
    several = formed.join(classes, ["source_table", "class"])
    members = rows.select("source_table", "key", "text").join(several, ["source_table", "text"]).withColumn("links", F.col("members") - F.col("same")).drop("same")
    return rows, forms, checkpointed(members)


def lookalike_classes(records: DataFrame) -> DataFrame:
    """One row per distinct record (source_table, key, stored) whose text has another spelling of the same look in its table.

    Output: source_table, key, stored, form (the class: the consistent form), spellings in the class, members, and
    links: the members that store another string. Texts are spelled once each, and counted by spelling before they
    meet, so a string that many records store costs a row. Null texts and keys, and texts that look empty, have no class.
    """
    rows, forms, members = _classes(records)
    stored = rows.join(members, ["source_table", "key", "text"])
    return stored.join(forms.select("class", "form").distinct(), "class").select("source_table", "key", "stored", "form", "spellings", "members", "links")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records of a table (source_table, key_a < key_b) whose texts look the same but are different strings.

    They are expanded from the classes of ``lookalike_classes``, each in shares of a bounded number of members, so
    that a class of any size is spread over as many tasks as it has shares. A record is never paired with itself,
    even if it is stored with two spellings.
    """
    members = _classes(records)[2].withColumn("shares", F.ceil(F.col("members") / SHARE).cast("int"))
    left = members.select("source_table", "class", F.pmod(F.xxhash64("key", "text"), F.col("shares")).cast("int").alias("share"), F.col("key").alias("k"), F.col("text").alias("one"))
    right = members.select("source_table", "class", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("key").alias("l"), F.col("text").alias("other"))
    met = left.join(right, ["source_table", "class", "share"]).where("one != other and k < l")
    return met.select("source_table", F.col("k").alias("key_a"), F.col("l").alias("key_b")).distinct()
