"""Text functions: Unicode forms, tokens, references to rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters without a glyph: soft hyphen, joiners, direction marks, word joiner, byte order mark (fixed values).
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: White space of every kind, for Java's and RE2's regular expressions alike (fixed values).
SPACE_CLASS = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_WIDTH_RUN = re.compile("[！-￮\u3000]+")
_NOT_SHOWN = re.compile(f"[{INVISIBLE}]+")
_SPACE = re.compile(r"\s+")


def same_look(text: str | None) -> str | None:
    """``text`` without invisible characters and white space, its width forms folded, its marks composed."""
    if text is None:
        return None
    if text.isascii():
        return _SPACE.sub("", text)
    text = _NOT_SHOWN.sub("", text)
    text = _WIDTH_RUN.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return _SPACE.sub("", unicodedata.normalize("NFC", text))


@pandas_udf(StringType())
def same_look_udf(texts: pd.Series) -> pd.Series:
    return texts.map(same_look)


@pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    """Compatibility composition, then lower case; null stays null."""
    return texts.map(lambda s: None if s is None else s.lower() if s.isascii() else unicodedata.normalize("NFKC", s).lower())


#: Full-width digits, letters, full stop, solidus and hyphen with their plain forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def narrow(text: Column) -> Column:
    """Full-width ASCII as plain ASCII, on the JVM."""
    return F.translate(text, _WIDE, _PLAIN)


def iso_date(text: Column) -> Column:
    """The first year-month-day in ``text`` as YYYY-MM-DD, whatever its notation; null where there is none."""
    pattern = r"(\d{4})[^0-9]{0,2}(\d{1,2})[^0-9]{0,2}(\d{1,2})"
    plain = F.regexp_replace(narrow(text), f"[{INVISIBLE}]", "")
    part = lambda i: F.regexp_extract(plain, pattern, i)
    read = F.when(plain.rlike(pattern), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(read)  # most are written so and need no more


def rule_number(text: Column) -> Column:
    """A rule number without decoration, lower case; text that holds none as it is, stripped; null where nothing is left."""
    plain = F.lower(F.regexp_replace(narrow(text), f"[{INVISIBLE}]|{SPACE_CLASS}", ""))
    number = F.regexp_extract(plain, r"(\d{3}\.\d+[a-z]?)", 1)
    read = F.nullif(F.coalesce(F.nullif(number, F.lit("")), plain), F.lit(""))
    return F.when(text.rlike(r"^\d{3}\.\d+[a-z]?$"), text).otherwise(read)  # most are plain and need no more


def rule_mentions(text: Column) -> Column:
    """The rule numbers named in running text, in order of their first place, without repeats."""
    return F.array_distinct(F.regexp_extract_all(F.lower(narrow(text)), F.lit(r"(?<![\d.])(\d{3}\.\d+[a-z]?)(?![a-z\d])"), 1))


def references(text: Column) -> Column:
    """Struct of the rules and sections that a definition refers to, each in order of first appearance, without repeats.

    Rules are numbers of the form 702.9 or 702.9b, ranges of letters included (509.1b–c is b and c; a range that runs
    backwards is its first). The letters l and o, which no rule has, are left out, alone too. Sections are what
    follows ``rule`` or ``rules`` and is no rule's number. Null text refers to nothing.
    """
    plain = narrow(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(plain, F.lit(rf"\d{{3}}\.\d+(?:[a-z](?:{SPACE_CLASS}*[–—-]{SPACE_CLASS}*[a-z])?)?"), F.lit(0))

    def spread_out(one: Column) -> Column:
        base, first = F.regexp_extract(one, r"^(\d{3}\.\d+)", 1), F.regexp_extract(one, r"^\d{3}\.\d+([a-z])", 1)
        low, high = F.ascii(first), F.ascii(F.right(one, F.lit(1)))
        letters = F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda code: F.char(code)), lambda x: ~x.isin("l", "o"))
        return F.when(first == "", F.array(base)).otherwise(F.transform(letters, lambda x: F.concat(base, x)))

    sections = F.regexp_extract_all(plain, F.lit(r"rules? (\d{3})(?!\.\d|\d)"), F.lit(1))
    return F.struct(F.array_distinct(F.flatten(F.transform(found, spread_out))).alias("rules"), F.array_distinct(sections).alias("sections"))
