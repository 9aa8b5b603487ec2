"""Tokens of mixed English and Japanese text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc_lower

# Numbers of rules with their letter, figures with a letter, words (an apostrophe stays inside), and the characters that are paired.
WORDS = r"\p{Nd}{3}\.\p{Nd}+[a-z]?|\p{Nd}+[a-z]?|[a-z][a-z']*"
CJK = "[\u3040-ヿ㐀-鿿]+"


def normalized(text: Column) -> Column:
    """The form in which queries, terms and texts meet: every compatibility form folded and marks composed, lower case."""
    return nfkc_lower(text)


def tokens(text: Column) -> Column:
    """Words in order, then the character pairs of each Japanese run (a lone character by itself); null has none."""
    plain = normalized(F.coalesce(text, F.lit("")))
    pairs = F.flatten(
        F.transform(
            F.regexp_extract_all(plain, F.lit(CJK), F.lit(0)),
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))),
        )
    )
    return F.concat(F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0)), pairs)
