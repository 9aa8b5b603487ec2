"""From the lines of a rulebook to its rules and glossary.

All take and give tables of lines: doc, line_no, line. Rulebooks are split by ``doc``, so a job can hold any number.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import SPACE_CLASS, references
from .ordered import forward_fill, running_count

# How rulebooks mark rules, headings and the parts after the rules.
RULE = r"^(\d{3})\.(\d+[a-z]?)\.?\s+(.+)$"
HEADING = r"^(\d{3})\.\s+(.+)$"
GLOSSARY = ("Glossary", "用語集")
CREDITS = ("Credits", "クレジット")
# Elements that end a line, and those whose text is not read.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div")
UNREAD = ("script", "style")
# Kana readings in a heading, and the characters that are read of the last body.
READING = "（[ぁ-ゖー・、\\s]+）"
LAST_BODY = 4000
_START, _END, _CUT = "\x01", "\x02", "\x03"


def lines_of(texts: DataFrame) -> DataFrame:
    """doc, line_no from 1, line (stripped) of the non-blank lines of texts (doc, text); a byte order mark goes."""
    split = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff", ""), r"\r\n|\r|\n")
    return texts.select("doc", F.posexplode(split).alias("line_no", "line")).select("doc", (F.col("line_no") + 1).alias("line_no"), stripped(F.col("line")).alias("line"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def parse_rules(lines: DataFrame) -> DataFrame:
    """doc, line_no, number, text, section, category of the rule lines before the glossary.

    A rule takes the last heading before it as its category ('' before any), whatever section the number says.
    Reading stops at the first glossary title after a rule, so the one in the table of contents is harmless.
    Lines that are neither rule nor heading are dropped. The first of rules with a number counts.
    """
    got = lambda pattern, i: F.regexp_extract("line", pattern, i)
    marked = lines.select("doc", "line_no", "line", F.col("line").rlike(RULE).alias("is_rule")).withColumn("heading", F.when(~F.col("is_rule") & F.col("line").rlike(HEADING), got(HEADING, 2)))
    first = marked.where("is_rule").groupBy("doc").agg(F.min("line_no").alias("first"))
    titles = marked.where(F.col("line").isin(*GLOSSARY)).select("doc", "line_no").join(first, "doc").where("line_no > first")
    stops = titles.groupBy("doc").agg(F.min("line_no").alias("stop"))
    read = marked.where("is_rule or heading is not null").join(stops, "doc", "left").where("stop is null or line_no < stop")
    filled = forward_fill(read, "doc", "line_no", "heading", "category")
    rules = filled.where("is_rule").select("doc", "line_no", F.concat_ws(".", got(RULE, 1), got(RULE, 2)).alias("number"), got(RULE, 3).alias("text"), got(RULE, 1).alias("section"), F.coalesce("category", F.lit("")).alias("category"))
    return keep_first(rules, ["doc", "number"], [F.col("line_no")])


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; with descending columns the last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def nth_line(lines: DataFrame, titles: tuple[str, ...], n: int) -> DataFrame:
    """doc and line_no of the n-th line of each doc that is one of the titles; docs with fewer have none."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))
    return lines.where(F.col("line").isin(*titles)).select("doc", "line_no", place.alias("place")).where(F.col("place") == n).drop("place")


def glossary_blocks(lines: DataFrame) -> DataFrame:
    """doc, ord, term_en, definition_en, rules, sections of the English glossary: blocks between blank lines, the first line being the term.

    It lies between the second glossary title and the second credits title; with fewer of either there is none.
    Blocks of one line are dropped. Rules and sections are those the definition refers to.
    """
    bounds = nth_line(lines, GLOSSARY, 2).withColumnRenamed("line_no", "start").join(nth_line(lines, CREDITS, 2).withColumnRenamed("line_no", "end"), "doc")
    body = lines.join(bounds, "doc").where("line_no > start and line_no < end").select("doc", "line_no", "line")
    blocks = line_blocks(body).where("size(lines) > 1")
    terms = blocks.select("doc", F.col("block").alias("ord"), F.element_at("lines", 1).alias("term_en"), F.array_join(F.slice("lines", F.lit(2), F.size("lines") - 1), " ").alias("definition_en"))
    return terms.withColumn("named", references(F.col("definition_en"))).select("doc", "ord", "term_en", "definition_en", "named.*")


def line_blocks(lines: DataFrame) -> DataFrame:
    """doc, block, lines: runs of non-blank lines, numbered by the blank lines before them."""
    counted = running_count(lines.withColumn("_blank", F.col("line") == ""), "doc", "line_no", "_blank", "block").where("line != ''")
    return counted.groupBy("doc", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line).alias("lines"))


@pandas_udf(ArrayType(StringType()))
def _unescaped(lines: pd.Series) -> pd.Series:
    return lines.map(lambda listed: [html.unescape(s) if "&" in s else s for s in listed])


def html_lines(pages: DataFrame) -> DataFrame:
    """doc, line_no from 1, line of pages (doc, html): the text of block elements, a line each, white space collapsed.

    All is column expressions: comments and unread elements go, tags that matter become one control character each,
    other tags vanish. Text counts from a block's start tag to the next start or end tag of a block, so what follows
    a nested block inside its outer one is dropped, as is text outside of blocks; a break parts a line. Entities are
    decoded once tags are gone. An unread element that never ends reaches to the end of the page; a tag ends at its
    first >. Null and empty pages have no lines.
    """
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), f"[{_START}{_END}{_CUT}]", " ")
    plain = F.regexp_replace(plain, rf"(?is)<!--.*?(?:-->|$)|<({'|'.join(UNREAD)})\b[^>]*>.*?(?:</\1\s*>|$)", "")
    for pattern, mark in ((rf"<(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", _START), (rf"</(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?>", _END), (r"<br(?:[\s/][^>]*)?>", _CUT), (r"</?[a-z][^>]*>|<[!?][^>]*>", "")):
        plain = F.regexp_replace(plain, f"(?i){pattern}", mark)
    read = F.regexp_extract_all(plain, F.lit(f"{_START}([^{_START}{_END}]*)"), F.lit(1))
    parts = F.flatten(F.transform(read, lambda block: F.split(block, _CUT)))
    clean = F.transform(_unescaped(parts), lambda line: stripped(F.regexp_replace(line, f"{SPACE_CLASS}+", " ")))
    found = pages.select("doc", clean.alias("lines")).select("doc", F.posexplode(F.filter("lines", lambda line: line != "")).alias("line_no", "line"))
    return found.select("doc", (F.col("line_no") + 1).alias("line_no"), "line")


def html_glossary(pages: DataFrame) -> DataFrame:
    """doc, ord, term_en, term_ja, definition_ja, rules, sections from headings ``<h5><a id="g_...">日本語（よみ）／English</a></h5>`` and what follows.

    The heading is parted at its last ／ (without one both terms are the whole), kana readings are cut from the
    Japanese, an empty one is null, as is an empty body. A body ends at the first </div> or <h4>; the last one has at
    most 4000 characters. Rules and sections are those the body refers to.
    """
    parts = F.split("html", r"(?i)<h5[^>]*>\s*<a[^>]*id=\"g_[^\"]*\"[^>]*>")
    rows = pages.select("doc", (F.size(parts) - 1).alias("n"), F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("ord", "part"))
    clean = lambda c, gap: stripped(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", gap), f"{SPACE_CLASS}+", " "))
    head = F.substring_index("part", "</h5>", 1)
    body = F.substr("part", F.length(head) + 6)
    body = F.when(F.col("ord") == F.col("n") - 1, F.substring(body, 1, LAST_BODY)).otherwise(body)
    rows = rows.select("doc", "ord", clean(head, "").alias("head"), clean(F.substring_index(F.substring_index(body, "</div>", 1), "<h4>", 1), " ").alias("body"))
    ja = F.when(F.contains("head", F.lit("／")), F.regexp_extract("head", "^(.*)／", 1)).otherwise(F.col("head"))
    terms = rows.select("doc", "ord", stripped(F.substring_index("head", "／", -1)).alias("term_en"), F.nullif(stripped(F.regexp_replace(ja, READING, "")), F.lit("")).alias("term_ja"), F.nullif("body", F.lit("")).alias("definition_ja"), references(F.col("body")).alias("named"))
    return terms.select("doc", "ord", "term_en", "term_ja", "definition_ja", "named.*")


def merge_glossaries(en: DataFrame, ja: DataFrame) -> DataFrame:
    """English and Japanese glossary joined on the term, whatever its case; terms of one language are kept.

    Each has ord, term_en, rules, sections, and definition_en or term_ja and definition_ja. Of terms repeated in a
    language the last counts, at the place of the first. Lists are united in order of first appearance; English
    terms come first, then those only Japanese.
    """

    def last(rows: DataFrame) -> DataFrame:
        key = F.lower("term_en")
        first = rows.groupBy(key.alias("key")).agg(F.min("ord").alias("place"))
        return keep_first(rows.withColumn("key", key), ["key"], [F.desc("ord")]).join(first, "key")

    e, j = last(en).alias("e"), last(ja).alias("j")
    empty = F.array().cast("array<string>")
    union = lambda c: F.array_distinct(F.concat(F.coalesce(f"e.{c}", empty), F.coalesce(f"j.{c}", empty)))
    return e.join(j, "key", "full").select(
        F.struct(F.col("e.place").isNull().alias("late"), F.coalesce("e.place", "j.place").alias("place")).alias("by"), F.coalesce("e.term_en", "j.term_en").alias("term_en"), "j.term_ja",
        F.coalesce("e.definition_en", F.lit("")).alias("definition_en"), "j.definition_ja", union("rules").alias("rules"), union("sections").alias("sections"),
    )


def bilingual(en: DataFrame, ja: DataFrame) -> DataFrame:
    """number, text_en, text_ja, section, category: English rules with the Japanese text of their number, the last of several, null without one."""
    latest = keep_first(ja, ["number"], [F.desc("ord"), F.desc("text")]).select("number", F.col("text").alias("text_ja"))
    return keep_first(en, ["number"], [F.col("ord"), F.col("text")]).select("number", "ord", F.col("text").alias("text_en"), "section", "category").join(latest, "number", "left")


def self_check(en: DataFrame, ja: DataFrame, least: int, coverage: float) -> DataFrame:
    """One row: rules per language, share of the Japanese numbers that the English has, and whether all is enough."""
    e, j = en.select("number").distinct(), ja.select("number").distinct()
    joined = e.withColumn("e", F.lit(1)).join(j.withColumn("j", F.lit(1)), "number", "full")
    counts = joined.agg(F.count("e").alias("n_en"), F.count("j").alias("n_ja"), F.count_if(F.expr("e = 1 and j = 1")).alias("n_both"))
    share = F.when(F.col("n_ja") > 0, F.col("n_both") / F.col("n_ja")).otherwise(0.0)
    return counts.select("n_en", "n_ja", F.round(share, 6).alias("coverage"), ((F.least("n_en", "n_ja") >= least) & (share >= coverage)).alias("passed"))
