"""Checks of evaluation questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rule_number
from ..storage import checkpointed


def question_problems(questions: DataFrame, known: DataFrame, categories: list[str], tools: list[str]) -> DataFrame:
    """id, problem, detail of every question that breaks a rule.

    Checked are: a missing question, answer or empty list; ids and question texts that occur more than once among
    distinct records; unknown categories and tools; cited rules not among the relevant ones, required ones not
    among the cited; cited or relevant rules that are not known (number). Null lists count as empty. Numbers are
    compared without decoration. Records loaded again are one. Each record is read and checked once; what the four
    kinds of problems need of it is stored.
    """
    plain = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), rule_number), lambda x: x.isNotNull())
    q = questions.select(
        "id", "category", "question", F.coalesce("expected_tools", F.array().cast("array<string>")).alias("tools"), F.col("expected_answer.conclusion").alias("conclusion"), plain("retrieval_relevant_rules").alias("relevant"), plain("expected_answer.rules_cited").alias("cited"), plain("evaluation_criteria.must_cite_rules").alias("must")
    ).distinct()
    listed = lambda c: F.array_join(F.array_sort(c), " ")
    off_tools, off_cited, off_must = F.array_except("tools", F.array(*map(F.lit, tools))), F.array_except("cited", "relevant"), F.array_except("must", "cited")
    category = F.coalesce("category", F.lit(""))
    incomplete = (F.coalesce("question", F.lit("")) == "") | (F.coalesce("conclusion", F.lit("")) == "") | (F.size("cited") == 0) | (F.size("relevant") == 0) | (F.size("must") == 0)
    checks = [("incomplete", incomplete, F.lit("")), ("category", ~category.isin(categories), category), ("tools", F.size(off_tools) > 0, listed(off_tools)), ("cited not relevant", F.size(off_cited) > 0, listed(off_cited)), ("required not cited", F.size(off_must) > 0, listed(off_must))]
    own = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(problem).alias("problem"), detail.alias("detail"))) for problem, broken, detail in checks)))
    q = checkpointed(q.select("id", "question", own.alias("own"), F.array_distinct(F.concat("cited", "relevant")).alias("numbers")))
    rows = lambda df, problem, detail: df.select("id", F.lit(problem).alias("problem"), detail.alias("detail"))
    unknown = q.select("id", F.explode("numbers").alias("number")).join(known.select("number").distinct(), "number", "left_anti")
    parts = [
        q.select("id", F.inline("own")),
        rows(q.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate id", F.col("n").cast("string")),
        rows(q.where("question is not null").groupBy("question").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n > 1"), "duplicate question", F.col("n").cast("string")),
        rows(unknown, "unknown rule", F.col("number")),
    ]
    return reduce(DataFrame.unionByName, parts)
