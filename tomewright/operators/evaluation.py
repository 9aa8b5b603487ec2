"""How well a ranking finds what it should, and how answers were scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PASS = 7
#: Width of a stretch of values.
STRETCH = 1_000


def judged_queries(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query with relevant documents: n_relevant, found (in the first k), recall, hit, rr.

    retrieved has query_id, doc_id, rank; relevant has query_id, doc_id. Recall is over all that is relevant, however
    large k is; rr is one over the rank of the first relevant one within k, else 0. Queries that retrieved nothing
    count with zeros.
    """
    wanted = relevant.select("query_id", "doc_id").distinct()
    within = retrieved.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    joined = wanted.join(within, ["query_id", "doc_id"], "left")
    per = joined.groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.count("rank").alias("found"), F.min("rank").alias("best"))
    return per.select("query_id", "n_relevant", "found", F.round(F.col("found") / F.col("n_relevant"), 6).alias("recall"), (F.col("found") > 0).cast("int").alias("hit"), F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """Mean recall, hit rate and reciprocal rank by the columns given; no columns, one row."""
    return judged.groupBy(*by).agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def judged_groups(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per question that was searched and has relevant rules: recall and must-cite recall over whole groups, and the reciprocal rank.

    found has question_id, query_ord, group_rank, parent, numbers (all rules of the group); wanted has question_id,
    category, relevant, must. What any query of a question found counts as found; the rank is that of the first
    group of its first query that holds a relevant rule, 0 without one. A question that nothing was found for is
    judged too, if wanted has it: give wanted for the questions asked. Recall is null where nothing must be cited.
    """
    numbers = found.select("question_id", "query_ord", "group_rank", F.explode("numbers").alias("number"))
    every = wanted.select("question_id", F.explode(F.array_union("relevant", "must")).alias("number"))
    met = every.join(numbers, ["question_id", "number"]).groupBy("question_id", "number").agg(F.min(F.when(F.col("query_ord") == 0, F.col("group_rank"))).alias("first"))
    per = met.groupBy("question_id").agg(F.collect_list(F.struct("number", "first")).alias("met"))
    joined = wanted.where("size(relevant) > 0").join(per, "question_id", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<number:string,first:int>>")))
    got = F.transform("met", lambda m: m.number)
    share = lambda c: F.round(F.size(F.array_intersect(c, got)) / F.size(c), 6)
    first = F.array_min(F.transform(F.filter("met", lambda m: F.array_contains("relevant", m.number)), lambda m: m.first))
    return joined.select(
        "question_id", "category", F.size("relevant").alias("n_relevant"), F.size("must").alias("n_must"), share("relevant").alias("recall"), F.when(F.size("must") > 0, share("must")).alias("must_recall"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr")
    )


def group_summary(judged: DataFrame) -> DataFrame:
    """Means over all questions (category null, is_total 1) and by category."""
    return judged.rollup("category").agg(F.grouping("category").cast("int").alias("is_total"), F.count("*").alias("n_questions"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("must_recall"), 6).alias("must_recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def group_misses(found: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """Questions whose recall is below ``least``: question_id, recall, expected (sorted), got (the groups of the first query in order)."""
    got = found.where("query_ord = 0").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_rank", "parent"))), lambda g: g.parent).alias("got"))
    low = judged_groups(found, wanted).where(F.col("recall") < least).select("question_id", "recall")
    return low.join(wanted.select("question_id", F.array_sort("relevant").alias("expected")), "question_id").join(got, "question_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))


def scored_questions(questions: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """The questions (id, and more) that have both an answer and a score, with their columns; those that lack one are in ``unfinished``."""
    return questions.join(answers, "id").join(scores, "id")


def unfinished(questions: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """id, category and what is lacking (answer, score, or both) of every question without an answer or a score."""
    marked = lambda df, name: df.select("id", F.lit(name).alias(name)).distinct()
    joined = questions.select("id", "category").join(marked(answers, "answer"), "id", "left").join(marked(scores, "score"), "id", "left")
    lacks = F.concat_ws(" ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("answer", "score")))
    return joined.select("id", "category", lacks.alias("lacks")).where("lacks != ''")


def first_passes(scored: DataFrame) -> DataFrame:
    """The first row of each category, by ord, whose score passes."""
    passed = scored.where(F.col("score") >= PASS)
    return passed.groupBy("category").agg(F.min_by(F.struct(*(c for c in passed.columns if c != "category")), "ord").alias("first")).select("category", "first.*")


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], stretch: float = STRETCH) -> DataFrame:
    """Nearest-rank percentiles per group of a numeric value.

    Values are counted, and their counts summed up within stretches of values; only the totals of the stretches, a
    row each, meet in a window over the group. Null values are left out; a group without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n")).withColumn("_stretch", F.floor(F.col(value) / stretch))
    totals = counts.groupBy(by, "_stretch").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = totals.select(F.col(by).alias("_by"), F.col("_stretch").alias("_at"), before.alias("before"), F.sum("_n").over(whole).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(by, "_stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    joined = counts.withColumn("_inside", inside).join(placed, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_stretch") == F.col("_at")))
    at = lambda s: F.min(F.when(F.col("before") + F.col("_inside") > F.least(F.floor(F.col("total") * F.lit(s)), F.col("total") - 1), F.col(value)))
    return joined.groupBy(by).agg(*(at(s).alias(name) for name, s in shares.items()))


def score_report(scores: DataFrame, by: str) -> DataFrame:
    """Scores 0 to 10 overall (group null) and by group, in one pass: count, passed, pass rate, mean, median."""
    return scores.rollup(by).agg(
        F.grouping(by).alias("is_total"), F.count("score").alias("n"), F.count_if(F.col("score") >= PASS).alias("passed"), F.round(F.avg((F.col("score") >= PASS).cast("double")), 6).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean"), F.median("score").alias("median")
    )
