"""References between records: which point at nothing, and which records hang on such a one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_date, rule_mentions, rule_number
from ..storage import checkpointed, salted_join
from .snapshots import snapshot_rows

EDGE = ["source_table", "field_name", "record_id", "edition", "number"]


def reference_edges(glossary: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per record, field and rule number named there, at the record's edition.

    Null and blank members are no references; neither are those of records without an id or a readable edition.
    """
    fields = [
        ("glossary", glossary, "term_en", "effective_date", {"rules": "rules"}),
        ("questions", questions, "id", "source", {"retrieval_relevant_rules": "retrieval_relevant_rules", "rules_cited": "expected_answer.rules_cited", "must_cite_rules": "evaluation_criteria.must_cite_rules"}),
    ]
    parts = []
    for name, df, key, edition, lists in fields:
        listed = F.array(*(F.struct(F.lit(field).alias("field_name"), F.col(c).alias("members")) for field, c in lists.items()))
        dated = df.select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), iso_date(F.col(edition)).alias("edition"), listed.alias("lists")).dropna(subset=["record_id", "edition"])
        named = dated.select("source_table", "record_id", "edition", F.inline("lists")).select("source_table", "field_name", "record_id", "edition", F.explode("members").alias("member"))
        parts.append(named.select(*EDGE[:4], rule_number(F.col("member")).alias("number")).where("number is not null"))
    return reduce(DataFrame.unionByName, parts).distinct()


def rule_edges(rules: DataFrame) -> DataFrame:
    """What rules refer to in their own snapshot: rules named in the text, and for a sub-rule its parent.

    ``rules`` has effective_date, number, text, a row to a number and date. A text is read once, however many
    snapshots repeat it. Output as of ``reference_edges``; a rule naming itself is no edge.
    """
    parent = F.regexp_extract("number", r"^(\d{3}\.\d+)[a-z]$", 1)
    named = F.transform(rule_mentions(F.coalesce("text", F.lit(""))), lambda n: F.struct(F.lit("text").alias("field_name"), n.alias("to")))
    up = F.when(parent != "", F.array(F.struct(F.lit("parent").alias("field_name"), parent.alias("to")))).otherwise(F.array().cast("array<struct<field_name:string,to:string>>"))
    texts = rules.groupBy("number", "text").agg(F.collect_set("effective_date").alias("editions"))
    edges = texts.select("number", "editions", F.explode(F.filter(F.concat(named, up), lambda e: e.to != F.col("number"))).alias("edge"))
    return edges.select(F.lit("rule_entries").alias("source_table"), "edge.field_name", F.col("number").alias("record_id"), F.explode("editions").alias("edition"), F.col("edge.to").alias("number"))


def orphan_cascade(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Every reference of ``edges`` and of the rules themselves that is orphaned, directly or by inheritance.

    A reference is a direct orphan if the snapshot of its edition lacks the number; ``status`` says whether an
    earlier snapshot has it (deleted), only a later one (late) or none (missing). A rule with a direct orphan is an
    orphaned record; what refers to such a rule at the same edition is an inherited orphan (status ``inherited``),
    and so on: the loop semi-joins the rule edges to the rules orphaned in the last round until a round finds none,
    so cycles end too. ``depth`` is 0 for direct orphans, else the number of steps to the nearest one. A direct
    orphan is never also an inherited one, as its number names no rule of that edition.

    Only distinct (number, edition) pairs are held against the snapshots, so a number that a third of all records
    name is looked up once; what is found meets the references again in shares of each pair. A round writes the
    rules it reached first and nothing else. ``rules`` are ``snapshot_rows`` of one language. Empty inputs give no rows.
    Output: source_table, field_name, record_id, edition, number, status, depth.
    """
    held = rules.select("number", F.col("effective_date").alias("edition")).distinct()
    inner = checkpointed(rule_edges(rules))
    every = edges.unionByName(inner)
    span = held.groupBy("number").agg(F.min("edition").alias("first"), F.max("edition").alias("last"))
    status = F.when(F.col("first") < F.col("edition"), "deleted").when(F.col("last") > F.col("edition"), "late").otherwise("missing")
    lost = every.select("number", "edition").distinct().join(held, ["number", "edition"], "left_anti").join(span, "number", "left").select("number", "edition", status.alias("status"))
    lost = checkpointed(lost)
    direct = salted_join(every, lost, ["number", "edition"], "record_id").withColumn("depth", F.lit(0))

    nodes = ["edition", "number"]
    as_node = lambda df: df.where("source_table = 'rule_entries'").select("edition", F.col("record_id").alias("number")).distinct()
    rounds = [checkpointed(as_node(direct))]
    while not rounds[-1].isEmpty():
        reached = as_node(salted_join(inner, rounds[-1], nodes, "record_id", how="left_semi"))
        rounds.append(checkpointed(reduce(lambda df, seen: df.join(seen, nodes, "left_anti"), rounds, reached)))
    seen = reduce(DataFrame.unionByName, [r.withColumn("depth", F.lit(i)) for i, r in enumerate(rounds, 1)])
    inherited = salted_join(every, seen, nodes, "record_id").withColumn("status", F.lit("inherited"))
    return direct.unionByName(inherited).select(*EDGE, "status", "depth")


def dangling_references(glossary: DataFrame, questions: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    """``orphan_cascade`` of the glossary and the questions over the English snapshots."""
    rules = snapshot_rows(documents, entries).where("language = 'en'").groupBy("effective_date", "number").agg(F.min(F.struct("ord", "text"))["text"].alias("text"))
    return orphan_cascade(checkpointed(reference_edges(glossary, questions)), checkpointed(rules))
