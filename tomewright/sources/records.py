"""Readers and writers of rulebooks, questions and reports; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES_DOCUMENT = "language string, effective_date string, source_sha256 string, rules array<struct<number:string,text:string,section:string,category:string>>"
GLOSSARY = "term_en string, term_ja string, definition_en string, definition_ja string, rules array<string>, sections array<string>"
QUESTION = "id string, category string, question string, cards array<struct<ja:string,en:string>>, expected_tools array<string>, expected_answer struct<conclusion:string,rules_cited:array<string>,key_facts:array<string>>, retrieval_relevant_rules array<string>, evaluation_criteria struct<must_cite_rules:array<string>,forbidden_mistakes:array<string>>, source string, notes string"
REPHRASING = "id string, queries array<string>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file), text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def rules_document(spark: SparkSession, path: str) -> DataFrame:
    """language, effective_date, ord, number, text, section, category of a parsed document."""
    doc = spark.read.schema(RULES_DOCUMENT).json(path, multiLine=True)
    return doc.select("language", "effective_date", F.posexplode("rules").alias("ord", "r")).select("language", "effective_date", "ord", "r.*")


def write_rules_document(rules: DataFrame, path: str) -> None:
    """A JSON record per language and date, its rules in order."""
    whole = rules.groupBy("language", "effective_date").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "text", "section", "category"))).alias("all"))
    whole.select("language", "effective_date", F.transform("all", lambda r: F.struct(r.number.alias("number"), r.text.alias("text"), r.section.alias("section"), r.category.alias("category"))).alias("rules")).write.mode("overwrite").json(path)


def optional_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """The records of a JSON file; none if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no from 1, line of text files, read in splits: a line's number is its place in its split after the lines of the splits before."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """file, line_no, record, error for every non-blank line (file, line_no, line): broken ones have an error and a null record."""
    own = lines.where("trim(line) != ''")
    parsed = own.select("file", "line_no", "line", F.from_json("line", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("record"))
    broken = F.col("record").isNull() | F.col("record._corrupt_record").isNotNull()
    return parsed.select("file", "line_no", F.when(~broken, F.col("record").dropFields("_corrupt_record")).alias("record"), F.when(broken, F.col("line")).alias("error"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``parsed_lines`` of files of JSON lines."""
    return parsed_lines(numbered_lines(spark, path), schema)


def merged_lines(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The last record of each id over all files: those named retry come after the others, else files by name."""
    rows = json_lines(spark, pattern, schema).where("record is not null and record.id is not null")
    latest = Window.partitionBy("record.id").orderBy(F.contains("file", F.lit("retry")).desc(), F.desc("file"), F.desc("line_no"))
    return rows.withColumn("n", F.row_number().over(latest)).where("n = 1").select("record.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of the bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def markdown_table(report: DataFrame) -> str:
    """A small aggregated report as Markdown."""
    rows = [report.columns, ["---"] * len(report.columns), *[["" if v is None else str(v) for v in r] for r in report.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def write_glossary(glossary: DataFrame, path: str) -> None:
    """A JSON record per term."""
    glossary.select("term_en", "term_ja", "definition_en", "definition_ja", "rules", "sections").write.mode("overwrite").json(path)


def write_contexts(contexts: DataFrame, path: str) -> None:
    """A JSON line per question: its groups in order, each with its parent and rules; empty texts are null."""
    groups = F.transform(F.array_sort(F.collect_list(F.struct("place", "parent", "rules"))), lambda g: F.struct(g.parent.alias("parent"), g.rules.alias("rules")))
    contexts.groupBy(F.col("question_id").alias("id")).agg(groups.alias("groups")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
