"""The queries of the retrieval engine, with their SQL.

Searches take as queries the questions whose number is divisible by 20 (eval items and vectors by their id), against all rows;
q_hybrid, q_hybrid_section and q_group_eval take all questions.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.numbers import parent_of, sort_key
from .functions.text import nfkc_lower, references, rule_mentions, rule_number
from .functions.tokens import tokens
from .operators.cards import find_cards, keyword_rules, plain_term, read_cards, with_rulings
from .operators.evaluation import first_passes, group_misses, group_summary, judged_groups, judged_queries, percentiles, score_report, scored_questions, summary, unfinished
from .operators.glossary import glossary_ranking, secondary_queries, term_hits, term_table
from .operators.ingest import bilingual, glossary_blocks, html_glossary, html_lines, keep_first, line_blocks, merge_glossaries, nth_line, parse_rules, self_check
from .operators.lookup import direct_lookup
from .operators.ordered import forward_fill, next_value
from .operators.ranking import bm25, bm25_ranking, fold_groups, minmax_fusion, rrf, top, vector_ranking
from .operators.snapshots import chosen_deliveries
from .operators.validation import question_problems
from .plans.search import Index, contexts, corpus_members, language_passages, multi_query_groups, passages, question_queries, reranked, search, vector_count
from .queries_data import _ASCII, _SNAPSHOTS, _SPACES, _WIDE, _number
from .sources.records import parsed_lines
from .storage import checkpointed, table

# The categories and tools that questions may name.
CATEGORIES = ["basic_rules", "card_interactions", "combat", "commander", "keywords", "layers", "replacement_effects", "stack_priority"]
TOOLS = ["search_rules", "lookup_card", "get_card_rulings"]

#: The questions that most searches ask.
_TWENTIETH = "try_cast(regexp_extract(id, '([0-9]+)$', 1) as int) % 20 = 0"


# --- tables -------------------------------------------------------------------------------------------------


def corpus_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus").select("number", "text_en", "text_ja", "section", "category").distinct().withColumn("ord", sort_key(F.col("number")))


def glossary_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").drop("effective_date").distinct().withColumn("ord", F.col("term_en"))


def records_of(spark: SparkSession, sf: str) -> DataFrame:
    """Questions, each once whatever it was loaded."""
    return keep_first(table(spark, sf, "questions"), ["id"], [F.desc("loaded_at"), F.asc("question")])


def asked_of(spark: SparkSession, sf: str) -> DataFrame:
    return records_of(spark, sf).where(_TWENTIETH).select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def every_question_of(spark: SparkSession, sf: str) -> DataFrame:
    """All questions as queries. Stored, as what draws their vectors and what searches read them."""
    return checkpointed(records_of(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text")))


def relevant_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = records_of(spark, sf).select(F.col("id").alias("query_id"), F.explode("retrieval_relevant_rules").alias("r"))
    return rows.select("query_id", rule_number(F.col("r")).alias("doc_id")).where("doc_id is not null").distinct()


def _drawn(spark: SparkSession, sf: str, rows: DataFrame, name: str) -> DataFrame:
    """The rows (id and more) with the vector that their id draws: no table says what a vector stands for, so a hash does."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    size = vectors.agg((F.max("vec_id") + 1).alias("size"))
    place = F.conv(F.substring(F.md5(F.col(name)), 1, 8), 16, 10).cast("long")
    return rows.crossJoin(F.broadcast(size)).withColumn("vec_id", F.pmod(place, "size")).join(vectors, "vec_id").drop("vec_id", "size")


def index_of(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> Index:
    """The index of the corpus; with queries (query_id) also with vectors, two to a bilingual rule."""
    corpus = checkpointed(corpus_of(spark, sf))
    index = Index(passages(corpus), corpus_members(corpus), terms=checkpointed(term_table(glossary_of(spark, sf), corpus)))
    if asked is not None:
        index.vectors = _drawn(spark, sf, language_passages(corpus).select("id", "doc_id"), "id").select("doc_id", "embedding")
        index.query_vectors = _drawn(spark, sf, asked.select("query_id"), "query_id")
    return index


def items_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def texts_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def one_language(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return language_passages(corpus_of(spark, sf)).where(F.col("lang") == lang).select("doc_id", "text")


# --- queries ------------------------------------------------------------------------------------------------


def q_tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return texts_of(spark, sf).select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).alias("n_distinct"))


def q_bm25_rules(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_ranking(passages(corpus_of(spark, sf)), asked_of(spark, sf))


def q_bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_ranking(texts_of(spark, sf), items_of(spark, sf), 10)


def q_bm25_section(spark: SparkSession, sf: str) -> DataFrame:
    docs = passages(corpus_of(spark, sf)).withColumn("section", F.substring("doc_id", 1, 3))
    return bm25_ranking(docs, asked_of(spark, sf), 10, keep=F.col("section") == "702")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_ranking(_vectors(spark, sf), _query_vectors(spark, sf), 10)


def q_vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return vector_ranking(_vectors(spark, sf).where("label = 3"), _query_vectors(spark, sf), 10)


def q_vector_best_of_item(spark: SparkSession, sf: str) -> DataFrame:
    """Two vectors to an item, as of its two languages: the better one counts."""
    return vector_ranking(_vectors(spark, sf).withColumn("doc_id", F.expr("doc_id div 2")), _query_vectors(spark, sf), 10)


def q_rrf(spark: SparkSession, sf: str) -> DataFrame:
    asked = asked_of(spark, sf)
    return rrf([(bm25_ranking(one_language(spark, sf, "en"), asked), 1.0), (bm25_ranking(one_language(spark, sf, "ja"), asked), 1.0)])


def q_rrf_weighted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by vectors (a vector stands for the document of its id) and by words, at different weights."""
    queries = items_of(spark, sf)
    vectors = _vectors(spark, sf)
    asked = vectors.select((F.col("doc_id") + 1000).alias("query_id"), "embedding").join(queries.select("query_id"), "query_id", "left_semi")
    return rrf([(vector_ranking(vectors, asked), 0.7), (bm25_ranking(texts_of(spark, sf), queries), 1.0)])


def q_minmax_fuse(spark: SparkSession, sf: str) -> DataFrame:
    asked = asked_of(spark, sf)
    return minmax_fusion([(bm25_ranking(one_language(spark, sf, "en"), asked), 0.5), (bm25_ranking(one_language(spark, sf, "ja"), asked), 0.5)])


def q_group_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    corpus = corpus_of(spark, sf)
    groups = fold_groups(bm25_ranking(passages(corpus), asked_of(spark, sf)), corpus_members(corpus), 7)
    return groups.select("query_id", "group_rank", "parent", "score", F.array_join("matched", " ").alias("matched"), F.array_join(F.transform("rules", lambda r: r.doc_id), " ").alias("rules"))


def q_direct_lookup(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "glossary").select(F.explode(F.concat(F.coalesce("rules", F.array().cast("array<string>")), F.coalesce("sections", F.array().cast("array<string>")))).alias("text")).distinct()
    return direct_lookup(named.select(F.col("text").alias("query_id"), "text").dropna(), corpus_of(spark, sf))


def q_number_sort(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy(F.substring("number", 1, 3)).orderBy(sort_key(F.col("number")))
    return corpus_of(spark, sf).select("number", parent_of(F.col("number")).alias("parent"), F.row_number().over(by).alias("place"))


def q_term_table(spark: SparkSession, sf: str) -> DataFrame:
    return term_table(glossary_of(spark, sf), corpus_of(spark, sf)).select("term", "kind", "lang", "ord", F.array_join("rules", " ").alias("rules"))


def q_glossary_match(spark: SparkSession, sf: str) -> DataFrame:
    terms = term_table(glossary_of(spark, sf), corpus_of(spark, sf))
    return term_hits(_term_queries(spark, sf), terms)


def q_glossary_ranking(spark: SparkSession, sf: str) -> DataFrame:
    terms = term_table(glossary_of(spark, sf), corpus_of(spark, sf))
    return glossary_ranking(_term_queries(spark, sf), terms)


def _term_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries made of the glossary's own terms: each term in both languages, then its English definition."""
    g = glossary_of(spark, sf)
    return g.select(F.col("term_en").alias("query_id"), F.concat_ws(" ", "term_en", F.coalesce("term_ja", F.lit("")), "definition_en").alias("text"))


def q_section_expansion(spark: SparkSession, sf: str) -> DataFrame:
    terms = term_table(glossary_of(spark, sf), corpus_of(spark, sf))
    return glossary_ranking(_term_queries(spark, sf), terms, "section")


def q_secondary_query(spark: SparkSession, sf: str) -> DataFrame:
    terms = term_table(glossary_of(spark, sf), corpus_of(spark, sf))
    return secondary_queries(_term_queries(spark, sf), terms)


def _newest(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    last = chosen_deliveries(table(spark, sf, "rules_documents")).where((F.col("language") == lang) & (F.col("seq") == F.col("n_dates"))).select("delivery_id")
    rows = table(spark, sf, "rule_entries").join(last, "delivery_id", "left_semi")
    return rows.select("ord", rule_number(F.col("number")).alias("number"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("category", F.lit("")).alias("category"))


def q_bilingual(spark: SparkSession, sf: str) -> DataFrame:
    return bilingual(_newest(spark, sf, "en"), _newest(spark, sf, "ja").where("number is not null")).drop("ord")


def q_coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    return self_check(_newest(spark, sf, "en"), _newest(spark, sf, "ja"), 100, 0.8)


def q_glossary_merge(spark: SparkSession, sf: str) -> DataFrame:
    g = glossary_of(spark, sf)
    en = g.where("definition_en != ''").select("ord", "term_en", "definition_en", "rules", F.array().cast("array<string>").alias("sections"))
    ja = g.where("term_ja is not null").select("ord", F.upper("term_en").alias("term_en"), "term_ja", "definition_ja", F.array().cast("array<string>").alias("rules"), "sections")
    return merge_glossaries(en, ja).select("term_en", "term_ja", "definition_en", "definition_ja", F.array_join("rules", " ").alias("rules"), F.array_join("sections", " ").alias("sections"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The deliveries as rulebooks: section headings and rule lines; what follows a line break is a line of its own. The glossary is named in the contents, and comes after place 150."""
    rows = table(spark, sf, "rule_entries")
    rules = rows.select(F.col("delivery_id").alias("doc"), (F.col("ord").cast("long") * 1000 + 1).alias("base"), F.split(F.concat_ws(". ", F.trim("number"), "text"), "\n").alias("parts"), "number", "text")
    rules = rules.groupBy("doc", "base").agg(F.min("parts").alias("parts")).select("doc", "base", F.posexplode("parts").alias("pos", "line")).select("doc", (F.col("base") + F.col("pos")).alias("line_no"), F.trim("line").alias("line"))
    heads = rows.where("section is not null and category is not null and category != ''").groupBy(F.col("delivery_id").alias("doc"), (F.col("ord").cast("long") * 1000).alias("line_no")).agg(F.min(F.concat_ws(". ", "section", "category")).alias("line"))
    titles = rows.select(F.col("delivery_id").alias("doc")).distinct().select("doc", F.explode(F.array(F.lit(-1).cast("long"), F.lit(150_999).cast("long"))).alias("line_no"), F.lit("Glossary").alias("line"))
    return rules.unionByName(heads).unionByName(titles)


def q_parse_rules(spark: SparkSession, sf: str) -> DataFrame:
    return parse_rules(_lines(spark, sf)).select("doc", "number", "text", "section", "category")


def q_html_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rules as pages with marked-up, escaped text, unread scripts, and text outside of blocks."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><script>var p = '<p>1</p>';</script><body><h5 class='n'><a href='#'>"), "number", F.lit("</a></h5><!-- <p>-->lost<P>"), escaped("text_en"), F.lit("<br/><b>"), escaped("text_ja"), F.lit("</b></P>lost<ul>lost<li>&amp;<div>"), escaped("category"), F.lit("</div>lost</li></ul></body></html>"))
    return html_lines(corpus_of(spark, sf).select(F.col("number").alias("doc"), page.alias("html")))


def _editions(spark: SparkSession, sf: str) -> DataFrame:
    """The glossary in books of one edition each, in small volumes: doc, place of the term in it, and the terms."""
    g = table(spark, sf, "glossary").select("term_en", "term_ja", "definition_en", "definition_ja", F.concat_ws(" ", "effective_date", F.substring(F.md5("term_en"), 1, 2)).alias("doc")).where("term_en is not null").distinct()
    return g.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("term_en", "definition_en", "term_ja", "definition_ja")))


def q_glossary_refs(spark: SparkSession, sf: str) -> DataFrame:
    """What the definitions refer to: rules, ranges of their letters, and sections."""
    g = glossary_of(spark, sf).select("term_en", references(F.col("definition_en")).alias("en"), references(F.col("definition_ja")).alias("ja")).distinct()
    shown = lambda c: F.array_join(F.array_sort(c), " ")
    return g.select("term_en", shown("en.rules").alias("rules_en"), shown("en.sections").alias("sections_en"), shown("ja.rules").alias("rules_ja"))


def q_glossary_en(spark: SparkSession, sf: str) -> DataFrame:
    """The English glossary read back from the lines of rulebooks that hold it after their contents."""
    g = _editions(spark, sf)
    title = lambda line, at: g.select("doc").distinct().select("doc", F.lit(at).alias("line_no"), F.lit(line).alias("line"))
    said = F.concat(F.array(F.lit(""), F.col("term_en")), F.split(F.coalesce("definition_en", F.lit("")), "\n"))
    body = g.select("doc", "place", F.posexplode(said).alias("pos", "line")).select("doc", (F.col("place") * 1000 + F.col("pos")).alias("line_no"), F.trim("line").alias("line"))
    lines = reduce(DataFrame.unionByName, [title("Glossary", 1), title("Credits", 2), title("Glossary", 3), body, title("Credits", 2_000_000_000)])
    return glossary_blocks(lines).select("doc", "term_en", "definition_en", F.array_join(F.array_sort("rules"), " ").alias("rules"), F.array_join(F.array_sort("sections"), " ").alias("sections"))


def q_glossary_ja(spark: SparkSession, sf: str) -> DataFrame:
    """The Japanese glossary read back from pages of headings with readings and marked-up bodies."""
    entry = F.concat(F.lit('<h5><a id="g_1"><b>'), F.coalesce("term_ja", F.lit("")), F.lit("</b>（よみ）／"), F.col("term_en"), F.lit("</a></h5><p>"), F.coalesce("definition_ja", F.lit("")), F.lit("</p>"))
    pages = _editions(spark, sf).groupBy("doc").agg(F.concat(F.lit("<h4>intro</h4>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))), lambda x: x.entry), ""), F.lit("</div>end")).alias("html"))
    return html_glossary(pages).select("doc", "term_en", "term_ja", "definition_ja", F.array_join(F.array_sort("rules"), " ").alias("rules"))


def q_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = texts_of(spark, sf).dropna().select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return line_blocks(lines).select(F.col("doc").alias("doc_id"), F.col("block").cast("int").alias("block"), F.size("lines").alias("n_lines"), F.length(F.array_join("lines", " ")).alias("n_chars"))


def q_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return keep_first(table(spark, sf, "rule_entries").where("number is not null"), ["delivery_id", "number"], [F.col("ord"), F.asc_nulls_first("text")]).select("delivery_id", "number", "ord", "text")


def q_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return records_of(spark, sf).select("id", "question", "loaded_at")


def q_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("signup"))
    return forward_fill(events, "user_id", "event_id", "signup", "last_signup").drop("signup")


def q_nth_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """The second signup of each user, as the second glossary title of a book is found."""
    lines = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))
    return nth_line(lines, ("signup",), 2).select(F.col("doc").alias("user_id"), F.col("line_no").alias("event_id"))


def q_lead_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The number of the next place in each delivery; of rows at one place the least number counts."""
    places = table(spark, sf, "rule_entries").where("number is not null").groupBy("delivery_id", "ord").agg(F.min("number").alias("number"))
    return next_value(places, "delivery_id", "ord", "number", "next_number")


def q_rule_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = texts_of(spark, sf).select(F.explode(rule_mentions(F.coalesce("text", F.lit("")))).alias("number"), "doc_id")
    return refs.distinct().groupBy("number").agg(F.count("*").alias("n_documents"))


def q_json_projection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _raw_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Card records as JSON, made of the questions: the first card's names, the facts as faces, and for ids that end in an even figure the conclusion as text; every 17th record is cut off."""
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    faces = F.transform("expected_answer.key_facts", lambda f: F.struct(f.alias("oracle_text"), F.length(f).cast("string").alias("power")))
    card = F.struct(F.get("cards", F.lit(0))["en"].alias("name"), F.get("cards", F.lit(0))["ja"].alias("printed_name"), F.when(number % 2 == 0, F.col("expected_answer.conclusion")).otherwise("").alias("oracle_text"), F.array("category").alias("keywords"), faces.alias("card_faces"))
    return records_of(spark, sf).select(F.col("id").alias("key"), F.when(number % 17 == 0, F.substring(F.to_json(card), 1, 9)).otherwise(F.to_json(card)).alias("json"))


def q_cards(spark: SparkSession, sf: str) -> DataFrame:
    return read_cards(_raw_cards(spark, sf)).select("key", "status", "name", "printed_name", "oracle_text", "power", F.array_join("keywords", " ").alias("keywords"))


def q_with_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """Cards by name with the rulings that each question on them is."""
    named = records_of(spark, sf).select(F.explode("cards").alias("c"), "category", "question")
    cards = named.select(F.col("c.en").alias("key"), F.to_json(F.struct(F.col("c.en").alias("id"), F.col("c.en").alias("name"))).alias("json")).dropna().distinct()
    rulings = named.select(F.col("c.en").alias("card_id"), F.to_json(F.struct(F.array(F.struct(F.col("category").alias("source"), F.col("question").alias("comment"))).alias("data"))).alias("json"))
    ruled = with_rulings(read_cards(cards), rulings)
    return ruled.select("key", F.size("rulings").alias("n"), F.element_at("rulings", 1)["source"].alias("source"), F.element_at("rulings", 1)["published_at"].alias("published_at"), F.element_at("rulings", 1)["comment"].alias("comment"))


def q_keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of the keywords of cards; a card for each term, with it and one that is no term as keywords."""
    g = glossary_of(spark, sf)
    raw = g.select(F.col("term_en").alias("key"), F.to_json(F.struct(F.col("term_en").alias("name"), F.array(F.upper("term_en"), F.lit("No such term")).alias("keywords"))).alias("json")).distinct()
    return keyword_rules(read_cards(raw), g)


def q_find_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards by a name whose first and last letter are missing, and by one whose halves are swapped."""
    named = records_of(spark, sf).select(F.explode("cards").alias("c")).select(F.col("c.en").alias("name")).dropna().distinct()
    slips = F.array(F.expr("substring(name, 2, length(name) - 2)"), F.expr("concat(substring(name, 1 + length(name) div 2), substring(name, 1, length(name) div 2))"))
    return find_cards(named.select(F.explode(slips).alias("query")).where("query != ''"), named)


def q_jsonl_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Records as lines of JSON, every 19th cut in the middle: which lines can be read."""
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    record = F.to_json(F.struct("id", "category"))
    lines = records_of(spark, sf).select(F.col("category").alias("file"), number.alias("line_no"), F.when(number % 19 == 0, F.substring(record, 1, 7)).otherwise(record).alias("line"))
    return parsed_lines(lines, "id string, category string").select("file", "line_no", F.col("record.id").alias("id"), "error")


def q_glossary_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many terms there are, with Japanese, with rules, and spelled in plain Latin letters; and the vectors that an index of the corpus holds."""
    terms = glossary_of(spark, sf).agg(F.count("*").alias("n_terms"), F.count_if(F.col("term_ja").isNotNull()).alias("n_ja"), F.count_if(F.size(F.coalesce("rules", F.array().cast("array<string>"))) > 0).alias("n_rules"), F.count_if(plain_term(F.col("term_en"))).alias("n_plain"))
    return terms.crossJoin(corpus_of(spark, sf).agg(vector_count().alias("n_vectors")))


def q_passages(spark: SparkSession, sf: str) -> DataFrame:
    """What an index holds: a text per rule and language, with its hash."""
    return language_passages(corpus_of(spark, sf)).select("id", "lang", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def q_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles(table(spark, sf, "documents"), "source", "n_chars", {"p50": 0.5, "p95": 0.95})


def q_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    return glossary_of(spark, sf).select("term_en", nfkc_lower("term_ja").alias("term"))


def q_question_problems(spark: SparkSession, sf: str) -> DataFrame:
    return question_problems(table(spark, sf, "questions"), corpus_of(spark, sf), CATEGORIES, TOOLS)


def _judged(spark: SparkSession, sf: str, ranking: DataFrame, k: int = 10) -> DataFrame:
    asked = asked_of(spark, sf).select("query_id")
    return judged_queries(ranking, relevant_of(spark, sf).join(asked, "query_id", "left_semi"), k)


def _by_category(spark: SparkSession, sf: str, judged: DataFrame) -> DataFrame:
    return judged.join(records_of(spark, sf).select(F.col("id").alias("query_id"), "category"), "query_id")


def q_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, q_bm25_rules(spark, sf))


def q_category_recall(spark: SparkSession, sf: str) -> DataFrame:
    return summary(_by_category(spark, sf, q_recall_mrr(spark, sf)), ["category"])


def q_misses(spark: SparkSession, sf: str) -> DataFrame:
    low = q_recall_mrr(spark, sf).where("recall < 0.5").select("query_id", "recall")
    wanted = relevant_of(spark, sf).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), " ").alias("expected"))
    return low.join(wanted, "query_id")


def q_score_report(spark: SparkSession, sf: str) -> DataFrame:
    """Recall in tenths as the score, overall and by category."""
    scores = _by_category(spark, sf, q_recall_mrr(spark, sf)).select("category", F.floor(F.col("recall") * 10).cast("int").alias("score"))
    return score_report(scores, "category")


def q_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """How well systems and their fusions find what they should: vectors of one language and of two, words of each language and of both, and the best fusion reranked."""
    asked = asked_of(spark, sf)
    corpus = corpus_of(spark, sf)
    docs, dual = passages(corpus), language_passages(corpus, fallback=True).select("id", "doc_id", "lang")
    en, ja = (checkpointed(bm25_ranking(one_language(spark, sf, x), asked)) for x in ("en", "ja"))  # each is read by several
    both = checkpointed(bm25_ranking(docs, asked))
    query_vectors = _drawn(spark, sf, asked.select("query_id"), "query_id")
    vectors = checkpointed(_drawn(spark, sf, dual, "id").select("doc_id", "lang", "embedding"))
    one, two = (checkpointed(vector_ranking(v, query_vectors)) for v in (vectors.where("lang = 'en'"), vectors))
    fused = top(minmax_fusion([(en, 0.5), (ja, 0.5)]), 50, [F.desc("score"), F.asc("doc_id")])
    mixed = checkpointed(rrf([(two, 1.0), (both, 1.0)]))
    configs = [
        ("bm25 en", en), ("bm25 ja", ja), ("bm25 both", both), ("vector en", one), ("vector dual", two), ("rrf en ja", rrf([(en, 1.0), (ja, 1.0)])), ("minmax en ja", fused), ("rrf dual ja", rrf([(two, 1.0), (ja, 1.0)])), ("rrf dual both", mixed),
        ("rrf dual both ja", rrf([(two, 1.0), (both, 1.0), (ja, 1.0)])), ("rrf dual both, reranked", reranked(mixed, asked, docs)),
    ]
    return reduce(DataFrame.unionByName, [summary(_judged(spark, sf, r), []).withColumn("config", F.lit(name)) for name, r in configs])


def q_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: groups of rules for all questions, by vectors, BM25 and glossary."""
    asked = every_question_of(spark, sf)
    return _flat(search(index_of(spark, sf, asked), asked))


def q_hybrid_reranked(spark: SparkSession, sf: str) -> DataFrame:
    asked = asked_of(spark, sf)
    return _flat(search(index_of(spark, sf, asked), asked, rerank=True))


def q_hybrid_section(spark: SparkSession, sf: str) -> DataFrame:
    """The same as q_hybrid inside one section: vectors and terms filtered before they are ranked, BM25 after it is scored."""
    asked = every_question_of(spark, sf)
    return _flat(search(index_of(spark, sf, asked), asked, section="702"))


def q_search_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Searches for the numbers that the glossary names, which are looked up, and for its terms, which are not."""
    g = glossary_of(spark, sf).where("definition_en != ''")
    named = g.select(F.explode("rules").alias("text")).dropna().distinct().unionByName(g.select(F.lower("term_en").alias("text")).distinct())
    return _flat(search(index_of(spark, sf), named.select(F.col("text").alias("query_id"), "text"), groups=3))


def _flat(groups: DataFrame) -> DataFrame:
    return groups.select("query_id", "group_rank", "parent", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"), F.array_join(F.transform("rules", lambda r: r.doc_id), " ").alias("rules"))


def q_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups found by a question or by the terms it contains, with their texts, as given to a generator."""
    index = index_of(spark, sf)
    queries = question_queries(checkpointed(asked_of(spark, sf)), index.terms)
    found = multi_query_groups(search(index, queries.select("query_id", "text")), queries)
    shown = F.array_join(F.transform("rules", lambda r: F.concat_ws("|", r.number, F.coalesce(r.text_en, F.lit("")), F.coalesce(r.text_ja, F.lit("-")))), "\n")
    return contexts(found, corpus_of(spark, sf)).select("question_id", "place", "parent", F.size("rules").alias("n_rules"), F.md5(shown).alias("md5"))


def _evaluated(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """The questions asked, or all there are, but those on cards: query_id, text, category, and the rules that are relevant and that must be cited. Stored, as searches and judgements read them."""
    plain = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), rule_number)))
    rows = records_of(spark, sf).where(F.col("category") != "card_interactions")
    if not every:
        rows = rows.where(_TWENTIETH)
    return checkpointed(rows.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "category", plain("retrieval_relevant_rules").alias("relevant"), plain("evaluation_criteria.must_cite_rules").alias("must")))


def _searched(spark: SparkSession, sf: str, asked: DataFrame, several: bool) -> DataFrame:
    """What searches find: question_id, query_ord, group_rank, parent and the numbers of the group, for the questions (query_id, text)."""
    asked = asked.select("query_id", "text")
    index = index_of(spark, sf)
    queries = question_queries(asked, index.terms, rephrasings_of(spark, sf)) if several else asked.select("query_id", F.col("query_id").alias("question_id"), F.lit(0).alias("query_ord"), "text")
    found = search(index, queries.select("query_id", "text"), groups=5).join(queries.select("query_id", "question_id", "query_ord"), "query_id")
    return found.select("question_id", "query_ord", "group_rank", "parent", F.transform("rules", lambda r: r.doc_id).alias("numbers"))


def rephrasings_of(spark: SparkSession, sf: str) -> DataFrame:
    """id, queries: other wordings of a question; here those facts of its answer that have words."""
    facts = F.filter("expected_answer.key_facts", lambda f: F.coalesce(F.trim(f), F.lit("")) != "")
    return records_of(spark, sf).select("id", facts.alias("queries")).where("size(queries) > 0")


def _wanted(asked: DataFrame) -> DataFrame:
    return asked.select(F.col("query_id").alias("question_id"), "category", "relevant", "must")


def _group_eval(spark: SparkSession, sf: str, asked: DataFrame, several: bool = False) -> DataFrame:
    return judged_groups(_searched(spark, sf, asked, several), _wanted(asked))


def q_group_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the relevant rules and of those that must be cited over the groups found, and the rank of the first group that holds a relevant one, for all questions."""
    return _group_eval(spark, sf, _evaluated(spark, sf, every=True))


def q_group_eval_several(spark: SparkSession, sf: str) -> DataFrame:
    """The same where a question is also asked by its terms and in other words: what any of them finds counts, the rank is that of the first."""
    return _group_eval(spark, sf, _evaluated(spark, sf), several=True)


def q_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return group_summary(_group_eval(spark, sf, _evaluated(spark, sf)))


def q_group_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of which less than half was found, with what was expected and the groups that were got."""
    asked = _evaluated(spark, sf)
    found = checkpointed(_searched(spark, sf, asked, False))  # read twice
    return group_misses(found, _wanted(asked)).select("question_id", "recall", F.array_join("expected", " ").alias("expected"), F.array_join("got", " ").alias("got"))


def _scored_answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, the answers they hold, and scores of them: facts stated, two points each. Answers of every 11th and scores of every 13th question are withheld."""
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    r = records_of(spark, sf).where("category != 'card_interactions'")
    facts = F.size(F.filter(F.coalesce("expected_answer.key_facts", F.array().cast("array<string>")), lambda f: F.coalesce(F.trim(f), F.lit("")) != ""))
    answers = r.where(number % 11 != 0).select("id", F.col("expected_answer.conclusion").alias("conclusion"))
    scores = r.where(number % 13 != 0).select("id", F.least(F.lit(10), facts * 3).alias("score"))
    return r.select("id", "category", F.col("id").alias("ord")), answers, scores


def q_answer_report(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the questions that are answered and scored, over all and by category."""
    return score_report(scored_questions(*_scored_answers(spark, sf)), "category")


def q_unanswered(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that lack an answer or a score, with what they lack."""
    return unfinished(*_scored_answers(spark, sf))


def q_first_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The first question of each category whose answer passes, as an example."""
    return first_passes(scored_questions(*_scored_answers(spark, sf))).select("category", "id", "score", "conclusion")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

# --- SQL ----------------------------------------------------------------------------------------------------


#: Characters whose compatibility form is one other character: what SQL can fold by translation. An ellipsis becomes three stops.
_COMPAT = [(c, n) for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x10000))) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != unicodedata.normalize("NFC", c)]


def _plain(x: str) -> str:
    folded = f"translate(replace({x}, '…', '...'), '{''.join(c for c, _ in _COMPAT)}', '{''.join(n for _, n in _COMPAT).replace(chr(39), chr(39) * 2)}')"
    return f"lower(nfc_normalize({folded}))"


def _tok(x: str) -> str:
    """Tokens as the engine is to make them, from the rule and not from the operator's constants."""
    p = _plain(f"coalesce({x}, '')")
    run = "case when length(c) = 1 then [c] else list_transform(range(1, length(c)), lambda i: substr(c, i::int, 2)) end"
    return f"list_concat(regexp_extract_all({p}, '[0-9]{{3}}\\.[0-9]+[a-z]?|[0-9]+[a-z]?|[a-z][a-z'']*'), flatten(list_transform(regexp_extract_all({p}, '[\u3040-\u30ff\u3400-\u9fff]+'), lambda c: {run})))"


def _refs(x: str, what: str) -> str:
    """References in a definition as a sorted list in a text."""
    p = f"translate(coalesce({x}, ''), '{_WIDE}\u3000', '{_ASCII} ')"
    if what == "sections":
        found = f"list_filter(regexp_extract_all({p}, 'rules? ([0-9]{{3}}(?:\\.[0-9]|[0-9])?)', 1), lambda m: length(m) = 3)"
    else:
        first = "regexp_extract(m, '^[0-9]{3}\\.[0-9]+([a-z])', 1)"
        codes = f"list_filter(range(ascii({first}), greatest(ascii({first}), ascii(right(m, 1))) + 1), lambda c: c not in (108, 111))"
        each = f"case when {first} = '' then [m] else list_transform({codes}, lambda c: regexp_extract(m, '^[0-9]{{3}}\\.[0-9]+') || chr(c::int)) end"
        found = f"flatten(list_transform(regexp_extract_all({p}, '[0-9]{{3}}\\.[0-9]+(?:[a-z](?:{_SPACES}*[–—-]{_SPACES}*[a-z])?)?'), lambda m: {each}))"
    return f"array_to_string(list_sort(list_distinct({found})), ' ')"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACES}+', ' ', 'g'), ' ')"


_PARENT = "regexp_replace({0}, '^([0-9]{{3}}\\.[0-9]+)[a-z]$', '\\1')"


def _parent(x: str) -> str:
    return _PARENT.format(x)


def _key(x: str) -> str:
    return f"cast(substr({x}, 1, 3) as int), coalesce(cast(nullif(regexp_extract({x}, '\\.([0-9]+)', 1), '') as int), 0), regexp_extract({x}, '([a-z])$', 1)"


_TWENTIETH_SQL = " where cast(regexp_extract(id, '([0-9]+)$', 1) as int) % 20 = 0"
_BASE = f"""
corp as (select distinct number, text_en, text_ja, section, category from corpus),
recs as (select * from questions qualify row_number() over (partition by id order by loaded_at desc nulls last, question) = 1),
asked as (select id as query_id, question as text from recs{_TWENTIETH_SQL}),
passages as (select number as doc_id, number || ' ' || coalesce(text_en, '') || case when coalesce(text_ja, '') <> '' then chr(10) || text_ja else '' end as text from corp),
en as (select number as doc_id, number || ' ' || text_en as text from corp where coalesce(text_en, '') <> ''),
ja as (select number as doc_id, number || ' ' || text_ja as text from corp where coalesce(text_ja, '') <> ''),
relevant as (select distinct id as query_id, {_number('m')} as doc_id from (select id, unnest(retrieval_relevant_rules) as m from recs)),
wanted as (select * from relevant where doc_id is not null and query_id in (select query_id from asked)),
gloss as (select distinct term_en, term_ja, definition_en, definition_ja, rules, sections from glossary)"""
_EVERY = _BASE.replace(_TWENTIETH_SQL, "")


def _bm(p: str, docs: str, queries: str, k: int, keep: str = "true") -> str:
    return f"""
{p}_len as (select doc_id, list, len(list) as dl from (select doc_id, {_tok('text')} as list from {docs})),
{p}_stat as (select count(*) as n, avg(dl) as avgdl from {p}_len),
{p}_post as (select doc_id, dl, token, count(*) as tf from (select doc_id, dl, unnest(list) as token from {p}_len) group by all),
{p}_raw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select token, count(*) as df from {p}_post group by 1), {p}_stat),
{p}_idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from {p}_raw) else raw end as idf from {p}_raw),
{p}_q as (select query_id, token, count(*) as qtf from (select query_id, unnest({_tok('text')}) as token from {queries}) group by all),
{p}_score as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from {p}_post join {p}_idf using (token) join {p}_q using (token), {p}_stat group by 1, 2),
{p} as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {p}_score where score > 0 and {keep} qualify rank <= {k})"""


def _vec(where: str = "true", item: str = "vec_id") -> str:
    return f"""with scored as (select q.vec_id as query_id, {item.replace('vec_id', 'd.vec_id')} as doc_id, list_dot_product(d.embedding::double[], q.embedding::double[]) as s
  from embeddings d, embeddings q where q.vec_id % 20 = 0 and {where}),
best as (select query_id, doc_id, round(max(s), 6) as score from scored group by 1, 2)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from best qualify rank <= 10"""


def _rrf(name: str, systems: list[tuple[str, float]]) -> str:
    union = " union all ".join(f"select query_id, doc_id, {i} as system, rank, {w}::double / (60 + rank) as part from {s}" for i, (s, w) in enumerate(systems))
    return f"""
{name}_f as (select query_id, doc_id, round(sum(part), 9) as score, min((system, rank)) as first from ({union}) group by 1, 2),
{name} as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from {name}_f)"""


def _minmax(name: str, systems: list[tuple[str, float]]) -> str:
    part = " union all ".join(
        f"select query_id, doc_id, {w} * (score - min(score) over p) / case when max(score) over p = min(score) over p then 1.0 else max(score) over p - min(score) over p end as part from {s} window p as (partition by query_id)" for s, w in systems
    )
    return f"\n{name} as (select query_id, doc_id, round(sum(part), 6) as score from ({part}) group by 1, 2)"


def _judge(name: str, ranking: str, k: int = 10) -> str:
    return f"""
{name} as (select w.query_id, count(*) as n_relevant, count(r.rank) as found, round(count(r.rank) / count(*), 6) as recall, cast(count(r.rank) > 0 as int) as hit, round(coalesce(1.0 / min(r.rank), 0), 6) as rr
  from wanted w left join (select * from {ranking} where rank <= {k}) r using (query_id, doc_id) group by 1)"""


_SUM = "count(*) as n_queries, round(avg(recall), 6) as recall, round(avg(hit), 6) as hit_rate, round(avg(rr), 6) as mrr"

_GROUPS = f"""
members as (select number as doc_id, {_parent('number')} as parent from corp),
hits as (select h.query_id, h.doc_id, h.score, h.rank, m.parent from {{0}} h join members m using (doc_id) where m.parent in (select doc_id from members)),
folded as (select query_id, parent, min(rank) as first, max(score) as score, string_agg(doc_id, ' ' order by rank) as matched from hits group by 1, 2),
whole as (select parent, string_agg(doc_id, ' ' order by {_key('doc_id')}, doc_id) as rules from members group by 1),
groups as (select query_id, row_number() over (partition by query_id order by first) as group_rank, parent, round(score, 6) as score, matched, rules from folded join whole using (parent) qualify group_rank <= 7)"""

_TERMS = f"""
nums as (select distinct number from corp),
named as (select term_en as ord, pos, {_number('m')} as number from (select term_en, unnest(rules) as m, generate_subscripts(rules, 1) as pos from gloss)),
known as (select * from named where number in (select number from nums)),
explicit as (select ord, list(number order by pos) as rules from (select ord, number, min(pos) as pos from known group by 1, 2) group by 1),
parents as (select number, substr(number, 1, 3) as section, row_number() over (partition by substr(number, 1, 3) order by {_key('number')}) as place, count(*) over (partition by substr(number, 1, 3)) as size
  from nums where {_parent('number')} = number and regexp_matches(number, '^[^.]*\\.[0-9]+$')),
secs as (select ord, section, min(pos) as pos from (select term_en as ord, regexp_extract({_plain('s')}, '([0-9]{{3}})', 1) as section, pos from (select term_en, unnest(sections) as s, generate_subscripts(sections, 1) as pos from gloss)) group by 1, 2),
section as (select s.ord, list(p.number order by s.pos, p.place, p.number) as rules from secs s join parents p using (section) where place <= 8 and not exists (select 1 from known k where k.ord = s.ord and k.number = p.number) group by 1),
words as (select term_en as ord, 0 as lang, trim({_plain('term_ja')}) as term from gloss union all select term_en, 1, trim({_plain('term_en')}) from gloss),
terms as (select term, 'explicit' as kind, ord, lang, rules from words join explicit using (ord) where term <> '' union all select term, 'section', ord, lang, rules from words join section using (ord) where term <> ''),
tq as (select term_en as query_id, term_en || ' ' || coalesce(term_ja, '') || coalesce(' ' || definition_en, '') as text from gloss)"""


def _hits(queries: str) -> str:
    return f"(select distinct q.query_id, t.term from (select query_id, {_plain('text')} as q from {queries} where text is not null) q join (select distinct term from terms) t on contains(q.q, t.term))"


def _gloss_rank(queries: str, kind: str) -> str:
    return f"""select query_id, doc_id, row_number() over (partition by query_id order by first, doc_id) as rank from (
  select query_id, doc_id, min((len, ord, lang, pos)) as first from (select h.query_id, -length(t.term) as len, t.ord, t.lang, unnest(t.rules) as doc_id, generate_subscripts(t.rules, 1) as pos
  from {_hits(queries)} h join terms t using (term) where t.kind = '{kind}') group by 1, 2)"""


def _draw_sql(inside: str = "true", name: str = "v", langs: tuple[str, ...] = ("en", "ja"), fallback: bool = False, shared: bool = True) -> str:
    """The 50 rules whose drawn vectors are nearest; with fallback a rule without Japanese has its English text twice."""
    place = "('0x' || substr(md5({0}), 1, 8))::bigint % (select max(vec_id) + 1 from embeddings)"
    source = {"en": "en", "ja": "(select doc_id from en union select doc_id from ja)" if fallback else "ja"}
    ids = " union all ".join(f"select doc_id, {place.format(f"doc_id || '#{x}'")} as vec_id from {source[x]}" for x in langs)
    asked = f"""
query_vec as (select query_id, embedding::double[] as e from (select query_id, {place.format("query_id")} as vec_id from asked) join embeddings using (vec_id)),"""
    return f"""{asked if shared else ''}
rule_{name} as (select doc_id, embedding::double[] as e from ({ids}) join embeddings using (vec_id) where {inside}),
{name} as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(max(list_dot_product(r.e, q.e)), 6) as score from rule_{name} r, query_vec q group by 1, 2) qualify rank <= 50)"""


#: The rankings of q_ablation, as SQL names them.
_ABLATION = {"a": "bm25 en", "b": "bm25 ja", "c": "bm25 both", "ve": "vector en", "vd": "vector dual", "f": "rrf en ja", "m": "minmax en ja", "x": "rrf dual ja", "y": "rrf dual both", "z": "rrf dual both ja", "rr": "rrf dual both, reranked"}
_DRAWN = _draw_sql()

_SECOND = f"""
second as (select query_id, string_agg(term, ' ' order by n) as text from (select h.query_id, h.term, row_number() over (partition by h.query_id order by -length(h.term), o.first, h.term) as n
  from {_hits('asked')} h join (select term, min((ord, lang)) as first from terms group by 1) o using (term)) where n <= 4 group by 1)"""


def _eval(queries: str, every: bool = False) -> str:
    """Groups found for queries (query_id, question_id, query_ord, text) of the questions asked, or of all, but those on cards, judged."""
    plain = lambda c: f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda m: {_number('m')}), lambda n: n is not null))"
    share = "round(len(list_intersect({0}, got)) / len({0}), 6)"
    return f"""{_BASE.replace(_TWENTIETH_SQL, f"{' where' if every else f'{_TWENTIETH_SQL} and'} category <> 'card_interactions'")},{_TERMS},{_SECOND},
qs as ({queries}),
{_bm('r', 'passages', 'qs', 50)}, g as ({_gloss_rank('qs', 'explicit')}),{_rrf('f', [('r', 1.0), ('g', 1.0)])},{_GROUPS.replace('{0}', 'f').replace('<= 7', '<= 5')},
found as (select question_id, query_ord, group_rank, parent, string_split(rules, ' ') as numbers from groups join qs using (query_id)),
lists as (select id as question_id, category, {plain('retrieval_relevant_rules')} as relevant, {plain('evaluation_criteria.must_cite_rules')} as must from recs where id in (select query_id from asked)),
got as (select question_id, list_distinct(flatten(list(numbers))) as got from found group by 1),
firsts as (select question_id, min(group_rank) as first from found join lists using (question_id) where query_ord = 0 and len(list_intersect(numbers, relevant)) > 0 group by 1),
judged as (select question_id, category, len(relevant)::int as n_relevant, len(must)::int as n_must, {share.format('relevant')} as recall, case when len(must) > 0 then {share.format('must')} end as must_recall, round(coalesce(1.0 / first, 0), 6) as rr
  from (select l.*, coalesce(g.got, []) as got from lists l left join got g using (question_id)) left join firsts using (question_id) where len(relevant) > 0)"""


_ONE = "select query_id, query_id as question_id, 0 as query_ord, text from asked"
_EVAL_ONE, _EVAL_EVERY = _eval(_ONE), _eval(_ONE, every=True)
_EVAL_SEVERAL = _eval(
    """select query_id || '#0' as query_id, query_id as question_id, 0 as query_ord, text from asked union all select query_id || '#1', query_id, 1, text from second
  union all select id || '#' || (pos + 1), id, pos + 1, text from (select id, unnest(facts) as text, generate_subscripts(facts, 1) as pos from (select id, list_filter(expected_answer.key_facts, lambda k: coalesce(trim(k, ' '), '') <> '') as facts from recs)) where id in (select query_id from asked)"""
)

_ANSWERS = f"""{_BASE}, qq as (select id, category, expected_answer, cast(regexp_extract(id, '([0-9]+)$', 1) as int) as k from recs where category <> 'card_interactions'),
answers as (select id, expected_answer.conclusion as conclusion from qq where k % 11 <> 0),
scores as (select id, least(10, 3 * len(list_filter(coalesce(expected_answer.key_facts, []), lambda k: coalesce(trim(k, ' '), '') <> ''))) as score from qq where k % 13 <> 0),
done as (select id, category, conclusion, score from qq join answers using (id) join scores using (id))"""

_NEWEST = f"""with {_SNAPSHOTS},
top_seq as (select language, max(seq) as seq from chosen group by 1),
lasts as (select s.*, e.section, e.category from snaps s join top_seq using (language, seq) join (select distinct delivery_id, {_number('number')} as number, ord, text, coalesce(section, '') as section, coalesce(category, '') as category from rule_entries) e
  on e.ord = s.ord and e.number is not distinct from s.number and e.text is not distinct from s.text and e.delivery_id = (select delivery_id from chosen c where c.language = s.language and c.seq = s.seq))"""

_DOCS = "docs as (select doc_id, text from documents), items as (select item_id as query_id, text from eval_items where item_id % 20 = 0)"

SQL = {
    "q_tokenize_counts": f"select doc_id, len(list) as n_tokens, len(list_distinct(list)) as n_distinct from (select doc_id, {_tok('text')} as list from documents)",
    "q_bm25_rules": f"with {_BASE},{_bm('r', 'passages', 'asked', 50)} select * from r",
    "q_bm25_documents": f"with {_DOCS},{_bm('r', 'docs', 'items', 10)} select * from r",
    "q_bm25_section": f"with {_BASE},{_bm('r', 'passages', 'asked', 10, chr(39).join(('substr(doc_id, 1, 3) = ', '702', '')))} select * from r",
    "q_vector_topk": _vec(),
    "q_vector_filtered": _vec("d.label = 3"),
    "q_vector_best_of_item": _vec(item="vec_id // 2"),
    "q_rrf": f"with {_BASE},{_bm('a', 'en', 'asked', 50)},{_bm('b', 'ja', 'asked', 50)},{_rrf('f', [('a', 1.0), ('b', 1.0)])} select * from f",
    "q_rrf_weighted_vectors": f"""with {_DOCS},{_bm('b', 'docs', 'items', 50)},
vs as (select q.vec_id + 1000 as query_id, d.vec_id as doc_id, round(list_dot_product(d.embedding::double[], q.embedding::double[]), 6) as score from embeddings d, embeddings q where q.vec_id + 1000 in (select query_id from items)),
a as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs qualify rank <= 50),{_rrf('f', [('a', 0.7), ('b', 1.0)])} select * from f""",
    "q_minmax_fuse": f"with {_BASE},{_bm('a', 'en', 'asked', 50)},{_bm('b', 'ja', 'asked', 50)},{_minmax('f', [('a', 0.5), ('b', 0.5)])} select * from f",
    "q_group_by_parent": f"with {_BASE},{_bm('r', 'passages', 'asked', 50)},{_GROUPS.replace('{0}', 'r')} select * from groups",
    "q_direct_lookup": f"""with {_BASE}, named as (select distinct text from (select unnest(rules) as text from glossary union all select unnest(sections) from glossary) where text is not null),
pref as (select text as query_id, regexp_extract({_plain('text')}, '^\\s*([0-9]{{3}}(?:\\.[0-9]+[a-z]?)?)\\.?\\s*$', 1) as prefix from named),
hit as (select distinct query_id, number, prefix from pref, (select distinct number from corp) where prefix <> '' and (number = prefix or substr(number, 1, 3) = prefix or {_parent('number')} = prefix))
select query_id, number as doc_id, 1.0::double as score, row_number() over (partition by query_id order by number <> prefix, {_key('number')}) as rank from hit""",
    "q_number_sort": f"with {_BASE} select number, {_parent('number')} as parent, row_number() over (partition by substr(number, 1, 3) order by {_key('number')}) as place from corp",
    "q_term_table": f"with {_BASE},{_TERMS} select term, kind, lang, ord, array_to_string(rules, ' ') as rules from terms",
    "q_glossary_match": f"with {_BASE},{_TERMS} select * from {_hits('tq')}",
    "q_glossary_ranking": f"with {_BASE},{_TERMS} {_gloss_rank('tq', 'explicit')}",
    "q_section_expansion": f"with {_BASE},{_TERMS} {_gloss_rank('tq', 'section')}",
    "q_secondary_query": f"""with {_BASE},{_TERMS}, ordered as (select h.query_id, h.term, row_number() over (partition by h.query_id order by -length(h.term), o.first, h.term) as n
  from {_hits('tq')} h join (select term, min((ord, lang)) as first from terms group by 1) o using (term)) select query_id, string_agg(term, ' ' order by n) as text from ordered where n <= 4 group by 1""",
    "q_bilingual": f"""{_NEWEST}, e as (select * from lasts where language = 'en' qualify row_number() over (partition by number order by ord, text) = 1),
j as (select number, text as text_ja from lasts where language = 'ja' and number is not null qualify row_number() over (partition by number order by ord desc, text desc) = 1)
select e.number, e.text as text_en, e.section, e.category, j.text_ja from e left join j using (number)""",
    "q_coverage_check": f"""{_NEWEST}, e as (select distinct number from lasts where language = 'en' and number is not null), j as (select distinct number from lasts where language = 'ja' and number is not null),
n as (select (select count(*) from e) as n_en, (select count(*) from j) as n_ja, (select count(*) from e join j using (number)) as n_both) select n_en, n_ja, round(n_both / n_ja, 6) as coverage, least(n_en, n_ja) >= 100 and n_both / n_ja >= 0.8 as passed from n""",
    "q_glossary_merge": f"""with {_BASE}, e as (select * from gloss where definition_en <> ''), j as (select * from gloss where term_ja is not null)
select coalesce(e.term_en, upper(j.term_en)) as term_en, j.term_ja, coalesce(e.definition_en, '') as definition_en, j.definition_ja,
  coalesce((select string_agg(x, ' ' order by i) from (select x, min(i) as i from (select unnest(e.rules) as x, generate_subscripts(e.rules, 1) as i) group by 1)), '') as rules,
  coalesce((select string_agg(x, ' ' order by i) from (select x, min(i) as i from (select unnest(j.sections) as x, generate_subscripts(j.sections, 1) as i) group by 1)), '') as sections
from e full join j on lower(e.term_en) = lower(j.term_en)""",
    "q_parse_rules": """with rows as (select * from rule_entries),
firsts as (select delivery_id as doc, ord::bigint * 1000 + 1 as base, min(string_split(concat_ws('. ', trim(number, ' '), text), chr(10))) as parts from rows group by 1, 2),
lines as (select doc, base + generate_subscripts(parts, 1) - 1 as line_no, trim(unnest(parts), ' ') as line from firsts
  union all select delivery_id, ord::bigint * 1000, min(section || '. ' || category) from rows where section is not null and category <> '' group by 1, 2),
marked as (select *, regexp_matches(line, '^[0-9]{3}\\.[0-9]+[a-z]?\\.?\\s+.+$') as is_rule from lines),
filled as (select *, last_value(case when not is_rule and regexp_matches(line, '^[0-9]{3}\\.\\s+.+$') then regexp_extract(line, '^[0-9]{3}\\.\\s+(.+)$', 1) end ignore nulls) over (partition by doc order by line_no rows unbounded preceding) as category from marked)
select doc, number, text, section, coalesce(category, '') as category from (
  select doc, line_no, category, regexp_extract(line, '^([0-9]{3}\\.[0-9]+[a-z]?)', 1) as number, regexp_extract(line, '^[0-9]{3}\\.[0-9]+[a-z]?\\.?\\s+(.+)$', 1) as text, substr(line, 1, 3) as section from filled where is_rule) where line_no < 150999
qualify row_number() over (partition by doc, number order by line_no) = 1""",
    "q_html_lines": f"""with {_BASE}, said as (select number as doc, unnest([(1, number), (2, {_squeezed("coalesce(text_en, '')")}), (3, {_squeezed("coalesce(text_ja, '')")}), (4, '&'), (5, {_squeezed("coalesce(category, '')")})], recursive := false) as x, hash(number, text_en, text_ja, category) as h from corp),
lines as (select doc, h, x[1] as pos, x[2] as line from said where x[2] <> '')
select doc, cast(row_number() over (partition by doc, h order by pos) as int) as line_no, line from lines""",
    "q_glossary_refs": f"with {_BASE} select distinct term_en, {_refs('definition_en', 'rules')} as rules_en, {_refs('definition_en', 'sections')} as sections_en, {_refs('definition_ja', 'rules')} as rules_ja from gloss",
    "q_glossary_en": f"""with g as (select distinct term_en, term_ja, definition_en, definition_ja, concat_ws(' ', effective_date, substr(md5(term_en), 1, 2)) as doc from glossary where term_en is not null)
select doc, trim(term_en, ' ') as term_en, definition_en, {_refs('definition_en', 'rules')} as rules, {_refs('definition_en', 'sections')} as sections from (select doc, term_en, trim(regexp_replace(definition_en, ' *\\n *', ' ', 'g'), ' ') as definition_en from g) where definition_en <> ''""",
    "q_glossary_ja": f"""with g as (select distinct term_en, term_ja, definition_en, definition_ja, concat_ws(' ', effective_date, substr(md5(term_en), 1, 2)) as doc from glossary where term_en is not null)
select doc, {_squeezed('term_en')} as term_en, nullif({_squeezed("coalesce(term_ja, '')")}, '') as term_ja, nullif({_squeezed("coalesce(definition_ja, '')")}, '') as definition_ja, {_refs('definition_ja', 'rules')} as rules from g""",
    "q_question_problems": f"""with {_BASE},
q as (select distinct id, category, question, coalesce(expected_tools, []) as tools, expected_answer.conclusion as conclusion,
  list_filter(list_transform(coalesce(retrieval_relevant_rules, []), lambda m: {_number('m')}), lambda n: n is not null) as relevant,
  list_filter(list_transform(coalesce(expected_answer.rules_cited, []), lambda m: {_number('m')}), lambda n: n is not null) as cited,
  list_filter(list_transform(coalesce(evaluation_criteria.must_cite_rules, []), lambda m: {_number('m')}), lambda n: n is not null) as must from questions),
off as (select id, list_distinct(list_filter(tools, lambda t: t is null or t not in ({', '.join(f"'{t}'" for t in TOOLS)}))) as tools, list_distinct(list_filter(cited, lambda n: not list_contains(relevant, n))) as cited, list_distinct(list_filter(must, lambda n: not list_contains(cited, n))) as must from q)
select id, 'incomplete' as problem, '' as detail from q where coalesce(question, '') = '' or coalesce(conclusion, '') = '' or len(cited) = 0 or len(relevant) = 0 or len(must) = 0
union all select id, 'duplicate id', count(*)::varchar from q group by 1 having count(*) > 1
union all select min(id), 'duplicate question', count(distinct id)::varchar from q where question is not null group by question having count(distinct id) > 1
union all select id, 'category', coalesce(category, '') from q where coalesce(category, '') not in ({', '.join(f"'{c}'" for c in CATEGORIES)})
union all select id, 'tools', array_to_string(list_sort(tools), ' ') from off where len(tools) > 0
union all select id, 'cited not relevant', array_to_string(list_sort(cited), ' ') from off where len(cited) > 0
union all select id, 'required not cited', array_to_string(list_sort(must), ' ') from off where len(must) > 0
union all select id, 'unknown rule', n from (select id, unnest(list_distinct(list_concat(cited, relevant))) as n from q) where n not in (select number from corp)""",
    "q_blocks": """with lines as (select doc_id, generate_subscripts(p, 1) as line_no, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)),
b as (select *, cast(count(*) filter (line = '') over (partition by doc_id order by line_no rows unbounded preceding) as int) as block from lines)
select doc_id, block, cast(count(*) as int) as n_lines, cast(sum(length(line)) + count(*) - 1 as int) as n_chars from b where line <> '' group by 1, 2""",
    "q_keep_first": "select delivery_id, number, ord, text from rule_entries where number is not null qualify row_number() over (partition by delivery_id, number order by ord, text nulls first) = 1",
    "q_keep_last": f"with {_BASE} select id, question, loaded_at from recs",
    "q_forward_fill": "select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as last_signup from events",
    "q_nth_occurrence": "select event_id, user_id from events where event_type = 'signup' qualify row_number() over (partition by user_id order by event_id) = 2",
    "q_lead_segments": "select delivery_id, ord, min(number) as number, lead(min(number)) over (partition by delivery_id order by ord) as next_number from rule_entries where number is not null group by 1, 2",
    "q_rule_refs": f"""select number, count(distinct doc_id) as n_documents from (select doc_id, unnest(regexp_extract_all(regexp_replace({_plain("coalesce(text, '')")}, '([0-9]{{3}}\\.[0-9]+[a-z]?)', ' \\1 ', 'g'), '(?:^|[^0-9.])\\s([0-9]{{3}}\\.[0-9]+[a-z]?)\\s(?:[^a-z0-9]|$)', 1)) as number from documents) group by 1""",
    "q_json_projection": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "q_nfkc": f"with {_BASE} select term_en, {_plain('term_ja')} as term from gloss",
    "q_cards": f"""with {_BASE}, k as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as int) as n, list_filter(expected_answer.key_facts, lambda f: true) as facts from recs),
c as (select id, n % 17 = 0 as cut, cards[1].en as name, cards[1].ja as printed_name, case when n % 2 = 0 then expected_answer.conclusion else '' end as said, facts, category from k)
select id as key, case when cut or name is null then 'error' else 'ok' end as status, case when not cut then name end as name, case when not cut then printed_name end as printed_name,
  case when cut then '' else coalesce(nullif(said, ''), array_to_string(list_transform(coalesce(facts, []), lambda f: coalesce(f, '')), chr(10) || '//' || chr(10)), '') end as oracle_text,
  case when not cut then length(facts[1])::varchar end as power, case when cut then '' else category end as keywords from c""",
    "q_with_rulings": f"""with {_BASE}, named as (select unnest(cards) as c, category, question from recs), keys as (select distinct c.en as key from named where c.en is not null)
select key, case when comment is null then 0 else 1 end::int as n, source, case when comment is not null then '' end as published_at, comment from (select k.key, category as source, coalesce(question, '') as comment from keys k left join named n on n.c.en = k.key)""",
    "q_keyword_rules": f"""with {_BASE}, cards0 as (select distinct term_en as key from gloss), lasts as (select lower(term_en) as kw, coalesce(nullif(array_to_string(list_filter(rules, lambda r: r is not null), ' '), ''), '-') as rules from gloss qualify row_number() over (partition by lower(term_en) order by term_en desc) = 1)
select key, upper(key) as keyword, coalesce(l.rules, '-') as rules from cards0 left join lasts l on l.kw = lower(key) union all select key, 'No such term', '-' from cards0""",
    "q_find_cards": f"""with {_BASE}, names as (select distinct c.en as name from (select unnest(cards) as c from recs) where c.en is not null),
asks as (select distinct query from (select substr(name, 2, length(name) - 2) as query from names union all select substr(name, 1 + length(name) // 2) || substr(name, 1, length(name) // 2) from names) where query <> ''),
near as (select query, name, levenshtein(lower(query), lower(name)) as distance from asks, names where abs(length(query) - length(name)) * 3 <= length(query)),
best as (select * from near where distance * 3 <= length(query) qualify row_number() over (partition by query order by distance, name) = 1)
select a.query, b.name, b.distance::int as distance, case when b.name is null then 'not_found' else 'ok' end as status from asks a left join best b using (query)""",
    "q_jsonl_errors": f"""with {_BASE}, k as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as int) as n from recs)
select category as file, n as line_no, case when n % 19 <> 0 then id end as id, case when n % 19 = 0 then substr('{{"id":"' || id || '"', 1, 7) end as error from k""",
    "q_glossary_counts": f"""with {_BASE} select count(*) as n_terms, count(term_ja) as n_ja, count(*) filter (len(rules) > 0) as n_rules, count(*) filter (term_en <> '' and ascii(term_en) < 128) as n_plain,
  (select sum(1 + cast(coalesce(text_ja, '') <> '' as int)) from corp)::bigint as n_vectors from gloss""",
    "q_passages": f"""with {_BASE}, t as (select number, section, 'en' as lang, text_en as t from corp union all select number, section, 'ja', text_ja from corp)
select number || '#' || lang as id, lang, section, length(number || ' ' || t) as n_chars, sha256(number || ' ' || t) as sha256 from t where coalesce(t, '') <> ''""",
    "q_percentiles": "select source, list_sort(list(n_chars))[least(floor(count(n_chars) * 0.5), count(n_chars) - 1)::int + 1] as p50, list_sort(list(n_chars))[least(floor(count(n_chars) * 0.95), count(n_chars) - 1)::int + 1] as p95 from documents where n_chars is not null group by 1",
    "q_recall_mrr": f"with {_BASE},{_bm('r', 'passages', 'asked', 50)},{_judge('j', 'r')} select * from j",
    "q_category_recall": f"with {_BASE},{_bm('r', 'passages', 'asked', 50)},{_judge('j', 'r')} select category, {_SUM} from j join recs on recs.id = j.query_id group by 1",
    "q_misses": f"with {_BASE},{_bm('r', 'passages', 'asked', 50)},{_judge('j', 'r')} select j.query_id, j.recall, string_agg(w.doc_id, ' ' order by w.doc_id) as expected from j join wanted w using (query_id) where recall < 0.5 group by 1, 2",
    "q_score_report": f"""with {_BASE},{_bm('r', 'passages', 'asked', 50)},{_judge('j', 'r')}, s as (select category, cast(floor(recall * 10) as int) as score from j join recs on recs.id = j.query_id)
select category, grouping(category) as is_total, count(score) as n, count(*) filter (score >= 7) as passed, round(avg(cast(score >= 7 as double)), 6) as pass_rate, round(avg(score), 6) as mean, median(score) as median from s group by rollup (category)""",
    "q_ablation": f"""with {_BASE},{_draw_sql(name='vd', fallback=True)},{_draw_sql(name='ve', langs=('en',), fallback=True, shared=False)},{_bm('a', 'en', 'asked', 50)},{_bm('b', 'ja', 'asked', 50)},{_bm('c', 'passages', 'asked', 50)},{_rrf('f', [('a', 1.0), ('b', 1.0)])},{_rrf('x', [('vd', 1.0), ('b', 1.0)])},{_rrf('y', [('vd', 1.0), ('c', 1.0)])},{_rrf('z', [('vd', 1.0), ('c', 1.0), ('b', 1.0)])},
{_minmax('m0', [('a', 0.5), ('b', 0.5)])}, m as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m0 qualify rank <= 50),
cut as (select c.query_id, c.doc_id, c.rank as old, round(len(list_intersect(q.t, p.t)) / greatest(1, len(q.t)), 9) as s from y c
  join (select query_id, list_distinct({_tok('text')}) as t from asked) q using (query_id) join (select doc_id, list_distinct({_tok('text')}) as t from passages) p using (doc_id) where c.rank <= 50),
rr as (select query_id, doc_id, row_number() over (partition by query_id order by s desc, old) as rank from cut),
{','.join(_judge('j_' + r, r) for r in _ABLATION)}
{' union all '.join(f"select '{name}' as config, {_SUM} from j_{r}" for r, name in _ABLATION.items())}""",
    "q_hybrid": f"with {_EVERY},{_TERMS},{_DRAWN},{_bm('r', 'passages', 'asked', 50)}, g as ({_gloss_rank('asked', 'explicit')}),{_rrf('f', [('v', 1.0), ('r', 1.0), ('g', 1.0)])},{_GROUPS.replace('{0}', 'f')} select * from groups",
    "q_hybrid_section": f"""with {_EVERY},{_TERMS},{_draw_sql("substr(doc_id, 1, 3) = '702'")},{_bm('r', 'passages', 'asked', 50, "substr(doc_id, 1, 3) = '702'")}, g0 as ({_gloss_rank('asked', 'explicit')}),
g as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from g0 where substr(doc_id, 1, 3) = '702'),{_rrf('f', [('v', 1.0), ('r', 1.0), ('g', 1.0)])},{_GROUPS.replace('{0}', 'f')} select * from groups""",
    "q_hybrid_reranked": f"""with {_BASE},{_TERMS},{_DRAWN},{_bm('r', 'passages', 'asked', 50)}, g as ({_gloss_rank('asked', 'explicit')}), gs as ({_gloss_rank('asked', 'section')}),{_rrf('f', [('v', 1.0), ('r', 1.0), ('g', 1.0), ('gs', 0.3)])},
cut as (select c.query_id, c.doc_id, c.rank as old, round(len(list_intersect(q.t, p.t)) / greatest(1, len(q.t)), 9) as s from f c
  join (select query_id, list_distinct({_tok('text')}) as t from asked) q using (query_id) join (select doc_id, list_distinct({_tok('text')}) as t from passages) p using (doc_id) where c.rank <= 50),
rr as (select query_id, doc_id, 1.0 / rank as score, rank from (select *, row_number() over (partition by query_id order by s desc, old) as rank from cut)),{_GROUPS.replace('{0}', 'rr')} select * from groups""",
    "q_search_numbers": f"""with {_BASE},{_TERMS}, spoken as (select distinct text from (select unnest(rules) as text from gloss where definition_en <> '') where text is not null union select distinct lower(term_en) from gloss where definition_en <> ''),
pref as (select text as query_id, text, regexp_extract({_plain('text')}, '^\\s*([0-9]{{3}}(?:\\.[0-9]+[a-z]?)?)\\.?\\s*$', 1) as prefix from spoken),
words0 as (select query_id, text from pref where prefix = ''),{_bm('r', 'passages', 'words0', 50)}, g as ({_gloss_rank('words0', 'explicit')}),{_rrf('h', [('r', 1.0), ('g', 1.0)])},
hit as (select distinct query_id, number, prefix from pref, (select distinct number from corp) where prefix <> '' and (number = prefix or substr(number, 1, 3) = prefix or {_parent('number')} = prefix)),
f as (select query_id, number as doc_id, 1.0::double as score, row_number() over (partition by query_id order by number <> prefix, {_key('number')}) as rank from hit union all select query_id, doc_id, score, rank from h),{_GROUPS.replace('{0}', 'f').replace('<= 7', '<= 3')} select * from groups""",
    "q_contexts": f"""with {_BASE},{_TERMS},{_SECOND},
qs as (select query_id || '#0' as query_id, query_id as question_id, 0 as query_ord, text from asked union all select query_id || '#1', query_id, 1, text from second),
{_bm('r', 'passages', 'qs', 50)}, g as ({_gloss_rank('qs', 'explicit')}),{_rrf('f', [('r', 1.0), ('g', 1.0)])},{_GROUPS.replace('{0}', 'f')},
placed as (select question_id, parent, row_number() over (partition by question_id order by first, parent) as place from (select question_id, parent, min((query_ord, group_rank)) as first from groups join qs using (query_id) group by 1, 2)),
whole2 as (select {_parent('number')} as parent, count(*)::int as n_rules, md5(string_agg(number || '|' || coalesce(text_en, '') || '|' || coalesce(nullif(substr(text_ja, 1, 600), ''), '-'), chr(10) order by {_key('number')}, number)) as md5 from corp group by 1)
select question_id, place, parent, n_rules, md5 from placed join whole2 using (parent)""",
    "q_group_eval": f"with {_EVAL_EVERY} select * from judged",
    "q_group_eval_several": f"with {_EVAL_SEVERAL} select * from judged",
    "q_group_summary": f"""with {_EVAL_ONE} select category, grouping(category) as is_total, count(*) as n_questions, round(avg(recall), 6) as recall, round(avg(must_recall), 6) as must_recall, round(avg(rr), 6) as mrr from judged group by rollup (category)""",
    "q_group_misses": f"""with {_EVAL_ONE} select question_id, recall, array_to_string(list_sort(relevant), ' ') as expected, coalesce((select string_agg(parent, ' ' order by group_rank) from found f where f.question_id = j.question_id and query_ord = 0), '') as got from judged j join lists using (question_id) where recall < 0.5""",
    "q_answer_report": f"""with {_ANSWERS} select category, grouping(category) as is_total, count(score) as n, count(*) filter (score >= 7) as passed, round(avg(cast(score >= 7 as double)), 6) as pass_rate, round(avg(score), 6) as mean, median(score) as median from done group by rollup (category)""",
    "q_unanswered": f"with {_ANSWERS} select id, category, case when a.id is null and s.id is null then 'answer score' when a.id is null then 'answer' else 'score' end as lacks from qq left join answers a using (id) left join scores s using (id) where a.id is null or s.id is null",
    "q_first_passes": f"with {_ANSWERS} select category, id, score, conclusion from done where score >= 7 qualify row_number() over (partition by category order by id) = 1",
}
