import math
import random

import numpy as np
from pyspark.sql import functions as F

from tomewright import queries_retrieval
from tomewright.functions.text import references
from tomewright.operators import cards, evaluation, glossary, ingest, lookup, ordered, ranking, validation
from tomewright.plans import search
from tomewright.sources import records


def ranks(spark, *lists, query="q"):
    return [spark.createDataFrame([(query, d, i + 1, float(10 - i)) for i, d in enumerate(x)], "query_id string, doc_id string, rank int, score double") for x in lists]


def test_rrf(spark):
    a, b = ranks(spark, "abc", "acb")
    got = ranking.rrf([(a, 1.0), (b, 1.0)]).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "b", "c"] and math.isclose(got[0]["score"], round(2 / 61, 9))
    assert ranking.rrf([(a.limit(0), 1.0)]).count() == 0


def test_minmax(spark, rows):
    a = spark.createDataFrame([("q", "a", 100.0), ("q", "b", 0.0)], "query_id string, doc_id string, score double")
    b = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 1.0)], "query_id string, doc_id string, score double")
    assert rows(ranking.minmax_fusion([(a, 0.5), (b, 0.5)])) == [("q", "a", 0.5), ("q", "b", 0.5)]
    flat = a.withColumn("score", F.lit(3.0))
    assert rows(ranking.minmax_fusion([(flat, 1.0)])) == [("q", "a", 0.0), ("q", "b", 0.0)]


def test_bm25_by_hand(spark):
    docs = {1: "red fox", 2: "red red dog", 3: "", 4: None, 5: "cat"}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.bm25(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame([("q", "fox fox"), ("empty", ""), ("null", None)], "query_id string, text string")).collect()}
    idf = math.log(5 - 1 + 0.5) - math.log(1 + 0.5)
    assert got == {("q", 1): round(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (6 / 5))), 6)}


def test_vectors(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "doc_id int, embedding array<float>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    assert rows(ranking.vector_ranking(v, q, 2).select("doc_id", "rank")) == [(1, 1), (2, 2)]


CORPUS = "number string, text_en string, text_ja string, section string, category string"


def corpus(spark, numbers):
    return spark.createDataFrame([(n, f"text of {n}", "日本語" if n.endswith("a") else None, n[:3], "c") for n in numbers], CORPUS).withColumn("ord", F.struct(F.col("number")))


def test_groups(spark):
    c = corpus(spark, ["702.9", "702.9a", "702.9b", "702.19", "702.2", "999.9a"])
    (r,) = ranks(spark, ["702.9b", "999.9a", "702.19", "702.9a", "702.2"])
    got = ranking.fold_groups(r, search.corpus_members(c), 2).orderBy("group_rank").collect()
    assert [g["parent"] for g in got] == ["702.9", "702.19"]
    assert got[0]["matched"] == ["702.9b", "702.9a"] and [(x["doc_id"], x["score"]) for x in got[0]["rules"]] == [("702.9", 0.0), ("702.9a", 7.0), ("702.9b", 10.0)]


def test_direct_lookup(spark, rows):
    c = corpus(spark, ["702.9", "702.90", "702.9a", "702.10", "702.2"])
    q = spark.createDataFrame([("a", "７０２．９"), ("b", "702"), ("c", "702.77"), ("d", "what is 702.9")], "query_id string, text string")
    got = rows(lookup.direct_lookup(q, c).select("query_id", "rank", "doc_id"))
    assert got == [("a", 1, "702.9"), ("a", 2, "702.9a"), ("b", 1, "702.2"), ("b", 2, "702.9"), ("b", 3, "702.9a"), ("b", 4, "702.10"), ("b", 5, "702.90")]


def test_terms(spark, rows):
    known = spark.createDataFrame([(f"903.{i}",) for i in range(1, 15)] + [(f"500.{i}",) for i in range(1, 4)] + [("100.1",)], "number string")
    g = spark.createDataFrame([("a", "Art", "芸", ["100.1", "999.9"], ["500"]), ("b", "Big Art", None, None, ["903"]), ("c", "None", "", [], None)], "ord string, term_en string, term_ja string, rules array<string>, sections array<string>")
    table = glossary.term_table(g, known, head=4)
    assert rows(table.select("term", "kind", F.array_join("rules", " "))) == [
        ("art", "explicit", "100.1"), ("art", "section", "500.1 500.2 500.3"), ("big art", "section", "903.1 903.2 903.3 903.4"), ("芸", "explicit", "100.1"), ("芸", "section", "500.1 500.2 500.3"),
    ]
    assert glossary.term_table(g, known, head=0).where("term = 'big art'").count() == 0
    q = spark.createDataFrame([("q", "The PARTY with big ART"), ("z", ""), ("n", None)], "query_id string, text string")
    assert rows(glossary.glossary_ranking(q, table)) == [("q", "100.1", 1)]
    assert [r[1] for r in rows(glossary.glossary_ranking(q, table, "section").orderBy("rank"))][:2] == ["500.1", "500.2"]
    assert rows(glossary.secondary_queries(q, table)) == [("q", "big art art")]
    assert glossary.term_table(g.limit(0), known).count() == 0


BOOK = """Title\nContents\n1. Part\n100. General\n200. Cards\nGlossary\nCredits\n\n1. Part\n100. General\n100.1. First rule.\n100.1a Sub rule.\ncontinuation\n200. Cards\n200.1. Card rule.\n704.5k Other.\n704.5m. Another.\n100.1. Again\nGlossary\n\nAlpha\nSee rules 509.1b.\nMore.\n\nLonely\n\nBeta\nA def\n\nCredits\n800.1. After"""


def test_parse_text(spark):
    lines = ingest.lines_of(spark.createDataFrame([("b", "﻿" + BOOK), ("empty", None)], "doc string, text string"))
    got = ingest.parse_rules(lines).orderBy("line_no").collect()
    assert [r["number"] for r in got] == ["100.1", "100.1a", "200.1", "704.5k", "704.5m"]
    assert [r["category"] for r in got] == ["General", "General", "Cards", "Cards", "Cards"] and got[3]["section"] == "704" and got[0]["text"] == "First rule."
    blocks = ingest.glossary_blocks(lines).orderBy("ord").collect()
    assert [(r["term_en"], r["definition_en"], r["rules"]) for r in blocks] == [("Alpha", "See rules 509.1b. More.", ["509.1b"]), ("Beta", "A def", [])]


def test_html(spark, rows):
    html = '<html><script>var x="<p>no</p>";</script><h5>100. 原則</h5><p>100.1. <a href="#">Link</a> <strong>text</strong></p>out<div><p>a</p>b</div><p>one<br>two</p></html>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "doc int, html string")
    assert [r[2] for r in rows(ingest.html_lines(pages))] == ["100. 原則", "100.1. Link text", "a", "one", "two"]
    hard = '<P CLASS="x">a &amp; b &lt;p&gt;<!-- <p>no</p> --> c</p><style>p{}</style><div>1 < 2<BR/>x</div>no<p>\u3000y <pre>z</pre></p><ul>no<li>w</li></ul><div>open<script>if (a < b) {'
    assert [r[1:] for r in rows(ingest.html_lines(spark.createDataFrame([(1, hard)], "doc int, html string")))] == [(1, "a & b <p> c"), (2, "1 < 2"), (3, "x"), (4, "y z"), (5, "w"), (6, "open")]
    book = '<h5 class="x"><a id="g_a">アルファ（あるふぁ）／Alpha</a></h5><p>本文<b>一</b></p><div>x</div></div>rest<h5><a id="g_b">Gamma</a></h5>終' + "長" * 5000
    got = ingest.html_glossary(spark.createDataFrame([(1, book)], "doc int, html string")).orderBy("ord").collect()
    assert [(r["term_en"], r["term_ja"]) for r in got] == [("Alpha", "アルファ"), ("Gamma", "Gamma")]
    assert got[0]["definition_ja"] == "本文 一 x" and len(got[1]["definition_ja"]) == 4000


def test_references(spark):
    cases = {
        "See rule 702.9b.": (["702.9b"], []), "See rules 509.1b–c.": (["509.1b", "509.1c"], []), "See rules 111.10k–m.": (["111.10k", "111.10m"], []), "See rules 613.2, 707.2, and 707.3.": (["613.2", "707.2", "707.3"], []),
        'See rule 502, "Untap Step." Also rules 510.': ([], ["502", "510"]), "509.1c - b, 509.1l, 702.9": (["509.1c", "702.9"], []), "rules 5021, rule 502.1, rule 502": (["502.1"], ["502"]), "": ([], []), None: ([], []),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", references(F.col("t")).alias("r"))
    assert {r["t"]: (r["r"]["rules"], r["r"]["sections"]) for r in df.collect()} == cases


def test_merge(spark):
    en = spark.createDataFrame([(0, "Alpha", "def", ["509.1b"], ["500"]), (1, "Beta", "b", [], []), (2, "ALPHA", "def2", ["509.1c"], [])], "ord int, term_en string, definition_en string, rules array<string>, sections array<string>")
    ja = spark.createDataFrame([(0, "alpha", "アルファ", "ja", ["200.1", "509.1c"], []), (1, "Gamma", "ガンマ", "g", [], [])], "ord int, term_en string, term_ja string, definition_ja string, rules array<string>, sections array<string>")
    got = ingest.merge_glossaries(en, ja).orderBy("by").collect()
    assert [(r["term_en"], r["term_ja"], r["definition_en"], r["rules"]) for r in got] == [("ALPHA", "アルファ", "def2", ["509.1c", "200.1"]), ("Beta", None, "b", []), ("Gamma", "ガンマ", "", [])]


def test_metrics(spark, rows):
    got = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 9)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "a"), ("none", "z")], "query_id string, doc_id string")
    judged = evaluation.judged_queries(got, rel, 5)
    assert rows(judged) == [("none", 1, 0, 0.0, 0, 0.0), ("q", 2, 1, 0.5, 1, 0.5)]
    assert rows(evaluation.summary(judged, [])) == [(2, 0.25, 0.5, 0.25)]
    v = spark.createDataFrame([("g", i) for i in range(1, 21)] + [("h", None)], "g string, v int")
    assert rows(evaluation.percentiles(v, "g", "v", {"p50": 0.5, "p95": 0.95})) == [("g", 11, 20)]
    s = spark.createDataFrame([("a", 7), ("a", 6), ("b", 10)], "c string, score int")
    assert sorted(evaluation.score_report(s, "c").where("is_total = 1").first()[2:]) == sorted((3, 2, round(2 / 3, 6), round(23 / 3, 6), 7.0))


def test_ordered(spark):
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate([None, 1, None, None, 2, None, None, None, 3])], "k string, i int, v int")
    for stretch in (1, 2, 3, 100):
        got = {(r["k"], r["i"]): (r["f"], r["n"]) for r in ordered.next_value(ordered.forward_fill(df, "k", "i", "v", "f", stretch), "k", "i", "v", "n", stretch).collect()}
        for k in ("a", None):
            assert [got[k, i][0] for i in range(9)] == [None, 1, 1, 1, 2, 2, 2, 2, 3] and [got[k, i][1] for i in range(9)] == [1, None, None, 2, None, None, None, 3, None]


def test_running_count(spark, rows):
    df = spark.createDataFrame([(k, i, i % 3 == 1) for k in ("a", None) for i in range(7)] + [("n", 1, None)], "k string, i int, b boolean")
    for stretch in (1, 2, 100):
        got = {(r["k"], r["i"]): r["n"] for r in ordered.running_count(df, "k", "i", "b", "n", stretch).collect()}
        assert [got["a", i] for i in range(7)] == [got[None, i] for i in range(7)] == [0, 1, 1, 1, 2, 2, 2] and got["n", 1] == 0


def test_vector_blocks(spark, rows, monkeypatch):
    rng = random.Random(3)
    data = [(i % 30, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(70)] + [(99, None)]
    asked = [(f"q{i}", [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(11)] + [("none", None)]
    v, q = spark.createDataFrame(data, "doc_id int, embedding array<float>"), spark.createDataFrame(asked, "query_id string, embedding array<float>")
    want = []
    for name, x in asked[:-1]:
        best = {}
        for d, y in data[:-1]:
            best[d] = max(best.get(d, -99.0), sum(a * b for a, b in zip(x, y)))
        want += [(name, d, s, i + 1) for i, (d, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:7])]
    for chunk, block in ((512, 256), (3, 2), (1, 1)):
        monkeypatch.setattr(ranking, "CHUNK", chunk)
        monkeypatch.setattr(ranking, "BLOCK", block)
        assert rows(ranking.vector_ranking(v, q, 7)) == sorted(want)
    assert ranking.vector_ranking(v.limit(0), q, 7).count() == ranking.vector_ranking(v, q.limit(0), 7).count() == 0


def test_validation(spark):
    schema = "id string, category string, question string, expected_tools array<string>, expected_answer struct<conclusion:string,rules_cited:array<string>>, retrieval_relevant_rules array<string>, evaluation_criteria struct<must_cite_rules:array<string>>"
    data = [
        ("ok", "combat", "q1", ["search_rules"], ("c", ["100.1"]), ["100.1", "100.2"], (["100.1"],)), ("unknown", "combat", "q2", [], ("c", ["999.1"]), ["999.1"], (["999.1"],)), ("cited", "combat", "q3", [], ("c", ["200.1"]), ["100.1"], (["200.1"],)),
        ("must", "combat", "q4", [], ("c", ["100.1"]), ["100.1"], (["100.2"],)), ("dup", "combat", "q5", [], ("c", ["100.1"]), ["100.1"], (["100.1"],)), ("dup", "combat", "q6", [], ("c", ["100.1"]), ["100.1"], (["100.1"],)), ("bad", "x", "q1", ["y"], ("c", ["100.1"]), ["100.1"], (["100.1"],)), ("null", None, None, None, None, None, None),
    ]
    known = spark.createDataFrame([("100.1",), ("100.2",), ("200.1",)], "number string")
    got = {(r["id"], r["problem"]) for r in validation.question_problems(spark.createDataFrame(data, schema), known, ["combat"], ["search_rules"]).collect()}
    assert got == {("unknown", "unknown rule"), ("cited", "cited not relevant"), ("must", "required not cited"), ("dup", "duplicate id"), ("bad", "category"), ("bad", "tools"), ("bad", "duplicate question"), ("null", "incomplete"), ("null", "category")}


def test_cards(spark, rows):
    raw = spark.createDataFrame([("two", '{"id":"1","name":"Two","oracle_text":"","card_faces":[{"oracle_text":"A","power":"3","mana_cost":"{R}"},{"oracle_text":"B","power":"5"}],"keywords":["Flying","Odd"]}'), ("broken", "{"), ("null", None)], "key string, json string")
    got = {r["key"]: r for r in cards.read_cards(raw).collect()}
    assert (got["two"]["oracle_text"], got["two"]["power"], got["two"]["mana_cost"], got["two"]["colors"]) == ("A\n//\nB", "3", "{R}", []) and got["broken"]["status"] == got["null"]["status"] == "error"
    ruled = cards.with_rulings(cards.read_cards(raw), spark.createDataFrame([("1", '{"data":[{"comment":"c"}]}')], "card_id string, json string")).where("key = 'two'").first()
    assert [tuple(x) for x in ruled["rulings"]] == [("", "", "c")]
    g = spark.createDataFrame([(0, "flying", ["702.9"]), (1, "FLYING", ["702.8"])], "ord int, term_en string, rules array<string>")
    assert rows(cards.keyword_rules(cards.read_cards(raw), g)) == [("two", "Flying", "702.8"), ("two", "Odd", "-")]
    names = spark.createDataFrame([("Two",), ("Twoo x",), ("Zzz",)], "query string")
    assert [(r[0], r[1], r[3]) for r in rows(cards.find_cards(names, cards.read_cards(raw)))] == [("Two", "Two", "ok"), ("Twoo x", None, "not_found"), ("Zzz", None, "not_found")]


def test_search(spark):
    c = corpus(spark, ["100.1", "100.1a", "200.1", "200.2"])
    index = search.Index(search.passages(c), search.corpus_members(c), terms=glossary.term_table(spark.createDataFrame([("a", "tall tale", None, ["200.2"], ["100"])], "ord string, term_en string, term_ja string, rules array<string>, sections array<string>"), c))
    q = spark.createDataFrame([("n", "100.1a"), ("m", "300.1"), ("t", "a tall tale of 200.1"), ("e", "")], "query_id string, text string")
    got = {(r["query_id"], r["group_rank"]): r["parent"] for r in search.search(index, q).collect()}
    assert got[("n", 1)] == "100.1" and ("m", 1) not in got and ("e", 1) not in got and {got[("t", 1)], got[("t", 2)]} == {"200.1", "200.2"}
    v = spark.createDataFrame([("100.1", [1.0, 0.0]), ("200.1", [0.0, 1.0]), ("200.2", [0.6, 0.8]), ("200.2", [0.8, 0.6])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([("n", [0.0, 1.0]), ("e", [0.0, 1.0]), ("t", [1.0, 0.0])], "query_id string, embedding array<float>")
    near = {(r["query_id"], r["group_rank"]): r["parent"] for r in search.search(search.Index(index.docs, index.members, vectors=v, terms=index.terms, query_vectors=asked), q).collect()}
    assert near[("n", 1)] == "100.1" and ("n", 2) not in near  # a number is looked up, whatever its vector is near
    assert [near[("e", i)] for i in (1, 2, 3)] == ["200.1", "200.2", "100.1"]  # an empty query has its vector alone
    inside = search.search(search.Index(index.docs, index.members, vectors=v, query_vectors=asked), q, section="100")
    assert {(r["query_id"], r["parent"]) for r in inside.collect()} == {("n", "100.1"), ("e", "100.1"), ("t", "100.1")}
    only = search.search(index, q, section="200").collect()
    assert {r["parent"] for r in only} <= {"200.1", "200.2"} and only
    again = search.search(index, q, rerank=True)
    assert again.where("query_id = 't'").orderBy("group_rank").first()["parent"] == "200.1"
    queries = search.question_queries(q, index.terms)
    groups = search.multi_query_groups(search.search(index, queries.select("query_id", "text")), queries)
    shown = search.contexts(groups, c).where("question_id = 'n'").first()
    assert [(x["number"], x["text_ja"]) for x in shown["rules"]] == [("100.1", None), ("100.1a", "日本語")]
    assert search.language_passages(c).count() == 5


def test_index_reuse(spark, tmp_path):
    mark = search.fingerprint(spark.createDataFrame([(1, "bb"), (0, "aa")], "ord int, sha256 string"), "model").first()[0]
    assert mark == "aa+bb+model+dual"
    rows = spark.range(3)
    assert [search.build_or_load(spark, str(tmp_path / "v"), r, m, r.count())[1] for r, m in ((rows, mark), (rows, mark), (rows, "other"), (spark.range(4), "other"))] == [False, True, False, False]
    assert [search.build_or_load(spark, str(tmp_path / "w"), spark.range(n), m)[1] for n, m in ((3, "a"), (3, "a"), (3, "b"))] == [False, True, False]


def test_encoded(spark):
    def encoder():
        return lambda texts: [[len(t), 3.0] for t in texts]

    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["embedding"] for r in search.encoded(df, encoder).collect()}
    assert [round(x, 6) for x in got[1]] == [0.8, 0.6] and got[2] is None and [round(x, 6) for x in got[3]] == [0.0, 1.0]
    assert {round(r["embedding"][0], 6) for r in search.encoded(df.where("doc_id = 3"), encoder, "multilingual-e5-small", "query").collect()} == {round(7 / math.hypot(7, 3), 6)}
    assert spark.createDataFrame([("a",), ("",), (None,)], "text_ja string").agg(search.vector_count().alias("n")).first()["n"] == 4


def test_groups_judged(spark, rows):
    found = spark.createDataFrame([("q", 0, 1, "100.1", ["100.1"]), ("q", 0, 2, "200.1", ["200.1", "200.1a"]), ("q", 1, 1, "300.1", ["300.1"]), ("z", 0, 1, "100.1", ["100.1"])], "question_id string, query_ord int, group_rank int, parent string, numbers array<string>")
    wanted = spark.createDataFrame([("q", "c", ["200.1a", "300.1", "400.1"], ["300.1"]), ("n", "c", ["1"], []), ("e", "d", [], ["1"])], "question_id string, category string, relevant array<string>, must array<string>")
    judged = evaluation.judged_groups(found, wanted)
    assert rows(judged.drop("must_recall")) == [("n", "c", 1, 0, 0.0, 0.0), ("q", "c", 3, 1, round(2 / 3, 6), 0.5)]
    assert {r["question_id"]: r["must_recall"] for r in judged.collect()} == {"n": None, "q": 1.0}
    total = evaluation.group_summary(judged).where("is_total = 1").first()
    assert (total["n_questions"], total["recall"], total["must_recall"], total["mrr"]) == (2, 0.333334, 1.0, 0.25)
    assert rows(evaluation.group_misses(found, wanted)) == [("n", 0.0, ["1"], [])] and evaluation.judged_groups(found.limit(0), wanted.limit(0)).count() == 0


def test_answers_scored(spark, rows):
    questions = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("d", "y", 4)], "id string, category string, ord int")
    answers = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, conclusion string")
    scores = spark.createDataFrame([("a", 6), ("b", 7), ("d", 9)], "id string, score int")
    assert rows(evaluation.unfinished(questions, answers, scores)) == [("c", "y", "score"), ("d", "y", "answer")]
    done = evaluation.scored_questions(questions, answers, scores)
    assert [(r["category"], r["id"], r["conclusion"]) for r in evaluation.first_passes(done).collect()] == [("x", "b", "B")]
    assert evaluation.first_passes(done.limit(0)).count() == 0


def test_percentiles_in_stretches(spark, rows):
    rng = random.Random(4)
    data = [("a", rng.randint(-50, 50)) for _ in range(101)] + [(None, 5), (None, None), ("b", 1)]
    want = sorted((g, *(v[min(int(len(v) * s), len(v) - 1)] for s in (0.5, 0.95))) for g in ("a", "b") for v in [sorted(x for k, x in data if k == g)])
    for stretch in (1, 7, 1000):
        got = evaluation.percentiles(spark.createDataFrame(data, "g string, v int"), "g", "v", {"p50": 0.5, "p95": 0.95}, stretch)
        assert rows(got.where("g is not null")) == want and rows(got.where("g is null")) == [(None, 5, 5)]


def test_cards_by_rough_names(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(80)})
    asked = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(60)} | {names[0], names[5].upper(), "zzzzzz", ""})

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for q in asked:
        near = sorted((d, n) for n in names if (d := levenshtein(q.lower(), n)) * 3 <= len(q))
        want[q] = (near[0][1], near[0][0], "ok") if near and q else (None, None, "not_found")
    found = cards.find_cards(spark.createDataFrame([(q,) for q in [*asked, None]], "query string"), spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"))
    assert {r["query"]: (r["name"], r["distance"], r["status"]) for r in found.collect()} == want


def test_lines_of_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i} {'x' * (i % 40)}\n" for i in range(3000)))
    (tmp_path / "short.txt").write_text("one\n\nthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = records.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    long = {r["line_no"]: r["line"] for r in got if r["file"].endswith("long.txt")}
    assert len(long) == 3000 and all(long[i + 1].startswith(f"line {i} ") for i in range(3000))
    assert {r["line_no"]: r["line"] for r in got if r["file"].endswith("short.txt")} == {1: "one", 2: "", 3: "three"}


def test_written_records(spark, tmp_path):
    g = spark.createDataFrame([("A", None, "d", None, ["1"], [])], records.GLOSSARY)
    records.write_glossary(g, str(tmp_path / "g"))
    assert records.optional_json(spark, str(tmp_path / "g" / "*.json"), records.GLOSSARY).first()["definition_en"] == "d"
    c = spark.createDataFrame([("q", 2, "b", [("b", "B", None)]), ("q", 1, "a", [("a", "A", "あ")])], "question_id string, place int, parent string, rules array<struct<number:string,text_en:string,text_ja:string>>")
    records.write_contexts(c, str(tmp_path / "c"))
    line = spark.read.text(str(tmp_path / "c")).first()[0]
    assert line.index('"parent":"a"') < line.index('"parent":"b"') and '"text_ja":null' in line


def test_records(spark, tmp_path):
    (tmp_path / "a-retry.jsonl").write_text('{"id":"1","queries":["new"]}\n\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"id":"1","queries":["old"]}\n{"id":"2","queries":["x"]}\n')
    got = {r["id"]: r["queries"] for r in records.merged_lines(spark, str(tmp_path / "*.jsonl"), records.REPHRASING).collect()}
    assert got == {"1": ["new"], "2": ["x"]}
    bad = records.json_lines(spark, str(tmp_path / "a-retry.jsonl"), records.REPHRASING).where("error is not null").first()
    assert (bad["line_no"], bad["error"]) == (3, "not json")
    assert records.optional_json(spark, str(tmp_path / "none.json"), records.GLOSSARY).count() == 0
    rules = spark.createDataFrame([("en", "2024-01-01", 1, "100.2", "b", "100", ""), ("en", "2024-01-01", 0, "100.1", "a", "100", "c")], "language string, effective_date string, ord int, number string, text string, section string, category string")
    records.write_rules_document(rules, str(tmp_path / "doc"))
    back = records.rules_document(spark, str(tmp_path / "doc" / "*.json")).orderBy("ord").collect()
    assert [r["number"] for r in back] == ["100.1", "100.2"]
    assert records.file_hashes(spark, str(tmp_path / "b.jsonl")).first()["sha256"] and "| a |" in records.markdown_table(spark.sql("select 1 as a"))


def test_term_hits_by_brute_force(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab日 ") for _ in range(n))
    terms = sorted({t for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 40) for t in [word(n).strip()] * 1 if t} | {"a", "😀b"})
    texts = {f"q{i}": word(60).strip() + draw.choice(terms) for i in range(40)} | {"none": "", "short": "a"}
    got = glossary.term_hits(spark.createDataFrame(list(texts.items()), "query_id string, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {tuple(r) for r in got.collect()} == {(k, t) for k, q in texts.items() for t in terms if t in q}
    # stretches are never taken for so few that they would be sent to every task
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_bm25_ranking_by_packs(spark, monkeypatch):
    """The packs' best are those of all scores, ties by id, whatever the packs are cut to; no row for a query and a document is shuffled to be summed."""
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice("abcdefghijklmnop") + draw.choice("xyz") for _ in range(n))
    docs = spark.createDataFrame([(i, text(draw.randrange(12)), i % 3 == 0) for i in range(150)], "doc_id int, text string, third boolean")
    queries = spark.createDataFrame([(f"q{i}", t) for i in range(8) for t in [text(6)] for _ in range(1)] + [("again", "ax bx ax"), ("twin", "bx ax ax"), ("empty", ""), ("new", "zzz")], "query_id string, text string")
    monkeypatch.setattr(ranking, "BAGS", 7)
    monkeypatch.setattr(ranking, "PACKED", 40)
    for dense in (0, 6, 1 << 14):
        monkeypatch.setattr(ranking, "DENSE", dense)
        for keep in (None, F.col("third")):
            got = ranking.bm25_ranking(docs, queries, 5, keep)
            scores = ranking.bm25(docs, queries)
            want = ranking.top(scores if keep is None else scores.join(docs.where(keep), "doc_id"), 5, [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "block" not in got._jdf.queryExecution().toString()


def test_search_plans_stay_small(spark):
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    c = corpus(spark, ["100.1", "100.1a", "200.1"])
    terms = glossary.term_table(spark.createDataFrame([("a", "tall tale", None, ["200.1"], ["100"])], "ord string, term_en string, term_ja string, rules array<string>, sections array<string>"), c)
    v = spark.createDataFrame([("100.1", [1.0, 0.0]), ("200.1", [0.0, 1.0])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([("t", [1.0, 0.0])], "query_id string, embedding array<float>")
    index = search.Index(search.passages(c), search.corpus_members(c), v, terms, asked)
    q = spark.createDataFrame([("t", "a tall tale"), ("n", "200.1")], "query_id string, text string")
    assert leaves(search.search(index, q, rerank=True)) <= 4  # each step that read the ranking or the queries repeated their plans
    queries = search.question_queries(q, terms)
    found = search.multi_query_groups(search.search(index, queries.select("query_id", "text")), queries)
    assert leaves(search.contexts(found, c)) <= 4


def test_group_queries_read_questions_once(spark, monkeypatch):
    """What is asked and wanted is stored once, and so is what is found where it is read twice; each step that read the questions read and sorted all of them."""
    read, table = [], queries_retrieval.table
    monkeypatch.setattr(queries_retrieval, "table", lambda spark, sf, name: read.append(name) or table(spark, sf, name))
    got = queries_retrieval.q_group_misses(spark, "/root/testdata/sf0.001")
    assert read.count("questions") == 1
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 5
    read.clear()
    queries_retrieval.q_group_summary(spark, "/root/testdata/sf0.001")
    assert read.count("questions") == 1


def test_bm25_packs_keep_the_best():
    """Products are the sums over shared tokens, as matrices or pair by pair; the best are cut seldom, also where the first documents of packs share an id."""
    rng = np.random.default_rng(1)
    for dense in (0, 4, 1 << 14):
        sides = []
        for n in (9, 40):
            key, word = np.nonzero(rng.random((n, 30)) < 0.2)
            order = np.argsort(word, kind="stable")
            sides += [word[order] * 7 - 100, key[order].astype(np.int32), rng.integers(1, 4, len(key)) / 2.0, n]
        of = lambda words, keys, values, n: {(k, w): v for k, w, v in zip(keys, words, values, strict=True)}
        asked, docs = of(*sides[:4]), of(*sides[4:])
        want = np.array([[sum(v * docs.get((d, w), 0) for (q, w), v in asked.items() if q == i) for d in range(40)] for i in range(9)])
        old, ranking.DENSE = ranking.DENSE, dense
        try:
            scores = ranking._products(*sides[4:], *sides[:4])
        finally:
            ranking.DENSE = old
        assert np.allclose(scores, want)
        ids = np.array([f"d{i % 8 * 5 + i // 8}" for i in range(40)], object)
        best, cuts = ranking._Best(9, 3), []
        cut = best.cut
        best.cut = lambda: cuts.append(1) or cut()  # noqa: B023
        for i in range(0, 40, 4):
            best.add(scores[:, i : i + 4], ids[i : i + 4])
        assert len(cuts) < 10 and len(best.ids) <= 67
        best.add(scores[:, :1], np.array(["d0"], object))  # the same id in another pack
        got = [sorted(zip(-s[q == i], d[q == i], strict=True)) for q, s, d in [cut()] for i in range(9)]
        assert got == [sorted((-s, d) for s, d in zip([*scores[i].round(6), scores[i, 0].round(6)], [*ids, "d0"], strict=True) if s > 0)[:3] for i in range(9)]


def test_group_eval_judges_every_question(spark, rows):
    """Only questions whose number is divisible by 20 were judged, of which sf0.001 has none."""
    wanted = queries_retrieval._evaluated(spark, "/root/testdata/sf0.001", every=True).where("size(relevant) > 0").select("query_id")
    got = rows(queries_retrieval.q_group_eval(spark, "/root/testdata/sf0.001").select("question_id"))
    every = queries_retrieval.records_of(spark, "/root/testdata/sf0.001").where("category != 'card_interactions' and size(retrieval_relevant_rules) > 0")
    assert got == rows(wanted) == rows(every.select("id")) and len(got) > 40


def test_hybrid_asks_every_question(spark, rows):
    """Only questions whose number is divisible by 20 were asked, of which sf0.001 has none; each has a hit there."""
    every = rows(queries_retrieval.records_of(spark, "/root/testdata/sf0.001").select("id"))
    assert rows(queries_retrieval.q_hybrid(spark, "/root/testdata/sf0.001").select("query_id").distinct()) == every and len(every) == 60


def test_hybrid_in_a_section_asks_every_question(spark, monkeypatch):
    """Only questions whose number is divisible by 20 were searched for, of which sf0.001 has none."""
    asked = []
    monkeypatch.setattr(queries_retrieval, "search", lambda index, queries, **kw: asked.append((queries, kw)) or search.search(index, queries, **kw))
    queries_retrieval.q_hybrid_section(spark, "/root/testdata/sf0.001")
    ((queries, how),) = asked
    every = queries_retrieval.records_of(spark, "/root/testdata/sf0.001").select("id")
    assert how == {"section": "702"} and queries.count() == 60 and every.exceptAll(queries.select("query_id")).count() == 0
