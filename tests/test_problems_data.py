"""Problems 2 and 4 against brute force, and their edge cases."""

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tomewright.operators.references import dangling_references
from tomewright.operators.snapshots import snapshot_changes

DOCS = "delivery_id long, language string, effective_date string, source_sha256 string, delivered_at timestamp"
RULES = "delivery_id long, ord int, number string, text string, section string, category string"
T = datetime.datetime(2024, 1, 1)


def tables(spark, docs, rules):
    return spark.createDataFrame([(d, lang, date, None, T + datetime.timedelta(days=at)) for d, lang, date, at in docs], DOCS), spark.createDataFrame([(d, o, n, t, None, None) for d, o, n, t in rules], RULES)


def brute_changes(docs, rules):
    best = {}
    for d, lang, date, at in docs:
        best[lang, date] = max(best.get((lang, date), (at, d)), (at, d))
    snaps = {k: {} for k in best}
    for (lang, date), (_, chosen) in best.items():
        for d, o, n, t in sorted((r for r in rules if r[2]), key=lambda r: r[1]):
            if d == chosen:
                snaps[lang, date].setdefault(n, t)
    out = set()
    for lang, date in snaps:
        before = [x for la, x in snaps if la == lang and x < date]
        if before:
            old, new = snaps[lang, max(before)], snaps[lang, date]
            out |= {(lang, date, n, "added") for n in new.keys() - old.keys()} | {(lang, date, n, "removed") for n in old.keys() - new.keys()}
            out |= {(lang, date, n, "changed") for n in old.keys() & new.keys() if old[n] != new[n]}
    return sorted(out)


doc = st.tuples(st.integers(1, 6), st.sampled_from(["en", "ja"]), st.sampled_from(["2024-01-01", "2024-02-01", "2024-03-01"]), st.integers(0, 3))
rule = st.tuples(st.integers(1, 6), st.integers(0, 9), st.sampled_from(["100.1", "100.2", "702.9b"]), st.sampled_from(["a", "b"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(doc, max_size=6, unique_by=lambda d: d[0]), st.lists(rule, max_size=14, unique_by=lambda r: (r[0], r[1])))
def test_changes_match_brute_force(spark, docs, rules):
    assert sorted(tuple(r) for r in snapshot_changes(*tables(spark, docs, rules)).collect()) == brute_changes(docs, rules)


def test_changes_edges(spark, rows):
    docs, rules = tables(spark, [(1, "en", "2024-1-1", 0), (2, "en", "2024年2月1日", 1), (2, "en", "2024年2月1日", 1), (3, "en", "２０２４-02-01", 0)], [(1, 0, " 100.1 ", "ｶﾞ x"), (1, 1, "100.2", None), (1, 2, None, "?"), (2, 5, "100.1.", "ガ　x"), (2, 5, "100.1.", "ガ　x"), (2, 6, "１００．２", ""), (3, 0, "100.9", "late")])
    extra = rules.withColumnRenamed("section", "language")
    assert rows(snapshot_changes(docs, extra)) == [("en", "2024-02-01", "100.2", "changed")]
    assert rows(snapshot_changes(docs.limit(0), rules)) == [] and rows(snapshot_changes(docs, rules.limit(0))) == []


def test_cascade(spark):
    docs, rules = tables(
        spark, [(1, "en", "2024-01-01", 0), (2, "en", "2024-02-01", 1), (3, "ja", "2024-01-01", 0)],
        [(1, 0, "100.1", "See rule 100.2."), (1, 1, "100.2", "See rule 999.9."), (1, 2, "100.3", "See rule 100.1, and 100.4."), (1, 3, "100.4", "See rule 100.3."), (1, 4, "100.5", "alone"), (2, 0, "100.5", "alone"), (2, 1, "200.1", None), (3, 0, "100.7", "x")],
    )
    g = spark.createDataFrame([("term", ["ルール100.3", "100.3", None, ""], "2024-01-01"), ("late", ["200.1"], "2024-01-01"), ("gone", ["100.1"], "2024-02-01"), ("none", None, "2024-01-01"), ("ok", ["100.5"], "2024-01-01"), ("undated", ["1"], None)], "term_en string, rules array<string>, effective_date string")
    q = spark.createDataFrame([("q1", ["777.7"], (["100.5"],), (["100.5"],), "CR 20240201 en"), ("q2", None, None, None, "CR 2024/01/01")], "id string, retrieval_relevant_rules array<string>, expected_answer struct<rules_cited:array<string>>, evaluation_criteria struct<must_cite_rules:array<string>>, source string")
    got = {(r["source_table"], r["record_id"], r["number"], r["status"], r["depth"]) for r in dangling_references(g, q, docs, rules).collect()}
    assert got == {
        ("rule_entries", "100.2", "999.9", "missing", 0), ("rule_entries", "100.1", "100.2", "inherited", 1), ("rule_entries", "100.3", "100.1", "inherited", 2), ("rule_entries", "100.4", "100.3", "inherited", 3), ("rule_entries", "100.3", "100.4", "inherited", 4),
        ("glossary", "term", "100.3", "inherited", 3), ("glossary", "late", "200.1", "late", 0), ("glossary", "gone", "100.1", "deleted", 0), ("questions", "q1", "777.7", "missing", 0),
    }
    assert dangling_references(g.limit(0), q.limit(0), docs.limit(0), rules.limit(0)).count() == 0
