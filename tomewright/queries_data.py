"""The queries of problems 2 and 4, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import INVISIBLE, SPACE_CLASS
from .operators.references import dangling_references
from .operators.snapshots import snapshot_changes
from .storage import table


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return dangling_references(*(table(spark, sf, t) for t in ("glossary", "questions", "rules_documents", "rule_entries"))).withColumn("ref_month", F.substring("edition", 1, 7))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _orphans(spark, sf).where("depth = 0 and source_table in ('glossary', 'questions')")
    return found.select("source_table", "field_name", "record_id", "number", "status", "ref_month").distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, field and month, by status; inherited ones beside the direct."""
    return _orphans(spark, sf).groupBy("source_table", "field_name", "ref_month", "status").agg(F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "rules_documents"), table(spark, sf, "rule_entries"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return p4_found(spark, sf).groupBy("language", "effective_date", "change_kind").agg(F.count("*").alias("n_numbers"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_report)}

_HALF = "".join(chr(c) for c in range(0xFF61, 0xFFA0))
_FULL = "".join(unicodedata.normalize("NFKC", c) for c in _HALF)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_SPACES = SPACE_CLASS.replace("\\s", " \\t\\n\\r\\f\\v")


def _plain(x: str) -> str:
    return f"translate({x}, '{_WIDE}', '{_ASCII}')"


def _look(x: str) -> str:
    return f"nfc_normalize(translate({_plain(f"regexp_replace({x}, '[{INVISIBLE}]|{_SPACES}', '', 'g')")}, '{_HALF}', '{_FULL}'))"


def _number(x: str) -> str:
    bare = f"lower(regexp_replace({_plain(x)}, '[{INVISIBLE}]|{_SPACES}', '', 'g'))"
    return f"nullif(coalesce(nullif(regexp_extract({bare}, '[0-9]{{3}}\\.[0-9]+[a-z]?'), ''), {bare}), '')"


def _date(x: str) -> str:
    found = f"regexp_extract({_plain(x)}, '([0-9]{{4}})[^0-9]{{0,2}}([0-9]{{1,2}})[^0-9]{{0,2}}([0-9]{{1,2}})', "
    return f"nullif({found}1) || '-' || lpad({found}2), 2, '0') || '-' || lpad({found}3), 2, '0'), '-00-00')"


_SNAPSHOTS = f"""
heads as (select distinct delivery_id, language, {_date('effective_date')} as effective_date, delivered_at from rules_documents),
chosen as (select delivery_id, language, effective_date, dense_rank() over (partition by language order by effective_date) as seq
           from heads qualify row_number() over (partition by language, effective_date order by delivered_at desc, delivery_id desc) = 1),
snaps as (select c.language, c.effective_date, c.seq, {_number('e.number')} as number, e.text, e.ord from rule_entries e join chosen c using (delivery_id)),
firsts as (select * from snaps where number is not null qualify row_number() over (partition by language, seq, number order by ord) = 1)"""

_P4 = f"""with {_SNAPSHOTS},
looks as (select language, seq, effective_date, number, {_look('text')} as look from firsts),
pairs as (select a.language, a.seq, a.effective_date from (select distinct language, seq, effective_date from looks) a where a.seq > 1),
news as (select p.language, p.effective_date, l.number, l.look, p.seq from pairs p join looks l on l.language = p.language and l.seq = p.seq),
olds as (select p.language, p.effective_date, l.number, l.look, p.seq from pairs p join looks l on l.language = p.language and l.seq = p.seq - 1),
found as (select coalesce(n.language, o.language) as language, coalesce(n.effective_date, o.effective_date) as effective_date, coalesce(n.number, o.number) as number,
          case when o.number is null then 'added' when n.number is null then 'removed' when n.look is distinct from o.look then 'changed' end as change_kind
          from news n full join olds o on n.language = o.language and n.seq = o.seq and n.number = o.number)
"""

_P2 = f"""with {_SNAPSHOTS},
held as (select number, effective_date as edition from firsts where language = 'en'),
members as (
  select 'glossary' as source_table, 'rules' as field_name, term_en as record_id, effective_date as named, unnest(rules) as member from glossary
  union all select 'questions', 'retrieval_relevant_rules', id, source, unnest(retrieval_relevant_rules) from questions
  union all select 'questions', 'rules_cited', id, source, unnest(expected_answer.rules_cited) from questions
  union all select 'questions', 'must_cite_rules', id, source, unnest(evaluation_criteria.must_cite_rules) from questions),
edges as (select distinct source_table, field_name, record_id, {_date('named')} as edition, {_number('member')} as number from members where record_id is not null)
select source_table, field_name, record_id, number, substr(edition, 1, 7) as ref_month,
  case when exists (select 1 from held h where h.number = e.number and h.edition < e.edition) then 'deleted'
       when exists (select 1 from held h where h.number = e.number and h.edition > e.edition) then 'late' else 'missing' end as status
from edges e where number is not null and edition is not null and not exists (select 1 from held h where h.number = e.number and h.edition = e.edition)"""

_MENTIONS = f"regexp_extract_all(regexp_replace(lower({_plain("coalesce(text, '')")}), '([0-9]{{3}}\\.[0-9]+[a-z]?)', ' \\1 ', 'g'), '(?:^|[^0-9.])\\s([0-9]{{3}}\\.[0-9]+[a-z]?)\\s(?:[^a-z0-9]|$)', 1)"
_P2_REPORT = _P2.replace("with ", "with recursive ", 1).partition("select source_table, field_name, record_id")[0].rstrip() + f""",
refs as (select * from edges where number is not null and edition is not null),
english as (select * from firsts where language = 'en'),
inner_edges as (select distinct 'rule_entries' as source_table, field_name, number as record_id, effective_date as edition, target as number from (
  select 'text' as field_name, number, effective_date, unnest({_MENTIONS}) as target from english
  union all select 'parent', number, effective_date, regexp_extract(number, '^([0-9]{{3}}\\.[0-9]+)[a-z]$', 1) from english) where target <> '' and target <> number),
every as (select * from refs union all select * from inner_edges),
direct as (select e.*, case when exists (select 1 from held h where h.number = e.number and h.edition < e.edition) then 'deleted'
    when exists (select 1 from held h where h.number = e.number and h.edition > e.edition) then 'late' else 'missing' end as status
  from every e where not exists (select 1 from held h where h.number = e.number and h.edition = e.edition)),
seen as (select distinct edition, record_id as number from direct where source_table = 'rule_entries'
  union select i.edition, i.record_id from inner_edges i join seen s on s.edition = i.edition and s.number = i.number),
orphans as (select * from direct union all select e.*, 'inherited' from every e join seen s on s.edition = e.edition and s.number = e.number)
select source_table, field_name, substr(edition, 1, 7) as ref_month, status, count(*) as n_references, count(distinct record_id) as n_records from orphans group by all"""

SQL = {
    "p2_found": _P2,
    "p2_report": _P2_REPORT,
    "p4_found": _P4 + "select * from found where change_kind is not null",
    "p4_report": _P4 + "select language, effective_date, change_kind, count(*) as n_numbers from found where change_kind is not null group by all",
}
