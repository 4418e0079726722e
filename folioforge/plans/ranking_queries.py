"""Queries of cover-density ranking with their SQL; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import ranking
from folioforge.plans import catalog
from folioforge.plans.catalog import query
from folioforge.plans.lineage import cut
from folioforge.plans.tables import table

_GROUPS = """q as (select item_id as qid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from benchmark),
grp as materialized (select qid, i as grp, ws[i * 4 + 1:i * 4 + 4] as words from q, unnest(range(0, (len(ws) + 3) // 4)) t(i)),
term as materialized (select distinct qid, grp, unnest(words) as lexeme from grp), size as (select qid, grp, count(*) as n from term group by 1, 2)"""
# all last places of a group's words as the text is read; a cover ends where the least of them moves
_COVERS = f"""with recursive {catalog._POSTINGS.split(' ix as')[0].rstrip(',').rstrip().rstrip(',')}, {_GROUPS},
e as materialized (select qid, grp, doc_id, pos, lexeme, row_number() over (partition by qid, grp, doc_id order by pos) as i from term join words using (lexeme)),
whole as materialized (select qid, grp, doc_id from e join size using (qid, grp) group by qid, grp, doc_id, n having count(distinct lexeme) = n),
ev as materialized (select e.* from e semi join whole using (qid, grp, doc_id)),
walk(qid, grp, doc_id, i, pos, last, low) as (
  select qid, grp, doc_id, 1::bigint, pos, map([lexeme], [1::bigint]), null::bigint from ev where i = 1
  union all
  select w.qid, w.grp, w.doc_id, ev.i, ev.pos, map_concat(w.last, map([ev.lexeme], [ev.i])), case when cardinality(w.last) = n then list_min(map_values(w.last)) end
  from walk w join ev on ev.qid = w.qid and ev.grp = w.grp and ev.doc_id = w.doc_id and ev.i = w.i + 1 join size s on s.qid = w.qid and s.grp = w.grp
),
ends as (select w.*, list_min(map_values(last)) as first_ from walk w join size using (qid, grp) where cardinality(last) = n),
found as (select f.qid, f.doc_id, a.pos as p, f.pos as q, f.i - first_ + 1 as k from ends f join ev a on a.qid = f.qid and a.grp = f.grp and a.doc_id = f.doc_id and a.i = first_ where low is null or first_ <> low),
r as (select qid, doc_id, count(*)::bigint as n_covers, sum(0.1::double / (1 + (q - p) - (k - 1))) as r from found group by 1, 2),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, n_covers, round(r / (r + 1.0::double), 9) as score from r))
select qid, doc_id, n_covers, score, rank::bigint as rank from ranked where rank <= 60"""


def _groups(spark, sf_dir: str, size: int, adjacent: bool) -> DataFrame:
    return cut(ranking.word_groups(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), size, adjacent), "groups")


@query(_COVERS)
def search_cover_density(spark, sf_dir):
    """Benchmark texts as questions, in groups of four words of any length."""
    return ranking.text_density(table(spark, sf_dir, "documents"), _groups(spark, sf_dir, 4, False))


@query("""with words as materialized (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents)),
q as (select item_id as qid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from benchmark),
grp as (select qid, ws[i * 3 + 1:i * 3 + 3] as words from q, unnest(range(0, (len(ws) + 2) // 3)) t(i)),
r as (select qid, doc_id, count(*)::bigint as n_covers, sum(0.1::double) as r from grp join words on words.ws[p] = grp.words[1] and words.ws[p:p + len(grp.words) - 1] = grp.words group by 1, 2),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, n_covers, round(r / (r + 1.0::double), 9) as score from r))
select qid, doc_id, n_covers, score, rank::bigint as rank from ranked where rank <= 60""")
def search_phrases(spark, sf_dir):
    """The same with phrases of three words."""
    return ranking.phrase_density(table(spark, sf_dir, "documents"), _groups(spark, sf_dir, 3, True))
