"""First-use annotation of all documents with its SQL; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import annotation
from folioforge.plans.catalog import query
from folioforge.plans.tables import table

#: Words of the documents' languages and a term for each; a caller's own glossary takes their place.
TERMS = {
    "und die": ["and those"], "para los": ["for them"], "avec les": ["with those"], "der": ["of whom"], "und": ["and also"], "mit": ["together"], "pour": ["in favour"], "les": ["these things"], "avec": ["alongside"],
    "los": ["those ones"], "para": ["meant for"], "entre": ["amid"], "the": ["thing"], "with": ["jointly"], "from": ["origin"],
}
_MOST = 3
# a select for each phrase, as a pattern that is no constant is compiled for each row
_HITS = " union all ".join(
    f"select doc_id, text, {i} as rank, '{t}' as term, padded, regexp_extract(padded, '[^\\p{{L}}\\p{{N}}_](?:{annotation.phrase_pattern(k)})[^\\p{{L}}\\p{{N}}_]') as g from d where length(padded) = length(text) + 2" for i, (k, t) in enumerate(annotation.ranked(TERMS))
)


@query(f"""with recursive d as materialized (select doc_id, text, ' ' || lower(translate(text, 'İI', 'iı')) || ' ' as padded from documents), hit as ({_HITS}),
placed as (select doc_id, text, rank, term, strpos(padded, g) as a, strpos(padded, g) + length(g) - 2 as b from hit where g <> ''),
ends as materialized (select doc_id, text, rank, term, a, b, b + length(regexp_extract(substr(text, b), '^[\\p{{L}}\\p{{N}}''’]*')) as e from placed),
ps as materialized (select doc_id, list({{a: a, b: b, e: e, term: term, ok: not contains(lower(text), term) and not starts_with(ltrim(substr(text, e, 2), ' '), '(')}} order by rank) as p from ends group by 1),
walk(doc_id, i, taken, edits) as (
  select doc_id, 1::bigint, []::struct(a bigint, b bigint)[], []::struct(e bigint, term varchar)[] from ps
  union all
  select w.doc_id, i + 1, case when free then list_append(taken, {{a: c.a::bigint, b: c.b::bigint}}) else taken end, case when free and c.ok then list_append(edits, {{e: c.e::bigint, term: c.term}}) else edits end
  from (select w.*, p[i] as c, len(edits) < {_MOST} and len(list_filter(taken, lambda t: p[i].a < t.b and t.a < p[i].b)) = 0 as free from walk w join ps using (doc_id) where i <= len(p)) w
),
done as (select doc_id, list_sort(arg_max(edits, i)) as es from walk group by 1)
select d.doc_id, coalesce(len(es), 0)::int as n_terms, md5(case when coalesce(len(es), 0) = 0 then text else array_to_string(list_transform(es, lambda x, i: substr(text, case when i = 1 then 1 else es[i - 1].e end, x.e - case when i = 1 then 1 else es[i - 1].e end) || ' (' || x.term || ')'), '') || substr(text, es[len(es)].e) end) as text_md5
from d left join done using (doc_id)""")
def first_use_terms(spark, sf_dir):
    """Whole texts with at most three terms, and how many were written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", annotation.annotate_first_use(F.col("text"), TERMS, frozenset(), _MOST).alias("new"))
    written = sum((F.contains("new", F.lit(f" ({t})")) & ~F.contains(F.lower("text"), F.lit(t))).cast("int") for t in {v[0]: None for v in TERMS.values()})
    return docs.select("doc_id", written.alias("n_terms"), F.md5("new").alias("text_md5"))
