"""Formula pieces and chunk context over the lines of all documents, with their SQL; registered with those of ``catalog``.

The documents are plain prose, so lines stand for units: lines with bars are
tables, those that begin as 'x is ...' legends, other short ones formulas; ten
lines are a section and a chunk; a document's own 'x is ...' are its glossary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.operators import context
from folioforge.plans.catalog import query
from folioforge.plans.lineage import cut
from folioforge.plans.tables import table

_TERM = "([A-Za-z]+) (?:is|est|ist|es) ([a-z][a-z ]{2,79})"


def _units(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.regexp_like("text", F.lit(context._LEGEND)), "legend").when(F.length("text") < 60, "formula").otherwise("paragraph")
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("ord"))
    return line.select(
        "doc_id", F.floor(F.col("ord") / 10).cast("int").alias("section"), "ord", kind.alias("kind"), F.col("ord").cast("string").alias("label"), "text",
        F.when(F.length(before) < 60, before).alias("lead_in"), F.lit(None).cast("string").alias("see_also"), F.when(F.regexp_like("text", F.lit("[0-9]")), "digits").alias("review"),
    )


def _glossary(spark, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_TERM), F.lit(g)).alias(n) for g, n in ((1, "symbol"), (2, "description"))])).alias("t"))
    return found.select("doc_id", "t.symbol", "t.description", F.lit(None).cast("string").alias("unit"), F.lit("text").alias("source"))


def _parts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units, glossary = cut(_units(spark, sf_dir), "units"), cut(_glossary(spark, sf_dir), "glossary")
    return units, context.formula_pieces(units, glossary), context.table_facts(units, glossary)


_NAME = context._NAME.replace("IsGreek", "Greek")
_LEGEND = context._LEGEND.replace("IsGreek", "Greek")
_SQL = f"""line as (select doc_id, source, lang, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10))))) as ord from documents where text is not null),
u as materialized (select *, ord // 10 as section, case when contains(text, '|') then 'table' when regexp_matches(text, '{_LEGEND}') then 'legend' when length(text) < 60 then 'formula' else 'paragraph' end as kind, lag(text) over (partition by doc_id order by ord) as prev from line),
glo as materialized (select doc_id, symbol, min(description) as description from (select doc_id, unnest(regexp_extract_all(text, '{_TERM}', 1)) as symbol, unnest(regexp_extract_all(text, '{_TERM}', 2)) as description from documents) group by 1, 2),
nxt as (select *, min(case when kind <> 'formula' then ord end) over (partition by doc_id, section order by ord rows between 1 following and unbounded following) as behind from u),
f as materialized (select a.doc_id, a.section, a.ord, a.text as line, case when length(a.prev) < 60 then a.prev end as lead, b.text as legend,
  list_filter(regexp_extract_all(a.text, '{_NAME}'), lambda s: length(s) <= 8 and lower(s) not in ({', '.join(f"'{w}'" for w in context.FUNCTIONS)})) as names from nxt a left join u b on b.doc_id = a.doc_id and b.ord = a.behind and b.kind = 'legend' where a.kind = 'formula'),
g as materialized (select *, list_filter(names, lambda s, i: list_position(names, s) = i) as symbols, regexp_extract(legend, '{_LEGEND}', 1) as own, trim(regexp_extract(legend, '{_LEGEND}', 2)) as own_said, nullif(regexp_extract(legend, '{_LEGEND}', 3), '') as own_unit from f),
k as (select doc_id, ord, list(symbol order by place) as ks, list(description order by place) as ds from (select doc_id, ord, unnest(symbols) as symbol, unnest(range(0, len(symbols))) as place, own from g) s join glo using (doc_id, symbol) where own is null or symbol <> own group by 1, 2),
p as materialized (select g.*, case when own <> '' then [own] else [] end || coalesce(ks, []) as vs, case when own <> '' then [own_said] else [] end || coalesce(ds, []) as says,
  array_to_string(list_filter([lead, line, legend], lambda x: x is not null and trim(x, ' ') <> ''), chr(10)) as piece from g left join k using (doc_id, ord))"""


@query(f"with {_SQL} select doc_id, ord::int as ord, md5(piece) as text_md5, array_to_string(symbols, ' ') as symbols, array_to_string(list_transform(vs, lambda v, i: v || '=' || says[i]), '; ') as variables from p")
def formula_pieces(spark, sf_dir):
    """Short lines of all documents as formulas, with lead-in, legend and meanings."""
    _, pieces, _ = _parts(spark, sf_dir)
    said = F.array_join(F.transform("variables", lambda v: F.concat(v["symbol"], F.lit("="), v["description"])), "; ")
    return pieces.select("doc_id", "ord", F.md5("text").alias("text_md5"), F.array_join("symbols", " ").alias("symbols"), said.alias("variables"))


@query(f"""with {_SQL}, vars as (select doc_id, section, ord, unnest(vs) as v, unnest(says) as s, unnest(range(0, len(vs))) as place, own, own_unit from p),
told as (select *, case when v = own then own_unit end as un, row_number() over (partition by doc_id, section, v order by ord, place) as r from vars where trim(s, ' ') <> ''),
lines as (select doc_id, section, list(v || ': ' || s || case when un is not null then ' [' || un || ']' else '' end order by ord, place) filter (r = 1) as ls from told group by 1, 2),
units_ as (select doc_id, section, list(un order by ord, place) as us from (select *, row_number() over (partition by doc_id, section, un order by ord, place) as ru from (select *, case when v = own and place = 0 then own_unit end as un from vars) where un is not null) where ru = 1 group by 1, 2),
sym as (select doc_id, section, list(s order by ord, place) as ss from (select *, row_number() over (partition by doc_id, section, s order by ord, place) as r from (select doc_id, section, ord, unnest(symbols) as s, unnest(range(0, len(symbols))) as place from p)) where r = 1 group by 1, 2),
eq as (select doc_id, section, string_agg(ord::varchar, ' ' order by ord) as equations, string_agg('formula (' || ord || '): digits', '; ' order by ord) filter (regexp_matches(line, '[0-9]')) as reasons from p group by 1, 2),
tab as (select doc_id, section, arg_min(text, ord) as t from u where kind = 'table' group by 1, 2),
cols as (select doc_id, section, list_filter(list_transform(string_split(regexp_replace(trim(t, ' '), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c, ' ')), lambda c: c <> '') as cs from tab)
select c.doc_id, c.section::int as idx, md5(array_to_string(list_slice([c.source || ' › ' || c.lang] || coalesce(ls, []) || case when len(cs) > 0 then ['Columns: ' || array_to_string(cs, ' | ')] else [] end, 1, 20), chr(10))) as context_md5,
  coalesce(array_to_string(list_slice(ss, 1, 40), ' '), '') as symbols, coalesce(array_to_string(us, ' '), '') as units, coalesce(equations, '') as equations, coalesce(reasons, '') as reasons
from (select distinct doc_id, section, source, lang from u) c left join lines using (doc_id, section) left join units_ using (doc_id, section) left join sym using (doc_id, section) left join eq using (doc_id, section) left join cols using (doc_id, section)""")
def chunk_context(spark, sf_dir):
    """Context lines of all chunks of ten lines: source and language, meanings, the columns of their first table."""
    units, pieces, tables = _parts(spark, sf_dir)
    named = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.array("lang").alias("path"))
    held = units.groupBy("doc_id", F.col("section").alias("idx")).agg(F.array_sort(F.collect_list("ord")).alias("ords"))
    out = context.chunk_context(held.join(named, "doc_id"), pieces, tables)
    return out.select("doc_id", "idx", F.md5("context").alias("context_md5"), *[F.array_join(c, " ").alias(c) for c in ("symbols", "units", "equations")], F.array_join("reasons", "; ").alias("reasons"))
