"""The calculation run over order lines as requests, with its SQL; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import calc, engine
from folioforge.plans import catalog, evidence_queries  # noqa: F401 (its SQL of the normal form is used)
from folioforge.plans.catalog import query
from folioforge.plans.tables import table

#: Passages of the benchmark that the calculations of these queries rest on: calculation, item, input, given.
_NEEDS = (
    ("cylindrical_gear_geometry", "item 11", "beta", False),
    ("cylindrical_gear_geometry", "item 16", "beta", True),
    ("cylindrical_gear_geometry", "item 1", "alpha_n", False),
    ("transverse_module", "item 3", "beta", False),
    ("transverse_module", "item 16", "beta", True),
)


def _requests(spark, sf_dir: str) -> DataFrame:
    """A request for each order line: what it asks for follows from its number, where its module comes from, from its part."""
    li, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    turn = F.col("l_linenumber") % 4
    kind = F.when(turn == 0, "worm_gear").when(turn == 3, "transverse_module").otherwise("cylindrical_gear_geometry")
    no = F.lit(None)
    one = lambda key, value, unit, prov="user_input", ref=no: F.struct(F.lit(key).alias("key"), value.cast("double").alias("value"), F.lit(unit).alias("unit") if isinstance(unit, str) else unit.alias("unit"), (F.lit(prov) if isinstance(prov, str) else prov).alias("prov_kind"), ref.cast("long").alias("ref_id"))
    prov = F.when(p % 9 == 0, "extracted_value").when(p % 9 == 1, "memory_item").otherwise("user_input")
    inputs = F.array(
        F.when(turn.isin(0, 1, 2), one("z", F.col("l_quantity") - 1, "")),
        F.when(p % 17 != 0, one("m_n", F.col("l_discount") * 100, F.when(p % 31 == 0, "inch").when(s % 5 == 0, "cm").otherwise("mm"), prov, F.when(p % 9 == 0, p).when(p % 9 == 1, s))),
        F.when((s % 2 == 0) & (turn != 3), one("alpha_n", F.lit(25.0), "derece")),
        F.when(p % 3 == 0, one("beta", F.col("l_tax") * 100, "deg")),
    )
    made = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("req_id"), kind.alias("calc_type"), (F.col("l_orderkey") % 100).alias("user_id"), F.explode(F.filter(inputs, lambda x: x.isNotNull())).alias("i"))
    return made.select("req_id", "calc_type", "user_id", "i.*")


def _resolved(spark, sf_dir: str) -> DataFrame:
    part, supplier, customer, size = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), F.col("p_size")
    extracted = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_type").alias("area"), F.when(size % 3 == 0, "draft_extraction").otherwise("user_confirmed").alias("status"), (size / 10.0).alias("value"), F.lit("mm").alias("unit"), F.when(size % 4 != 0, size / 5.0).alias("confirmed_value"), F.when(size % 5 == 0, "cm").alias("confirmed_unit"))
    memory = supplier.select(F.col("s_suppkey").alias("ref_id"), F.col("s_nationkey").cast("long").alias("owner_id"), (F.col("s_suppkey") % 2 == 0).alias("shared"), F.when(F.col("s_acctbal") > 0, "user_confirmed").otherwise("draft").alias("status"), F.when(F.col("s_suppkey") % 3 != 0, 3.0 + F.col("s_nationkey")).alias("value"), F.lit(None).cast("string").alias("unit"))
    areas = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("ECONOMY"), F.lit("STANDARD"))).otherwise(F.array(F.lit("PROMO")))
    scopes = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 10 == 0).alias("is_owner"), areas.alias("areas"))
    return engine.resolve_inputs(_requests(spark, sf_dir), extracted, memory, scopes)


def _found(spark, sf_dir: str) -> DataFrame:
    docs, labels, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    seen = docs.join(labels.filter("toxic = 1"), "doc_id", "left_anti")
    pages = seen.select("doc_id", (F.col("doc_id") % 50).cast("int").alias("page"), F.concat(F.lit("COL "), (F.col("doc_id") % 3).cast("string"), F.lit(":2020")).alias("code"), "text")
    phrases = F.filter(F.transform(F.split("text", "[.]"), lambda p: F.trim(p)), lambda x: x != "")
    asked = items.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("requirement_id"), F.concat(F.lit("col "), (F.col("item_id") % 3).cast("string")).alias("code"), (F.col("item_id") % 50).cast("int").alias("page_hint"), phrases.alias("phrases"))
    return engine.evidence(asked, pages)


def _output(key: str):
    return F.filter("outputs", lambda o: o["key"] == key)


_SQL_REQUESTS = """req0 as (select l_orderkey * 10 + l_linenumber as req_id, case when l_linenumber % 4 = 0 then 'worm_gear' when l_linenumber % 4 = 3 then 'transverse_module' else 'cylindrical_gear_geometry' end as calc_type, l_orderkey % 100 as user_id,
  unnest(list_filter([case when l_linenumber % 4 <> 3 then {key: 'z', value: l_quantity - 1, unit: '', prov_kind: 'user_input', ref_id: null::bigint} end,
    case when l_partkey % 17 <> 0 then {key: 'm_n', value: l_discount * 100, unit: case when l_partkey % 31 = 0 then 'inch' when l_suppkey % 5 = 0 then 'cm' else 'mm' end,
      prov_kind: case l_partkey % 9 when 0 then 'extracted_value' when 1 then 'memory_item' else 'user_input' end, ref_id: case l_partkey % 9 when 0 then l_partkey when 1 then l_suppkey end} end,
    case when l_suppkey % 2 = 0 and l_linenumber % 4 <> 3 then {key: 'alpha_n', value: 25.0::double, unit: 'derece', prov_kind: 'user_input', ref_id: null::bigint} end,
    case when l_partkey % 3 = 0 then {key: 'beta', value: l_tax * 100, unit: 'deg', prov_kind: 'user_input', ref_id: null::bigint} end], lambda x: x is not null)) as i from lineitem),
req as (select req_id, calc_type, user_id, i.key as key, i.value as value, i.unit as unit, i.prov_kind as prov_kind, i.ref_id as ref_id from req0),
told as (select r.*, case prov_kind when 'extracted_value' then coalesce(c_custkey % 10 = 0 or (c_nationkey % 2 = 0 and p_type in ('ECONOMY', 'STANDARD')) or (c_nationkey % 2 = 1 and p_type = 'PROMO'), false) and p_partkey is not null
    when 'memory_item' then s_suppkey is not null and (coalesce(c_custkey % 10 = 0, false) or s_nationkey = user_id or s_suppkey % 2 = 0) end as seen, p_size, s_suppkey, s_nationkey, s_acctbal
  from req r left join part on prov_kind = 'extracted_value' and p_partkey = ref_id left join supplier on prov_kind = 'memory_item' and s_suppkey = ref_id left join customer on c_custkey = user_id),
resolved as materialized (select req_id, calc_type, key, prov_kind, case when prov_kind = 'extracted_value' and seen and p_size % 3 <> 0 then (case when p_size % 4 <> 0 then p_size / 5.0::double else p_size / 10.0::double end) when prov_kind = 'memory_item' and seen and s_suppkey % 3 <> 0 then 3.0::double + s_nationkey else value end as value,
  case when prov_kind = 'extracted_value' and seen and p_size % 3 <> 0 then (case when p_size % 5 = 0 then 'cm' else 'mm' end) else unit end as unit,
  case when prov_kind = 'user_input' then 'user_input' when not seen then 'missing' when prov_kind = 'extracted_value' then (case when p_size % 3 = 0 then 'draft_extraction' else 'user_confirmed' end) when s_acctbal > 0 then 'user_confirmed' else 'draft' end as prov_status from told)"""
# the normal form of the query evidence_normal
_SQL_NORM = catalog.ORACLES["evidence_normal"].split("md5(", 1)[1].rsplit(") as normal_md5", 1)[0]
_SQL_FOUND = f"""pages as materialized (select doc_id, doc_id % 50 as page, doc_id % 3 as code, {_SQL_NORM} as norm from documents where text is not null and doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)),
phrase as materialized (select 'item ' || item_id as requirement_id, item_id % 3 as code, item_id % 50 as hint, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') as raw from benchmark),
asked as materialized (select requirement_id, code, hint, list({_SQL_NORM}) as ps from (select requirement_id, code, hint, unnest(raw) as text from phrase) group by all),
found as materialized (select requirement_id, page, doc_id from (select requirement_id, page, doc_id, row_number() over (partition by requirement_id order by page <> hint, page, doc_id) as r from pages join asked using (code)
  where len(list_filter(ps, lambda p: not contains(norm, p))) = 0) where r = 1)"""
_SQL_NEEDS = "needs as (select * from (values " + ", ".join(f"('{t}', '{r}', '{k}', {str(g).lower()})" for t, r, k, g in _NEEDS) + ") v(calc_type, requirement_id, key, given))"
_CHECKED = """checked as materialized (select *, case when not known then 'unknown_input' when prov_kind = 'extracted_value' and prov_status not in ('user_confirmed', 'verified_source') then 'draft_input_blocked'
  when prov_kind = 'memory_item' and prov_status <> 'user_confirmed' then 'draft_input_blocked' when value is null then 'invalid_value' when factor is null then 'invalid_unit' when key = 'z' and value <> floor(value) then 'not_integer'
  when not (value * factor between lo and hi) then 'out_of_range' end as code from (select *, calc_type = 'cylindrical_gear_geometry' or (calc_type = 'transverse_module' and key in ('m_n', 'beta')) as known,
  case when key = 'm_n' then (case unit when 'cm' then 10.0::double when 'mm' then 1.0::double end) else 1.0::double end as factor, case key when 'z' then 1.0::double when 'm_n' then 1e-6::double else 0.0::double end as lo,
  case key when 'z' then 100000.0::double when 'm_n' then 1e5::double else 89.0::double end as hi from resolved)),
wide as materialized (select req_id, calc_type, coalesce(list_sort(list_distinct(list(key || ':' || code) filter (known and code is not null))), []) as problems, count(*) filter (not known) as n_unknown, coalesce(list_distinct(list(key) filter (known)), []) as keys,
  """ + ", ".join(f"max(case when key = '{k}' and code is null then value * factor end) as {k}_in" for k in ("z", "m_n", "alpha_n", "beta")) + """ from checked group by 1, 2),
due as (select req_id, w.calc_type, list_sort(list(n.requirement_id) filter (f.doc_id is null)) as missing_sources, list_sort(list(n.requirement_id || '@' || f.doc_id || ':' || f.page) filter (f.doc_id is not null)) as evidence
  from wide w join needs n on n.calc_type = w.calc_type and list_contains(w.keys, n.key) = n.given left join found f using (requirement_id) group by 1, 2),
full_ as (select w.*, case calc_type when 'cylindrical_gear_geometry' then list_filter(['m_n', 'z'], lambda k: not list_contains(keys, k)) when 'transverse_module' then list_filter(['m_n'], lambda k: not list_contains(keys, k)) else [] end as missing,
  coalesce(d.missing_sources, []) as missing_sources, coalesce(d.evidence, []) as evidence, z_in as z, m_n_in as m_n, coalesce(alpha_n_in, 20.0::double) as alpha_n, coalesce(beta_in, 0.0::double) as beta, 0.0::double as x, 0.0::double as k, 1.0::double as h_aP, 1.25::double as h_fP
  from wide w left join due d using (req_id, calc_type))"""
_STATES = """coded as (select *, case when calc_type = 'worm_gear' then 'unsupported_formula' when len(problems) > 0 or n_unknown > 0 or len(missing) > 0 then 'invalid_input' when len(missing_sources) > 0 then 'missing_source' end as first_ from outs),
stated as (select *, coalesce(first_, case when calc_type = 'cylindrical_gear_geometry' and d_f <= 0 then 'invalid_input' end) as code from coded)"""


@query(f"with {_SQL_REQUESTS}, {_SQL_FOUND}, {_SQL_NEEDS}, {_CHECKED}, outs as materialized (select * from {calc.rule_sql('full_', calc.CYLINDRICAL)}), {_STATES} " + """
select req_id, calc_type, case when code is null then 'ok' when code = 'invalid_input' then code else 'refused' end as status, code, array_to_string(problems, ' ') as problems, n_unknown::bigint as n_unknown, array_to_string(missing, ' ') as missing,
  array_to_string(missing_sources, ' ') as missing_sources, array_to_string(evidence, ' ') as evidence,
  case when first_ is not null then '' when calc_type = 'transverse_module' then (case when beta_in is null then 'beta' else '' end) else array_to_string(list_filter([case when alpha_n_in is null then 'alpha_n' end, case when beta_in is null then 'beta' end, 'x', 'k', 'h_aP', 'h_fP'], lambda c: c is not null), ' ') end as constants,
  round(case when code is null then m_t end, 6) as m_t, round(case when code is null and calc_type <> 'transverse_module' then d_b end, 6) as d_b, round(case when code is null and calc_type <> 'transverse_module' then d_f end, 6) as d_f from stated""")
def engine_run(spark, sf_dir):
    """Requests of all order lines from provenance to status, resting on passages of the benchmark that documents state."""
    found, needs = _found(spark, sf_dir), spark.createDataFrame(list(_NEEDS), engine.NEED)
    out = engine.run(_resolved(spark, sf_dir), needs, found)
    joined = [F.array_join(c, " ").alias(c) for c in ("problems", "missing", "missing_sources", "constants")]
    told = F.transform("evidence", lambda e: F.concat(e["requirement_id"], F.lit("@"), e["doc_id"].cast("string"), F.lit(":"), e["page"].cast("string")))
    stated = F.array_join(F.array_sort(told), " ").alias("evidence")  # in the order of the texts: 'item 11@' stands before 'item 1@'
    values = [F.round(F.try_element_at(_output(k), F.lit(1))["value"], 6).alias(k) for k in ("m_t", "d_b", "d_f")]
    return out.select("req_id", "calc_type", "status", "code", "n_unknown", *joined, stated, *values)


@query(f"with {_SQL_REQUESTS} select key, prov_kind, prov_status, unit, count(*)::bigint as n, round(sum(value), 3) as total from resolved group by all")
def input_provenance(spark, sf_dir):
    """Inputs of all requests by what they point to."""
    return _resolved(spark, sf_dir).groupBy("key", "prov_kind", "prov_status", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
