"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain > language > source.  A token budget flows down it: each node
splits its budget among its children by weight; a child that can't use its
share (its subtree's tokens times ``max_epochs``) takes what it can, and the
shortage goes to its siblings in proportion to their weights.  Only what all
siblings together can't use goes to the ancestor's other children.  With the
capacity of a node known before the split, one water-filling for each parent
does this exactly: with children sorted by capacity/weight, the level is
(budget - capacities of the saturated) / (weights of the others).

Each leaf then takes a token prefix of its seeded epochs: epoch e orders the
documents by md5(seed, e, doc_id); whole epochs are taken while the budget
lasts, then the documents whose running token sum stays within the rest.

Plan.  Only node totals meet in windows; they are grouped with partial
aggregation.  The last epoch of a leaf isn't sorted in one task: its documents
fall into 4096 ranges of the order, range sums find the range where the budget
ends, and only documents of that range are sorted.

Defined cases: null lang or source is the value ''; a null text has 0 tokens
and, like any text without a word, is never selected; rows with a null
``doc_id`` are left out; repeated rows are documents of their own with tied
order, and ties are all taken or all left; the words of a very long text are
counted whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.lineage import broadcast_if_small, cut

SEED, SHARE, MAX_EPOCHS, DOMAINS = 17, 0.6, 2, 4
#: Relative weights, numbers exact in binary so that sums don't depend on their order.
DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
#: Leaves up to which the plan of budgets is broadcast (about 150 bytes each).
BROADCAST_ROWS = 100_000


def tokens(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def default_domain(source: Column) -> Column:
    """A domain for each source where none is given."""
    return F.concat(F.lit("domain"), F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) / F.lit(16 // DOMAINS)).cast("string"))


def _weight(col: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(col == k, F.lit(float(v))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Water-filling among siblings: adds ``name``_budget to nodes with weight and cap."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    ahead = w.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("_done", F.coalesce(F.sum("cap").over(ahead), F.lit(0))).withColumn("_left", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    n = n.withColumn("_level", (F.col(budget) - F.col("_done")) / F.col("_left"))
    # the level that holds is that of the first child it doesn't saturate
    n = n.withColumn("_open", F.min(F.when(F.col("cap") / F.col("weight") > F.col("_level"), F.struct(F.col("cap") / F.col("weight"), F.col(name), F.col("_level").alias("level")))).over(w)["level"])
    share = F.when(F.col("_open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("_open") * F.col("weight"))))
    return n.withColumn(f"{name}_budget", share.cast("long")).drop("_done", "_left", "_level", "_open")


def leaf_budgets(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, domain_weights: dict | None = None, lang_weights: dict | None = None, source_weights: dict | None = None) -> DataFrame:
    """``leaves(domain, lang, source, avail)`` with ``budget`` tokens for each leaf."""
    dw, lw, sw = (DOMAIN_WEIGHTS if domain_weights is None else domain_weights), (LANG_WEIGHTS if lang_weights is None else lang_weights), source_weights or {}
    cap = leaves.filter("avail > 0").withColumn("cap", F.col("avail") * F.lit(max_epochs))
    langs = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    doms = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = F.floor(F.sum("cap").over(Window.partitionBy(F.lit(1))) / F.lit(max_epochs) * F.lit(float(share))).cast("long")
    doms = _fill(doms.withColumn("total", total).withColumn("weight", _weight(F.col("domain"), dw)), [], "domain", "total").select("domain", "domain_budget")
    langs = _fill(langs.join(doms, "domain").withColumn("weight", _weight(F.col("lang"), lw)), ["domain"], "lang", "domain_budget").select("domain", "lang", "lang_budget")
    out = _fill(cap.join(langs, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), sw)), ["domain", "lang"], "source", "lang_budget")
    return out.select("domain", "lang", "source", "avail", F.col("source_budget").alias("budget"))


def mix(docs: DataFrame, domain: Column | None = None, seed: int = SEED, **options) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, epoch)``: one row for each time a document is taken."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"))
    src = src.filter("doc_id is not null and n_tokens > 0").withColumn("domain", default_domain(F.col("source")) if domain is None else domain)
    src = cut(src, "tokens")  # the texts are read once; what follows works on a few bytes a document
    leaf = ["domain", "lang", "source"]
    plan = leaf_budgets(src.groupBy(*leaf).agg(F.sum("n_tokens").alias("avail")), **options)
    plan = cut(plan.withColumn("whole", F.expr("budget div avail")).withColumn("rest", F.expr("budget % avail")), "budgets")
    plan, _ = broadcast_if_small(plan, BROADCAST_ROWS)
    x = src.join(plan, leaf).withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.col("whole") + 1, "doc_id"))).withColumn("range", F.substring("order", 1, 3))
    sums = x.groupBy(*leaf, "range", "rest").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(*leaf).orderBy("range")
    upto = sums.withColumn("run", F.sum("t").over(before))
    last = cut(upto.filter("run > rest").groupBy(*leaf).agg(F.min(F.struct("range", F.expr("run - t").alias("base"))).alias("c")).select(*leaf, F.col("c.range").alias("cut_range"), F.col("c.base").alias("base")), "cuts")
    last, _ = broadcast_if_small(last, BROADCAST_ROWS)
    # a leaf's rest is less than its tokens, so each leaf has such a range
    y = x.join(last, leaf)
    sure = y.filter("range < cut_range").select("doc_id", *leaf, "n_tokens", "whole", F.lit(True).alias("extra"))
    at = Window.partitionBy(*leaf).orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = y.filter("range = cut_range").withColumn("run", F.col("base") + F.sum("n_tokens").over(at)).select("doc_id", *leaf, "n_tokens", "whole", (F.col("run") <= F.col("rest")).alias("extra"))
    over = y.filter("range > cut_range").select("doc_id", *leaf, "n_tokens", "whole", F.lit(False).alias("extra"))
    took = sure.unionByName(edge).unionByName(over).withColumn("times", F.col("whole") + F.col("extra").cast("int")).filter("times > 0")
    return took.select("doc_id", *leaf, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("epoch"))


def _case(col: str, weights: dict[str, float]) -> str:
    return "case " + " ".join(f"when {col} = '{k}' then {float(v)}::double" for k, v in weights.items()) + " else 1.0::double end"


def _sql_fill(src: str, parent: str, name: str, budget: str) -> str:
    part = f"partition by {parent}" if parent else ""
    return f"""(
  select * exclude (done_, left_, level_, open_), (case when open_ is null then cap else least(cap, floor(open_.level * weight)) end)::bigint as {name}_budget from (
    select *, min(case when cap / weight > level_ then struct_pack(r := cap / weight, n := {name}, level := level_) end) over ({part}) as open_ from (
      select *, ({budget} - done_) / left_ as level_ from (
        select *, coalesce(sum(cap) over ({part} order by cap / weight, {name} rows between unbounded preceding and 1 preceding), 0)::bigint as done_,
          sum(weight) over ({part}) - coalesce(sum(weight) over ({part} order by cap / weight, {name} rows between unbounded preceding and 1 preceding), 0.0) as left_ from {src}))))"""


def oracle(docs: str = "documents", columns: str = "doc_id, domain, lang, source, n_tokens, epoch") -> str:
    """DuckDB SQL of ``mix`` over a relation of documents."""
    return f"""
with d as materialized (
  select doc_id, coalesce(lang, '') as lang, source, concat('domain', (instr('0123456789abcdef', md5(source)[1]) - 1) // {16 // DOMAINS}) as domain, n_tokens from (
    select doc_id, lang, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from {docs}
  ) x where doc_id is not null and n_tokens > 0
), leaves as (select domain, lang, source, sum(n_tokens)::bigint as avail, (sum(n_tokens) * {MAX_EPOCHS})::bigint as cap from d group by 1, 2, 3),
l0 as (select domain, lang, sum(cap)::bigint as cap from leaves group by 1, 2), d0 as (select domain, sum(cap)::bigint as cap from l0 group by 1),
t0 as (select floor(sum(cap) / {MAX_EPOCHS} * {SHARE}::double)::bigint as total from d0),
d1 as (select d0.*, total, {_case('domain', DOMAIN_WEIGHTS)} as weight from d0, t0), d2 as {_sql_fill('d1', '', 'domain', 'total')},
l1 as (select l0.*, domain_budget, {_case('lang', LANG_WEIGHTS)} as weight from l0 join d2 using (domain)), l2 as {_sql_fill('l1', 'domain', 'lang', 'domain_budget')},
s1 as (select leaves.*, lang_budget, 1.0::double as weight from leaves join l2 using (domain, lang)), s2 as {_sql_fill('s1', 'domain, lang', 'source', 'lang_budget')},
p as (select domain, lang, source, source_budget // avail as whole, source_budget % avail as rest from s2),
r as (select d.*, whole, rest, sum(n_tokens) over (partition by domain, lang, source order by md5(concat_ws('|', '{SEED}', (whole + 1)::varchar, doc_id::varchar)) range between unbounded preceding and current row) as run from d join p using (domain, lang, source)),
q as (select *, whole + (case when run <= rest then 1 else 0 end) as times from r)
select {columns} from (select doc_id, domain, lang, source, n_tokens, unnest(range(1, times + 1))::bigint as epoch from q where times > 0)
"""


ORACLE = oracle()
