"""Queries over the eligible view, lists, counts and re-runs, with their SQL; registered with those of ``catalog``.

The driver's tables stand for the collection: documents with labels for
versions, languages for areas, orders and their items for what users keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import evidence as E
from folioforge.operators import critical, packing, reingest, relational, search, symbols
from folioforge.plans import catalog
from folioforge.plans.catalog import query
from folioforge.plans.lineage import cut
from folioforge.plans.tables import table

_ELIGIBLE = """eligible as materialized (select d.doc_id, d.text, d.source as code, d.lang as area from documents d join labels l using (doc_id)
  where l.quality = 1 and length(d.text) > 0 and coalesce(l.toxic, 0) = 0 and d.lang in ('en', 'de', 'fr'))"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, clean, non-empty documents of the verified languages."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    versions = labels.select("doc_id", (F.coalesce("toxic", F.lit(0)) == 0).alias("active"), F.when(F.col("quality") == 1, "verified").otherwise("needs_review").alias("corpus"))
    versions = versions.join(d.select("doc_id", F.when(F.length("text") > 0, "indexed").otherwise("failed").alias("ingestion")), "doc_id")
    areas = spark.createDataFrame([("en", True), ("de", True), ("fr", True), ("es", False)], "area string, area_verified boolean")
    return E.evidence_view(d.select("doc_id", "text"), versions, d.select("doc_id", F.col("lang").alias("area"), F.col("source").alias("code")), areas)


@query(f"with {_ELIGIBLE} select doc_id, area, code, length(text)::bigint as n_chars from eligible")
def evidence_view(spark, sf_dir):
    return _eligible(spark, sf_dir).select("doc_id", "area", "code", F.length("text").cast("long").alias("n_chars"))


@query(f"with {_ELIGIBLE}, {catalog._POSTINGS.replace(' from documents', ' from eligible')}, {catalog._TERMS}, {catalog._CHANNELS}, {catalog._FUSED} select qid, doc_id, fused, n_channels from fused")
def search_eligible(spark, sf_dir):
    """Both channels over the eligible view only: text that isn't approved can't be returned."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    terms = search.question_terms(questions, 6)
    index = cut(search.postings(_eligible(spark, sf_dir), only=terms), "postings")
    fused = search.fuse({"lexical": search.lexical_channel(index, terms), "exact": search.exact_channel(index, terms)})
    return fused.select("qid", "doc_id", "fused", "n_channels")


@query("select s_suppkey, s_name from supplier where regexp_matches(s_name, '(?:^|[^0-9])0*(?:12|95|7)(?:[^0-9]|$)')")
def code_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").filter(E.has_code(F.col("s_name"), ["12", "95", "7"]))


@query("""with f as (select c_custkey, c_name, c_mktsegment, c_acctbal from customer where c_mktsegment = 'BUILDING' and (contains(lower(c_name), '00') or contains(lower(c_mktsegment), '00')))
select c_custkey, c_name, c_acctbal, (select count(*) from f)::bigint as total from f order by c_acctbal desc, c_custkey limit 50 offset 10""")
def document_list(spark, sf_dir):
    """The second page of a filtered list, with its total."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return E.document_list(rows, "00", ["c_name", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 50, 10, c_mktsegment="BUILDING").select("c_custkey", "c_name", "c_acctbal", "total")


@query("""select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and (o_custkey = 7 or o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'N' and l_quantity >= 49))
order by o_orderdate desc, o_orderkey limit 500""")
def conversation_list(spark, sf_dir):
    """The newest 500 open ones that are the owner's or granted."""
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", "o_custkey")
    grants = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' and l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.granted_list(rows, grants, "o_orderkey", F.col("o_custkey") == 7, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_orderdate")


@query("""select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linestatus = 'O' and l_suppkey in (select s_suppkey from supplier where s_nationkey in (1, 3, 5))
order by l_shipdate, l_orderkey, l_linenumber limit 200""")
def draft_queue(spark, sf_dir):
    drafts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_linestatus")
    scopes = table(spark, sf_dir, "supplier").filter(F.col("s_nationkey").isin(1, 3, 5)).select(F.col("s_suppkey").alias("l_suppkey"))
    return E.draft_queue(drafts, scopes, "l_suppkey", F.col("l_linestatus") == "O", [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 200).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""select 'orders' as part, o_orderstatus as status, count(*)::bigint as n from orders group by 2 union all select 'drafts', l_linestatus, count(*) from lineitem group by 2
union all select 'documents', lang, count(*) from documents group by 2 union all select 'labels', quality::varchar, count(*) from labels group by 2 union all select 'turns', role, count(*) from conversations group by 2""")
def counts_by_status(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return E.status_counts({"orders": (t("orders"), "o_orderstatus"), "drafts": (t("lineitem"), "l_linestatus"), "documents": (t("documents"), "lang"), "labels": (t("labels"), "quality"), "turns": (t("conversations"), "role")})


@query(catalog._PACK + "select lang, source, count(*)::bigint as n_chunks, sum(n_lines)::bigint as n_lines, sum(tokens)::bigint as n_tokens from chunks join documents using (doc_id) group by lang, source")
def chunk_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return E.chunk_matrix(packing.pack_lines(d).select("doc_id", "n_lines", "tokens").join(d.select("doc_id", "lang", "source"), "doc_id"), ["lang", "source"])


@query("""select c_custkey, n_name, o_orderkey, o_orderstatus from customer left join nation on c_nationkey = n_nationkey
left join (select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1) on o_custkey = c_custkey""")
def documents_current(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    last = E.newest(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate"), "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return E.current(c.select("c_custkey", "c_nationkey"), n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", last, "c_custkey").select("c_custkey", "n_name", "o_orderkey", "o_orderstatus")


@query("select l_orderkey as node, l_suppkey as other, 'out' as direction from lineitem union all select l_suppkey, l_orderkey, 'in' from lineitem")
def relationships_both(spark, sf_dir):
    return E.relationships(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("""select c.conv_id, c.turn, s.n_turns from conversations c join (select conv_id, count(*)::bigint as n_turns from conversations group by 1) s using (conv_id) where c.role = 'user' and contains(lower(c.text), 'the')""")
def memory_conversations(spark, sf_dir):
    """Remembered turns that hold a word, with their conversations."""
    c = table(spark, sf_dir, "conversations")
    found = c.filter((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")
    return found.join(c.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conv_id")


_SQL_SQUASH = "regexp_replace({}, '[\\s\\x{{00A0}}]+', '', 'g')"


@query(f"""select doc_id, case when len(ls) = 0 then 1.0 else len(list_filter(ls, lambda x: contains(held, x))) / len(ls)::double end as coverage from (select doc_id, {_SQL_SQUASH.format('text')} as held,
  list_filter(list_transform(string_split({catalog._NORMAL}, chr(10)), lambda x: {_SQL_SQUASH.format('x')}), lambda x: length(x) >= 4) as ls from documents)""")
def content_coverage(spark, sf_dir):
    """Share of each normalised page's lines that the text, which its chunks are made of, holds."""
    return table(spark, sf_dir, "documents").select("doc_id", E.content_coverage(T.normalize_text(F.col("text")), F.col("text")).alias("coverage"))


@query("""select item_id as chunk_id, min(score) as confidence, bool_or(draft) as draft from benchmark join (select doc_id, length(text)::double / (length(text) + 1000) as score, contains(text, '|') as draft from documents) on doc_id between item_id and item_id + 3 group by 1""")
def weakest_page(spark, sf_dir):
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("item_id").alias("p0"), (F.col("item_id") + 3).alias("p1"))
    size = F.length("text").cast("double")
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), (size / (F.length("text") + 1000)).alias("score"), F.contains("text", F.lit("|")).alias("draft"))
    return E.weakest_page(chunks, pages)


@query("""select doc_id, array_to_string(list_slice(list_filter(ls, lambda x, i: list_position(ls, x) = i), 1, 8), ' / ') as labels from (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) <= 80 and regexp_matches(x, '^[A-Z]')) as ls from documents)""")
def label_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(E.label_lines(F.col("text")), " / ").alias("labels"))


@query("""select doc_id, md5(translate(replace(replace(lower(trim(regexp_replace(translate(text, '‐‑‒–—−', '------'), '[\\s\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}]+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ'),
  'αβγδεζηθικλνξπρστυφχψω', 'abgdezhqiklnxprstufcyw')) as normal_md5 from documents""")
def evidence_normal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(E.evidence_normal(F.col("text"))).alias("normal_md5"))


@query(f"""select n.doc_id, case when coalesce(l.quality = 1 and n.h = md5(d.text), false) then 'user_confirmed' else 'draft' end as status, coalesce(l.quality = 1 and n.h = md5(d.text), false) as kept
from (select doc_id, md5({catalog._NORMAL}) as h from documents) n join documents d using (doc_id) left join labels l using (doc_id)""")
def confirmations_kept(spark, sf_dir):
    """Confirmed pages (label 1) whose text a new run, which normalises it, leaves as it was."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    before = d.join(labels, "doc_id").select("doc_id", F.md5("text").alias("text_hash"), F.when(F.col("quality") == 1, "user_confirmed").otherwise("draft").alias("status"))
    after = d.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("text_hash"), F.lit("draft").alias("status"))
    return E.preserved(before, after, "doc_id").select("doc_id", "status", "kept")


_PACKED_TEXT = catalog._PACK.rsplit("), t as (", 1)[0] + ") "


@query(_PACKED_TEXT + f"""select q.doc_id, q.doc_id as cite_id, m.chunk from (select doc_id, substr({_SQL_SQUASH.format('text')}, 1, 80) as s from documents) q
left join (select c.doc_id, min(c.chunk)::bigint as chunk from c join documents d using (doc_id) where contains({_SQL_SQUASH.format('c.text')}, substr({_SQL_SQUASH.format('d.text')}, 1, 80)) group by 1) m using (doc_id)""")
def citations_remapped(spark, sf_dir):
    """Each text's start as a citation, on the first of its packed chunks that holds it."""
    d = table(spark, sf_dir, "documents")
    return E.remapped(d.select("doc_id", F.col("doc_id").alias("cite_id"), F.col("text").alias("quote")), packing.pack_lines(d), "doc_id", "chunk").select("doc_id", "cite_id", "chunk")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as n from documents),
old as (select doc_id, count(*) as c, sum(length(line)) as k, list(line order by n) as t from l group by 1),
new as (select doc_id, count(*) as c, sum(length(x)) as k, list(x order by n) as t from (select doc_id, n, trim(line) as x from l) where x <> '' group by 1),
f as (select d.doc_id, case when quality = 1 then 'verified' else 'needs_review' end as corpus_status, old.c as oc, old.k as ok, new.c as nc, new.k as nk, old.t as ot, new.t as nt, contains(text, chr(65533)) as bad
  from documents d left join labels using (doc_id) left join old using (doc_id) left join new using (doc_id))
select doc_id as version_id, corpus_status, coalesce(oc, 0)::bigint as old_chunks, coalesce(nc, 0)::bigint as new_chunks, coalesce(ok, 0)::bigint as old_chars, coalesce(nk, 0)::bigint as new_chars,
  case when bad or nt is null then 'blocked_gates' when corpus_status = 'verified' and ot <> nt then 'blocked_verified' when ot = nt then 'unchanged' else 'apply' end as decision from f""")
def reingest_report(spark, sf_dir):
    """Lines as stored chunks, trimmed lines without blank ones as a new extraction of every document."""
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    old = d.select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("chunk_no", "text"))
    new = old.withColumn("text", F.trim("text")).filter("text <> ''")
    gates = d.select(F.col("doc_id").alias("version_id"), F.lit("clean_glyphs").alias("gate"), F.when(F.contains("text", F.lit("�")), "fail").otherwise("pass").alias("status"))
    versions = d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("version_id"), F.when(F.col("quality") == 1, "verified").otherwise("needs_review").alias("corpus_status"))
    out = reingest.decisions(reingest.digests(new), reingest.digests(old), gates, versions)
    return out.select("version_id", "corpus_status", "old_chunks", "new_chunks", "old_chars", "new_chars", "decision")


_SYMBOL_WORDS = ", ".join(f"'{w}'" for w in symbols.WORDS)
_SYMBOLS = f"""tokens as (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as s from documents),
found as materialized (select distinct doc_id, s from tokens where length(s) between 2 and 6 and regexp_matches(s, '^\\p{{L}}') and lower(s) not in ({_SYMBOL_WORDS})
  and (regexp_matches(lower(s), '[α-ω]') or (regexp_matches(substr(s, 2), '[A-Z]') and regexp_matches(s, '[a-z]')) or (length(s) <= 3 and lower(s) = s) or regexp_matches(s, '[0-9]')))"""


@query(f"with {_SYMBOLS} select doc_id, count(*)::bigint as n_symbols, md5(string_agg(s, ' ' order by s)) as symbols_md5 from found group by doc_id")
def symbol_lexicon(spark, sf_dir):
    """Symbols of each document, from its whole text."""
    found = symbols.lexicon(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("symbols").cast("long").alias("n_symbols"), F.md5(F.array_join("symbols", " ")).alias("symbols_md5"))


# the joins of the first pass, by places of letters and of what follows them; a letter taken by the join before it is no beginning
@query(f"""with {_SYMBOLS}, p as (select doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') as ps from documents),
spot as (select doc_id, i, ps[i] as a, ps[i + 2] as b from p, unnest(range(1, len(ps) - 1)) t(i) where ps[i + 1] = ' ' and length(ps[i]) = 1 and regexp_matches(ps[i], '\\p{{L}}') and length(ps[i + 2]) <= 4),
ok as materialized (select spot.* from spot join found f on f.doc_id = spot.doc_id and f.s = a || b)
select d.doc_id, (select count(*) from ok where ok.doc_id = d.doc_id) > 0 as joined from documents d""")
def symbols_rejoined(spark, sf_dir):
    """Whether a document's text changes by the rejoining of its split symbols."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    return symbols.rejoin(docs).select("doc_id", (F.col("text") != F.col("whole")).alias("joined"))


@query("""with c as (select o_custkey, year(o_orderdate)::varchar || '.' || month(o_orderdate) || '.' || day(o_orderdate) as clause from orders),
r as (select distinct o_custkey, y || m as clause from orders, unnest(['1992', '1995', '1998']) a(y), unnest(['', '.1', '.12']) b(m))
select r.o_custkey, r.clause, count(c.clause)::bigint as n_chunks, count(c.clause) > 0 as preserved from r left join c on c.o_custkey = r.o_custkey and (c.clause = r.clause or starts_with(c.clause, r.clause || '.')) group by 1, 2""")
def clauses_preserved(spark, sf_dir):
    """Order dates as clauses of a customer; years and their months 1 and 12 are required."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    chunks = o.select("o_custkey", F.concat_ws(".", F.year(d), F.month(d), F.dayofmonth(d)).alias("clause"))
    wanted = o.select("o_custkey", F.explode(F.array(*(F.lit(y + m) for y in ("1992", "1995", "1998") for m in ("", ".1", ".12")))).alias("clause"))
    return critical.clauses_preserved(wanted, chunks, "o_custkey")


_CRITICAL = {"en": ("the", "and", "of", "(c)"), "de": ("der", "und", "die"), "fr": ("le", "et", "les"), "es": ("el", "y", "los")}


@query("with r as (select * from (values " + ", ".join(f"('{k}', '{t}')" for k, ts in _CRITICAL.items() for t in ts) + """) v(lang, token))
select doc_id, count(token)::bigint as n_required, string_agg(token, ' ' order by token) filter (not case when starts_with(token, '(') then contains(text, token)
  else regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || token || '($|[^\\p{L}\\p{N}_])') end) as missing from documents left join r using (lang) group by doc_id""")
def critical_tokens(spark, sf_dir):
    """Words that a text of its language should hold, in whole texts."""
    required = spark.createDataFrame([(k, t) for k, ts in _CRITICAL.items() for t in ts], "lang string, token string")
    out = critical.tokens_missing(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), required, "lang")
    return out.select("doc_id", "n_required", F.when(F.size("missing") > 0, F.array_join("missing", " ")).alias("missing"))


@query("""with n as (select conv_id, row_number() over w as n_messages, first(turn) over s as first_turn, turn as last_turn, coalesce(sum(length(text)) over s, 0) as n_chars from conversations
  window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first), s as (partition by conv_id order by turn nulls first, role nulls first, text nulls first rows between 3 preceding and current row))
select conv_id, n_messages::bigint as n_messages, first_turn::bigint as first_turn, last_turn::bigint as last_turn, n_chars::bigint as n_chars from n where n_messages % 4 = 0""")
def summaries_due(spark, sf_dir):
    return relational.summaries_due(table(spark, sf_dir, "conversations"), 4)
