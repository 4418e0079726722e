"""The query catalogue: each operator applied to whole driver tables, with DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import calc, diagnosis, grounding, packing, relational, search
from folioforge.plans.lineage import cut
from folioforge.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ text

_FEATURES = """
  len(regexp_extract_all(text, '[A-Za-z]+')) as w, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]{8,}'), lambda x: length(x) - 7)), 0)::bigint as l,
  len(regexp_extract_all(text, '[0-9]')) as d, len(regexp_extract_all(text, '[^\\x00-\\x7F]')) as n, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) as p,
  len(regexp_extract_all(text, chr(10))) as nl"""
_ESTIMATE = "greatest(1, ceil(0.217::double + 0.842::double * w::double + 0.276::double * l::double + 1.249::double * d::double + 1.327::double * n::double + 0.987::double * p::double + 1.108::double * nl::double))::bigint"


@query(f"select doc_id, case when text = '' then 0 else {_ESTIMATE} end::bigint as tokens from (select doc_id, text, {_FEATURES} from documents)")
def text_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""select doc_id, case when coalesce(length(text), 0) = 0 then 0.0 else round((n - odd) / n * (1.0::double - least(1.0::double, 20.0::double * bad / n)), 6) end::double as score from (
  select doc_id, text, length(text)::double as n, len(regexp_extract_all(translate(text, chr(10) || chr(9) || ' ', ''), '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Z}]')) as odd, length(text) - length(replace(text, chr(65533), '')) as bad from documents)""")
def text_page_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.page_quality(F.col("text")), 6).alias("score"))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>|</div>|</li>|</h[0-9]>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in T.ENTITIES.items():
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query(f"select page_id, md5(t) as text_md5, length(t)::bigint as n_chars from (select page_id, {_STRIP} as t from pages)")
def text_html_strip(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


_NORMAL = """regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(replace(
  regexp_replace(replace(regexp_replace(translate(text, '‐‑‒', '---'), '\\x{00AD}[ \\t]*\\r?\\n', '', 'g'), chr(173), '-'), '[\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', ' ', 'g'),
  chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: not regexp_matches(trim(x), '(?:^Not for Resale\\s*$)|(?:^--`[`,\\-]*---\\s*$)')), chr(10)),
  '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '')"""


@query(f"select doc_id, md5({_NORMAL}) as text_md5 from documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("text_md5"))


@query("""select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, chr(31))) as sentences_md5 from (select doc_id, list_filter(string_split(
  regexp_replace(text, '([.!?;:])\\s+([A-Z(\"“—–-]|[0-9]+\\s)', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '') as s from documents)""")
def text_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\u001f")).alias("sentences_md5"))


def _sql_numbers(x: str) -> str:
    raw = f"list_filter(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_.,]+'), lambda r: case when regexp_extract(r, '^([0-9]+[.,][0-9]+)(?:$|[.,])', 1) <> '' then regexp_extract(r, '^([0-9]+[.,][0-9]+)(?:$|[.,])', 1) else regexp_extract(r, '^([0-9]+)(?:$|[.,])', 1) end), lambda n: n <> '')"
    point = "replace(n, ',', '.')"
    short = f"case when contains({point}, '.') then regexp_replace(regexp_replace({point}, '0+$', ''), '\\.$', '') else {point} end"
    canon = f"case when regexp_replace({short}, '^0+', '') = '' then '0' else regexp_replace({short}, '^0+', '') end"
    return f"list_sort(list_distinct(list_transform({raw}, lambda n: {canon})))"


@query(f"select doc_id, array_to_string({_sql_numbers('text')}, ' ') as numbers from documents")
def text_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers_in(F.col("text")), " ").alias("numbers"))


_LANGS = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in T.LANGUAGE_WORDS.items()}


@query("select doc_id, case when greatest(en, de, fr, tr) < 5 then 'und' when en = greatest(en, de, fr, tr) then 'en' when de = greatest(en, de, fr, tr) then 'de' when fr = greatest(en, de, fr, tr) then 'fr' else 'tr' end as detected from (select doc_id, "
       + ", ".join(f"len(list_filter(ws, lambda w: list_contains({v}, w))) as {k}" for k, v in _LANGS.items()) + " from (select doc_id, regexp_extract_all(lower(text), '\\p{L}+') as ws from documents))")
def text_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("detected"))


@query("select conv_id, turn, regexp_replace(lower(translate(text, 'İI', 'iı')), '[\\s\\x{00A0}]+', '', 'g') as squashed from conversations")
def text_turkish_fold(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.squash(T.tr_lower(F.col("text"))).alias("squashed"))


@query("select doc_id, source, trim(regexp_replace(substr(regexp_replace(regexp_replace(lower(translate(s, 'çğıöşüÇĞİÖŞÜ', 'cgiosucgiosu')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g')) as slug from (select doc_id, source, text as s from documents)")
def text_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.slugify(F.col("text")).alias("slug"))


# ------------------------------------------------------------------ segments and chunks


@query()
def text_segments(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(packing.segments(T.normalize_text(F.col("text")))).alias("page", "text"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_PACK = f"""
with recursive pieces as materialized (
  select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as text, len(ls) as k from (select doc_id, string_split(text, chr(10)) as ls from documents where text <> '')
), f as materialized (select doc_id, i, k, text, {_FEATURES} from pieces),
r as (
  select doc_id, i, w::bigint as w, l::bigint as l, d::bigint as d, n::bigint as n, p::bigint as p, nl::bigint as nl, 0::bigint as chunk from f where i = 1
  union all
  select f.doc_id, f.i, case when fits then jw else f.w end, case when fits then jl else f.l end, case when fits then jd else f.d end, case when fits then jn else f.n end, case when fits then jp else f.p end,
    case when fits then jnl else f.nl end, case when fits then chunk else chunk + 1 end
  from (select r.*, f2.i as ni, r.w + f2.w as jw, r.l + f2.l as jl, r.d + f2.d as jd, r.n + f2.n as jn, r.p + f2.p as jp, r.nl + f2.nl + 1 as jnl,
    {_ESTIMATE.replace(' w::', ' (r.w + f2.w)::').replace(' l::', ' (r.l + f2.l)::').replace(' d::', ' (r.d + f2.d)::').replace(' n::', ' (r.n + f2.n)::').replace(' p::', ' (r.p + f2.p)::').replace(' nl::', ' (r.nl + f2.nl + 1)::')} <= 160 as fits
    from r join f f2 on f2.doc_id = r.doc_id and f2.i = r.i + 1) x join f on f.doc_id = x.doc_id and f.i = x.ni
), c as (
  select doc_id, chunk, string_agg(text, chr(10) order by i) as text, count(*) as n_lines from r join f using (doc_id, i) group by doc_id, chunk
), t as (select doc_id, chunk, n_lines::bigint as n_lines, text, {_FEATURES} from c), chunks as (select doc_id, chunk, n_lines, md5(text) as text_md5, case when text = '' then 0 else {_ESTIMATE} end::bigint as tokens from t)
"""


@query(_PACK + "select * from chunks")
def chunk_pack(spark, sf_dir):
    return packing.pack_lines(table(spark, sf_dir, "documents")).select("doc_id", "chunk", "n_lines", F.md5("text").alias("text_md5"), "tokens")


@query(_PACK + "select lang, count(*)::bigint as n_chunks, (list_sort(list(tokens)))[count(*) // 2 + 1]::bigint as median_tokens, max(tokens)::bigint as max_tokens from chunks join documents using (doc_id) group by lang")
def chunk_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = packing.pack_lines(d).select("doc_id", "tokens").join(d.select("doc_id", "lang"), "doc_id")
    return packing.chunk_summary(chunks, ["lang"])


@query("""with recursive e as materialized (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select user_id, i, ts as anchor, 0::bigint as w from e where i = 1
  union all select e.user_id, e.i, case when epoch_us(e.ts) - epoch_us(anchor) >= 60000000 then e.ts else anchor end, case when epoch_us(e.ts) - epoch_us(anchor) >= 60000000 then w + 1 else w end from r join e on e.user_id = r.user_id and e.i = r.i + 1)
select user_id, w as win, count(*)::bigint as n_events from r group by user_id, w""")
def transcript_windows(spark, sf_dir):
    """Windows of 60 s from the first event of each user."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return packing.anchored_windows(e, "user_id", "t", 60_000_000.0).withColumnRenamed("n", "n_events")


# ------------------------------------------------------------------ index and retrieval

_POSTINGS = """words as materialized (select doc_id, unnest(ws) as lexeme, unnest(range(0, len(ws))) as pos from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents)),
ix as materialized (select doc_id, lexeme, count(*)::bigint as tf, min(pos)::bigint as first_pos from words group by 1, 2)"""
_TERMS = "terms as materialized (select distinct item_id as qid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as lexeme from benchmark), long_ as materialized (select * from terms where length(lexeme) >= 6)"
_CHANNELS = """lex as materialized (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, round(sum(tf / (tf + 1.0::double)), 9) as score from ix join long_ using (lexeme) group by 1, 2)) where rank <= 60),
exact as materialized (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, count(*)::double as score from ix join (select * from long_ where length(lexeme) >= 9) using (lexeme) group by 1, 2)) where rank <= 40)"""
_FUSED = """fused0 as materialized (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 12) as fused, count(*)::bigint as n_channels from (select * from lex union all select * from exact) group by 1, 2),
fused as materialized (select *, case when max(fused) over (partition by qid) > min(fused) over (partition by qid) then (fused - min(fused) over (partition by qid)) / (max(fused) over (partition by qid) - min(fused) over (partition by qid)) else 1.0 end as fused_norm from fused0)"""
_COVERED = """held as (select qid, doc_id, count(*) as k from fused join long_ using (qid) join ix using (doc_id, lexeme) group by 1, 2), wanted as (select qid, count(*) as n from long_ group by 1),
covered as materialized (select fused.*, coalesce(k, 0)::double / n as coverage from fused join wanted using (qid) left join held using (qid, doc_id)),
final_ as materialized (select *, round(coverage + 0.15::double * fused_norm, 9) as final from covered where coverage >= 0.3)"""
_DIVERSE = """spilled as (select f.*, source, (row_number() over (partition by qid, source order by final desc, doc_id) > 2)::int as spill from final_ f join documents using (doc_id)),
placed as materialized (select * from (select *, row_number() over (partition by qid order by spill, final desc, doc_id) as place from spilled) where place <= 8)"""


def _index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Postings of the questions' words of 6 letters or more, the searchable ones here, and these words."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    terms = search.question_terms(questions, 6)
    return cut(search.postings(table(spark, sf_dir, "documents"), only=terms), "postings"), terms


def _fused(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    index, terms = _index(spark, sf_dir)
    return search.fuse({"lexical": search.lexical_channel(index, terms), "exact": search.exact_channel(index, terms)}), index, terms


def _placed(spark, sf_dir) -> DataFrame:
    fused, index, terms = _fused(spark, sf_dir)
    ranked = search.rerank(search.coverage(fused, index, terms), least=0.3)
    return search.diversify(ranked.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), "source")


@query(f"with {_POSTINGS} select * from ix")
def index_postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"))


@query(f"with {_POSTINGS} select doc_id, sum(tf)::bigint as n_hits from ix where starts_with(lexeme, 'lic') or starts_with(lexeme, 'apa') group by doc_id having bool_or(starts_with(lexeme, 'lic')) and bool_or(starts_with(lexeme, 'apa')) order by n_hits desc, doc_id limit 50")
def search_prefix(spark, sf_dir):
    return search.prefix_search(search.postings(table(spark, sf_dir, "documents")), ["lic", "apa"])


@query(f"with {_POSTINGS}, {_TERMS}, {_CHANNELS} select qid, doc_id, score, rank::bigint as rank from exact")
def search_exact(spark, sf_dir):
    return search.exact_channel(*_index(spark, sf_dir))


@query(f"with {_POSTINGS}, {_TERMS}, {_CHANNELS} select qid, doc_id, score, rank::bigint as rank from lex")
def search_lexical_simple(spark, sf_dir):
    return search.lexical_channel(*_index(spark, sf_dir))


@query(f"with {_POSTINGS}, {_TERMS}, {_CHANNELS}, {_FUSED} select qid, doc_id, fused, round(fused_norm, 6) as fused_norm, n_channels from fused")
def search_rrf(spark, sf_dir):
    return _fused(spark, sf_dir)[0].withColumn("fused_norm", F.round("fused_norm", 6))


@query(f"with {_POSTINGS}, {_TERMS}, {_CHANNELS}, {_FUSED}, {_COVERED} select qid, doc_id, round(coverage, 6) as coverage, round(final, 6) as final from final_")
def search_rerank_coverage(spark, sf_dir):
    ranked = search.rerank(search.coverage(*_fused(spark, sf_dir)), least=0.3)
    return ranked.select("qid", "doc_id", F.round("coverage", 6).alias("coverage"), F.round("final", 6).alias("final"))


@query(f"with {_POSTINGS}, {_TERMS}, {_CHANNELS}, {_FUSED}, {_COVERED}, {_DIVERSE} select qid, doc_id, source, place::bigint as place from placed")
def search_diversify(spark, sf_dir):
    return _placed(spark, sf_dir).select("qid", "doc_id", "source", "place")


@query()
def search_context_budget(spark, sf_dir):
    placed = _placed(spark, sf_dir).select("qid", "doc_id", "place")
    return search.budgeted(placed.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


@query(f"""with {_POSTINGS}, {_TERMS}, {_CHANNELS}, {_FUSED}, {_COVERED}, {_DIVERSE},
truth as materialized (select distinct item_id as qid, d.doc_id from benchmark b join documents d on contains(d.text, b.text)), nt as (select qid, count(*) as n_true from truth group by 1),
hits as (select qid, min(place) as first, sum((place <= 4)::int) as held from placed join truth using (qid, doc_id) group by 1), e as (select * from nt left join hits using (qid))
select count(*)::bigint as n_questions, round(avg(coalesce(first = 1, false)::int::double), 6) as hit_1, round(avg(coalesce(first <= 4, false)::int::double), 6) as hit_depth,
  round(avg(coalesce(held / n_true::double, 0.0)), 6) as recall_depth, round(avg(coalesce(1.0::double / first, 0.0)), 6) as mrr from e""")
def search_metrics(spark, sf_dir):
    """Truth: the documents that hold a benchmark text, found by its longest word and then by containment."""
    return search.retrieval_metrics(_placed(spark, sf_dir), _truth(spark, sf_dir))


def _truth(spark, sf_dir) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    return search.phrase_candidates(d, b, "item").filter(F.contains("text", F.col("item"))).select("qid", "doc_id").distinct()


@query("""select item_id, d.doc_id, row_number() over (partition by item_id order by d.doc_id <> item_id, d.doc_id)::bigint as place from documents d join (
  select item_id, array_to_string(ws[1:4], ' ') as p1, array_to_string(ws[5:8], ' ') as p2 from (select item_id, string_split(text, ' ') as ws from benchmark)) b on contains(d.text, p1) and contains(d.text, p2)""")
def evidence_match(spark, sf_dir):
    """Requirements of two phrases; an inner word of the first one finds the candidates by equality."""
    d, ws = table(spark, sf_dir, "documents"), F.split("text", " ")
    req = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(ws, 1, 4), " ").alias("p1"), F.array_join(F.slice(ws, 5, 4), " ").alias("p2"))
    held = search.phrase_candidates(d, req, "p1").filter(F.contains("text", F.col("p1")) & F.contains("text", F.col("p2"))).select("item_id", "doc_id").distinct()
    w = Window.partitionBy("item_id").orderBy(F.col("doc_id") != F.col("item_id"), "doc_id")
    return held.select("item_id", "doc_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""select a.conv_id, a.turn, len({_sql_numbers('a.text')})::bigint as n_stated, len(list_filter({_sql_numbers('a.text')}, lambda n: not list_contains({_sql_numbers("coalesce(q.text, '')")}, n)
  and not list_contains(list_transform(regexp_extract_all(a.text, '(?m)^[ \\t]*([0-9]{{1,2}})[.)]\\s', 1), lambda n: case when regexp_replace(n, '^0+', '') = '' then '0' else regexp_replace(n, '^0+', '') end), n)))::bigint as n_unsupported
  from conversations a left join conversations q on q.conv_id = a.conv_id and q.turn = a.turn - 1 and q.role = 'user' where a.role = 'assistant'""")
def ground_numbers(spark, sf_dir):
    """Numbers of an assistant's turn that the user's turn before doesn't hold."""
    c = table(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    a = c.filter("role = 'assistant'").join(q, ["conv_id", "turn"], "left")
    allowed = T.numbers_in(F.coalesce("asked", F.lit("")))
    return a.select("conv_id", "turn", F.size(T.numbers_in(F.col("text"))).cast("long").alias("n_stated"), F.size(grounding.unsupported(F.col("text"), allowed)).cast("long").alias("n_unsupported"))


# ------------------------------------------------------------------ gates, lineage, lifecycle

_GATES = """g0 as (select source, avg((length(text) >= 200)::int::double) as text_coverage, avg((not contains(text, chr(65533)))::int::double) as clean_glyphs, avg((length(trim(text)) > 0)::int::double) as nonempty,
  count(distinct doc_id) = count(*) as unique_ids from documents group by source),
gates as (select source, 'text_coverage' as gate, case when text_coverage >= 0.9 then 'pass' when text_coverage >= 0.5 then 'review' else 'fail' end as status, round(text_coverage, 6) as value from g0
 union all select source, 'clean_glyphs', case when clean_glyphs >= 1.0 then 'pass' when clean_glyphs >= 0.0 then 'review' else 'fail' end, round(clean_glyphs, 6) from g0
 union all select source, 'nonempty', case when nonempty >= 0.97 then 'pass' when nonempty >= 0.5 then 'review' else 'fail' end, round(nonempty, 6) from g0
 union all select source, 'chunk_lineage', case when unique_ids then 'pass' else 'fail' end, unique_ids::int::double from g0)"""


def _gates(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    share = lambda c: F.avg(c.cast("double"))
    copies = d.groupBy("source", "doc_id").agg(F.count("*").alias("c")).groupBy("source").agg((F.max("c") == 1).alias("unique_ids"))
    g = d.groupBy("source").agg(share(F.length("text") >= 200).alias("text_coverage"), share(~F.contains("text", F.lit("�"))).alias("clean_glyphs"), share(F.length(F.trim("text")) > 0).alias("nonempty")).join(copies, "source")
    rows = [
        F.struct(F.lit("text_coverage").alias("gate"), relational.gate(F.col("text_coverage"), 0.9, 0.5).alias("status"), F.round("text_coverage", 6).alias("value")),
        F.struct(F.lit("clean_glyphs").alias("gate"), relational.gate(F.col("clean_glyphs"), 1.0, 0.0).alias("status"), F.round("clean_glyphs", 6).alias("value")),
        F.struct(F.lit("nonempty").alias("gate"), relational.gate(F.col("nonempty"), 0.97, 0.5).alias("status"), F.round("nonempty", 6).alias("value")),
        F.struct(F.lit("chunk_lineage").alias("gate"), F.when(F.col("unique_ids"), "pass").otherwise("fail").alias("status"), F.col("unique_ids").cast("double").alias("value")),
    ]
    return g.select("source", F.explode(F.array(*rows)).alias("x")).select("source", "x.*")


@query(f"with {_GATES} select * from gates")
def gate_report(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(f"with {_GATES} select source, case when bool_or(status = 'fail' and gate in ('chunk_lineage')) then 'failed' when bool_or(status <> 'pass') then 'needs_review' else 'extracted' end as outcome, count(*)::bigint as n_gates from gates group by source")
def gate_outcome(spark, sf_dir):
    return relational.outcome(_gates(spark, sf_dir), ["source"], ["chunk_lineage"])


@query("select doc_id, sha256('1' || chr(0) || lang || chr(0) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: sha256(x) || chr(0)), '')) as fingerprint from documents")
def fingerprint_docs(spark, sf_dir):
    parts = F.transform(F.split("text", "\n"), lambda x: F.sha2(x, 256))
    return table(spark, sf_dir, "documents").select("doc_id", relational.fingerprint(parts, F.lit(1), F.col("lang")).alias("fingerprint"))


@query(f"""select doc_id, case when len(ls) = 0 then 1.0 else len(list_filter(ls, lambda x: contains(page, x))) / len(ls)::double end as traced from (select doc_id, regexp_replace({_NORMAL}, '[\\s\\x{{00A0}}]+', '', 'g') as page,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\s\\x{{00A0}}]+', '', 'g')), lambda x: length(x) >= 8) as ls from documents)""")
def traceability(spark, sf_dir):
    """Share of each text's lines that its normalised pages hold."""
    return table(spark, sf_dir, "documents").select("doc_id", relational.traced_share(F.col("text"), T.normalize_text(F.col("text"))).alias("traced"))


@query("select o_custkey, count(*)::bigint as n_entries, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey))::bigint as o_orderkey, max_by(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) as o_orderstatus from orders group by o_custkey")
def version_active(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus")


@query("""with m as (select *, lag(h) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from (select o_custkey, o_orderdate, o_orderkey, md5(o_orderstatus || o_orderpriority) as h from orders))
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as version, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as active from m where b is null or b <> h""")
def version_supersede(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("h"))
    return relational.changed_versions(log, "o_custkey", ["o_orderdate", "o_orderkey"], "h").select("o_custkey", "o_orderkey", "version", "active")


@query("select distinct d.doc_id, o.o_orderkey as target from (select doc_id, unnest(regexp_extract_all(text, '([0-9]{4,7})', 1))::bigint as code from documents) d join orders o on o.o_orderkey = d.code and o.o_orderkey <> d.doc_id")
def reference_links(spark, sf_dir):
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("code"), F.col("o_orderkey").alias("target"))
    codes = F.array_join(F.transform(F.regexp_extract_all("text", F.lit("([0-9]{4,7})")), lambda c: c.cast("long").cast("string")), " ")
    return relational.reference_links(table(spark, sf_dir, "documents").select("doc_id", codes.alias("text")), owners, "([0-9]+)")


@query("""with n as (select n_nationkey, n_regionkey from nation), c as (select c_custkey, c_nationkey, n_regionkey from customer join n on c_nationkey = n_nationkey)
select user_id, c_custkey from c, (values ('owner')) u(user_id) union all
select distinct user_id, c_custkey from (select 'area_user' as user_id, c_custkey from c where n_regionkey in (0, 2) union all select 'mixed_user', c_custkey from c where n_regionkey = 1 or c_custkey in (5, 6, 7) union all select 'doc_user', c_custkey from c where c_custkey in (10, 11))""")
def scope_filter(spark, sf_dir):
    """Customers as documents of an area (their region): the owner, an area user, a document user, one with both kinds, one revoked."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("area"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey").select("c_custkey", F.col("c_custkey").cast("string").alias("doc"), "area")
    users = spark.createDataFrame([("owner", "owner_admin"), ("area_user", "member"), ("mixed_user", "member"), ("doc_user", "member"), ("gone_user", "member")], "user_id string, role string")
    granted = [("area_user", "area", "0", False), ("area_user", "area", "2", False), ("mixed_user", "area", "1", False), *[("mixed_user", "document", str(k), False) for k in (5, 6, 7)], ("doc_user", "document", "10", False), ("doc_user", "document", "11", False), ("gone_user", "area", "0", True)]
    scopes = spark.createDataFrame(granted, "user_id string, scope_type string, scope_id string, revoked boolean")
    return relational.in_scope(rows, scopes, users, "area", "doc").select("user_id", "c_custkey")


@query("select event_id, user_id, event_type, value from events where event_type ilike 'p%' and props ilike '%1%' order by ts desc, event_id desc limit 50 offset 25")
def audit_page(spark, sf_dir):
    return relational.audit_page(table(spark, sf_dir, "events"), prefix="p", contains="1", limit=50, offset=25).select("event_id", "user_id", "event_type", "value")


@query("select distinct event_type from events")
def audit_types(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


@query("""select source, case when l.doc_id is null then 'candidate' when toxic = 1 then 'rejected' when quality = 0 then 'needs_review' else 'verified' end as status, count(*)::bigint as n from documents d left join labels l using (doc_id) group by 1, 2""")
def status_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    status = F.when(F.col("labelled").isNull(), "candidate").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "needs_review").otherwise("verified")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


@query("""with s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 1800000000)::int, 1) as new from events))
select user_id, session::bigint as session, count(*)::bigint as n_events, ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000)::double as seconds from s group by 1, 2""")
def session_gaps(spark, sf_dir):
    return relational.sessions(table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ reconciliation

_SNAPSHOTS = """base as (select o_orderkey as row_key, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) as digest from orders),
local_ as (select o_orderkey as row_key, sha256(o_orderkey || '|' || (case when o_orderkey % 7 = 0 then 'L' else o_orderstatus end) || '|' || o_orderpriority) as digest from orders where o_orderkey % 11 <> 0),
remote_ as (select o_orderkey as row_key, sha256(o_orderkey || '|' || (case when o_orderkey % 5 = 0 then 'R' else o_orderstatus end) || '|' || o_orderpriority) as digest from orders where o_orderkey % 13 <> 0
  union all select -o_orderkey - 1, sha256((-o_orderkey - 1) || '|N|new') from orders where o_orderkey % 97 = 0),
plan as (select row_key, l.digest as l, r.digest as r, b.digest as b from local_ l full join remote_ r using (row_key) full join base b using (row_key)),
acts as (select *, case when l is not distinct from r then 'keep' when l is distinct from b and r is distinct from b then 'conflict' when l is distinct from b and l is null then 'delete_remote' when l is distinct from b then 'push' when r is null then 'delete_local' else 'pull' end as action from plan)"""


def _reconciled(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")

    def side(rows: DataFrame, status) -> DataFrame:
        return rows.select(k.alias("row_key"), status.alias("s"), F.col("o_orderpriority").alias("p")).select("row_key", relational.digest("row_key", "s", "p").alias("digest"))

    base = side(o, F.col("o_orderstatus"))
    local = side(o.filter(k % 11 != 0), F.when(k % 7 == 0, "L").otherwise(F.col("o_orderstatus")))
    new = o.filter(k % 97 == 0).select((-k - 1).alias("row_key"), F.lit("N").alias("s"), F.lit("new").alias("p")).select("row_key", relational.digest("row_key", "s", "p").alias("digest"))
    remote = side(o.filter(k % 13 != 0), F.when(k % 5 == 0, "R").otherwise(F.col("o_orderstatus"))).unionByName(new)
    return relational.reconcile(local, remote, base)


@query(f"with {_SNAPSHOTS} select row_key, action, case when action = 'conflict' then null when action in ('push', 'keep') then l when action = 'pull' then r end as winner from acts")
def sync_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(f"with {_SNAPSHOTS} select action, count(*)::bigint as n from acts group by action")
def sync_conflicts(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("""with a as (select o_orderkey as path, o_orderstatus as sha from orders where o_orderkey % 10 <> 3), b as (select o_orderkey as path, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as sha from orders where o_orderkey % 8 <> 1)
select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'missing' when a.sha = b.sha then 'unchanged' else 'changed' end as change from a full join b on a.path = b.path""")
def snapshot_changes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    before = o.filter(k % 10 != 3).select(k.alias("path"), F.col("o_orderstatus").alias("sha"))
    now = o.filter(k % 8 != 1).select(k.alias("path"), F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("sha"))
    return relational.snapshot_diff(before, now)


@query("""with recursive i as (select row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, o_orderkey, o_custkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as replaces from orders),
r as (select o_orderkey, o_orderkey as root, 0::bigint as depth from i where replaces is null union all select i.o_orderkey, root, depth + 1 from r join i on i.replaces = r.o_orderkey) select o_orderkey as item_id, root, depth from r""")
def chain_history(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lag("o_orderkey").over(w).alias("replaces"))
    return relational.chains(items)


@query("""with notes as (select event_id as item_id, ts, event_type as kind, event_type || ' ' || props as note from events order by ts desc, event_id desc limit 50),
q as (select item_id as qid, text || ' purchase k' as question from benchmark), m as (select qid, n.item_id, n.ts, kind = 'purchase' as pref, len(list_intersect(list_distinct(regexp_extract_all(lower(note), '[\\p{L}\\p{N}]{3,}')), list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]{3,}')))) as shared from q, notes n)
select qid, item_id, place from (select *, row_number() over (partition by qid order by not pref, shared desc, ts desc, item_id desc)::bigint as place from m where pref or shared > 0) where place <= 6""")
def memory_relevance(spark, sf_dir):
    """Events as notes (purchases as preferences), benchmark texts as questions."""
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), "ts", F.when(F.col("event_type") == "purchase", "preference").otherwise("fact").alias("kind"), F.concat_ws(" ", "event_type", "props").alias("note"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" purchase k")).alias("question"))
    return relational.memory_relevance(notes, q)


# ------------------------------------------------------------------ calculation

_GEARS = "(select p_partkey as req_id, (17 + p_size)::double as z, (1 + p_partkey % 10) / 2.0::double as m_n, (case when p_partkey % 2 = 0 then 20.0 else 25.0 end)::double as alpha_n, (p_partkey % 4 * 10)::double as beta, ((p_partkey % 7 - 3) / 10.0)::double as x, 0.0::double as k, 1.0::double as h_aP, 1.25::double as h_fP from part)"


def _gears(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("req_id"), (F.col("p_size") + 17).cast("double").alias("z"), ((1 + k % 10) / 2.0).alias("m_n"), F.when(k % 2 == 0, 20.0).otherwise(25.0).alias("alpha_n"), (k % 4 * 10).cast("double").alias("beta"),
        ((k % 7 - 3) / 10.0).alias("x"), F.lit(0.0).alias("k"), F.lit(1.0).alias("h_aP"), F.lit(1.25).alias("h_fP"),
    )


_OUT = [key for key, _, _ in calc.CYLINDRICAL]


@query("select req_id, " + ", ".join(f"round({k}, 6) as {k}" for k in _OUT) + f", case when d_f > 0 then 'ok' else 'invalid_input' end as status from {calc.rule_sql(_GEARS, calc.CYLINDRICAL)}")
def calc_cylindrical(spark, sf_dir):
    return calc.cylindrical(_gears(spark, sf_dir)).select("req_id", *[F.round(k, 6).alias(k) for k in _OUT], "status")


_PAIRS = "(select l_orderkey as req_id, l_linenumber as line, (17 + l_linenumber)::double as z1, l_quantity + 18 as z2, (1 + l_partkey % 6)::double as m_n, 20.0::double as alpha_n, (l_suppkey % 3 * 15)::double as beta, (1 + l_partkey % 6) * (35 + l_linenumber + l_quantity) / 2 * 1.02::double as a_w from lineitem)"


@query(f"select req_id, line, round(u, 6) as u, round(d1, 6) as d1, round(d2, 6) as d2, round(alpha_wt, 6) as alpha_wt from {calc.rule_sql(_PAIRS, calc.PAIR)}")
def calc_gear_pair(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = (1 + F.col("l_partkey") % 6).cast("double")
    r = li.select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + 17).cast("double").alias("z1"), (F.col("l_quantity") + 18).alias("z2"), m.alias("m_n"), F.lit(20.0).alias("alpha_n"), (F.col("l_suppkey") % 3 * 15).cast("double").alias("beta"), (m * (35 + F.col("l_linenumber") + F.col("l_quantity")) / 2 * 1.02).alias("a_w"))
    return calc.gear_pair(r).select("req_id", "line", *[F.round(c, 6).alias(c) for c in ("u", "d1", "d2", "alpha_wt")])


_FLANKS = "(select p_partkey as req_id, (1 + p_partkey % 80)::double as m_n, (4 + p_partkey % 997)::double as z, 0.0::double as beta, (1 + p_partkey % 80)::double * (4 + p_partkey % 997) as d, (2 + p_size * 20)::double as b, (1 + p_partkey % 11)::double as A from part)"
_HALF_UP = lambda v: f"case when {v} > 10 then floor({v} + 0.5) when {v} >= 5 then floor({v} * 2 + 0.5) / 2 else floor({v} * 10 + 0.5) / 10 end"
_FLANK_OUT = {"f_pT": "f_pT_raw", "F_pT_sum": "F_pT_raw_total", "f_HaT": "f_HaT_raw", "f_faT": "f_faT_raw", "F_aT": "F_aT_raw", "f_HbT": "f_HbT_raw", "f_fbT": "f_fbT_raw", "F_bT": "F_bT_raw"}


@query("select req_id, " + ", ".join(f"round({_HALF_UP(v)}, 1) as o_{i}" for i, v in enumerate(_FLANK_OUT.values()))
       + f", case when m_n between 0.5 and 70 and d between 5 and 15000 and z between 5 and 1000 and b between 4 and 1200 and beta between 0 and 45 then 'ok' else 'refused' end as status from {calc.rule_sql(_FLANKS, calc.FLANK)}")
def calc_flank_tolerance(spark, sf_dir):
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("req_id"), (1 + k % 80).cast("double").alias("m_n"), (4 + k % 997).cast("double").alias("z"), F.lit(0.0).alias("beta"), (2 + F.col("p_size") * 20).cast("double").alias("b"), (1 + k % 11).cast("double").alias("A"))
    r = r.withColumn("d", F.col("m_n") * F.col("z"))
    return calc.flank_tolerance(r).select("req_id", *[F.round(c, 1).alias(f"o_{i}") for i, c in enumerate(_FLANK_OUT)], "status")


#: An invented table of the right shape: size ranges and the grades' values in micrometres.
GRADE_ROWS = [(0.0, 3.0), (3.0, 6.0), (6.0, 10.0), (10.0, 18.0), (18.0, 30.0), (30.0, 50.0)]
_GRADES = "(values " + ", ".join(f"({a}::double, {b}::double, {[float(round((i + 2) * 1.6**g, 1)) for g in range(6)]})" for i, (a, b) in enumerate(GRADE_ROWS)) + ") g(above, up_to, its)"


def grade_table(spark: SparkSession) -> DataFrame:
    rows = [(a, b, [float(round((i + 2) * 1.6**g, 1)) for g in range(6)]) for i, (a, b) in enumerate(GRADE_ROWS)]
    return spark.createDataFrame(rows, "above double, up_to double, its array<double>")


@query(f"""select req_id, line, it, case when it is not null then round(size + it / 1000.0::double, 6) end as hole_upper, case when it is not null then round(size - it / 1000.0::double, 6) end as shaft_lower from (
  select l_orderkey as req_id, l_linenumber as line, l_quantity + 2 as size, its[1 + l_partkey % 6]::double as it from lineitem left join {_GRADES} on l_quantity + 2 > above and l_quantity + 2 <= up_to)""")
def calc_it_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") + 2).alias("size"), (F.col("l_partkey") % 6 + 1).cast("int").alias("grade"))
    r = calc.grade_lookup(r, grade_table(spark)).withColumn("it", F.try_element_at("its", F.col("grade")))
    return r.select("req_id", "line", "it", F.round(calc.limit_sizes(F.col("size"), F.col("it"), "H")["upper_size"], 6).alias("hole_upper"), F.round(calc.limit_sizes(F.col("size"), F.col("it"), "h")["lower_size"], 6).alias("shaft_lower"))


_REQUESTS = """(select l_orderkey * 10 + l_linenumber as req_id, k as key, case k when 'z' then l_quantity + (case when l_partkey % 5 = 0 then 0.5 else 0 end) when 'm_n' then l_discount * 100 when 'alpha_n' then 20.0 else l_tax end::double as value,
  case k when 'z' then '' when 'm_n' then (case when l_suppkey % 3 = 0 then 'cm' when l_suppkey % 3 = 1 then 'mm' else 'inch' end) when 'alpha_n' then 'derece' else '' end as unit,
  case when l_partkey % 9 = 0 then 'extracted_value' when l_partkey % 9 = 1 then 'guess' else 'user_input' end as prov_kind, case when l_suppkey % 2 = 0 then 'user_confirmed' else 'draft_extraction' end as prov_status
  from lineitem, (values ('z'), ('m_n'), ('alpha_n'), ('wobble')) v(k))"""


@query(f"""select code, key, count(*)::bigint as n, round(sum(canonical), 3) as total from (select key, code, case when code is null then value * factor end as canonical from (select *, case when key = 'wobble' then 'unknown_input'
  when prov_kind = 'extracted_value' and prov_status not in ('user_confirmed', 'verified_source') then 'draft_input_blocked' when prov_kind = 'guess' then 'invalid_provenance' when factor is null then 'invalid_unit'
  when key = 'z' and value <> floor(value) then 'not_integer' when not (value * factor between lo and hi) then 'out_of_range' end as code from (select *, case when key = 'm_n' then (case unit when 'cm' then 10.0::double when 'mm' then 1.0::double end) else 1.0::double end as factor,
  case key when 'z' then 1.0::double when 'm_n' then 1e-6::double else 0.0::double end as lo, case key when 'z' then 100000.0::double when 'm_n' then 1e5::double else 89.0::double end as hi from {_REQUESTS}))) group by code, key""")
def calc_validate(spark, sf_dir):
    li, k = table(spark, sf_dir, "lineitem"), F.col("key")
    keys = F.explode(F.array(*map(F.lit, ("z", "m_n", "alpha_n", "wobble")))).alias("key")
    r = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("req_id"), "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", keys)
    value = F.when(k == "z", F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 0.5).otherwise(0.0)).when(k == "m_n", F.col("l_discount") * 100).when(k == "alpha_n", 20.0).otherwise(F.col("l_tax"))
    s = F.col("l_suppkey") % 3
    unit = F.when(k == "m_n", F.when(s == 0, "cm").when(s == 1, "mm").otherwise("inch")).when(k == "alpha_n", "derece").otherwise("")
    p = F.col("l_partkey") % 9
    r = r.select("req_id", "key", value.alias("value"), unit.alias("unit"), F.when(p == 0, "extracted_value").when(p == 1, "guess").otherwise("user_input").alias("prov_kind"), F.when(F.col("l_suppkey") % 2 == 0, "user_confirmed").otherwise("draft_extraction").alias("prov_status"))
    return calc.validate(r, "cylindrical_gear_geometry").groupBy("code", "key").agg(F.count("*").alias("n"), F.round(F.sum("canonical"), 3).alias("total"))


_ENGINE = f"(select req_id, unnest(['d', 'd_b', 'd_a', 'd_f']) as key, unnest([d, d_b, d_a, d_f]) as value from {calc.rule_sql(_GEARS, calc.CYLINDRICAL)})"


@query(f"""select key, status, count(*)::bigint as n from (select key, case when raw is null then 'missing_in_draft' when try_cast(replace(raw, ',', '.') as double) is null then 'non_numeric'
  when abs(try_cast(replace(raw, ',', '.') as double) - value) <= greatest(0.01, 0.005 * abs(value)) then 'match' else 'mismatch' end as status from (select *, case (req_id * 7 + length(key)) % 5 when 0 then null when 1 then 'n/a' when 2 then replace(round(value, 2)::decimal(18,2)::varchar, '.', ',') when 3 then (round(value, 2)::decimal(18,2) + 3)::varchar else '1' end as raw from {_ENGINE})) group by key, status""")
def calc_compare(spark, sf_dir):
    keys = ["d", "d_b", "d_a", "d_f"]
    wide = calc.cylindrical(_gears(spark, sf_dir))
    engine = wide.select("req_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("x")).select("req_id", "x.*", F.lit("mm").alias("unit"))
    turn, two = (F.col("req_id") * 7 + F.length("key")) % 5, F.round("value", 2).cast("decimal(18,2)")
    raw = F.when(turn == 1, "n/a").when(turn == 2, F.replace(two.cast("string"), F.lit("."), F.lit(","))).when(turn == 3, (two + 3).cast("string")).when(turn == 4, "1")
    drafts = engine.select("req_id", "key", raw.alias("raw")).filter("raw is not null")
    return calc.compare(engine, drafts).groupBy("key", "status").agg(F.count("*").alias("n"))


@query()
def calc_diagnose(spark, sf_dir):
    """Drafts made by every error model of the base and tip circle, and their diagnosis."""
    gears = _gears(spark, sf_dir)
    wide = calc.cylindrical(gears)
    made = [F.struct(F.lit(k).alias("key"), F.lit(i).alias("model"), diagnosis.compile_column(text).alias("v")) for k in ("d_b", "d_a") for i, (_, _, text) in enumerate(diagnosis.HYPOTHESES[k])]
    drafts = wide.select("req_id", F.explode(F.array(*made)).alias("x")).select("req_id", "x.key", F.col("x.model").alias("model"), F.col("x.v").cast("decimal(24,9)").cast("string").alias("raw"))
    found = diagnosis.diagnose(gears, drafts.withColumn("_m", F.col("model")).select("req_id", "key", "raw"))
    return found.groupBy("key", "cls").agg(F.count("*").alias("n"))


_CASES = """(with base as (select a as alpha_n, m as m_n, z::double as z from (values (20.0::double), (25.0::double)) t(a), (values (1.0::double), (2.0::double), (3.0::double)) u(m), (values (17), (20), (30), (40), (80)) v(z))
  select 'spur' as grp, *, 0.0::double as beta, 0.0::double as x, 0.0::double as k, 1.0::double as h_aP, 1.25::double as h_fP from base union all select 'helical', base.*, b, 0.0, 0.0, 1.0, 1.25 from base, (values (15.0::double), (30.0::double)) w(b)
  union all select 'profile_shift', base.*, 0.0, s, 0.0, 1.0, 1.25 from base, (values (-0.3::double), (0.5::double)) w(s))"""


@query("select claim, grp, count(*)::bigint as n_cases, sum((abs(lhs - rhs) > 1e-9 * abs(rhs))::int)::bigint as n_failed, sum((abs(lhs - rhs) > 1e-9 * abs(rhs))::int) = 0 as passed from ("
       + " union all ".join(f"select '{n}' as claim, grp, {calc.to_sql(a)} as lhs, {calc.to_sql(b)} as rhs from c" for n, a, b in diagnosis.CLAIMS) + ") group by claim, grp")
def regression_base_circle(spark, sf_dir):
    return diagnosis.regression(diagnosis.cylindrical_cases(spark))


ORACLES["regression_base_circle"] = f"with c as materialized (select * from {calc.rule_sql(_CASES, calc.CYLINDRICAL)}) " + ORACLES["regression_base_circle"]
