"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is what stands between line feeds, compared without outer white space.
For each host, the share of a line is the number of the host's pages that hold
it over the host's page total; pages of equal text are one page here, so that
copies of a page aren't taken for boilerplate.  A line goes when its share
exceeds ``max_ratio`` and at least ``min_pages`` pages of that host hold it (so a
host of one or two pages loses nothing).  Every occurrence on such pages goes.
Blank lines stay.

Plan.  Copies are counted by (host, hash of the text); a page with m copies weighs
1 / m, so that sums of weights are counts of different pages.  Lines are made
distinct within a page before the explode, hashed to two longs, and summed by
(host, hash) with partial aggregation, so neither a hot host nor a hot line nor a
group of copies meets in one task.  A host has at most (mean lines of a
page / max_ratio) boilerplate lines, yet hosts grow with the data: the list is
broadcast only after a bounded count has shown it to be small; beyond that,
lines are joined with it by (host, hash) and only the numbers of the dropped
lines travel back to the pages, which are known by key, host and text.

Defined cases: a null host is a host of its own; a null text stays null with no
lines; an empty text stays empty; a line whose share is the ratio exactly stays;
very long texts are split whole; repeated rows are copies of a page; other
columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.plans.lineage import broadcast_if_small, cut, drop

MAX_RATIO, MIN_PAGES = 0.05, 3
#: Boilerplate lines up to which the list is broadcast (about 50 bytes each), and short lists a host's are dealt to.
BROADCAST_ROWS, BUCKETS = 200_000, 256


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def _trim(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(_host, h, g)`` of the lines above the ratio of their host."""
    src = pages.select(F.col(host).cast("string").alias("_host"), F.col(text).cast("string").alias("_text"))
    marks = [F.xxhash64("_text").alias("_t"), F.xxhash64(F.lit("page"), "_text").alias("_u")]
    texts = cut(src.select("_host", *marks).groupBy("_host", "_t", "_u").agg(F.count("*").alias("_copies")), "texts")
    totals = texts.groupBy("_host").agg(F.count("*").alias("_total"))
    copies, _ = broadcast_if_small(texts.filter("_copies > 1"), broadcast_rows)
    same = F.col("x._host").eqNullSafe(F.col("y._host")) & (F.col("x._t") == F.col("y._t")) & (F.col("x._u") == F.col("y._u"))
    weighed = src.select("*", *marks).alias("x").join(copies.alias("y"), same, "left").select("x._host", "_text", (F.lit(1.0) / F.coalesce("_copies", F.lit(1))).alias("_weight"))
    lines = weighed.select("_host", "_weight", F.explode(F.array_distinct(F.transform(F.split("_text", "\n"), _trim))).alias("_line")).filter("_line <> ''")
    held = lines.select("_host", "_weight", _key(F.col("_line")).alias("k")).select("_host", "_weight", "k.*")
    held = held.groupBy("_host", "h", "g").agg(F.round(F.sum("_weight")).cast("long").alias("_pages")).filter(F.col("_pages") >= min_pages)
    joined = held.alias("a").join(totals.alias("b"), F.col("a._host").eqNullSafe(F.col("b._host")))
    found = cut(joined.filter(F.col("_pages") > F.col("_total") * F.lit(float(max_ratio))).select("a._host", "h", "g"), "boilerplate")
    drop(texts)
    return found


def _listed(found: DataFrame) -> DataFrame:
    """``(host, bad)``: each host's boilerplate as BUCKETS lists of keys, so that a line is looked up in one short list."""
    keys = found.select(F.col("_host").alias("host"), F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"), F.struct("h", "g").alias("k"))
    lists = keys.groupBy("host", "bucket").agg(F.collect_list("k").alias("ks")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "ks"))).alias("by_bucket"))
    none = F.array().cast("array<struct<h:bigint,g:bigint>>")
    return lists.select("host", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("by_bucket", b), none)).alias("bad"))


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``pages`` with ``text`` less its boilerplate lines, and ``_n_lines`` / ``_n_dropped`` (which replace columns of these names)."""
    found = boilerplate(pages, host, text, max_ratio, min_pages, broadcast_rows)
    _, small = broadcast_if_small(found, broadcast_rows)
    # a page's own columns travel as one struct, so no name of theirs can clash
    rows = pages.select(F.struct(*pages.columns).alias("page"), F.col(key).alias("id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).withColumn("lines", F.split("text", "\n"))
    if small:
        held = rows.join(F.broadcast(_listed(found)).withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")

        def clean(x: Column) -> Column:
            k = _key(_trim(x))
            return (_trim(x) == "") | ~F.array_contains(F.element_at("bad", (F.pmod(k["h"], F.lit(BUCKETS)) + 1).cast("int")), k)

        kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", clean))
    else:
        # a page is known by its key, host and text: keys may be null or repeated, and equal rows drop equal lines
        marks = {"id": F.col("id"), "host": F.col("host"), "t": F.xxhash64("text"), "u": F.xxhash64(F.lit("page"), "text")}
        numbered = rows.select(*(c.alias(n) for n, c in marks.items()), F.posexplode(F.transform("lines", _trim)).alias("pos", "line")).filter("line <> ''")
        numbered = numbered.select(*marks, "pos", _key(F.col("line")).alias("k")).select(*marks, "pos", "k.*")
        a, b = numbered.alias("a"), found.alias("b")
        hits = a.join(b, F.col("a.host").eqNullSafe(F.col("b._host")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")), "left_semi")
        gone = hits.groupBy(*marks).agg(F.collect_set("pos").alias("gone"))  # at most the lines of one page
        gone = gone.select(*(F.col(n).alias(f"of_{n}") for n in marks), "gone")
        same = F.lit(True)
        for n, c in marks.items():
            same = same & c.eqNullSafe(F.col(f"of_{n}"))
        held = rows.join(gone, same, "left")
        kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
    n_dropped = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept"))
    out = held.withColumn("kept", kept)
    own = [F.array_join("kept", "\n").alias(c) if c == text else F.col("page")[c].alias(c) for c in pages.columns if c not in ("_n_lines", "_n_dropped")]
    return out.select(*own, n_lines.cast("long").alias("_n_lines"), n_dropped.cast("long").alias("_n_dropped"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """Digest of ``drop_boilerplate`` over documents: ``doc_id, n_lines, n_dropped, kept_md5``."""
    src = docs.select("doc_id", "source", "text")
    out = drop_boilerplate(src, **options)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.md5("text").alias("kept_md5"))


ORACLE = f"""
with l as materialized (
  select doc_id, source, text, string_split(text, chr(10)) as ls from documents
), tot as (select source, count(distinct text) + coalesce(max((text is null)::int), 0) as total from documents group by source),
x as (select source, text, unnest(list_distinct(list_transform(ls, lambda s: trim(translate(s, chr(9) || chr(13), '  '))))) as line from l),
bad as (
  select x.source, line from x join tot on x.source is not distinct from tot.source where line <> ''
  group by x.source, line, total having count(distinct text) >= {MIN_PAGES} and count(distinct text) > total * cast({MAX_RATIO} as double)
), lists as (select source, list(line) as bad from bad group by source),
k as (
  select doc_id, ls, case when bad is null then ls else list_filter(ls, lambda s: trim(translate(s, chr(9) || chr(13), '  ')) = ''
    or not list_contains(bad, trim(translate(s, chr(9) || chr(13), '  ')))) end as kept
  from l left join lists on l.source is not distinct from lists.source
)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::bigint as n_dropped,
  case when ls is null then null when len(kept) = 0 then md5('') else md5(array_to_string(kept, chr(10))) end as kept_md5 from k
"""
