"""Blocks of a page from placed lines: every line is claimed by exactly one block.

``lines(doc_id, page, x0, y0, x1, y1, text, bold, upright)`` and table boxes
``boxes(doc_id, page, box, x0, y0, x1, y1)``, y downwards.  The passes claim in
this order: running heads and feet, tables with caption, unit notes and
footnotes, equations left of a number at the right margin, legends behind
"where", figures with their key, headings, then notes, examples, lists and
paragraphs; rotated text comes last on its page.  Each pass sees only what
those before left.

All but one pass are windows and joins by page, and what a pass claims is written
down before the next one reads it.  Claimed places come to the lines page by page,
as one list, so that a pass deals its lines out once; it reads only pages that hold
a line of the kind it starts from (``_marks``).  Which numbers are plausible
headings depends on all numbers before, over pages: one fold for each document
over its numbered lines alone, no other line goes to Python.

Defined cases: a null or blank line and one without a page belong to no block;
equal lines at one place are two lines; a page without boxes has no tables; a
line in two boxes belongs to the one with the lesser ``box``; other columns are
left out; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.structure import follows, furniture_places, key_of
from folioforge.plans.lineage import cut

# What lines of such documents begin with.
NUMBER = r"[A-Z]?\.?[0-9]{1,3}"
CLAUSE = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,5}|[A-Z](?:\.[0-9]{1,2}){1,5})(?:\s+(\S.*))?$"
ANNEX = r"^Annex\s+([A-Z])\b\s*(.*)$"
CAPTION = rf"^Table\s+({NUMBER})\s*(?:[—–-]\s*\S|\((?:continued|concluded)\))"
FIGURE = rf"^Figure\s+({NUMBER})\s*[—–-]\s*\S"
MARGIN = r"^\(((?:[A-Z]\.)?[0-9]{1,3}[a-z]?)\)$"
VARIABLE = r"^([^\s,;]{1,12})\s+(?:is|are|designates|denotes|represents|=|—|–)\s+\S"
UNIT_NOTE = r"^(?i:Dimensions|Deviations|Values|Tolerances|Measurements)\s+in\s+\S"
KEY_ITEM = r"^(?!(?:The|This|For|All|An?|In|It|If|Of|On|See|At)\s)(?:[0-9]{1,2}[a-z]?|[A-Za-z]|[A-Za-zα-ωΑ-Ω]{1,3}[A-Za-z0-9]{0,3})\s+\S"
UNNUMBERED = ("foreword", "introduction", "contents", "bibliography", "index")

AT = ["doc_id", "page", "pos"]
#: Bits of ``_marks``, by what some line of the page is.
MARGINS, WHERES, KEYS, NUMBERS = 1, 2, 4, 8


def _shape(t: Column, right: Column) -> Column:
    """What a line is by its text; ``right`` tells that it begins in the right part of the page."""
    is_ = lambda p: F.regexp_like(t, F.lit(p))
    return (
        F.when(is_(MARGIN) & right, "margin").when(is_(CAPTION), "caption").when(is_(FIGURE), "figure").when(is_(r"\.{5,}\s*\S{0,6}$"), "toc").when(is_(r"^(?i:where)\s*:?$"), "where")
        .when(is_(r"^(?i:where)\s+\S{1,12}\s+(?:is|are|designates|denotes|=)\s"), "where_inline").when(t == "Key", "key").when(is_(r"^(?:NOTE(?:\s+[0-9]+)?\b|Note\s+[0-9]+\s+to\s+entry)"), "note")
        .when(is_(r"^EXAMPLE(?:\s+[0-9]+)?\b"), "example").when(is_(r"^(?:[—–•-]\s|[a-z]\)\s)"), "list").when(is_(CLAUSE) | is_(ANNEX), "numbered").otherwise("text")
    )


def _unnumbered() -> Column:
    """Whether a line is a heading that goes without a number."""
    return F.col("bold") & F.rtrim(F.lower("line"), F.lit(".")).isin(*UNNUMBERED)


def placed(lines: DataFrame, width: float = 595.0) -> DataFrame:
    """Lines in reading order (``pos`` within the page) with what each tells by itself."""
    t = F.trim("text")
    keep = [F.col(c) for c in ("doc_id", "page", "x0", "y0", "x1", "y1")]
    src = lines.select(*keep, t.alias("line"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("upright", F.lit(True)).alias("upright")).filter("line <> '' and page is not null")
    order = Window.partitionBy("doc_id", "page").orderBy(~F.col("upright"), F.round((F.col("y0") + F.col("y1")) / 6), "x0", "line")
    shape = _shape(F.col("line"), F.col("x0") > 0.6 * width)
    out = src.withColumn("pos", F.row_number().over(order)).withColumn("shape", shape).withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    prose = F.regexp_count("line", F.lit(r"\p{Ll}{3,}")) >= 4
    marks = (
        F.when(F.col("shape") == "margin", MARGINS).when(F.col("shape").isin("where", "where_inline"), WHERES).when(F.col("shape").isin("key", "figure"), KEYS)
        .when((F.col("shape") == "numbered") | _unnumbered(), NUMBERS).otherwise(0)
    )
    out = out.withColumn("_marks", F.bit_or(marks).over(Window.partitionBy("doc_id", "page")))
    return out.withColumn("prose", prose).withColumn("barrier", prose | ~F.col("shape").isin("text", "margin") | F.regexp_like("line", F.lit(r"^\p{L}{4,}:?$")))


def _left(lines: DataFrame, *claimed: DataFrame) -> DataFrame:
    """Lines whose places are in none of ``claimed``."""
    taken = reduce(DataFrame.unionByName, [c.select(*AT) for c in claimed]).groupBy("doc_id", "page").agg(F.collect_set("pos").alias("_taken"))
    return lines.join(taken, ["doc_id", "page"], "left").filter(~F.coalesce(F.array_contains("_taken", F.col("pos")), F.lit(False))).drop("_taken")


def _tables(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines of tables: within a box, its caption, unit notes between caption and box, footnotes under it."""
    b = boxes.select("doc_id", "page", "box", *(F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")))
    near = lines.join(b, ["doc_id", "page"]).filter("yc between by0 - 90 and by1 + 50")
    above = F.col("by0") - F.col("y1")
    middle = (F.col("x0") + F.col("x1")) / 2
    role = (
        F.when(middle.between(F.col("bx0"), F.col("bx1")) & F.col("yc").between(F.col("by0"), F.col("by1")), "cell").when((F.col("shape") == "caption") & (above >= -4) & (above < 80), "caption")
        .when(F.regexp_like("line", F.lit(UNIT_NOTE)) & F.col("yc").between(F.col("by0") - 40, F.col("by0") + 2), "unit")
        .when(F.col("y0").between(F.col("by1") - 1, F.col("by1") + 40) & F.regexp_like("line", F.lit(r"^[a-h]\s+\S")) & F.col("x0").between(F.col("bx0") - 5, F.col("bx1")), "foot")
    )
    level = (F.col("shape") == "margin") & F.col("yc").between(F.col("by0") - 6, F.col("by1") + 6)
    near = near.withColumn("role", role).withColumn("level", level).filter("role is not null or level")
    one = Window.partitionBy("doc_id", "page", "box")
    cells = F.sum((F.col("role") == "cell").cast("int")).over(one)
    captioned = F.max((F.col("role") == "caption").cast("int")).over(one) == 1
    sums = F.max(((F.col("role") == "cell") & F.col("line").isin("=", "+", "−", "-")).cast("int")).over(one) == 1
    lowest = F.max(F.when(F.col("role") == "caption", F.struct("y1", "pos"))).over(one)
    sure = near.withColumn("_table", (cells >= 2) & (F.max(F.col("level").cast("int")).over(one) == 0) & (captioned | ~sums)).withColumn("_caption", lowest["pos"])
    sure = sure.filter("_table and role is not null and (role <> 'caption' or pos = _caption)")
    first = Window.partitionBy(*AT).orderBy(F.when(F.col("role") == "cell", 0).otherwise(1), "box")
    label = F.when(F.col("role") == "caption", F.concat(F.lit("Table "), F.regexp_extract("line", CAPTION, 1)))
    return sure.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*AT, F.lit("table").alias("kind"), F.col("box").cast("string").alias("group"), label.alias("label"), F.lit(False).alias("review"))


def _equations(lines: DataFrame, reach: float, edge: float = 14.0) -> DataFrame:
    """Lines of displayed equations: those left of a margin number, within the band that prose and other numbers leave free.

    A band ends half way to the next number, at prose or structure, at most
    ``reach`` away; what goes on right beyond a free end makes it one to review.
    """
    down = Window.partitionBy("doc_id", "page").orderBy("yc", "pos")
    eq = lines.filter("shape = 'margin'").select("doc_id", "page", F.col("pos").alias("eq"), F.col("yc").alias("ey"), F.col("x0").alias("ex"), F.col("line").alias("number"), F.lag("yc").over(down).alias("up"), F.lead("yc").over(down).alias("down"))
    low, high = F.greatest(F.col("ey") - reach, (F.col("ey") + F.col("up")) / 2), F.least(F.col("ey") + reach, (F.col("ey") + F.col("down")) / 2)
    eq = eq.withColumn("low", low).withColumn("high", high)
    pair = lines.join(eq, ["doc_id", "page"]).filter(F.abs(F.col("yc") - F.col("ey")) <= reach + edge + 200)
    wall = F.col("barrier") & (F.abs(F.col("yc") - F.col("ey")) >= 4)
    one = Window.partitionBy("doc_id", "page", "eq")
    over = F.max(F.when(wall & (F.col("yc") < F.col("ey")), F.col("y1") - 0.5)).over(one)
    under = F.min(F.when(wall & (F.col("yc") > F.col("ey")), F.col("y0") + 0.5)).over(one)
    pair = pair.withColumn("lo", F.greatest("low", over)).withColumn("hi", F.least("high", under))
    free = ~F.col("barrier") & (F.col("shape") != "margin") & (F.col("x1") <= F.col("ex") + 2)
    held = (F.col("pos") == F.col("eq")) | free & F.col("yc").between(F.col("lo"), F.col("hi"))
    beyond = free & ((F.col("lo") == F.col("ey") - reach) & F.col("yc").between(F.col("lo") - edge, F.col("lo")) | (F.col("hi") == F.col("ey") + reach) & F.col("yc").between(F.col("hi"), F.col("hi") + edge)) & ~held
    pair = pair.withColumn("_held", held).withColumn("review", F.max(beyond.cast("int")).over(one) == 1).filter("_held")
    nearest = Window.partitionBy(*AT).orderBy(F.abs(F.col("yc") - F.col("ey")), "eq")
    return pair.withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").select(*AT, F.lit("formula").alias("kind"), F.col("eq").cast("string").alias("group"), F.col("number").alias("label"), "review")


def _legends(lines: DataFrame, most: int = 40) -> DataFrame:
    """Lines of "where" and of the rows behind it that define symbols, wrapped descriptions among them."""
    down = Window.partitionBy("doc_id", "page").orderBy("yc", "pos")
    apart = F.coalesce(F.col("yc") - F.lag("yc").over(down) > 0.5 * F.greatest(F.col("y1") - F.col("y0"), F.lit(4.0)), F.lit(True))
    marks = F.col("shape").isin("where", "where_inline")
    rows = lines.withColumn("_new", (apart | marks).cast("int")).withColumn("_row", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.array_sort(F.collect_list(F.struct("x0", "line")))
    structural = F.max((~F.col("shape").isin("text", "where", "where_inline")).cast("int")) == 1
    rows = rows.groupBy("doc_id", "page", "_row").agg(
        F.array_join(F.transform(cells, lambda c: c["line"]), " ").alias("text"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max(F.when(marks, F.col("shape"))).alias("mark"), structural.alias("structural"), F.collect_list("pos").alias("members")
    )
    by_row = Window.partitionBy("doc_id", "page").orderBy("_row")
    rows = rows.withColumn("_run", F.sum(F.col("mark").isNotNull().cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_gap", F.col("top") - F.lag("bottom").over(by_row)).filter("_run > 0")
    run = Window.partitionBy("doc_id", "page", "_run").orderBy("_row")
    rows = rows.withColumn("_n", F.row_number().over(run) - 1).withColumn("_height", F.first(F.greatest(F.col("bottom") - F.col("top"), F.lit(8.0))).over(run)).withColumn("_mark", F.first("mark").over(run))
    defines = F.regexp_like("text", F.lit(VARIABLE))
    wrapped = (F.col("_n") > 1) & F.regexp_like("text", F.lit(r"^\p{Ll}")) & ~F.regexp_like("text", F.lit(r"^\S{1,8}\s+(?:is|are)\b"))
    stop = (F.col("_n") > 0) & ((F.col("_mark") == "where_inline") | (F.col("_gap") > 2.2 * F.col("_height")) | F.col("structural") | ~(defines | wrapped) | (F.col("_n") > most))
    rows = rows.withColumn("_stops", F.sum(stop.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).filter("_stops = 0")
    whole = Window.partitionBy("doc_id", "page", "_run")
    rows = rows.withColumn("_size", F.count("*").over(whole)).filter("_size > 1 or _mark = 'where_inline'")
    return rows.select("doc_id", "page", F.explode("members").alias("pos"), F.lit("legend").alias("kind"), F.col("_run").cast("string").alias("group"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("review"))


def _figures(lines: DataFrame) -> DataFrame:
    """Captions of figures, each with the key before it; a key ends at its caption or at prose that is no item, and with its page."""
    down = Window.partitionBy("doc_id", "page").orderBy("pos")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    item = F.regexp_like("line", F.lit(KEY_ITEM)) & (F.length("line") < 160) | ~F.col("prose") & (F.length("line") < 60)
    k = lines.withColumn("_key", F.max(F.when(F.col("shape") == "key", F.col("pos"))).over(upto)).filter("_key is not null or shape = 'figure'")
    one = Window.partitionBy("doc_id", "page", "_key").orderBy("pos")
    ends = ~F.col("shape").isin("key") & ((F.col("shape") == "figure") | ~item | F.col("shape").isin("caption", "toc"))
    k = k.withColumn("_ends", F.sum(ends.cast("int")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    # the caption that follows with no more than prose between takes the key in
    all_ = Window.partitionBy("doc_id", "page", "_key")
    k = k.withColumn("_caption", F.min(F.when((F.col("shape") == "figure") & (F.col("_ends") <= 3) & F.col("_key").isNotNull(), F.col("pos"))).over(all_))
    held = k.filter("shape = 'figure' or _ends = 0")
    group = F.when(F.col("shape") == "figure", F.col("pos")).otherwise(F.coalesce("_caption", "_key"))
    kind = F.when((F.col("shape") == "figure") | F.col("_caption").isNotNull(), "figure").otherwise("figure_key")
    label = F.when(F.col("shape") == "figure", F.concat(F.lit("Figure "), F.regexp_extract("line", FIGURE, 1)))
    return held.select(*AT, kind.alias("kind"), group.cast("string").alias("group"), label.alias("label"), F.lit(False).alias("review"))


def _numbers(batches: pd.DataFrame) -> pd.DataFrame:
    """The numbered lines of one document that go on plausibly from those before."""
    last: tuple[int, ...] = ()
    taken = []
    for r in batches.sort_values(["page", "pos"]).itertuples():
        key = key_of(r.number)
        if follows(last, key, bool(r.strong)):
            last = key
            taken.append((r.doc_id, r.page, r.pos, r.number, r.heading))
    return pd.DataFrame(taken, columns=["doc_id", "page", "pos", "number", "heading"])


def _headings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of headings, lines that open a clause of running text with its number)."""
    page = Window.partitionBy("doc_id", "page")
    down = page.orderBy("pos")
    contents = F.sum((F.col("shape") == "toc").cast("int")).over(page) >= 3
    after = lambda c: F.lead(c).over(down)
    title_like = (F.length(after("line")) < 80) & ~after("line").endswith(".") & ~F.regexp_like(after("line"), F.lit(r"^\p{Ll}"))
    titled = F.coalesce((after("shape") == "text") & (after("bold") | title_like & ~after("prose")), F.lit(False))
    clause, annex = F.regexp_extract("line", CLAUSE, 1), F.regexp_extract("line", ANNEX, 1)
    x = lines.withColumn("_contents", contents).withColumn("_titled", titled).withColumn("_next", after("pos")).filter(~F.col("_contents"))
    x = x.withColumn("number", F.when(annex != "", annex).otherwise(clause)).withColumn("title", F.when(annex != "", F.regexp_extract("line", ANNEX, 2)).otherwise(F.regexp_extract("line", CLAUSE, 2)))
    n = x.filter("shape = 'numbered'")
    top, stopped = ~F.contains("number", F.lit(".")), F.col("title").endswith(".")
    with_title = F.col("bold") | top & (F.length("title") < 70) & ~stopped
    heading = F.when(annex != "", F.col("bold") | (F.length("line") < 60)).when(F.col("title") != "", with_title).otherwise(~top | F.col("bold") | F.col("_titled"))
    n = n.withColumn("heading", heading).withColumn("strong", F.col("bold") & (F.col("title") != "") & ~stopped).filter(F.col("heading") | ~top)
    sent = n.select("doc_id", "page", "pos", "number", "heading", "strong")
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    taken = sent.groupBy("doc_id").applyInPandas(_numbers, f"doc_id {kinds['doc_id']}, page {kinds['page']}, pos int, number string, heading boolean")
    found = taken.join(n.select(*AT, "line", "title", "_titled", "_next"), AT)
    annexed = F.col("line").startswith("Annex")
    label = F.when(annexed, F.concat(F.lit("Annex "), F.col("number"))).otherwise(F.col("number"))
    heads = found.filter("heading").select("doc_id", "page", F.explode(F.when((F.col("title") == "") & F.col("_titled"), F.array("pos", "_next")).otherwise(F.array("pos"))).alias("at"), "pos", label.alias("label"))
    heads = heads.select("doc_id", "page", F.col("at").alias("pos"), F.lit("heading").alias("kind"), F.col("pos").cast("string").alias("group"), "label", F.lit(False).alias("review"))
    plain = x.filter(_unnumbered()).select(*AT, F.lit("heading").alias("kind"), F.col("pos").cast("string").alias("group"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("review"))
    return heads.unionByName(plain.join(heads.select(*AT), AT, "left_anti")), found.filter("not heading").select(*AT, "number")


def claims(lines: DataFrame, boxes: DataFrame, width: float = 595.0, reach: float = 45.0) -> DataFrame:
    """``(doc_id, page, pos, line, kind, block, label, review)``: each line once, with the block that claims it.

    ``block`` is the place of the block's first line on its page; running heads
    and feet have kind 'furniture' and no block.  ``reach`` is how far an
    equation may go over and under its number.
    """
    every = cut(placed(lines, width), "lines")
    page_number = F.regexp_like("line", F.lit(r"^(?:[0-9]{1,3}|[ivxlc]{1,6})$")) & ~F.col("bold")
    marked = every.filter("upright").withColumn("_shape", F.col("shape")).withColumn("shape", F.when(page_number, "text").otherwise(F.col("shape")))
    gone = cut(furniture_places(marked), "gone")
    live = every.filter("upright")
    on = lambda marks: live.filter(F.col("_marks").bitwiseAND(marks) != 0)
    tables = cut(_tables(_left(live, gone), boxes), "tables")
    formulas = cut(_equations(_left(on(MARGINS), gone, tables), reach), "formulas")
    legends = cut(_legends(_left(on(WHERES), gone, tables, formulas)), "legends")
    figures = cut(_figures(_left(on(KEYS), gone, tables, formulas, legends)), "figures")
    headings, clauses = _headings(_left(on(NUMBERS), gone, tables, formulas, legends, figures))
    headings, clauses = cut(headings, "headings"), cut(clauses, "clauses")
    turned = every.filter("not upright").select(*AT, F.lit("rotated").alias("kind"), F.lit("").alias("group"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("review"))
    told = gone.select(*AT, F.lit(True).alias("_gone"))
    for c in (tables, formulas, legends, figures, headings, turned, clauses):
        told = told.unionByName(c, allowMissingColumns=True)
    said = ("kind", "group", "label", "review")
    told = told.groupBy("doc_id", "page").agg(F.collect_list(F.struct("pos", "_gone", "number", *said)).alias("_told"))
    out = every.join(told, ["doc_id", "page"], "left").withColumn("_told", F.filter("_told", lambda x: x["pos"] == F.col("pos")))
    one = lambda test: F.get(F.filter("_told", test), F.lit(0))
    claim = one(lambda x: x["kind"].isNotNull())
    running = F.coalesce(F.exists("_told", lambda x: x["_gone"]), F.lit(False)) | F.col("doc_id").isNull()
    out = out.select(*every.columns, *[claim[c].alias(c) for c in said], one(lambda x: x["number"].isNotNull())["number"].alias("number"), running.alias("_gone"))
    # running heads and feet are a side of their own, as the lines around them follow each other
    out = out.withColumn("_gone", F.col("_gone") & F.col("kind").isNull())
    page = Window.partitionBy("doc_id", "page", "_gone")
    down = page.orderBy("pos")
    open_ = F.col("kind").isNull() & ~F.col("_gone")
    own = F.col("shape").isin("note", "example", "list", "caption")
    body = out.withColumn("_open", open_)
    before = F.coalesce(F.lag("_open").over(down) & (F.lag("shape").over(down) != "caption"), F.lit(False))
    starts = F.col("_open") & (~before | own | F.col("number").isNotNull())
    body = body.withColumn("_start", F.max(F.when(starts, F.struct("pos", "shape", "number"))).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    shape = F.col("_start.shape")
    body = body.withColumn("kind", F.when(F.col("_open"), F.when(shape.isin("note", "example", "list", "caption"), shape).otherwise("text")).when(F.col("_gone"), "furniture").otherwise(F.col("kind")))
    body = body.withColumn("label", F.when(F.col("_open"), F.when(shape == "caption", F.concat(F.lit("Table "), F.regexp_extract("line", CAPTION, 1))).otherwise(F.col("_start.number"))).otherwise(F.col("label")))
    group = Window.partitionBy("doc_id", "page", "kind", "group")
    block = F.when(F.col("_open"), F.col("_start.pos")).when(~F.col("_gone"), F.min("pos").over(group))
    return body.select(*AT, "line", "kind", block.cast("int").alias("block"), "label", F.coalesce("review", F.lit(False)).alias("review"))


def blocks(claimed: DataFrame) -> DataFrame:
    """``(doc_id, page, block, kind, label, text, n_lines, review)`` of ``claims``, one row a block, its lines in reading order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    b = claimed.filter("block is not null").groupBy("doc_id", "page", "block").agg(F.first("kind").alias("kind"), F.max("label").alias("label"), text.alias("text"), F.count("*").alias("n_lines"), F.max("review").alias("review"))
    return b.select("doc_id", "page", "block", "kind", "label", "text", "n_lines", "review")
