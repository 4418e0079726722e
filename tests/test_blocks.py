"""Block detection on an invented standard of three pages, and on pages made of random lines."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import blocks

LINES = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, bold boolean, upright boolean"
BOXES = "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double"


def line(page, y, text, x=70.0, bold=False, upright=True, doc=1):
    return (doc, page, float(x), float(y), x + 5.0 * len(text), y + 10.0, text, bold, upright)


def standard():
    out = []
    for p in (1, 2, 3):
        out += [line(p, 20, "Invented standard 17:2031"), line(p, 32, "Draft of the works"), line(p, 800, "All rights kept"), line(p, 815, f"{p}", 300)]
    out += [
        line(1, 60, "1 Scope", bold=True), line(1, 76, "This document tells how a wheel is measured and"), line(1, 90, "what its teeth are."),
        line(1, 120, "3", bold=True), line(1, 121, "Symbols", 95, bold=True),
        line(1, 150, "Table 1 — Symbols of wheels"), line(1, 164, "Dimensions in millimetres"),
        line(1, 190, "Symbol"), line(1, 190, "Meaning", 200), line(1, 206, "d"), line(1, 206, "diameter", 200), line(1, 222, "z"), line(1, 222, "number of teeth", 200), line(1, 240, "a Values for steel"),
        line(1, 300, "4 Measures", bold=True), line(1, 320, "4.3 Wheels", bold=True), line(1, 340, "The reference diameter of a wheel follows from its teeth by"),
        line(1, 380, "d = z m", 120), line(1, 380, "(1)", 480), line(1, 420, "db = d cos α", 120), line(1, 420, "(2)", 480),
        line(1, 450, "where"), line(1, 466, "d is the reference diameter, mm;"), line(1, 482, "z is the number of teeth that the"), line(1, 497, "whole wheel has;"), line(1, 512, "m is the module, mm."),
        line(1, 560, "NOTE The values are rounded."), line(1, 590, "4.3.1 The wheel is held so that its axis stays where it was and"), line(1, 604, "turns freely"),
        line(2, 60, "until it stops."), line(2, 90, "4.4 Racks", bold=True), line(2, 110, "Key"), line(2, 124, "1 Datum line"), line(2, 138, "a tooth flank"), line(2, 160, "Figure 2 — A rack and its lines"),
        line(2, 190, "EXAMPLE A rack of ten teeth."), line(2, 210, "— first item"), line(2, 224, "— second item"), line(2, 250, "5 Limits", bold=True), line(2, 270, "12 Wheels were measured in all of the trials that were made."),
        line(2, 300, "Table 2 — Limits"), line(2, 330, "Size"), line(2, 330, "Limit", 200), line(2, 346, "10"), line(2, 346, "0,2", 200), line(2, 500, "turned text of the margin", 20, upright=False),
        line(3, 60, "Table 2 (continued)"), line(3, 90, "Size"), line(3, 90, "Limit", 200), line(3, 106, "20"), line(3, 106, "0,3", 200),
        line(3, 150, "6 Report", bold=True), line(3, 170, "The report names the wheel."), line(3, 200, "a/b + c", 120), line(3, 214, "x/y", 120), line(3, 236, "p/q", 120), line(3, 262, "r/s", 120), line(3, 216, "(3)", 480),
        line(3, 300, "Annex A", bold=True), line(3, 318, "More about wheels", bold=True), line(3, 340, "A.1 Wheels of wood", bold=True), line(3, 360, "Wheels of wood are not measured."), line(3, 400, "Bibliography", bold=True),
    ]
    boxes = [(1, 1, 0, 65.0, 184.0, 400.0, 236.0), (1, 1, 1, 110.0, 374.0, 470.0, 394.0), (1, 2, 0, 65.0, 324.0, 400.0, 360.0), (1, 3, 0, 65.0, 84.0, 400.0, 120.0)]
    return out, boxes


def run(spark, lines, boxes):
    claimed = blocks.claims(spark.createDataFrame(lines, LINES), spark.createDataFrame(boxes, BOXES))
    return claimed.collect(), blocks.blocks(claimed).orderBy("doc_id", "page", "block").collect()


def test_the_blocks_of_a_standard(spark):
    lines, boxes = standard()
    claimed, got = run(spark, lines, boxes)
    assert sorted(r.line for r in claimed) == sorted(x[6] for x in lines)  # none lost, none twice
    assert len({(r.page, r.pos) for r in claimed}) == len(lines)
    assert sorted(r.line for r in claimed if r.kind == "furniture") == sorted(x[6] for x in lines if x[3] in (20.0, 32.0, 800.0, 815.0))
    assert [(r.page, r.kind, r.label) for r in got] == [
        (1, "heading", "1"), (1, "text", None), (1, "heading", "3"), (1, "table", "Table 1"), (1, "heading", "4"), (1, "heading", "4.3"), (1, "text", None), (1, "formula", "(1)"), (1, "formula", "(2)"), (1, "legend", None),
        (1, "note", None), (1, "text", "4.3.1"), (2, "text", None), (2, "heading", "4.4"), (2, "figure", "Figure 2"), (2, "example", None), (2, "list", None), (2, "list", None), (2, "heading", "5"), (2, "text", None),
        (2, "table", "Table 2"), (2, "rotated", None), (3, "table", "Table 2"), (3, "heading", "6"), (3, "text", None), (3, "formula", "(3)"), (3, "text", None), (3, "heading", "Annex A"), (3, "heading", "A.1"), (3, "text", None), (3, "heading", None),
    ]
    assert [r.text for r in got if r.review] == ["a/b + c\nx/y\n(3)\np/q"]  # what goes on beyond the reach stays text
    text = {(r.page, r.kind, r.label): r.text for r in got}
    assert text[1, "heading", "3"] == "3\nSymbols" and text[3, "heading", "Annex A"] == "Annex A\nMore about wheels"
    assert text[1, "table", "Table 1"].startswith("Table 1 — Symbols of wheels\nDimensions in millimetres\nSymbol\nMeaning") and text[1, "table", "Table 1"].endswith("a Values for steel")
    assert text[1, "formula", "(1)"] == "d = z m\n(1)" and len(text[1, "legend", None].split("\n")) == 5
    assert text[1, "text", "4.3.1"].endswith("turns freely") and text[2, "figure", "Figure 2"].count("\n") == 3
    assert {(r.page, r.label): r.review for r in got if r.kind == "formula"} == {(1, "(1)"): False, (1, "(2)"): False, (3, "(3)"): True}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_line_once_whatever_the_page(spark, seed):
    r = random.Random(seed)
    pool = ["where", "Key", "1 Datum", "d is the wheel, mm;", "wrapped on", "Table 1 — A", "Table 1 (continued)", "Figure 1 — B", "NOTE a", "EXAMPLE b", "— c", "1", "1 Scope", "1.1 Part", "2.", "(1)", "x = y", "=", "plain words of a longer line here", "Annex A", "Contents", "a....... 7", "Dimensions in mm", "Foreword", "Z", "  ", None]
    lines = [line(r.choice([1, 2, 3]), r.randrange(40, 780), r.choice(pool) or " ", r.choice([70.0, 70.0, 450.0]), r.random() < 0.3, r.random() < 0.95, doc=r.choice([1, 2])) for _ in range(240)]
    lines += lines[:5]
    boxes = [(d, p, b, 60.0, float(y), 500.0, float(y + 80)) for d in (1, 2) for p in (1, 2) for b, y in enumerate((100, 150, 500))]
    claimed, got = run(spark, lines, boxes)
    assert sorted((x.doc_id, x.page, x.line) for x in claimed) == sorted((x[0], x[1], x[6].strip()) for x in lines if x[6].strip())
    assert len({(x.doc_id, x.page, x.pos) for x in claimed}) == len(claimed)
    assert sum(x.n_lines for x in got) == sum(x.block is not None for x in claimed)
    assert all(x.kind != "furniture" for x in got) and all((x.kind == "furniture") == (x.block is None) for x in claimed)


def test_empty_tables_and_odd_rows(spark):
    assert run(spark, [], []) == ([], [])
    odd = [line(1, 60, "Words of a line"), (None, 1, 1.0, 1.0, 2.0, 2.0, "no document", None, None), (1, None, 1.0, 1.0, 2.0, 2.0, "no page", False, True), (1, 1, None, None, None, None, "no place", False, True), (1, 1, 1.0, 1.0, 2.0, 2.0, None, False, True)]
    claimed, _ = run(spark, odd, [])
    assert {r.line for r in claimed if r.doc_id == 1} == {"Words of a line", "no place"}
    assert blocks.placed(spark.createDataFrame(odd, LINES).withColumn("line", F.lit(1))).filter("line = 'Words of a line'").count() == 1


def test_the_query_keeps_all_lines(spark, sf):
    from folioforge.plans import layout_queries
    from folioforge.plans.tables import table

    lines = layout_queries.set_lines(table(spark, sf, "documents")).cache()
    n = lines.filter("trim(text) <> ''").count()
    claimed = blocks.claims(lines, layout_queries.column_boxes(lines))
    assert claimed.count() == n == claimed.select("doc_id", "page", "pos").distinct().count()
    got = layout_queries.page_blocks(spark, sf)
    assert got.agg(F.sum("n_lines")).first()[0] == claimed.filter("block is not null").count()


def test_lines_are_dealt_out_once_after_the_passes(spark):
    lines = [(d, p, 72.0, 40.0 + 14 * i, 300.0, 50.0 + 14 * i, t, False, True) for d in (1, 2) for p in range(4) for i, t in enumerate(["Running head", f"1.{p} Title", "where", "x is a length", "Text of a page.", f"({p})"])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claimed = blocks.claims(spark.createDataFrame(lines, LINES), spark.createDataFrame([], BOXES))
        found = blocks.blocks(claimed)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the lines, and what the passes told
        assert claimed.select("doc_id", "page", "pos").distinct().count() == claimed.count() == len(lines)
        assert found.agg(F.sum("n_lines")).first()[0] == claimed.filter("kind <> 'furniture'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
