"""Tables as data: cells placed in a grid, column names from merged header cells, units, and row groups for chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import token_estimate


def place_cells(words: DataFrame, grid: DataFrame) -> DataFrame:
    """``words(table, x0, y0, x1, y1, text, ord)`` put into ``grid(table, row, col, x0, y0, x1, y1)`` by their centre.

    Cells are binned by rows of 16 units, so words meet the cells of their own
    band by equality and the rest is a filter; a word outside every cell is kept with null place.
    """
    band = 16.0
    w = words.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("bin", F.floor(F.col("cy") / band))
    g = grid.select("table", "row", "col", F.col("x0").alias("gx0"), F.col("y0").alias("gy0"), F.col("x1").alias("gx1"), F.col("y1").alias("gy1"), F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("bin"))
    inside = (w["table"] == g["table"]) & (w["bin"] == g["bin"]) & (w["cx"] >= g["gx0"]) & (w["cx"] < g["gx1"]) & (w["cy"] >= g["gy0"]) & (w["cy"] < g["gy1"])
    return w.join(g, inside, "left").select(w["table"], "row", "col", "text", "ord")


def cell_texts(placed: DataFrame) -> DataFrame:
    """``(table, row, col, text)`` with the words of a cell in order, and ``lost``: the share of a table's words in no cell."""
    cells = placed.filter("row is not null").groupBy("table", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    lost = placed.groupBy("table").agg(F.avg(F.col("row").isNull().cast("double")).alias("lost"))
    return cells.join(lost, "table")


def header_rows(rows: Column, most: int = 3) -> Column:
    """How many rows at the top hold no number (at most ``most``, at least one)."""
    plain = F.transform(F.slice(rows, 1, most), lambda r: ~F.exists(r, lambda c: F.regexp_like(c, F.lit("^[-+±]?[0-9]"))))
    n = F.aggregate(plain, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda a, p: F.struct((a["on"] & p).alias("on"), (a["n"] + (a["on"] & p).cast("int")).alias("n")), lambda a: a["n"])
    return F.greatest(F.lit(1), n)


def column_names(rows: Column, n_header: Column) -> Column:
    """Names of the columns: header cells from top to bottom, an empty one standing for the one before it in its row."""
    filled = F.transform(
        F.slice(rows, F.lit(1), n_header),
        lambda r: F.aggregate(r, F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out")), lambda a, c: F.struct(F.when(F.trim(c) == "", a["last"]).otherwise(F.trim(c)).alias("last"), F.concat(a["out"], F.array(F.when(F.trim(c) == "", a["last"]).otherwise(F.trim(c)))).alias("out")), lambda a: a["out"]),
    )
    width = F.size(F.element_at(rows, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.array_join(F.array_distinct(F.filter(F.transform(filled, lambda r: F.coalesce(F.get(r, i - 1), F.lit(""))), lambda x: x != "")), " / "))


def column_units(names: Column) -> Column:
    """The unit a column's name ends with or holds in brackets, in one spelling; null if none."""
    unit = lambda n: F.regexp_extract(n, "(?:^|[\\s(\\[])(mm|µm|μm|um|°|deg|%|MPa|N/mm2|rad)[)\\]]?$", 1)
    return F.transform(names, lambda n: F.when(unit(n) == "", F.lit(None)).when(unit(n).isin("μm", "um"), "µm").when(unit(n) == "deg", "°").otherwise(unit(n)))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def row_groups(tables: DataFrame, whole: int = 280, group: int = 200) -> DataFrame:
    """``tables(table, caption, rows, n_header)`` -> chunks: one for a small table, else an overview and groups of rows, each with caption and header.

    The fold carries the text of the open group; a row opens a new one when the
    estimate of the joined text would exceed the limit.
    """
    head = F.array_compact(F.array(F.nullif(F.trim(F.coalesce("caption", F.lit(""))), F.lit(""))))
    header = F.transform(F.slice("rows", F.lit(1), F.col("n_header")), _line)
    rule = F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at("rows", 1)))))
    t = tables.withColumn("prefix", F.array_join(F.concat(head, header, rule), "\n")).withColumn("body", F.transform(F.filter(F.slice("rows", F.col("n_header") + 1, F.greatest(F.lit(0), F.size("rows") - F.col("n_header"))), lambda r: F.exists(r, lambda c: F.trim(c) != "")), _line))
    t = t.withColumn("full", F.concat_ws("\n", "prefix", F.array_join("body", "\n"))).withColumn("tokens", token_estimate(F.col("full")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.when(acc["open"] == "", F.concat(F.col("prefix"), F.lit("\n"), line)).otherwise(F.concat(acc["open"], F.lit("\n"), line))
        fits = (acc["open"] == "") | (token_estimate(joined) <= group)
        return F.struct(F.when(fits, joined).otherwise(F.concat(F.col("prefix"), F.lit("\n"), line)).alias("open"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))).alias("out"))

    groups = F.aggregate("body", start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["open"]))))
    t = t.withColumn("groups", F.when(F.col("tokens") > whole, groups).otherwise(F.array().cast("array<string>")))
    overview = F.concat_ws("\n", "prefix", F.concat(F.lit("("), F.size("body").cast("string"), F.lit(" rows in "), F.size("groups").cast("string"), F.lit(" row groups)")))
    many = F.size("groups") > 1
    first = F.struct(F.lit(0).alias("n"), F.when(many, "overview").otherwise("table").alias("role"), F.when(many, overview).otherwise(F.col("full")).alias("text"))
    rest = F.transform("groups", lambda g, i: F.struct((i + 1).cast("int").alias("n"), F.lit("table_row_group").alias("role"), g.alias("text")))
    chunks = F.when(many, F.concat(F.array(first), rest)).otherwise(F.array(first))
    return t.select("table", F.explode(chunks).alias("c")).select("table", "c.*").withColumn("tokens", token_estimate(F.col("text")))


def append_continued(tables: DataFrame) -> DataFrame:
    """Parts ``(doc_id, number, page, continued, rows, n_header)`` of one table joined in page order, repeated headers dropped."""
    part = F.struct("page", "rows", "n_header")
    g = tables.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    rows = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1)), F.element_at("parts", 1)["rows"], lambda a, p: F.concat(a, F.slice(p["rows"], p["n_header"] + 1, F.greatest(F.lit(0), F.size(p["rows"]) - p["n_header"]))))
    return g.select("doc_id", "number", F.element_at("parts", 1)["page"].alias("page"), F.element_at("parts", -1)["page"].alias("last_page"), F.element_at("parts", 1)["n_header"].alias("n_header"), rows.alias("rows"))
