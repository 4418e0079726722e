"""Queries over placed lines; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import blocks
from folioforge.plans.catalog import query
from folioforge.plans.tables import table


def set_lines(docs: DataFrame, per_page: int = 50) -> DataFrame:
    """``docs(doc_id, text)`` set on pages of ``per_page`` lines, 14 units apart; short lines without a full stop that begin with a capital are bold.

    Lines with a bar stand in columns, a cell each; rows of one id count as one document after another.
    """
    line = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    cells = line.select("doc_id", "i", F.posexplode(F.split("line", F.lit(r"\|"))).alias("cell", "text"))
    at = (72.0 + 90.0 * F.col("cell")).alias("x0")
    top = (40.0 + 14.0 * (F.col("i") % per_page)).alias("y0")
    bold = (F.length("text") < 60) & ~F.rtrim("text").endswith(".") & F.regexp_like("text", F.lit(r"^\s*(?:\p{Lu}|[0-9]+(?:\.[0-9]+)*\s+\p{Lu})"))
    return cells.select("doc_id", F.floor(F.col("i") / per_page).cast("int").alias("page"), at, top, "text", bold.alias("bold")).select("*", (F.col("x0") + 5.0 * F.length("text")).alias("x1"), (F.col("y0") + 10.0).alias("y1"), F.lit(True).alias("upright"))


def column_boxes(lines: DataFrame) -> DataFrame:
    """A box around each run of rows that stand in columns."""
    rows = lines.groupBy("doc_id", "page", "y0").agg(F.count("*").alias("n"), F.max("x1").alias("x1")).filter("n > 1")
    down = Window.partitionBy("doc_id", "page").orderBy("y0")
    new = F.coalesce(F.col("y0") - F.lag("y0").over(down) > 14.5, F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("box", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.groupBy("doc_id", "page", "box").agg(F.lit(70.0).alias("x0"), (F.min("y0") - 1).alias("y0"), F.max("x1").alias("x1"), (F.max("y0") + 11).alias("y1"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, their lines set on pages; texts by digest."""
    lines = set_lines(table(spark, sf_dir, "documents"))
    found = blocks.blocks(blocks.claims(lines, column_boxes(lines)))
    return found.select("doc_id", "page", "block", "kind", "label", "n_lines", "review", F.sha2("text", 256).alias("text_sha256"))
