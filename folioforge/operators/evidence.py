"""What readers of a collection see: the eligible view, lists with filters, counts, confidence, and what survives a new run.

Filters, scopes and eligibility are conditions of the plan, in front of every
join and channel, so they reach the scans; lists are ordered to the last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let, squash
from folioforge.operators.relational import eligible

# ------------------------------------------------------------------ the eligible view


def evidence_view(chunks: DataFrame, versions: DataFrame, documents: DataFrame, areas: DataFrame) -> DataFrame:
    """Chunks of active, indexed, verified versions in verified areas, with their document's code and area.

    ``chunks(doc_id, ...)``, ``versions(doc_id, active, ingestion, corpus)``,
    ``documents(doc_id, area, code)``, ``areas(area, area_verified)``.
    """
    seen = versions.join(documents, "doc_id").join(areas, "area")
    seen = seen.filter(eligible(F.col("area_verified"), F.col("active"), F.col("ingestion"), F.col("corpus")))
    return chunks.join(seen.select("doc_id", "area", "code"), "doc_id")


def has_code(code: Column, numbers: list[str]) -> Column:
    """Whether a code holds one of the numbers as a whole (286 isn't in 2860 or 1286)."""
    return F.regexp_like(code, F.lit("(?:^|[^0-9])0*(?:" + "|".join(numbers) + ")(?:[^0-9]|$)"))


# ------------------------------------------------------------------ lists


def document_list(rows: DataFrame, words: str | None, columns: list[str], order: list[Column], limit: int, offset: int = 0, **equal) -> DataFrame:
    """A page of the rows whose named columns hold ``words`` in any case, and the ``total`` of all pages."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    if words:
        holds = F.lit(False)
        for c in columns:
            holds = holds | F.contains(F.lower(c), F.lit(words.lower()))
        rows = rows.filter(holds)
    total = rows.agg(F.count("*").alias("total")).first().total
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def granted_list(rows: DataFrame, grants: DataFrame, key: str, owner: Column, order: list[Column], limit: int = 500) -> DataFrame:
    """The newest rows that are the owner's or granted by key."""
    mine = rows.filter(owner)
    shared = rows.filter(~F.coalesce(owner, F.lit(False))).join(grants.select(key).distinct(), key, "left_semi")
    return mine.unionByName(shared.select(*rows.columns)).orderBy(*order).limit(limit)


def draft_queue(drafts: DataFrame, scopes: DataFrame, scope: str, status: Column, order: list[Column], limit: int) -> DataFrame:
    """Drafts of a status within the granted scopes, in order; the scope is part of the plan, not a filter after the page."""
    return drafts.filter(status).join(scopes.select(scope).distinct(), scope, "left_semi").orderBy(*order).limit(limit)


def current(documents: DataFrame, areas: DataFrame, area: str, versions: DataFrame, key: str) -> DataFrame:
    """All documents, each with its area and its current version where it has them."""
    return documents.join(areas, area, "left").join(versions, key, "left")


def relationships(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``(node, other, direction)``: each edge from both of its ends."""
    ends = F.array(
        F.struct(F.col(source).alias("node"), F.col(target).alias("other"), F.lit("out").alias("direction")),
        F.struct(F.col(target).alias("node"), F.col(source).alias("other"), F.lit("in").alias("direction")),
    )
    return edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.explode(ends).alias("e")).select("e.*")


# ------------------------------------------------------------------ counts


def status_counts(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(part, status, n)`` of several tables, each by its status column."""
    out = None
    for name, (rows, status) in parts.items():
        one = rows.groupBy(F.col(status).cast("string").alias("status")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "status", "n")
        out = one if out is None else out.unionByName(one)
    return out


def chunk_matrix(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, lines and tokens by kinds."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum("n_lines").alias("n_lines"), F.sum("tokens").alias("n_tokens"))


# ------------------------------------------------------------------ confidence and coverage


def weakest_page(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``(chunk_id, confidence, draft)``: a chunk is as good as its worst page, and a draft if any page is one.

    ``chunks(chunk_id, p0, p1)`` meet ``pages(page, score, draft)`` by equality on each page of their range.
    """
    each = chunks.select("chunk_id", F.explode(F.sequence("p0", "p1")).alias("page"))
    return each.join(pages, "page").groupBy("chunk_id").agg(F.min("score").alias("confidence"), F.bool_or("draft").alias("draft"))


def content_coverage(page: Column, chunks: Column, least: int = 4) -> Column:
    """Share of a page's lines of at least ``least`` characters (without white space) that its chunks hold."""
    lines = F.filter(F.transform(F.split(page, "\n"), squash), lambda x: F.length(x) >= least)
    both = F.struct(lines.alias("lines"), squash(chunks).alias("chunks"))
    return let(both, lambda b: F.when(F.size(b["lines"]) == 0, F.lit(1.0)).otherwise(F.size(F.filter(b["lines"], lambda x: F.contains(b["chunks"], x))) / F.size(b["lines"])))


def label_lines(text: Column, most: int = 8, longest: int = 80) -> Column:
    """The first distinct label lines of a passage: short lines that open with a capital letter."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # F.trim itself would take a line's number for the characters to trim
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (F.length(x) <= longest) & F.regexp_like(x, F.lit("^[A-Z]")))), 1, most)


#: Greek letters and the Latin ones by which a symbol font writes them; the micro sign and mu stay.
_GREEK, _SYMBOL_FONT = "αβγδεζηθικλνξπρστυφχψω", "abgdezhqiklnxprstufcyw"


def evidence_normal(text: Column) -> Column:
    """Text as evidence is compared: hyphens alike, one blank for any white space, lower case with ss for ß, Greek letters as a symbol font's."""
    t = F.translate(text, "‐‑‒–—−", "------")
    t = F.trim(F.regexp_replace(t, "[\\s\\u00A0\\u2000-\\u200B\\u202F\\u3000]+", " "))
    return F.translate(F.replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), _GREEK, _SYMBOL_FONT)


# ------------------------------------------------------------------ what survives a new run


def preserved(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Pages of a new run with the confirmation they keep: only where the text is the same and the new page is still a draft.

    ``before(key, text_hash, status)``, ``after(key, text_hash, status)``.
    """
    old = before.filter(F.col("status") == "user_confirmed").select(key, "text_hash", F.lit(True).alias("_confirmed")).distinct()
    joined = after.join(old, [key, "text_hash"], "left")
    kept = F.coalesce(F.col("_confirmed"), F.lit(False)) & (F.col("status") == "draft")
    return joined.withColumn("kept", kept).withColumn("status", F.when(F.col("kept"), "user_confirmed").otherwise(F.col("status"))).drop("_confirmed")


def remapped(citations: DataFrame, chunks: DataFrame, key: str, order: str, quoted: int = 80) -> DataFrame:
    """``citations(key, cite_id, quote)`` on the first of the new chunks ``(key, order, text)`` that holds the start of the quote; null if none does."""
    wanted = citations.select(key, "cite_id", F.left(squash(F.col("quote")), F.lit(quoted)).alias("_start"))
    held = wanted.join(chunks.select(key, order, squash(F.col("text")).alias("_text")), key).filter(F.contains("_text", F.col("_start")))
    first = held.groupBy(key, "cite_id").agg(F.min(order).alias(order))
    return citations.select(key, "cite_id").join(first, [key, "cite_id"], "left")


def newest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
