"""What a chunk says beside its text: pieces of formulas with legend and variables, and the context lines of chunks.

A formula piece is its lead-in, its line, the legend behind its run of formulas
and what it refers to; symbols that the legend doesn't define are looked up in
the document's glossary.  A chunk's context is its document and path, what its
symbols mean and what its table's columns are called, within a number of lines.

Windows go by (document, section), joins by (document, place) and (document,
symbol); arrays hold what one formula, table or chunk holds.

Defined cases: ``(doc_id, ord)`` names a unit, ``(doc_id, idx)`` a chunk, and
``(doc_id, symbol)`` a glossary row (of repeated ones the least counts); null or
empty texts give no lines; a chunk whose units aren't formulas or tables has its
path alone; rows whose document or place is null keep their own parts and meet
no glossary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let, sentences, token_estimate

FUNCTIONS = ("sin", "cos", "tan", "inv", "arcsin", "arccos", "arctan", "sqrt", "max", "min", "log", "ln", "exp", "pi")
VARIABLE = "array<struct<symbol:string,description:string,unit:string,source:string>>"
_NAME = r"[A-Za-z\p{IsGreek}][A-Za-z0-9_\p{IsGreek}]*"
_LEGEND = rf"^\s*(?:where\s+)?({_NAME})\s+(?:is|are|denotes?)\s+(?:the\s+)?([^,;.]{{3,80}})(?:,\s*(mm|µm|°|rad|N|MPa))?"


def _filled(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def symbols_of(formula: Column, longest: int = 8) -> Column:
    """Names in a formula, each once, in order; functions are none."""
    found = F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(f"({_NAME})"))
    return F.array_distinct(F.filter(found, lambda s: (F.length(s) <= longest) & ~F.lower(s).isin(*FUNCTIONS)))


def legend_variables(legend: Column) -> Column:
    """The lines 'symbol is the ... [, unit]' of a legend as variables."""
    part = lambda x, g: F.regexp_extract(x, _LEGEND, g)
    lines = F.filter(F.split(F.coalesce(legend, F.lit("")), "\n"), lambda x: part(x, 1) != "")
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("symbol"), F.trim(part(x, 2)).alias("description"), F.nullif(part(x, 3), F.lit("")).alias("unit"), F.lit("legend").alias("source")))


def _meanings(rows: DataFrame, asked: str, glossary: DataFrame) -> DataFrame:
    """``(doc_id, ord, _known)``: the symbols of an array column that the glossary describes, in order."""
    least = glossary.groupBy("doc_id", "symbol").agg(F.min(F.struct("description", "unit", "source")).alias("g"))
    wanted = rows.select("doc_id", "ord", F.posexplode(asked).alias("at", "symbol"))
    known = wanted.join(least, ["doc_id", "symbol"]).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set(F.struct("at", "symbol", "g"))).alias("k"))
    return known.select("doc_id", "ord", F.transform("k", lambda x: F.struct(x["symbol"].alias("symbol"), x["g"]["description"].alias("description"), x["g"]["unit"].alias("unit"), x["g"]["source"].alias("source"))).alias("_known"))


def formula_pieces(units: DataFrame, glossary: DataFrame, lead_max: int = 90) -> DataFrame:
    """``(doc_id, ord, number, review, text, lead, legend, symbols, variables)`` of the formulas of ``units``.

    ``units(doc_id, section, ord, kind, label, text, lead_in, see_also, review)``; ``glossary(doc_id, symbol, description, unit, source)``.
    A legend that follows a run of formulas belongs to each of them; a lead-in of more than ``lead_max`` tokens is cut to its last sentence.
    """
    back = Window.partitionBy("doc_id", "section").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.last(F.when(F.col("kind") != "formula", F.struct("kind", "text")), ignorenulls=True).over(back)
    rows = units.withColumn("_behind", behind).filter("kind = 'formula'")
    lead = let(F.coalesce("lead_in", F.lit("")), lambda t: F.when(token_estimate(t) > lead_max, F.concat(F.lit("… "), F.coalesce(F.try_element_at(sentences(t), F.lit(-1)), t))).otherwise(t))
    rows = rows.select("doc_id", "ord", F.col("label").alias("number"), "review", F.col("text").alias("line"), "see_also", F.nullif(lead, F.lit("")).alias("lead"), F.when(F.col("_behind.kind") == "legend", F.col("_behind.text")).alias("legend"))
    rows = rows.withColumn("symbols", symbols_of(F.col("line"))).withColumn("_own", legend_variables(F.col("legend")))
    rows = rows.withColumn("_open", F.array_except("symbols", F.transform("_own", lambda v: v["symbol"])))
    rows = rows.join(_meanings(rows, "_open", glossary), ["doc_id", "ord"], "left")
    text = F.array_join(F.filter(F.array("lead", "line", "legend", "see_also"), _filled), "\n")
    return rows.select("doc_id", "ord", "number", "review", text.alias("text"), "lead", "legend", "symbols", F.concat("_own", F.coalesce("_known", F.array().cast(VARIABLE))).alias("variables"))


def table_facts(units: DataFrame, glossary: DataFrame, most: int = 12) -> DataFrame:
    """``(doc_id, ord, columns, symbols, meanings)`` of the tables of ``units``, whose first line names the columns between bars.

    Symbols stand below a column named for them; the first ``most`` are looked up, unless the table itself says what they mean.
    """
    rows = units.filter("kind = 'table'").withColumn("_rows", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _filled), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c))))
    rows = rows.withColumn("columns", F.coalesce(F.try_element_at("_rows", F.lit(1)), F.array().cast("array<string>")))
    low = F.transform("columns", F.lower)
    names = F.transform(low, lambda c: F.contains(c, F.lit("symbol")) | F.startswith(c, F.lit("item")) | (c == "parameter"))
    rows = rows.withColumn("_at", F.array_position(names, True).cast("int"))
    cells = F.transform(F.slice("_rows", F.lit(2), F.size("_rows")), lambda r: F.when(F.col("_at") > 0, F.try_element_at(r, F.greatest(F.col("_at"), F.lit(1)))))
    rows = rows.withColumn("symbols", F.filter(cells, lambda s: F.length(s).between(1, 12)))
    meant = F.exists(low, lambda c: F.contains(c, F.lit("symbol"))) & F.exists(low, lambda c: F.regexp_like(c, F.lit("description|meaning|designation")))
    rows = rows.withColumn("_asked", F.when(meant, F.array().cast("array<string>")).otherwise(F.slice("symbols", 1, most))).select("doc_id", "ord", "columns", "symbols", "_asked")
    return rows.join(_meanings(rows, "_asked", glossary), ["doc_id", "ord"], "left").select("doc_id", "ord", "columns", "symbols", F.coalesce("_known", F.array().cast(VARIABLE)).alias("meanings"))


def _said(variables: Column) -> Column:
    """'symbol: description [unit]' of those that are described, each symbol once."""
    told = F.filter(variables, lambda v: _filled(v["description"]))
    once = let(told, lambda vs: F.filter(vs, lambda v, i: F.array_position(F.transform(vs, lambda x: x["symbol"]), v["symbol"]) == i + 1))
    return F.transform(once, lambda v: F.concat(v["symbol"], F.lit(": "), v["description"], F.when(_filled(v["unit"]), F.concat(F.lit(" ["), v["unit"], F.lit("]"))).otherwise("")))


def chunk_context(chunks: DataFrame, pieces: DataFrame, tables: DataFrame, most_lines: int = 20, most_symbols: int = 40) -> DataFrame:
    """``(doc_id, idx, context, symbols, units, equations, reasons)`` of ``chunks(doc_id, idx, title, path, ords)``.

    Meanings come from the chunk's formulas in order, then the columns and the symbols of its first table.
    """
    none = lambda t: F.lit(None).cast(t)
    strings = "array<string>"
    facts = pieces.select("doc_id", "ord", "number", "review", "symbols", "variables", none(strings).alias("columns")).unionByName(
        tables.select("doc_id", "ord", none("string").alias("number"), none("string").alias("review"), "symbols", F.col("meanings").alias("variables"), "columns")
    )
    held = chunks.select("doc_id", "idx", F.explode("ords").alias("ord")).join(facts, ["doc_id", "ord"])
    fact = F.struct("ord", "number", "review", "symbols", "variables", "columns")
    held = held.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(fact)).alias("_f"))
    rows = chunks.select("doc_id", "idx", "title", "path").join(held, ["doc_id", "idx"], "left")
    rows = rows.withColumn("_e", F.filter("_f", lambda f: f["columns"].isNull())).withColumn("_t", F.try_element_at(F.filter("_f", lambda f: f["columns"].isNotNull()), F.lit(1)))
    listed = lambda c: F.coalesce(c, F.array().cast(strings))
    own = F.coalesce(F.flatten(F.transform("_e", lambda f: f["variables"])), F.array().cast(VARIABLE))
    meanings = F.coalesce(F.col("_t.variables"), F.array().cast(VARIABLE))
    rows = rows.withColumn("_own", own)
    told = F.transform(F.filter("_own", lambda v: _filled(v["description"])), lambda v: v["symbol"])
    later = F.filter(meanings, lambda v: ~F.array_contains(told, v["symbol"]))
    head = F.array_join(F.filter(F.concat(F.array("title"), listed(F.col("path"))), _filled), " › ")
    named = F.filter(listed(F.col("_t.columns")), _filled)
    columns = F.when(F.size(named) > 0, F.array(F.concat(F.lit("Columns: "), F.array_join(named, " | ")))).otherwise(F.array().cast(strings))
    lines = F.slice(F.concat(F.array(head), _said(F.col("_own")), columns, _said(later)), 1, most_lines)
    symbols = F.slice(F.array_distinct(F.concat(listed(F.flatten(F.transform("_e", lambda f: f["symbols"]))), listed(F.col("_t.symbols")))), 1, most_symbols)
    units = F.array_distinct(F.filter(F.transform("_own", lambda v: v["unit"]), _filled))
    doubtful = F.filter("_e", lambda f: _filled(f["review"]))
    reasons = F.transform(doubtful, lambda f: F.concat(F.lit("formula ("), F.coalesce(f["number"], F.lit("")), F.lit("): "), f["review"]))
    return rows.select("doc_id", "idx", F.array_join(lines, "\n").alias("context"), symbols.alias("symbols"), units.alias("units"), F.filter(listed(F.transform("_e", lambda f: f["number"])), _filled).alias("equations"), listed(reasons).alias("reasons"))
