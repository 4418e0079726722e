"""Draft values in page text: labelled quantities, diameters, tolerances and bare numbers with units, with their places.

Every number of a page is found once.  What it means is read off the text around
it: a label to its left, a unit to its right.  Labels, units and their dimensions
are tables.  All of it is built-in expressions; a number's place is the running
length of what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels and units with their dimensions.
SYMBOLS = {
    "m": None, "mn": None, "m_n": None, "z": "count", "z1": "count", "z2": "count", "d": None, "da": None, "d_a": None, "db": None, "d_b": None, "df": None, "d_f": None, "dw": None, "d_w": None, "b": None, "x": None, "k": None,
    "α": "angle", "αn": None, "α_n": None, "α_": None, "alpha": "angle", "β": "angle", "beta": "angle", "aw": None, "a_w": None, "ha": None, "h_a": None, "hf": None, "h_f": None, "h": None, "Ra": None, "Rz": None, "A": None,
}
NAMES = {
    "modül": None, "module": None, "diş sayısı": "count", "number of teeth": "count", "helis açısı": "angle", "helix angle": "angle", "basınç açısı": "angle", "pressure angle": "angle", "diş genişliği": None, "face width": None, "facewidth": None,
    "eksen mesafesi": None, "centre distance": None, "center distance": None,
}
UNITS = {"mm": "length", "µm": "length", "μm": "length", "um": "length", "°": "angle", "deg": "angle", "derece": "angle"}
DIAMETER, TOLERANCE = "Øø⌀", "±"
#: Values kept of a page; None keeps all.
MOST = 60
#: Characters to a number's left in which its label is looked for, and of context on either side.
LEFT, AROUND = 40, 50

_NUMBER = "(?<![0-9])(?<![0-9][.,])-?[0-9]+(?:[.,][0-9]+)?"


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def _lookup(table: dict[str, str | None], key: Column) -> Column:
    known = {k.lower(): v for k, v in table.items() if v}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.lower(key))


def quantity(unit: Column, label: Column) -> Column:
    """length, angle, count or null: by the unit, else by the label."""
    own = F.coalesce(_lookup(UNITS, unit), F.when(label == "Ø", "length"), _lookup(SYMBOLS | NAMES, label))
    return F.coalesce(own, F.when(F.lower(label).startswith("z"), "count"))


def numbers(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, text, i, number, at, left, right)``: each number of a page with its place and the text at its sides."""
    split = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "text", F.split("text", _NUMBER).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({_NUMBER})")).alias("found"))
    each = split.select("doc_id", "page", "text", "gaps", F.posexplode("found").alias("i", "number"))
    gap = lambda k: F.element_at("gaps", F.col("i") + k)
    each = each.select("doc_id", "page", "text", "i", "number", F.length(gap(1)).alias("before"), F.right(gap(1), F.lit(LEFT)).alias("left"), F.left(gap(2), F.lit(LEFT)).alias("right"))
    upto = Window.partitionBy("doc_id", "page").orderBy("i")
    return each.withColumn("at", (F.sum(F.col("before") + F.length("number")).over(upto) - F.length("number")).cast("int")).drop("before")


def draft_values(pages: DataFrame, most: int | None = MOST) -> DataFrame:
    """``pages(doc_id, page, text)`` -> one row a value, all drafts until someone confirms them; doc_id and page name a page.

    Kinds, the more telling first: a symbol with = or :, a name, a diameter
    sign, a tolerance sign, a bare number with a unit.  A label, number and unit
    are reported once a page; ``most`` keeps the first of the more telling.
    """
    left, right, number = F.col("left"), F.col("right"), F.col("number")
    word = "(?<![\\p{L}\\p{N}_])"
    ends = lambda p: F.regexp_extract(left, p + "$", 0)
    forms = {
        "labelled": ends(word + _any(SYMBOLS) + "\\s*[=:]\\s*"),
        "named": ends("(?iu)" + _any(NAMES) + "\\s*[=:]?\\s*"),
        "diameter": F.when(~number.startswith("-"), ends(f"[{DIAMETER}]\\s*")).otherwise(""),
        "tolerance": F.when(~number.startswith("-"), ends(f"{TOLERANCE}\\s*")).otherwise(""),
    }
    # a sign before a bare number is a dash, and the number isn't the end of a word or of another number
    bare = F.when(number.startswith("-") | ~F.regexp_like(left, F.lit("[\\p{L}\\p{N}_.,]$")), F.lit("plain"))
    kind = F.coalesce(*(F.when(x != "", name) for name, x in forms.items()), bare)
    n = numbers(pages).withColumn("kind", kind).withColumn("said", F.when(F.col("kind") == "plain", "").otherwise(F.coalesce(*(F.when(F.col("kind") == name, x) for name, x in forms.items()))))
    unit = F.regexp_extract("right", "^\\s*(" + _any(UNITS) + ")", 1)
    short = F.regexp_extract("right", "^\\s*(mm|µm|μm|um)", 1)
    whole = F.regexp_extract("right", "^\\s*(mm|µm|μm|um|°)(?![\\p{L}\\p{N}_])", 1)
    n = n.withColumn("unit", F.nullif(F.when(F.col("kind") == "diameter", "mm").when(F.col("kind") == "tolerance", short).when(F.col("kind") == "plain", whole).otherwise(unit), F.lit("")))
    n = n.filter((F.col("kind") != "plain") | F.col("unit").isNotNull())
    before = F.regexp_extract_all("left", F.lit("([\\p{L}][\\p{L}\\p{N}_]*)"))
    named = F.regexp_replace(F.col("said"), "\\s*[=:]?\\s*$", "")
    n = n.withColumn("label", F.when(F.col("kind") == "diameter", "Ø").when(F.col("kind") == "plain", F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("value"))).otherwise(named))
    n = n.withColumn("number", F.when(F.col("kind") == "plain", F.ltrim(F.col("number"), F.lit("-"))).otherwise(F.col("number"))).withColumn("at", F.col("at") + F.when((F.col("kind") == "plain") & number.startswith("-"), 1).otherwise(0))
    after = F.when(F.col("kind") == "diameter", F.length(F.regexp_extract("right", "^\\s*[A-Za-z]{1,2}[0-9]{1,2}", 0))).when(F.col("unit").isNotNull(), F.length(F.regexp_extract("right", "^\\s*", 0)) + F.length("unit")).otherwise(0)
    n = n.withColumn("start", F.col("at") - F.length("said")).withColumn("stop", (F.col("at") + F.length("number") + after).cast("int"))
    rank = F.array_position(F.array(*map(F.lit, [*forms, "plain"])), F.col("kind"))
    same = Window.partitionBy("doc_id", "page", F.lower("label"), "number", "unit").orderBy(rank, "start")
    n = n.withColumn("turn", F.row_number().over(same)).filter("turn = 1")
    if most is not None:
        n = n.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(rank, "start"))).filter(F.col("turn") <= most)
    cut = lambda a, b: F.substring("text", a + F.lit(1), b - a)
    around = F.greatest(F.col("start") - AROUND, F.lit(0))
    return n.select(
        "doc_id", "page", "label", F.trim(cut(F.col("start"), F.col("stop"))).alias("raw"), F.replace("number", F.lit(","), F.lit(".")).cast("double").alias("value"), "unit", "start", "stop",
        F.trim(F.regexp_replace(cut(around, F.col("stop") + AROUND), "\n", " ")).alias("context"), quantity(F.col("unit"), F.col("label")).alias("quantity"), F.lit("draft_extraction").alias("status"),
    )


def confirm(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drafts with decisions ``(doc_id, page, start, action, value)`` applied: confirmed (edited if the value differs) or rejected."""
    d = decisions.select("doc_id", "page", "start", "action", F.col("value").alias("new_value"))
    j = drafts.join(d, ["doc_id", "page", "start"], "left")
    edited = F.col("new_value").isNotNull() & (F.col("new_value") != F.col("value"))
    status = F.when(F.col("action") == "confirm", "user_confirmed").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("edited", F.coalesce((F.col("action") == "confirm") & edited, F.lit(False))).withColumn("value", F.when(F.col("action") == "confirm", F.coalesce("new_value", "value")).otherwise(F.col("value"))).drop("action", "new_value")
