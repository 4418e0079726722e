"""Reading requests and codes out of text with built-in expressions: calculation inputs, standard codes, titles, inline equations.

Inputs: a message is split at its numbers.  What stands before a number (a
symbol with a sign, or a name) or behind it (a noun) says which input it is,
by the tables of this module, and the unit stands behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import let

_NOT_IN_WORD, _WORD_ENDS = "(?<![\\p{L}\\p{N}_])", "(?!\\p{L})"
_NUMBER = "(?<![\\p{L}\\p{N}_.,])-?[0-9]+(?:[.,][0-9]+)?"
# Kinds of the inputs, how they are written, units.
KINDS = {
    "z1": "integer", "z2": "integer", "z": "integer", "m_n": "length", "alpha_n": "angle", "beta": "angle", "x": "dimensionless", "k": "dimensionless", "h_aP": "dimensionless", "h_fP": "dimensionless",
    "b": "length", "d": "length", "a_w": "length", "A": "grade", "grade": "grade", "nominal_size": "length",
}
SYMBOLS = {
    "z1": ["z1", "z₁"], "z2": ["z2", "z₂"], "z": ["z"], "m_n": ["m", "mn"], "alpha_n": ["α", "αn", "alfa", "alfan", "alpha", "alphan"], "beta": ["β", "beta"], "x": ["x"], "k": ["k"], "h_aP": ["haP", "haP*"], "h_fP": ["hfP", "hfP*"],
    "b": ["b"], "d": ["d"], "a_w": ["aw"],
}
NAMES = {
    "z": ["diş sayısı", "number of teeth"], "m_n": ["modül", "modülü", "modul", "module"], "alpha_n": ["basınç açısı", "kavrama açısı", "pressure angle"], "beta": ["helis açısı", "helix angle"],
    "x": ["profil kaydırma", "profil kaydırma katsayısı"], "b": ["diş genişliği", "face width", "facewidth"], "d": ["referans çap", "referans çapı", "reference diameter"],
    "a_w": ["eksen mesafesi", "centre distance", "center distance"], "A": ["tolerans sınıfı", "kalite sınıfı", "flank tolerance class", "sınıf", "sınıfı", "class"], "nominal_size": ["anma ölçüsü", "nominal size", "nominal ölçü", "ø"],
}
NOUNS = {"z": ["diş", "dişli", "teeth"], "nominal_size": ["mm anma", "mm nominal", "mm çap", "mm mil", "mm delik", "mm için"]}
#: The wheel named before "20 diş".
WHEELS = {"z1": "pinyon", "z2": "çark"}
UNITS = ("mm", "cm", "µm", "μm", "um", "mikron", "metre", "kg", "inch", "in", "°", "derece", "deg", "rad", "radyan")
_DEFAULT = {"length": "mm", "angle": "°"}
#: Calculations, the more special first: the inputs all of which they need, and those of which they need one.
CALCULATIONS = (
    ("iso286_it_tolerance", ("grade", "nominal_size"), ()),
    ("iso1328_flank_tolerance", ("m_n",), ("d", "z")),
    ("gear_pair", ("z1", "z2", "m_n"), ()),
    ("cylindrical_gear_geometry", ("z", "m_n"), ()),
    ("transverse_module", ("m_n", "beta"), ()),
)
#: Inputs that a calculation knows; others in the message aren't passed on.
KNOWN = {
    "iso286_hole_H": ("nominal_size", "grade"), "iso286_shaft_h": ("nominal_size", "grade"), "iso286_it_tolerance": ("nominal_size", "grade"), "iso1328_flank_tolerance": ("m_n", "d", "z", "beta", "b", "A"),
    "gear_pair": ("z1", "z2", "m_n", "alpha_n", "beta", "a_w"), "cylindrical_gear_geometry": ("z", "m_n", "alpha_n", "beta", "x", "k", "h_aP", "h_fP"), "transverse_module": ("m_n", "beta"),
}


def _choice(words: list[str]) -> str:
    """Words of a table as one alternative, longest first; blanks and underscores may stand between parts."""
    spaced = lambda w: "\\s+".join(w.split()) if " " in w else w.replace("*", "\\s*\\*")
    return "(?:" + "|".join(map(spaced, sorted(words, key=lambda w: (-len(w), w)))) + ")"


def _symbol(word: str) -> str:
    return "\\s*_?\\s*".join(c.replace("*", "\\*") for c in word)


def _readings() -> list[tuple[str, int, str, str]]:
    """(input, rank, pattern before the number, pattern behind it), in the order in which a number is tried."""
    out = [(key, 2, word + "\\D{0,25}$", "^\\s*diş" + _WORD_ENDS) for key, word in WHEELS.items()]
    for key, words in SYMBOLS.items():
        out.append((key, 1, _NOT_IN_WORD + "(?:" + "|".join(_symbol(w) for w in sorted(words, key=len, reverse=True)) + ")\\s*[=:]\\s*$", ""))
    for key, words in NAMES.items():
        out.append((key, 2, _NOT_IN_WORD + _choice(words) + "\\s*(?:[=:]|olan|ise|of)?\\s*$", ""))
    for key, words in NOUNS.items():
        out.append((key, 3, "", "^\\s*" + _choice(words) + (_WORD_ENDS if key == "z" else "")))
    return [*out, ("nominal_size", 3, "", "^\\s*mm\\s*[Hh][0-9]{1,2}(?![0-9])")]


def _keyed(rows: Column, *keys: str) -> Column:
    return F.filter(rows, lambda r: r["key"].isin(*keys))


def inputs(text: Column) -> Column:
    """Array of (key, value, unit, assumed): of the numbers that can be an input, the first of the best rank; a pair's z1 or z2 takes the place of z."""
    return let(F.struct(F.regexp_extract_all(text, F.lit(f"({_NUMBER})")).alias("found"), F.split(text, _NUMBER).alias("gaps")), lambda t: let(_read(t["found"], t["gaps"]), lambda n: _chosen(n, _grade(text))))


def _read(found: Column, gaps: Column) -> Column:
    """Each number of a message as (key, rank, place, value, unit); the key is null where it is no input."""

    def one(number: Column, i: Column) -> Column:
        before, behind = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
        tests = []
        for name, rank, left, right in _readings():
            fits = F.lit(True)
            for side, pattern in ((before, left), (behind, right)):
                if pattern:
                    fits = fits & F.regexp_like(side, F.lit("(?iu)" + pattern))
            if KINDS[name] in ("integer", "grade"):
                fits = fits & F.regexp_like(number, F.lit("^[0-9]+$"))
            tests.append(F.when(fits, F.struct(F.lit(name).alias("key"), F.lit(rank).alias("rank"))))
        unit = F.nullif(F.regexp_extract(behind, "(?iu)^\\s*" + _choice(list(UNITS)).replace("(?:", "(", 1) + _WORD_ENDS, 1), F.lit(""))
        value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
        return let(F.coalesce(*tests), lambda hit: F.struct(hit["key"].alias("key"), hit["rank"].alias("rank"), i.alias("i"), value.alias("value"), unit.alias("unit")))

    return F.transform(found, one)


def _chosen(numbers: Column, grade: Column) -> Column:
    """The best number of each input as (key, value, unit, assumed)."""
    rows = []
    for key, kind in KINDS.items():
        default = F.lit(_DEFAULT.get(kind, ""))
        best = F.array_min(F.transform(_keyed(numbers, key), lambda x: F.struct(x["rank"], x["i"], x["value"], x["unit"])))
        if key == "grade":
            best = F.when(grade.isNotNull(), F.struct(grade.alias("value"), F.lit("").alias("unit")))
        rows.append(let(best, _row(key, default, kind in _DEFAULT)))
    given = F.array_compact(F.array(*rows))
    return let(given, lambda g: F.filter(g, lambda r: ~((r["key"] == "z") & (F.size(_keyed(g, "z1", "z2")) > 0))))


def _row(key: str, default: Column, has_unit: bool) -> Callable[[Column], Column]:
    unit = lambda b: F.coalesce(b["unit"], default) if has_unit else default
    return lambda b: F.when(b.isNotNull(), F.struct(F.lit(key).alias("key"), b["value"].alias("value"), unit(b).alias("unit"), (b["unit"].isNull() & F.lit(has_unit)).alias("assumed")))


_IT, _CLASS = "(?i)(?<![\\p{L}\\p{N}_])IT\\s*(01|0|1[0-8]|[1-9])(?![0-9])", "(?<![A-Za-z])([Hh])\\s?([0-9]{1,2})(?![0-9])"


def _grade(text: Column) -> Column:
    """The grade of IT7, or of a hole H7 or shaft h7; IT01 is -1."""
    it = F.nullif(F.regexp_extract(text, _IT, 1), F.lit(""))
    return F.when(it == "01", F.lit(-1.0)).otherwise(F.coalesce(it, F.nullif(F.regexp_extract(text, _CLASS, 2), F.lit(""))).try_cast("double"))


def calculation_type(text: Column, given: Column) -> Column:
    """Which calculation the inputs ask for; null if none."""
    return let(given, lambda g: _type(text, g))


def _type(text: Column, given: Column) -> Column:
    has = lambda key: F.size(_keyed(given, key)) > 0
    like = lambda p: F.regexp_like(text, F.lit(p))
    said = {"iso286_it_tolerance": like(_IT), "iso1328_flank_tolerance": has("A") | like("(?i)iso\\s*1328|tolerans"), "transverse_module": like("(?i)alın\\s*modül|transverse\\s*module|m_?t")}
    letter = F.regexp_extract(text, _CLASS, 1)
    fit = like("[A-Z][0-9]{1,2}\\s*/\\s*[a-z][0-9]{1,2}")  # a fit of a hole and a shaft is neither
    kind = F.when((letter != "") & has("nominal_size") & ~like(_IT) & ~fit, F.when(letter == "H", "iso286_hole_H").otherwise("iso286_shaft_h"))
    for name, every, some in CALCULATIONS:
        holds = said.get(name, F.lit(True))
        for key in every:
            holds = holds & has(key)
        if some:
            holds = holds & (F.size(_keyed(given, *some)) > 0)
        kind = F.coalesce(kind, F.when(holds, name))
    return kind


def requests(messages: DataFrame) -> DataFrame:
    """``messages(req_id, text)`` -> the long request table of calculations with the inputs they know, all as user input."""
    m = messages.withColumn("given", inputs(F.col("text"))).withColumn("calc_type", calculation_type(F.col("text"), F.col("given")))
    known = F.create_map(*(c for k, v in KNOWN.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = m.filter("calc_type is not null").withColumn("given", F.filter("given", lambda r: F.array_contains(known[F.col("calc_type")], r["key"])))
    return rows.select("req_id", "calc_type", F.explode("given").alias("g")).select("req_id", "calc_type", "g.*", F.lit("user_input").alias("prov_kind"), F.lit(None).cast("string").alias("prov_status"))


# ------------------------------------------------------------------ codes

_CODE = "\\b(?:BS\\s+(?:EN\\s+)?)?(ISO(?:[/_]T[RS])?\\s?[0-9]{2,5}(?:-[0-9]{1,2})?(?::[0-9]{4})?)"


def tidy_code(code: Column) -> Column:
    """One spelling: 'ISO 53:1998', 'ISO/TR 10064-1'."""
    return F.regexp_replace(F.replace(code, F.lit("_T"), F.lit("/T")), "^ISO(/T[RS])?\\s?", "ISO$1 ")


def file_code(name: Column) -> Column:
    """The code a file name of the form 'ISO 53, 2, 1998' states; null if none."""
    p = "\\bISO(?:_(TR|TS))?\\s([0-9]{2,5}),\\s[0-9]+,\\s([0-9]{4})\\b"
    kind = F.regexp_extract(name, p, 1)
    return F.when(F.regexp_like(name, F.lit(p)), F.concat(F.lit("ISO"), F.when(kind != "", F.concat(F.lit("/"), kind)).otherwise(""), F.lit(" "), F.regexp_extract(name, p, 2), F.lit(":"), F.regexp_extract(name, p, 3)))


def detect_codes(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, text, name)`` -> ``(doc_id, code)``: the code mentioned most (a year counts double), one with a year before one without, then the longest; else the file name's."""
    said = pages.select("doc_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(_CODE)), tidy_code)).alias("code"))
    bare = F.regexp_extract("code", "^ISO(?:/T[RS])? ([0-9]+)$", 1)
    kept = said.filter((bare == "") | ~bare.try_cast("int").between(1950, 2035))
    counted = kept.groupBy("doc_id", "code").agg(F.sum(F.when(F.contains("code", F.lit(":")), 2).otherwise(1)).alias("n"))
    best = counted.groupBy("doc_id").agg(F.max(F.struct("n", F.contains("code", F.lit(":")).alias("year"), F.length("code").alias("size"), "code")).alias("b")).select("doc_id", F.col("b.code").alias("said"))
    names_ = pages.groupBy("doc_id").agg(F.first(file_code(F.col("name")), ignorenulls=True).alias("named"))
    return names_.join(best, "doc_id", "left").select("doc_id", F.coalesce("said", "named").alias("code"))


def code_issues(code: Column, name: Column) -> Column:
    """What is wrong with a detected code: form, number or part against the file name, edition, year."""
    form = "^(ISO(?:/T[RS])?) ([0-9]{2,5})(?:-[0-9]{1,2})?:([0-9]{4})$"
    part, other = (lambda g: F.regexp_extract(code, form, g)), (lambda g: F.regexp_extract(file_code(name), form, g))
    good, both = F.regexp_like(code, F.lit(form)), file_code(name).isNotNull()
    number = good & both & ((part(1) != other(1)) | (part(2) != other(2)))
    return F.array_compact(F.array(F.when(code.isNotNull() & ~good, "not_canonical"), F.when(number, "number_differs"), F.when(good & both & ~number & (part(3) != other(3)), "edition_differs"), F.when(good & ~part(3).try_cast("int").between(1947, 2035), "bad_year")))


def title(name: Column, code: Column) -> Column:
    """A readable title of a file name, with the code before it where it lacks it."""
    base = F.regexp_replace(F.split_part(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit(" -- "), F.lit(1)), "_\\s", ": ")
    base = F.regexp_replace(base, "^[\\s—_,-]+|[\\s—_,-]+$", "")
    return F.when(code.isNotNull() & ~F.contains(base, code), F.concat(code, F.lit(" — "), base)).otherwise(base)


def inline_equations(text: Column, symbols: Column, most: int = 6) -> Column:
    """'p = π m' within running text, where the left side is one of the document's symbols and the right one isn't a number."""
    found = F.regexp_extract_all(text, F.lit("(?<![\\p{L}\\p{N}|=])([A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ω]{0,5}\\s?=\\s?[^=;\\n]{1,40}?)(?=[.;,]\\s|[.;,]?$|\\n)"))
    left, right = (lambda e: F.trim(F.split_part(e, F.lit("="), F.lit(1)))), (lambda e: F.trim(F.split_part(e, F.lit("="), F.lit(2))))
    kept = F.filter(found, lambda e: F.array_contains(symbols, left(e)) & ~F.regexp_like(right(e), F.lit("^[0-9\\s,.]*$")))
    return F.slice(F.transform(kept, lambda e: F.concat(left(e), F.lit(" = "), right(e))), 1, most)
