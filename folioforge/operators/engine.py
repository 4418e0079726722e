"""One calculation run over any number of requests: provenance, validation, evidence, defaults, outputs, status.

``requests`` is long: a row for each input of a request, with its calculation.
(1) ``resolve_inputs`` replaces values that point to a stored value or a memory
item by what is confirmed there.  (2) ``evidence`` finds, for each requirement,
the page that states it: pages of the standard with all its phrases, the hinted
page before others.  Codes meet by equality on their words, so no requirement is
tried on pages of another standard.  (3) ``run`` aggregates a request to one row,
says why it can't be computed, or computes it by its rule.

The number of calculations, their inputs and requirements is fixed by the rules;
requests and pages may be of any number and are joined and grouped, never
collected.  Rows whose input points nowhere pass by the joins, so missing
references don't meet in one task.

Defined cases: a reference that is null, unknown or out of the user's sight has
the status ``missing``, which is blocked as a draft is; of stored rows with one
id the least counts; of inputs given twice the largest good value counts, and
any bad one makes the request invalid; inputs the calculation doesn't know are
counted; a requirement without phrases is met by no page; one that no row of
``evidence`` meets refuses every request that needs it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.expr import compile_column
from folioforge.operators import calc
from folioforge.operators.evidence import evidence_normal
from folioforge.plans.lineage import broadcast_if_small, cut

# What a page must state: requirement, code, page it is expected on, phrases.
REQUIREMENTS = (
    ("iso21771.eq1", "ISO 21771", 18, ("The reference diameter, d, is determined by",)),
    ("iso21771.eq2", "ISO 21771", 19, ("For a helical gear, the transverse module, mt, is found as",)),
    ("iso21771.eq13", "ISO 21771", 24, ("is the acute angle between the tangent to the involutes at their point of intersection with the reference circle",)),
    ("iso21771.eq14", "ISO 21771", 24, ("Normal pressure angle at a point, normal pressure angle", "this is equal to the pressure angle")),
    ("iso21771.eq19", "ISO 21771", 25, ("Base cylinder, base circle, base diameter", "is given by")),
    ("iso21771.eq23", "ISO 21771", 26, ("is the length of the reference circle arc between two successive equal-handed tooth flanks",)),
    ("iso21771.eq24", "ISO 21771", 26, ("is the length of the helix arc between two successive equal-handed",)),
    ("iso21771.eq28", "ISO 21771", 27, ("on the developed base cylinder tangential plane is the base pitch", "Transverse base pitch")),
    ("iso21771.eq33", "ISO 21771", 28, ("The nominal dimension of the tip diameter",)),
    ("iso21771.eq34", "ISO 21771", 28, ("The nominal dimension of the root diameter",)),
    ("iso21771.eq35", "ISO 21771", 28, ("of cylindrical gear (or rack) teeth is the difference between tip and root radius",)),
    ("iso21771.eq36_37", "ISO 21771", 29, ("are stated on the basis of the reference circle", "Equations (36) and (37)")),
    ("iso21771.eq52", "ISO 21771", 32, ("of a gear pair is the ratio of the number of teeth of the wheel",)),
    ("iso21771.eq54", "ISO 21771", 33, ("is that pressure angle whose vertex lies on the pitch circle", "is calculated from")),
    ("iso53.table2", "ISO 53", 5, ("Table 2 — Standard basic rack proportions", "aP 20° haP 1 m cP 0,25 m hfP 1,25 m rfP 0,38 m")),
    ("iso1328.scope", "ISO 1328-1", 9, ("These tolerances are applicable to", "5 ≤ z ≤ 1 000", "5 mm ≤ d ≤ 15 000 mm", "0,5 mm ≤ mn ≤ 70 mm", "4 mm ≤ b ≤ 1 200 mm", "β ≤ 45°")),
    ("iso1328.no_extrapolation", "ISO 1328-1", 34, ("shall not be extrapolated beyond these limits",)),
    ("iso1328.step", "ISO 1328-1", 34, ("The step factor between two consecutive classes is",)),
    ("iso1328.rounding", "ISO 1328-1", 34, ("if greater than 10 µm, round to the nearest integer micrometre", "round to the nearest 0,5 µm", "round to the nearest 0,1 µm")),
    ("iso1328.f5", "ISO 1328-1", 34, ("Single pitch tolerance, fpT, shall be calculated using Formula (5)",)),
    ("iso1328.f6", "ISO 1328-1", 34, ("Total cumulative pitch (index) tolerance, FpT, shall be calculated using Formula (6)",)),
    ("iso1328.f7", "ISO 1328-1", 34, ("Profile slope tolerance, fHαT, shall be calculated using Formula (7)",)),
    ("iso1328.f8", "ISO 1328-1", 35, ("Profile form tolerance, ffαT, shall be calculated using Formula (8)",)),
    ("iso1328.f9", "ISO 1328-1", 35, ("Total profile tolerance, FαT, shall be calculated as given by Formula (9)",)),
    ("iso1328.f10", "ISO 1328-1", 35, ("Helix slope tolerance, fHβT, shall be calculated using Formula (10)",)),
    ("iso1328.f11", "ISO 1328-1", 35, ("Helix form tolerance, ffβT, shall be calculated using Formula (11)",)),
    ("iso1328.f12", "ISO 1328-1", 35, ("Total helix tolerance, FβT, shall be calculated as given by Formula (12)",)),
    ("iso286.table1", "ISO 286-1", 26, ("Table 1 — Values of standard tolerance grades for nominal sizes up to 3 150 mm", "Standard tolerance values")),
    ("iso286.basic_hole", "ISO 286-1", 8, ("a basic hole is a hole for which the lower limit deviation is zero",)),
    ("iso286.basic_shaft", "ISO 286-1", 8, ("a basic shaft is a shaft for which the upper limit deviation is zero",)),
    ("iso286.hole_H", "ISO 286-1", 40, ("the fundamental deviation can be chosen in the column H", "the lower limit deviation EI = 0", "ES = EI + IT")),
    ("iso286.shaft_h", "ISO 286-1", 17, ("basic shaft “h”",)),
    ("iso286.shaft_ei", "ISO 286-1", 25, ("es = 0", "ei = es - IT")),
)
# Requirements of a calculation, always, or where an input is given (+) or left out (-).
NEEDS = {
    "cylindrical_gear_geometry": "eq1 eq2 eq13 eq14 eq19 eq23 eq24 eq28 eq33 eq34 eq35 eq36_37 iso53.table2-alpha_n iso53.table2-h_aP iso53.table2-h_fP",
    "transverse_module": "eq2",
    "gear_pair": "eq52 eq1 eq2 eq14 eq54+a_w iso53.table2-alpha_n",
    "iso1328_flank_tolerance": "iso1328.scope iso1328.no_extrapolation iso1328.step iso1328.rounding iso1328.f5 iso1328.f6 iso1328.f7 iso1328.f8 iso1328.f9 iso1328.f10+b iso1328.f11+b iso1328.f12+b eq1-d eq2-d",
}

NEED = "calc_type string, requirement_id string, key string, given boolean"
KEYS = tuple(dict.fromkeys(s.key for specs in calc.SPECS.values() for s in specs))
_RULES = {"cylindrical_gear_geometry": calc.CYLINDRICAL, "transverse_module": calc.TRANSVERSE, "gear_pair": calc.PAIR}
_FLANK_OUT = ("f_pT", "F_pT_sum", "f_HaT", "f_faT", "F_aT", "f_HbT", "f_fbT", "F_bT")
_SHOWN = {"F_pT_sum": "F_pT"}  # column names don't tell F_pT from f_pT


def requirement_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, code, page, list(phrases)) for i, code, page, phrases in REQUIREMENTS], "requirement_id string, code string, page_hint int, phrases array<string>")


def need_table(spark) -> DataFrame:
    """``NEEDS`` as rows; of rows with one requirement any that holds makes it needed."""
    rows = []
    for calc_type, words in NEEDS.items():
        for w in words.split():
            name, sign, key = next(((n, s, k) for s in "+-" for n, found, k in [w.partition(s)] if found), (w, "", ""))
            rows.append((calc_type, name if "." in name else f"iso21771.{name}", key or None, {"+": True, "-": False}.get(sign)))
    return spark.createDataFrame(rows, NEED)


# ------------------------------------------------------------------ provenance


def _one(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each id that isn't null, the least of those it has."""
    kept = df.filter("ref_id is not null").groupBy("ref_id").agg(F.min(F.struct(*columns)).alias("s"))
    return kept.select("ref_id", F.lit(True).alias("there"), *[F.col(f"s.{c}").alias(f"s_{c}") for c in columns])


def resolve_inputs(requests: DataFrame, extracted: DataFrame, memory: DataFrame, scopes: DataFrame) -> DataFrame:
    """``requests(user_id, value, unit, prov_kind, ref_id, ...)`` with value and unit of what they point to, and ``prov_status``.

    ``extracted(ref_id, area, status, value, unit, confirmed_value, confirmed_unit)``;
    ``memory(ref_id, owner_id, shared, status, value, unit)``; ``scopes(user_id, is_owner, areas)``,
    one row a user.  A confirmed extracted value counts as confirmed, any other
    as the request states it; a memory item's own value comes first.  Every other
    kind is the user's input.
    """
    own = requests.columns
    pointing = F.coalesce(F.col("prov_kind").isin("extracted_value", "memory_item"), F.lit(False)) & F.col("ref_id").isNotNull()
    astray = F.coalesce(F.col("prov_kind").isin("extracted_value", "memory_item"), F.lit(False)) & F.col("ref_id").isNull()
    plain = requests.filter(~pointing).withColumn("prov_status", F.when(astray, "missing").otherwise("user_input")).withColumn("prov_kind", F.when(astray, F.col("prov_kind")).otherwise("user_input"))
    sight = scopes.groupBy("user_id").agg(F.max("is_owner").alias("is_owner"), F.array_distinct(F.flatten(F.collect_list("areas"))).alias("areas"))
    owner = F.coalesce("is_owner", F.lit(False))

    def met(kind: str, stored: DataFrame, columns: list[str], seen: Column, value: Column, unit: Column) -> DataFrame:
        rows = requests.filter(pointing & (F.col("prov_kind") == kind)).join(_one(stored, columns), "ref_id", "left").join(sight, "user_id", "left")
        visible = F.coalesce(F.col("there") & (owner | seen), F.lit(False))
        new = {"value": F.when(visible, value).otherwise(F.col("value")), "unit": F.when(visible, unit).otherwise(F.col("unit")), "prov_status": F.when(visible, F.col("s_status")).otherwise("missing")}
        return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in own], new["prov_status"].alias("prov_status"))

    confirmed = F.coalesce(F.col("s_status") == "user_confirmed", F.lit(False))
    values = met(
        "extracted_value", extracted, ["area", "status", "value", "unit", "confirmed_value", "confirmed_unit"], F.array_contains("areas", F.col("s_area")),
        F.when(confirmed, F.coalesce("s_confirmed_value", "s_value")).otherwise(F.col("value")), F.when(confirmed, F.coalesce("s_confirmed_unit", "s_unit", F.lit(""))).otherwise(F.col("unit")),
    )
    notes = met("memory_item", memory, ["owner_id", "shared", "status", "value", "unit"], F.coalesce(F.col("s_owner_id") == F.col("user_id"), F.lit(False)) | F.coalesce("s_shared", F.lit(False)), F.coalesce("s_value", "value"), F.coalesce("s_unit", "unit"))
    return plain.unionByName(values).unionByName(notes)


# ------------------------------------------------------------------ evidence


def code_keys(code: Column) -> Column:
    """The codes by which a longer one can be found: 'ISO 53:1998' by 'iso 53'; up to three words, each as it stands, the last one up to its colon."""
    words = F.filter(F.split(F.lower(F.coalesce(code, F.lit(""))), "\\s+"), lambda w: w != "")
    last = F.transform(words, lambda w: F.regexp_extract(w, "^[^:]*", 0))

    def with_before(n: int) -> Column:
        return F.transform(words, lambda w, i: F.when(i >= n, F.array_join(F.concat(F.slice(words, F.greatest(i - n + 1, F.lit(1)), F.lit(n)), F.array(F.regexp_extract(w, "^[^:]*", 0))), " ")))

    return F.filter(F.array_distinct(F.concat(last, with_before(1), with_before(2))), lambda k: k.isNotNull() & (k != ""))


def evidence(requirements: DataFrame, pages: DataFrame) -> DataFrame:
    """``(requirement_id, doc_id, page, excerpt)``: where each requirement is stated, one row for each that is.

    ``requirements(requirement_id, code, page_hint, phrases)``; ``pages(doc_id, page, code, text)`` are
    those that may be cited.  The hinted page comes before others, then the least page and document.
    """
    asked = requirements.filter(F.size("phrases") > 0).select("requirement_id", F.lower("code").alias("_key"), "page_hint", F.transform("phrases", evidence_normal).alias("_phrases"))
    asked, _ = broadcast_if_small(cut(asked, "requirements"), 10_000)  # written, so that phrases are brought to their normal form once
    keyed = pages.filter("text is not null").select("doc_id", "page", F.explode(code_keys(F.col("code"))).alias("_key"), "text")
    named = keyed.join(asked.select("_key").distinct(), "_key", "left_semi").withColumn("_norm", evidence_normal(F.col("text")))
    # an array of phrases and a text of the other side never meet in one lambda: such a filter is pushed to one side
    near = named.join(asked.withColumn("_phrase", F.element_at("_phrases", 1)), "_key").filter(F.contains("_norm", F.col("_phrase")))
    held = F.struct("_norm", "_phrases").alias("_held")
    stated = near.select("*", held).withColumn("_told", F.transform(F.array("_held"), lambda h: F.forall(h["_phrases"], lambda p: F.contains(h["_norm"], p)))).filter(F.element_at("_told", 1))
    at = F.instr(F.col("_norm"), F.col("_phrase"))
    start = F.greatest(F.lit(0), at - 81)
    excerpt = F.substring(F.trim(F.regexp_replace("text", "\\s+", " ")), start + 1, at - 1 + F.length("_phrase") + 160 - start)
    order = F.struct((~F.col("page_hint").eqNullSafe(F.col("page"))).alias("other"), F.col("page"), F.col("doc_id"), excerpt.alias("excerpt"))
    best = stated.groupBy("requirement_id").agg(F.min(order).alias("b"))
    return best.select("requirement_id", "b.doc_id", "b.page", "b.excerpt")


# ------------------------------------------------------------------ the run


def _sources(needs: DataFrame, found: DataFrame) -> DataFrame:
    """One row a calculation: its requirements as an array of (requirement, input, given, page that states it)."""
    met = needs.join(found.select("requirement_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page")), "requirement_id", "left")
    need = F.struct("requirement_id", "key", "given", F.col("doc_id").isNotNull().alias("met"), "doc_id", "page")
    return met.groupBy("calc_type").agg(F.array_sort(F.collect_list(need)).alias("_needs"))


def _computed(rows: DataFrame, calc_type: str) -> DataFrame:
    """Adds defaults, outputs, and what the rule says of them to the rows of one calculation."""
    specs = {s.key: s for s in calc.SPECS[calc_type]}
    defaulted = [k for k, s in specs.items() if s.default is not None]
    constants = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in defaulted] or [F.lit(None).cast("string")]), lambda k: k.isNotNull())
    rows = rows.withColumn("constants", constants)
    for k in defaulted:
        rows = rows.withColumn(k, F.coalesce(k, F.lit(specs[k].default)))
    unit = {key: u for key, u, _ in _RULES.get(calc_type, ())}
    wanted = list(unit) or list(_FLANK_OUT)
    absent = F.lit(False)
    if calc_type == "iso1328_flank_tolerance":
        given = F.col("d")
        rows = rows.withColumn("d", F.coalesce(given, compile_column("z * m_n / cos(radians(beta))", {"z": F.col("z"), "m_n": F.col("m_n"), "beta": F.coalesce("beta", F.lit(0.0))})))
        rows = calc.flank_tolerance(rows.withColumn("_needs_size", F.col("d").isNull()).drop("status")).withColumn("rule", F.when(F.col("_needs_size"), "invalid_input").when(F.col("status") == "refused", "rule_refusal"))
        may_lack = F.col("b").isNull()
        optional = ("f_HbT", "f_fbT", "F_bT")
    else:
        rows = calc.apply_rule(rows, _RULES[calc_type])
        low = F.col("d_f") <= 0 if calc_type == "cylindrical_gear_geometry" else F.lit(False)
        rows = rows.withColumn("rule", F.when(low, "invalid_input"))
        may_lack = F.col("a_w").isNull()
        optional = ("alpha_wt",)
    for k in wanted:
        lost = F.col(k).isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
        absent = absent | (lost & ~may_lack if k in optional else lost)
    rows = rows.withColumn("rule", F.coalesce("rule", F.when(absent, "math_error")))
    outputs = F.array(*[F.when(~(may_lack if k in optional else F.lit(False)), F.struct(F.lit(_SHOWN.get(k, k)).alias("key"), F.col(k).alias("value"), F.lit(unit.get(k, "µm")).alias("unit"))) for k in wanted])
    return rows.withColumn("outputs", F.filter(outputs, lambda o: o.isNotNull()))


RESULT = ("req_id", "calc_type", "status", "code", "problems", "n_unknown", "missing", "missing_sources", "evidence", "constants", "outputs")


def run(requests: DataFrame, needs: DataFrame, found: DataFrame) -> DataFrame:
    """One row a request of ``requests(req_id, calc_type, key, value, unit, prov_kind, prov_status)``, as ``resolve_inputs`` leaves them.

    ``needs(calc_type, requirement_id, key, given)`` and ``found`` as ``evidence`` gives it.  Status and
    code, the first that holds: refused (unsupported_formula), invalid_input, refused
    (missing_source), then the rule's own: refused (rule_refusal), invalid_input,
    error (math_error); else ok.  Outputs are there only where the status is ok.
    """
    known = F.col("calc_type").isin(*calc.SPECS)
    checked = calc.validate(requests)
    unknown = F.col("code").eqNullSafe("unknown_input")
    wide = checked.groupBy("req_id", "calc_type").agg(
        F.array_sort(F.collect_set(F.when(F.col("code").isNotNull() & ~unknown, F.concat_ws(":", "key", "code")))).alias("problems"), F.sum(unknown.cast("long")).alias("n_unknown"),
        F.collect_set(F.when(~unknown, F.col("key"))).alias("_given"), *[F.max(F.when(F.col("key") == k, F.col("canonical"))).alias(k) for k in KEYS],
    )
    required = F.lit(None).cast("array<string>")
    for t, specs in calc.SPECS.items():
        required = F.when(F.col("calc_type") == t, F.array(*[F.lit(s.key) for s in specs if s.required])).otherwise(required)
    wide = wide.withColumn("missing", F.array_sort(F.array_except(F.coalesce(required, F.array().cast("array<string>")), "_given")))
    wide = wide.join(F.broadcast(_sources(needs.filter(F.col("calc_type").isin(*calc.SPECS)), found)), "calc_type", "left")  # a row a calculation
    due = F.filter(F.coalesce("_needs", F.array().cast("array<struct<requirement_id:string,key:string,given:boolean,met:boolean,doc_id:bigint,page:int>>")), lambda n: n["key"].isNull() | (F.array_contains("_given", n["key"]) == n["given"]))
    wide = wide.withColumn("_due", due)
    wide = wide.withColumn("missing_sources", F.array_distinct(F.transform(F.filter("_due", lambda n: ~n["met"]), lambda n: n["requirement_id"])))
    wide = wide.withColumn("evidence", F.array_distinct(F.transform(F.filter("_due", lambda n: n["met"]), lambda n: F.struct(n["requirement_id"].alias("requirement_id"), n["doc_id"].alias("doc_id"), n["page"].alias("page")))))
    wide = cut(wide.drop("_needs", "_due", "_given"), "requests")
    first = F.when(~F.coalesce(known, F.lit(False)), "unsupported_formula").when((F.size("problems") > 0) | (F.col("n_unknown") > 0) | (F.size("missing") > 0), "invalid_input").when(F.size("missing_sources") > 0, "missing_source")
    empty = "array<struct<key:string,value:double,unit:string>>"
    other = wide.filter(~F.coalesce(known, F.lit(False))).select("*", F.array().cast("array<string>").alias("constants"), F.lit(None).cast("string").alias("rule"), F.array().cast(empty).alias("outputs"))
    shown = [c for c in RESULT if c not in ("status", "code")]
    rows = reduce(DataFrame.unionByName, [_computed(wide.filter(F.col("calc_type") == t), t).select(*shown, "rule") for t in calc.SPECS] + [other.select(*shown, "rule")])
    rows = rows.withColumn("first", first).withColumn("code", F.coalesce("first", "rule"))
    status = F.when(F.col("code").isNull(), "ok").when(F.col("code") == "invalid_input", "invalid_input").when(F.col("code") == "math_error", "error").otherwise("refused")
    good = F.col("code").isNull()
    rows = rows.withColumn("status", status).withColumn("outputs", F.when(good, F.col("outputs")).otherwise(F.array().cast(empty)))
    return rows.withColumn("constants", F.when(F.col("first").isNull(), F.col("constants")).otherwise(F.array().cast("array<string>"))).select(*RESULT)
