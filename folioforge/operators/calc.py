"""Unit-aware engineering calculations as Column builders over a request table.

A rule is a list of (key, unit, expression); expressions are compiled to
Columns, so a batch of requests is one projection.  Long request tables
(request, key, value, unit, provenance) are validated by joins with the
specification and unit dimensions and pivoted to one row a request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.expr import compile_column, to_sql
from folioforge.plans.lineage import broadcast_if_small

# Units and their factor to the canonical unit of the kind.
UNITS = {
    "length": {"mm": 1.0, "milimetre": 1.0, "millimetre": 1.0, "millimeter": 1.0, "cm": 10.0, "m": 1000.0, "metre": 1000.0, "µm": 0.001, "μm": 0.001, "um": 0.001, "mikron": 0.001, "mikrometre": 0.001},
    "angle": {"deg": 1.0, "°": 1.0, "derece": 1.0, "degree": 1.0, "degrees": 1.0, "rad": 57.29577951308232, "radyan": 57.29577951308232},
    "dimensionless": {"": 1.0, "1": 1.0, "-": 1.0, "adet": 1.0, "none": 1.0},
}
UNITS["integer"] = UNITS["grade"] = UNITS["dimensionless"]


@dataclass(frozen=True)
class Spec:
    """One input of a rule: kind, whether it must be given, range, value where it isn't given."""

    key: str
    kind: str
    required: bool
    low: float
    high: float
    default: float | None = None


SPECS = {
    "cylindrical_gear_geometry": (
        Spec("z", "integer", True, 1, 100000), Spec("m_n", "length", True, 1e-6, 1e5), Spec("alpha_n", "angle", False, 0, 89, 20.0), Spec("beta", "angle", False, 0, 89, 0.0),
        Spec("x", "dimensionless", False, -10, 10, 0.0), Spec("k", "dimensionless", False, -10, 10, 0.0), Spec("h_aP", "dimensionless", False, 1e-6, 10, 1.0), Spec("h_fP", "dimensionless", False, 1e-6, 10, 1.25),
    ),
    "transverse_module": (Spec("m_n", "length", True, 1e-6, 1e5), Spec("beta", "angle", False, 0, 89, 0.0)),
    "gear_pair": (
        Spec("z1", "integer", True, 1, 100000), Spec("z2", "integer", True, 1, 100000), Spec("m_n", "length", True, 1e-6, 1e5), Spec("alpha_n", "angle", False, 0, 89, 20.0),
        Spec("beta", "angle", False, 0, 89, 0.0), Spec("a_w", "length", False, 1e-6, 1e7),
    ),
    "iso1328_flank_tolerance": (
        Spec("m_n", "length", True, 1e-6, 1e5), Spec("d", "length", False, 1e-6, 1e7), Spec("z", "integer", False, 1, 100000), Spec("beta", "angle", False, 0, 89),
        Spec("b", "length", False, 1e-6, 1e6), Spec("A", "grade", True, 1, 11),
    ),
}

#: Rules: outputs in order; an expression may use inputs and the outputs before it.
CYLINDRICAL = (
    ("m_t", "mm", "m_n / cos(radians(beta))"),
    ("alpha_t", "°", "degrees(atan(tan(radians(alpha_n)) / cos(radians(beta))))"),
    ("d", "mm", "z * m_t"),
    ("d_b", "mm", "d * cos(radians(alpha_t))"),
    ("p_n", "mm", "pi * m_n"),
    ("p_t", "mm", "pi * m_t"),
    ("p_bt", "mm", "p_t * cos(radians(alpha_t))"),
    ("h_a", "mm", "(h_aP + x + k) * m_n"),
    ("h_f", "mm", "(h_fP - x) * m_n"),
    ("h", "mm", "(h_aP + k + h_fP) * m_n"),
    ("d_a", "mm", "d + 2 * (x + h_aP + k) * m_n"),
    ("d_f", "mm", "d - 2 * (h_fP - x) * m_n"),
)
TRANSVERSE = (("m_t", "mm", "m_n / cos(radians(beta))"),)
PAIR = (
    ("za", "", "min(z1, z2)"),
    ("zb", "", "max(z1, z2)"),
    ("u", "", "zb / za"),
    ("m_t", "mm", "m_n / cos(radians(beta))"),
    ("d1", "mm", "za * m_t"),
    ("d2", "mm", "zb * m_t"),
    ("alpha_t", "°", "degrees(atan(tan(radians(alpha_n)) / cos(radians(beta))))"),
    ("alpha_wt", "°", "degrees(acos(m_n * (za + zb) / (2 * a_w * cos(radians(beta))) * cos(radians(alpha_t))))"),
)
FLANK = (
    ("f", "", "sqrt(2) ^ (A - 5)"),
    ("f_pT_raw", "µm", "(0.001 * d + 0.4 * m_n + 5) * f"),
    ("F_pT_raw_total", "µm", "(0.002 * d + 0.55 * sqrt(d) + 0.7 * m_n + 12) * f"),
    ("f_HaT_raw", "µm", "(0.4 * m_n + 0.001 * d + 4) * f"),
    ("f_faT_raw", "µm", "(0.55 * m_n + 5) * f"),
    ("F_aT_raw", "µm", "sqrt(f_HaT_raw ^ 2 + f_faT_raw ^ 2)"),
    ("f_HbT_raw", "µm", "(0.05 * sqrt(d) + 0.35 * sqrt(b) + 4) * f"),
    ("f_fbT_raw", "µm", "(0.07 * sqrt(d) + 0.45 * sqrt(b) + 4) * f"),
    ("F_bT_raw", "µm", "sqrt(f_HbT_raw ^ 2 + f_fbT_raw ^ 2)"),
)
FLANK_RANGES = {"m_n": (0.5, 70.0), "d": (5.0, 15000.0), "z": (5.0, 1000.0), "b": (4.0, 1200.0), "beta": (0.0, 45.0)}


def apply_rule(requests: DataFrame, rule: tuple) -> DataFrame:
    """Adds the rule's outputs as columns."""
    for key, _, text in rule:
        requests = requests.withColumn(key, compile_column(text))
    return requests


def rule_sql(source: str, rule: tuple) -> str:
    """The same as nested SQL selects."""
    for key, _, text in rule:
        source = f"(select *, {to_sql(text)} as {key} from {source})"
    return source


def cylindrical(requests: DataFrame) -> DataFrame:
    """Geometry of cylindrical gears; ``status`` is invalid_input where the root diameter isn't positive."""
    for s in SPECS["cylindrical_gear_geometry"]:
        if s.default is not None and s.key not in requests.columns:
            requests = requests.withColumn(s.key, F.lit(s.default))
        elif s.default is not None:
            requests = requests.withColumn(f"{s.key}_defaulted", F.col(s.key).isNull()).withColumn(s.key, F.coalesce(s.key, F.lit(s.default)))
    return apply_rule(requests, CYLINDRICAL).withColumn("status", F.when(F.col("d_f") > 0, "ok").otherwise("invalid_input"))


def gear_pair(requests: DataFrame) -> DataFrame:
    """Ratio, diameters and working pressure angle; null where the arc cosine has no value."""
    return apply_rule(requests, PAIR)


def tolerance_round(v: Column) -> Column:
    """Above 10 whole numbers, from 5 half steps, below tenths; half up on the steps counted in doubles, as the SQL has it."""
    steps = lambda n: F.floor(v * n + 0.5).cast("double") / n
    return F.when(v > 10, steps(1)).when(v >= 5, steps(2)).otherwise(steps(10))


def flank_tolerance(requests: DataFrame) -> DataFrame:
    """Flank tolerances of a class; ``status`` refused outside the scope (no extrapolation), missing face width leaves helix values null."""
    if "d" not in requests.columns:
        requests = requests.withColumn("d", compile_column("z * m_n / cos(radians(beta))"))
    out = apply_rule(requests, FLANK)
    for key, _, _ in FLANK[1:]:
        out = out.withColumn(key.removesuffix("_total").removesuffix("_raw") if key != "F_pT_raw_total" else "F_pT_sum", tolerance_round(F.col(key)))
    inside = F.lit(True)
    for key, (low, high) in FLANK_RANGES.items():
        if key in requests.columns:
            inside = inside & (F.col(key).isNull() | F.col(key).between(low, high))
    inside = inside & (F.col("A") == F.floor("A")) & F.col("A").between(1, 11)
    return out.withColumn("status", F.when(inside, "ok").otherwise("refused"))


def grade_lookup(requests: DataFrame, table: DataFrame, size: str = "size") -> DataFrame:
    """Requests with the row ``above < size <= up_to`` of a tolerance table.

    Rows are dealt to the whole sizes they cover, so that the join is by equality.
    """
    dealt = table.withColumn("_covers", F.explode(F.sequence(F.floor("above").cast("long"), F.ceil("up_to").cast("long"))))
    dealt, _ = broadcast_if_small(dealt, 100_000)
    asked = requests.withColumn("_whole", F.ceil(size).cast("long"))
    return asked.join(dealt, (F.col("_whole") == F.col("_covers")) & (F.col(size) > F.col("above")) & (F.col(size) <= F.col("up_to")), "left").drop("_whole", "_covers")


def limit_sizes(size: Column, it: Column, letter: str) -> dict[str, Column]:
    """Deviations (µm) and limit sizes (mm) of the basic hole 'H' or the basic shaft 'h'."""
    low, high = (F.lit(0.0), it) if letter == "H" else (-it, F.lit(0.0))
    return {"lower_dev": low, "upper_dev": high, "lower_size": size + low / 1000.0, "upper_size": size + high / 1000.0}


# ------------------------------------------------------------------ validation


def spec_table(spark, calc_type: str | None = None) -> DataFrame:
    """The inputs of one calculation, or of all with ``calc_type`` beside them."""
    rows = [(t, s.key, s.kind, s.required, float(s.low), float(s.high)) for t, specs in SPECS.items() if calc_type in (None, t) for s in specs]
    specs = spark.createDataFrame(rows, "calc_type string, key string, kind string, required boolean, low double, high double")
    return F.broadcast(specs.drop("calc_type") if calc_type else specs)


def unit_table(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, u, f) for k, us in UNITS.items() for u, f in us.items()], "kind string, unit_token string, factor double"))


def validate(requests: DataFrame, calc_type: str | None = None) -> DataFrame:
    """``requests(req_id, key, value, unit, prov_kind, prov_status)`` with ``canonical`` and ``code`` (null: good), one row each.

    Checks in order: unknown input, blocked draft, provenance, finite value,
    unit, whole number, range; ``missing_inputs`` finds what isn't there at all.
    Without ``calc_type`` each row names its own in a column, and inputs of an
    unknown calculation are unknown.
    """
    spark = requests.sparkSession
    r = requests.withColumn("unit_token", F.replace(F.lower(F.trim(F.coalesce("unit", F.lit("")))), F.lit("derecesi"), F.lit("derece")))
    r = r.join(spec_table(spark, calc_type), "key" if calc_type else ["calc_type", "key"], "left").join(unit_table(spark), ["kind", "unit_token"], "left")
    canonical = F.col("value") * F.col("factor")
    trusted = F.when(F.col("prov_kind") == "extracted_value", F.coalesce(F.col("prov_status").isin("user_confirmed", "verified_source"), F.lit(False))).when(F.col("prov_kind") == "memory_item", F.coalesce(F.col("prov_status") == "user_confirmed", F.lit(False))).otherwise(F.lit(True))
    code = (
        F.when(F.col("kind").isNull(), "unknown_input").when(~trusted, "draft_input_blocked").when(~F.coalesce(F.col("prov_kind").isin("user_input", "extracted_value", "memory_item"), F.lit(False)), "invalid_provenance")
        .when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "invalid_value").when(F.col("factor").isNull(), "invalid_unit")
        .when(F.col("kind").isin("integer", "grade") & (canonical != F.floor(canonical)), "not_integer").when(~canonical.between(F.col("low"), F.col("high")), "out_of_range")
    )
    return r.withColumn("code", code).withColumn("canonical", F.when(F.col("code").isNull(), canonical)).drop("unit_token", "factor", "low", "high", "required")


def missing_inputs(requests: DataFrame, calc_type: str) -> DataFrame:
    """``(req_id, key, code)`` of required inputs that a request lacks."""
    need = [s.key for s in SPECS[calc_type] if s.required]
    had = requests.groupBy("req_id").agg(F.collect_set(F.when(F.col("key").isin(need), F.col("key"))).alias("had"))
    return had.select("req_id", F.explode(F.array_except(F.array(*map(F.lit, need)), F.col("had"))).alias("key"), F.lit("missing_input").alias("code"))


def wide(requests: DataFrame, calc_type: str) -> DataFrame:
    """One row a request with a column for each input of the rule."""
    keys = [s.key for s in SPECS[calc_type]]
    return requests.groupBy("req_id").agg(*[F.max(F.when(F.col("key") == k, F.col("canonical"))).alias(k) for k in keys])


# ------------------------------------------------------------------ comparison

# Absolute tolerances by unit, and the relative one.
ABSOLUTE = {"mm": 0.01, "°": 0.05, "µm": 0.5, "": 0.001}
RELATIVE = 0.005


def tolerance(value: Column, unit: Column, fixed: Column | None = None) -> Column:
    least = F.lit(0.001)
    for u, t in ABSOLUTE.items():
        least = F.when(unit == u, F.lit(t)).otherwise(least)
    own = F.greatest(least, F.lit(RELATIVE) * F.abs(value))
    return own if fixed is None else F.coalesce(fixed, own)


def compare(engine: DataFrame, drafts: DataFrame) -> DataFrame:
    """``engine(req_id, key, value, unit)`` against ``drafts(req_id, key, raw)``: status of each engine output."""
    joined = engine.join(drafts.hint("merge"), ["req_id", "key"], "left")  # long tables look as small as what they are exploded from
    draft = F.replace(F.col("raw"), F.lit(","), F.lit(".")).try_cast("double")
    tol = tolerance(F.col("value"), F.col("unit"))
    diff = F.abs(draft - F.col("value"))
    status = F.when(F.col("raw").isNull(), "missing_in_draft").when(draft.isNull() | F.isnan(draft), "non_numeric").when(diff <= tol, "match").otherwise("mismatch")
    return joined.withColumn("draft", draft).withColumn("tolerance", tol).withColumn("abs_diff", diff).withColumn("status", status)


def extra_keys(engine: DataFrame, drafts: DataFrame) -> DataFrame:
    """Draft keys that the engine didn't compute."""
    return drafts.join(engine.select("req_id", "key").hint("merge"), ["req_id", "key"], "left_anti").select("req_id", "key")


def parse_tolerance_table(tokens: DataFrame) -> DataFrame:
    """Checks rows ``([table,] row, above, up_to, values array<double>)``: within a table bounds chain, values rise along a row and never fall down a column."""
    w = Window.partitionBy(F.col("table") if "table" in tokens.columns else F.lit(0)).orderBy("row")  # a table has a few dozen rows
    chain = F.coalesce(F.abs(F.col("above") - F.lag("up_to").over(w)) <= 1e-9, F.lit(True)) & (F.col("up_to") > F.col("above"))
    rises = F.forall(F.sequence(F.lit(2), F.size("values")), lambda i: F.element_at("values", i) > F.element_at("values", i - 1))
    prior = F.lag("values").over(w)
    falls = F.coalesce(F.exists(F.zip_with("values", prior, lambda a, b: a < b), lambda x: x), F.lit(False))
    return tokens.withColumn("code", F.when(~chain, "bounds").when(~rises, "row_order").when(falls, "column_order"))
