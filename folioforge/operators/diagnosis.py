"""Why a drafted value is wrong: every known error model is an expression, and the first one that gives the draft explains it.

Hypotheses are a table (output, class, condition, expression), compiled to
Columns; a mismatching field is one row, its tests one array, so no join or
cross product is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.expr import compile_column
from folioforge.operators.calc import CYLINDRICAL, cylindrical, tolerance

# Error models of cylindrical gear outputs, in the order they are tried.
# Conditions: '' always, 'helical' beta <> 0, 'shifted' x <> 0, 'tip' k <> 0.
HYPOTHESES = {
    "d_b": (
        ("DEGREE_RADIAN_ERROR", "", "d * cos(alpha_t)"),
        ("DEGREE_RADIAN_ERROR", "", "d * cos(radians(radians(alpha_t)))"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "d * cos(radians(alpha_n))"),
        ("HELIX_ANGLE_OMITTED", "helical", "z * m_n * cos(radians(alpha_n))"),
        ("MODULE_CONVERSION_ERROR", "helical", "z * m_n * cos(radians(alpha_t))"),
        ("WRONG_BASE_CIRCLE_FORMULA", "", "d * sin(radians(alpha_t))"),
        ("WRONG_BASE_CIRCLE_FORMULA", "", "d / cos(radians(alpha_t))"),
        ("WRONG_BASE_CIRCLE_FORMULA", "", "d * cos(radians(alpha_t)) ^ 2"),
        ("WRONG_BASE_CIRCLE_FORMULA", "", "d * tan(radians(alpha_t))"),
        ("WRONG_BASE_CIRCLE_FORMULA", "", "d / 2 * cos(radians(alpha_t))"),
        ("FORMULA_SELECTION_ERROR", "", "d_a * cos(radians(alpha_t))"),
        ("FORMULA_SELECTION_ERROR", "", "d_f * cos(radians(alpha_t))"),
        ("FORMULA_SELECTION_ERROR", "shifted", "(d + 2 * x * m_n) * cos(radians(alpha_t))"),
    ),
    "p_bt": (
        ("DEGREE_RADIAN_ERROR", "", "p_t * cos(alpha_t)"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "p_n * cos(radians(alpha_n))"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "p_t * cos(radians(alpha_n))"),
        ("WRONG_BASE_PITCH_FORMULA", "", "p_t * sin(radians(alpha_t))"),
        ("WRONG_BASE_PITCH_FORMULA", "", "p_t / cos(radians(alpha_t))"),
        ("WRONG_BASE_PITCH_FORMULA", "", "pi * d_b"),
        ("WRONG_BASE_PITCH_FORMULA", "", "p_t * cos(radians(alpha_t)) ^ 2"),
    ),
    "d": (
        ("HELIX_ANGLE_OMITTED", "helical", "z * m_n"),
        ("MODULE_CONVERSION_ERROR", "helical", "z * m_n * cos(radians(beta))"),
        ("DEGREE_RADIAN_ERROR", "helical", "z * m_n / cos(beta)"),
        ("FORMULA_SELECTION_ERROR", "", "d / 2"),
    ),
    "m_t": (
        ("MODULE_CONVERSION_ERROR", "helical", "m_n * cos(radians(beta))"),
        ("HELIX_ANGLE_OMITTED", "helical", "m_n"),
        ("DEGREE_RADIAN_ERROR", "helical", "m_n / cos(beta)"),
    ),
    "alpha_t": (
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "alpha_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "degrees(atan(tan(radians(alpha_n)) * cos(radians(beta))))"),
        ("ANGLE_UNIT_ERROR", "", "radians(alpha_t)"),
        ("DEGREE_RADIAN_ERROR", "", "degrees(atan(radians(alpha_n) / cos(radians(beta))))"),
    ),
    "p_n": (("NORMAL_TRANSVERSE_CONFUSION", "helical", "p_t"),),
    "p_t": (("NORMAL_TRANSVERSE_CONFUSION", "helical", "p_n"),),
    "h_a": (
        ("PROFILE_SHIFT_OMITTED", "shifted", "(h_aP + k) * m_n"),
        ("INTERNAL_EXTERNAL_SIGN_ERROR", "shifted", "(h_aP - x + k) * m_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "(h_aP + x + k) * m_t"),
    ),
    "h_f": (
        ("PROFILE_SHIFT_OMITTED", "shifted", "h_fP * m_n"),
        ("INTERNAL_EXTERNAL_SIGN_ERROR", "shifted", "(h_fP + x) * m_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "(h_fP - x) * m_t"),
    ),
    "h": (
        ("FORMULA_SELECTION_ERROR", "tip", "(h_aP + h_fP) * m_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "(h_aP + h_fP + k) * m_t"),
    ),
    "d_a": (
        ("PROFILE_SHIFT_OMITTED", "shifted", "d + 2 * (h_aP + k) * m_n"),
        ("INTERNAL_EXTERNAL_SIGN_ERROR", "", "d - 2 * (h_aP + x + k) * m_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "d + 2 * (x + h_aP + k) * m_t"),
        ("HELIX_ANGLE_OMITTED", "helical", "z * m_n + 2 * (x + h_aP + k) * m_n"),
        ("FORMULA_SELECTION_ERROR", "", "d + 2 * (h_fP - x) * m_n"),
    ),
    "d_f": (
        ("PROFILE_SHIFT_OMITTED", "shifted", "d - 2 * h_fP * m_n"),
        ("INTERNAL_EXTERNAL_SIGN_ERROR", "", "d + 2 * (h_fP - x) * m_n"),
        ("INTERNAL_EXTERNAL_SIGN_ERROR", "shifted", "d - 2 * (h_fP + x) * m_n"),
        ("NORMAL_TRANSVERSE_CONFUSION", "helical", "d - 2 * (h_fP - x) * m_t"),
        ("HELIX_ANGLE_OMITTED", "helical", "z * m_n - 2 * (h_fP - x) * m_n"),
        ("FORMULA_SELECTION_ERROR", "", "d - 2 * (h_aP + x + k) * m_n"),
    ),
}
#: Tried after the rule's own models, on the engine's value e.
GENERIC = {
    "°": (("ANGLE_UNIT_ERROR", "radians(e)"), ("ANGLE_UNIT_ERROR", "e * 10 / 9")),
    "mm": (("UNIT_ERROR", "e / 25.4"), ("UNIT_ERROR", "e * 25.4"), ("UNIT_ERROR", "e / 10"), ("UNIT_ERROR", "e * 10"), ("UNIT_ERROR", "e * 1000"), ("UNIT_ERROR", "e / 1000")),
}
GENERIC["µm"] = GENERIC["mm"]
CONDITIONS = {"": "1 = 1", "helical": "abs(beta) > 1e-12", "shifted": "abs(x) > 1e-12", "tip": "abs(k) > 1e-12"}
# Pressure angles in use, and the order that decides between classes of equal count.
PRESSURE_ANGLES = (14.5, 15.0, 17.5, 20.0, 22.5, 25.0, 30.0)
ROOT_CAUSES = (
    "ANGLE_UNIT_ERROR", "DEGREE_RADIAN_ERROR", "WRONG_PRESSURE_ANGLE", "NORMAL_TRANSVERSE_CONFUSION", "MODULE_CONVERSION_ERROR", "WRONG_BASE_CIRCLE_FORMULA", "WRONG_BASE_PITCH_FORMULA", "PROFILE_SHIFT_OMITTED",
    "INTERNAL_EXTERNAL_SIGN_ERROR", "HELIX_ANGLE_OMITTED", "ROUNDING_ERROR", "UNIT_ERROR", "FORMULA_SELECTION_ERROR", "LLM_ARITHMETIC_ERROR", "UNKNOWN",
)


def _models(key: str, unit: str) -> Column:
    """Error models of an output as an array of (class, prediction, own): own ones don't count where they give the right value."""
    e = F.col("engine")
    rows = [F.struct(F.lit(cls).alias("cls"), F.when(F.expr(CONDITIONS[c]), compile_column(text)).alias("pred"), F.lit(True).alias("own")) for cls, c, text in HYPOTHESES.get(key, ())]
    rows += [F.struct(F.lit(cls).alias("cls"), compile_column(text, {"e": e}).alias("pred"), F.lit(False).alias("own")) for cls, text in GENERIC.get(unit, ())]
    return F.array(*rows)


def explained(rows: DataFrame) -> DataFrame:
    """Adds ``cls``: the class of the first error model that gives ``draft``; null if none does."""
    units = {key: unit for key, unit, _ in CYLINDRICAL}
    models = F.lit(None)
    for key, unit in units.items():
        models = F.when(F.col("key") == key, _models(key, unit)).otherwise(models)
    out = rows.withColumn("models", models)
    draft, engine, tol = F.col("draft"), F.col("engine"), F.col("tol")
    wide = lambda m: F.when(m["own"], tol).otherwise(F.greatest(tol, F.lit(1e-9) * F.abs(m["pred"])))
    fits = F.filter("models", lambda m: ~(m["own"] & (F.abs(m["pred"] - engine) <= tol)) & (F.abs(draft - m["pred"]) <= wide(m)))
    early = F.lit(False)
    for n in range(4):
        early = early | (F.abs(draft - F.bround(engine, n)) <= 10.0 ** -(n + 3))
    base = F.when(F.col("key") == "d_b", F.col("d")).when(F.col("key") == "p_bt", F.col("p_t"))
    implied = F.degrees(F.when((draft > 0) & (draft <= base), F.acos(draft / base)))
    angles = F.array(*map(F.lit, PRESSURE_ANGLES))
    wrong = F.exists(angles, lambda a: (F.abs(F.col("implied") - a) <= 0.05) & (F.abs(a - F.col("alpha_t")) > 0.05))
    out = out.withColumn("first", F.try_element_at(fits, F.lit(1))["cls"]).withColumn("implied", implied)
    return out.withColumn("cls", F.coalesce("first", F.when(early, "ROUNDING_ERROR"), F.when(F.coalesce(wrong, F.lit(False)), "WRONG_PRESSURE_ANGLE"))).drop("models", "first")


def plausible(key: str, engine: Column, draft: Column) -> Column:
    """Whether a value is at least in the physical range of its output."""
    same_sign = ~((engine > 0) & (draft < 0)) & ~((engine < 0) & (draft > 0))
    if key == "d_b":
        return same_sign & (draft > 0) & (draft < F.col("d"))
    if key == "p_bt":
        return same_sign & (draft > 0) & (draft < F.col("p_t"))
    return same_sign & (F.abs(draft - engine) <= 0.5 * F.greatest(F.abs(engine), F.lit(1e-9)))


def diagnose(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """``(req_id, key, engine, draft, cls)`` of every drafted field that misses the engine's value."""
    wide = cylindrical(requests)
    units = {key: unit for key, unit, _ in CYLINDRICAL}
    got = drafts.withColumn("draft", F.replace(F.col("raw"), F.lit(","), F.lit(".")).try_cast("double"))
    joined = got.hint("merge").join(wide, "req_id")  # an exploded side looks as small as the table it comes from, and would be broadcast
    engine = F.coalesce(*[F.when(F.col("key") == k, F.col(k)) for k in units])
    unit = F.coalesce(*[F.when(F.col("key") == k, F.lit(u)) for k, u in units.items()])
    rows = joined.withColumn("engine", engine).filter("engine is not null").withColumn("tol", tolerance(F.col("engine"), unit))
    rows = rows.filter(F.col("draft").isNull() | F.isnan("draft") | (F.abs(F.col("draft") - F.col("engine")) > F.col("tol")))
    rows = explained(rows)
    likely = F.lit(False)
    for key in units:
        likely = F.when(F.col("key") == key, plausible(key, F.col("engine"), F.col("draft"))).otherwise(likely)
    return rows.select("req_id", "key", "engine", "draft", F.when(F.col("draft").isNull(), "UNKNOWN").otherwise(F.coalesce("cls", F.when(likely, "LLM_ARITHMETIC_ERROR"), F.lit("UNKNOWN"))).alias("cls"))


def primary_class(fields: DataFrame) -> DataFrame:
    """``(req_id, primary)``: the commonest structural class, else arithmetic, else unknown."""
    order = F.lit(len(ROOT_CAUSES))
    for i, c in enumerate(ROOT_CAUSES):
        order = F.when(F.col("cls") == c, F.lit(i)).otherwise(order)
    counts = fields.groupBy("req_id", "cls").agg(F.count("*").alias("n")).withColumn("fallback", F.col("cls").isin("LLM_ARITHMETIC_ERROR", "UNKNOWN")).withColumn("place", order)
    w = Window.partitionBy("req_id").orderBy("fallback", F.when(F.col("fallback"), F.lit(0)).otherwise(-F.col("n")), "place")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("req_id", F.col("cls").alias("primary"))


# ------------------------------------------------------------------ regression


def cylindrical_cases(spark, with_tip: bool = False) -> DataFrame:
    """The case matrix: 30 spur, 60 helical and 60 shifted gears, and 10 with tip alteration."""
    grid = "(values {}) as {}"
    base = "select a as alpha_n, m as m_n, z from " + ", ".join([grid.format("(20.0D), (25.0D)", "t(a)"), grid.format("(1.0D), (2.0D), (3.0D)", "u(m)"), grid.format("(17), (20), (30), (40), (80)", "v(z)")])
    out = spark.sql(f"""
      with base as ({base})
      select 'spur' as grp, alpha_n, m_n, cast(z as double) as z, 0.0D as beta, 0.0D as x, 0.0D as k, 1.0D as h_aP, 1.25D as h_fP from base
      union all select 'helical', alpha_n, m_n, cast(z as double), b, 0.0D, 0.0D, 1.0D, 1.25D from base, (values (15.0D), (30.0D)) as w(b)
      union all select 'profile_shift', alpha_n, m_n, cast(z as double), 0.0D, s, 0.0D, 1.0D, 1.25D from base, (values (-0.3D), (0.5D)) as w(s)""")
    if with_tip:
        tips = spark.sql(f"select 'tip_alteration' as grp, alpha_n, m_n, cast(z as double) as z, 0.0D as beta, 0.2D as x, -0.1D as k, 0.8D as h_aP, 1.0D as h_fP from ({base}) where alpha_n = 20 and m_n <= 2")
        out = out.unionByName(tips)
    return out


#: Claims: identities that hold for every case, as (name, left, right).
CLAIMS = (
    ("base_circle", "d_b", "d * cos(radians(alpha_t))"),
    ("base_pitch", "p_bt * z", "pi * d_b"),
    ("pitch", "p_t", "pi * d / z"),
    ("depth", "h", "h_a + h_f"),
    ("tip_root", "d_a - d_f", "2 * h"),
    ("shift_keeps_base", "d_b", "z * m_n / cos(radians(beta)) * cos(radians(alpha_t))"),
)


def regression(cases: DataFrame, claims: tuple = CLAIMS, rel: float = 1e-9) -> DataFrame:
    """``(claim, grp, n_cases, n_failed, passed)`` of claims over a case matrix, all in one plan."""
    wide = cylindrical(cases)
    checks = F.array(*[F.struct(F.lit(n).alias("claim"), compile_column(a).alias("lhs"), compile_column(b).alias("rhs")) for n, a, b in claims])
    rows = wide.select("grp", F.explode(checks).alias("c")).select("grp", "c.*")
    holds = F.coalesce(F.abs(F.col("lhs") - F.col("rhs")) <= F.lit(rel) * F.greatest(F.abs("rhs"), F.lit(1e-12)), F.lit(False))
    return rows.groupBy("claim", "grp").agg(F.count("*").alias("n_cases"), F.sum((~holds).cast("long")).alias("n_failed")).withColumn("passed", F.col("n_failed") == 0)


def correction_status(passed: Column, evidence_missing: Column, now: Column) -> Column:
    """Only a regression changes a correction: blocked keeps it a candidate, failure rejects it, success verifies it."""
    return F.when(now == "REJECTED", now).when(evidence_missing, "CANDIDATE").when(passed, "VERIFIED").otherwise("REJECTED")
