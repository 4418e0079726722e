import math

import pytest
from pyspark.sql import functions as F

from folioforge.functions.expr import ExpressionError, compile_column, parse, to_sql
from folioforge.operators import calc, diagnosis


def gear(spark, **values):
    row = {"alpha_n": 20.0, "beta": 0.0, "x": 0.0, "k": 0.0, "h_aP": 1.0, "h_fP": 1.25} | {k: float(v) for k, v in values.items()}
    return calc.cylindrical(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))).first()


def test_spur_gear(spark):
    g = gear(spark, z=20, m_n=2)
    assert (g.d, g.d_a, g.d_f, g.h) == (40, 44, 35, 4.5)
    assert g.d_b == pytest.approx(40 * math.cos(math.radians(20))) and g.p_n == pytest.approx(2 * math.pi)


def test_helical_shifted_gear(spark):
    g = gear(spark, z=30, m_n=3, beta=15, x=0.2)
    assert g.m_t == pytest.approx(3 / math.cos(math.radians(15)))
    assert (g.h_a, g.h_f) == (pytest.approx(3.6), pytest.approx(3.15)) and g.d_a == pytest.approx(30 * g.m_t + 7.2)
    assert gear(spark, z=2, m_n=1).status == "invalid_input"


def test_pair(spark):
    r = spark.createDataFrame([(45.0, 20.0, 2.0, 20.0, 0.0, 66.0), (45.0, 20.0, 2.0, 20.0, 0.0, 20.0)], "z1 double, z2 double, m_n double, alpha_n double, beta double, a_w double")
    a, b = calc.gear_pair(r).collect()
    assert a.u == 2.25 and a.d1 == 40 and a.alpha_wt == pytest.approx(math.degrees(math.acos(130 / 132 * math.cos(math.radians(20)))))
    assert b.alpha_wt is None


def test_flank_tolerance(spark):
    r = spark.createDataFrame([(3.0, 40.0, 0.0, 30.0, 6.0), (0.4, 40.0, 0.0, 30.0, 6.0)], "m_n double, z double, beta double, b double, A double")
    a, b = calc.flank_tolerance(r).collect()
    assert (a.f_pT, a.F_pT_sum, a.F_aT, a.status) == (9.0, 29.0, 12.0, "ok") and b.status == "refused"


@pytest.mark.parametrize("v, expected", [(12.49, 12), (10.4, 10), (7.3, 7.5), (7.2, 7), (4.96, 5.0), (4.94, 4.9)])
def test_rounding(spark, v, expected):
    assert spark.range(1).select(calc.tolerance_round(F.lit(v))).first()[0] == expected


def test_grade_lookup(spark):
    t = spark.createDataFrame([(0.0, 3.0, 1.0), (3.0, 50.0, 2.0)], "above double, up_to double, it double")
    got = calc.grade_lookup(spark.createDataFrame([(3.0,), (3.1,), (50.0,), (51.0,)], "size double"), t).orderBy("size").collect()
    assert [r.it for r in got] == [1.0, 2.0, 2.0, None]


def test_table_structure(spark):
    rows = [(1, 0.0, 3.0, [1.0, 2.0]), (2, 3.0, 6.0, [1.0, 3.0]), (3, 7.0, 9.0, [2.0, 4.0]), (4, 9.0, 12.0, [3.0, 3.0]), (5, 12.0, 13.0, [1.0, 9.0])]
    got = calc.parse_tolerance_table(spark.createDataFrame(rows, "row int, above double, up_to double, values array<double>")).orderBy("row").collect()
    assert [r.code for r in got] == [None, None, "bounds", "row_order", "column_order"]


def test_validation(spark):
    rows = [
        (1, "z", 20.0, "", "user_input", None), (1, "m_n", 0.3, "cm", "user_input", None), (2, "z", 20.5, "", "user_input", None), (2, "m_n", 1.0, "kg", "user_input", None),
        (3, "z", 20.0, "", "extracted_value", "draft_extraction"), (3, "alpha_n", 95.0, "deg", "user_input", None), (4, "wobble", 1.0, "", "user_input", None), (4, "z", float("nan"), "", "user_input", None),
    ]
    r = spark.createDataFrame(rows, "req_id int, key string, value double, unit string, prov_kind string, prov_status string")
    got = {(x.req_id, x.key): (x.code, x.canonical) for x in calc.validate(r, "cylindrical_gear_geometry").collect()}
    assert got[1, "m_n"] == (None, 3.0) and got[1, "z"] == (None, 20.0)
    assert {k: v[0] for k, v in got.items() if v[0]} == {(2, "z"): "not_integer", (2, "m_n"): "invalid_unit", (3, "z"): "draft_input_blocked", (3, "alpha_n"): "out_of_range", (4, "wobble"): "unknown_input", (4, "z"): "invalid_value"}
    assert {(x.req_id, x.key) for x in calc.missing_inputs(r, "cylindrical_gear_geometry").collect()} == {(3, "m_n"), (4, "m_n")}


def test_expressions(spark):
    assert spark.range(1).select(compile_column("2 + 3 * 4 ^ 2 ^ 0 - -1")).first()[0] == 15
    assert spark.range(1).select(compile_column("inv_inverse(inv(0.35))")).first()[0] == pytest.approx(0.35, abs=1e-9)
    assert spark.range(1).select(compile_column("1 / (2 - 2)")).first()[0] is None and spark.range(1).select(compile_column("acos(2)")).first()[0] is None
    assert to_sql("min(a, 2) / b").startswith("(least(a")
    for bad in ("a.b", "a[0]", "lambda x: x", "f(1)", "'x'", "a < b", "1 +", "sin(1, 2)", "(1"):
        with pytest.raises(ExpressionError):
            parse(bad)


def drafted(spark, drafts, **values):
    row = {"req_id": 1.0, "alpha_n": 20.0, "beta": 0.0, "x": 0.0, "k": 0.0, "h_aP": 1.0, "h_fP": 1.25} | {k: float(v) for k, v in values.items()}
    r = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    d = spark.createDataFrame([(1.0, k, v) for k, v in drafts.items()], "req_id double, key string, raw string")
    return diagnosis.diagnose(r, d)


def test_diagnosis(spark):
    at = math.radians(20)
    cases = [
        ({"d_b": str(60 * math.cos(20.0))}, {"z": 30, "m_n": 2}, "DEGREE_RADIAN_ERROR"), ({"d_b": str(60 * math.sin(at))}, {"z": 30, "m_n": 2}, "WRONG_BASE_CIRCLE_FORMULA"),
        ({"d": "60"}, {"z": 30, "m_n": 2, "beta": 15}, "HELIX_ANGLE_OMITTED"), ({"d_a": "64"}, {"z": 30, "m_n": 2, "x": 0.5}, "PROFILE_SHIFT_OMITTED"),
        ({"d_b": str(60 * math.cos(math.radians(25)))}, {"z": 30, "m_n": 2}, "WRONG_PRESSURE_ANGLE"), ({"d_b": "53,452"}, {"z": 30, "m_n": 2}, "LLM_ARITHMETIC_ERROR"), ({"d_b": "-5"}, {"z": 30, "m_n": 2}, "UNKNOWN"),
        ({"d_b": "x"}, {"z": 30, "m_n": 2}, "UNKNOWN"), ({"d_a": str(64 / 25.4)}, {"z": 30, "m_n": 2}, "UNIT_ERROR"),
    ]
    for drafts, values, cls in cases:
        assert [r.cls for r in drafted(spark, drafts, **values).collect()] == [cls], (drafts, cls)
    assert drafted(spark, {"d_b": "56.3816"}, z=30, m_n=2).count() == 0
    assert diagnosis.primary_class(drafted(spark, {"d_b": "53.452", "p_bt": "5.345"}, z=30, m_n=2)).first().primary == "LLM_ARITHMETIC_ERROR"


def test_regression(spark):
    cases = diagnosis.cylindrical_cases(spark)
    assert cases.count() == 150 and diagnosis.cylindrical_cases(spark, True).count() == 160
    assert all(r.passed for r in diagnosis.regression(cases).collect())
    wrong = diagnosis.regression(cases, (("wrong", "d_b", "d * sin(radians(alpha_t))"),)).collect()
    assert not any(r.passed for r in wrong)
