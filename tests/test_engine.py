import math

import pytest
from pyspark.sql import functions as F

from folioforge.operators import engine

REQUEST = "req_id long, calc_type string, user_id long, key string, value double, unit string, prov_kind string, ref_id long"
PAGE = "doc_id long, page int, code string, text string"
CHECKED = "req_id long, calc_type string, key string, value double, unit string, prov_kind string, prov_status string"


def test_requirements_and_needs_agree(spark):
    known = {r[0] for r in engine.REQUIREMENTS}
    assert len(known) == len(engine.REQUIREMENTS) == 33
    needs = engine.need_table(spark).collect()
    assert {n.requirement_id for n in needs} <= known and {n.calc_type for n in needs} == set(engine.NEEDS)
    assert ("gear_pair", "iso21771.eq54", "a_w", True) in [tuple(n) for n in needs] and ("iso1328_flank_tolerance", "iso21771.eq1", "d", False) in [tuple(n) for n in needs]


def test_codes_by_their_words(spark):
    rows = [("ISO 53:1998",), ("TS EN ISO 1328-1",), ("ISO 5300",), (None,), ("",)]
    got = [set(r[0]) for r in spark.createDataFrame(rows, "c string").select(engine.code_keys(F.col("c"))).collect()]
    assert "iso 53" in got[0] and "iso 53:1998" not in got[0] and "iso 1328-1" in got[1] and "en iso 1328-1" in got[1]
    assert "iso 53" not in got[2] and got[3] == got[4] == set()


def test_provenance(spark):
    extracted = [(1, "a", "user_confirmed", 2.0, "mm", 3.0, "cm"), (2, "a", "draft", 2.0, "mm", None, None), (3, "b", "user_confirmed", 4.0, None, None, None), (3, "b", "user_confirmed", 4.0, None, None, None), (None, "a", "user_confirmed", 9.0, "mm", None, None)]
    memory = [(1, 7, False, "user_confirmed", 5.0, None), (2, 8, True, "draft", None, "mm"), (3, 8, False, "user_confirmed", 6.0, "mm")]
    ask = [(i, "t", user, "k", 1.0, "m", kind, ref) for i, (user, kind, ref) in enumerate([
        (7, "extracted_value", 1), (7, "extracted_value", 2), (7, "extracted_value", 3), (9, "extracted_value", 3), (7, "extracted_value", None), (7, "extracted_value", 99), (None, "extracted_value", 1),
        (7, "memory_item", 1), (7, "memory_item", 2), (7, "memory_item", 3), (9, "memory_item", 3), (7, "guess", 1), (7, None, None)])]
    scopes = [(7, False, ["a"]), (9, True, []), (7, False, ["a", "c"])]
    out = engine.resolve_inputs(
        spark.createDataFrame(ask, REQUEST).withColumn("a.b", F.lit(1)), spark.createDataFrame(extracted, "ref_id long, area string, status string, value double, unit string, confirmed_value double, confirmed_unit string"),
        spark.createDataFrame(memory, "ref_id long, owner_id long, shared boolean, status string, value double, unit string"), spark.createDataFrame(scopes, "user_id long, is_owner boolean, areas array<string>"),
    )
    got = {r.req_id: (r.value, r.unit, r.prov_kind, r.prov_status) for r in out.collect()}
    lost = (1.0, "m", "extracted_value", "missing")
    assert len(got) == out.count() == len(ask) and "a.b" in out.columns
    assert got[0] == (3.0, "cm", "extracted_value", "user_confirmed") and got[1] == (1.0, "m", "extracted_value", "draft") and got[3] == (4.0, "", "extracted_value", "user_confirmed")
    assert got[2] == got[4] == got[5] == got[6] == lost
    assert got[7] == (5.0, "m", "memory_item", "user_confirmed") and got[8] == (1.0, "mm", "memory_item", "draft") and got[9][3] == "missing" and got[10] == (6.0, "mm", "memory_item", "user_confirmed")
    assert got[11] == got[12] == (1.0, "m", "user_input", "user_input")


def test_evidence(spark):
    pages = [(1, 3, "ISO 53:1998", "A  standard\nrack‐profile is used"), (2, 5, "ISO 53", "is used. standard rack-profile"), (2, 4, "ISO 53", "is used; Standard Rack-Profile"), (3, 5, "ISO 530", "standard rack-profile is used"), (4, 5, "ISO 53", None), (5, 5, None, "standard")]
    asked = [("r", "ISO 53", 5, ["Standard rack-profile", "is used"]), ("s", "ISO 53", 9, ["standard rack-profile"]), ("none", "ISO 53", 5, []), ("gone", "ISO 53", 5, ["absent"]), ("half", "ISO 53", 5, ["standard", "absent"]), ("nohint", "iso 530", None, ["standard"])]
    need = "requirement_id string, code string, page_hint int, phrases array<string>"
    out = engine.evidence(spark.createDataFrame(asked, need), spark.createDataFrame(pages, PAGE).withColumn("_key", F.lit("clash")))
    got = {r.requirement_id: (r.doc_id, r.page) for r in out.collect()}
    assert got == {"r": (2, 5), "s": (1, 3), "nohint": (3, 5)}
    assert next(r.excerpt for r in out.collect() if r.requirement_id == "s") == "A standard rack‐profile is used"
    assert engine.evidence(spark.createDataFrame([], need), spark.createDataFrame(pages, PAGE)).count() == engine.evidence(spark.createDataFrame(asked, need), spark.createDataFrame([], PAGE)).count() == 0


def _rows(req, calc_type, **values):
    units = {"m_n": "mm", "beta": "deg", "alpha_n": "deg", "b": "mm", "d": "mm", "a_w": "mm"}
    return [(req, calc_type, k, float(v), units.get(k, ""), "user_input", "user_input") for k, v in values.items()]


@pytest.fixture(scope="module")
def stated(spark):
    return spark.createDataFrame([(r[0], i, r[2]) for i, r in enumerate(engine.REQUIREMENTS)], "requirement_id string, doc_id long, page int")


def test_run_by_status(spark, stated):
    gear, flank = "cylindrical_gear_geometry", "iso1328_flank_tolerance"
    asked = (
        _rows(1, gear, z=20, m_n=2) + _rows(2, "worm", z=1) + _rows(3, gear, z=20) + _rows(4, gear, z=2, m_n=1) + _rows(5, gear, z=20.5, m_n=2) + _rows(6, gear, z=20, m_n=2, wobble=1)
        + _rows(7, "gear_pair", z1=45, z2=20, m_n=2, a_w=66) + _rows(8, "gear_pair", z1=45, z2=20, m_n=2, a_w=1) + _rows(9, "gear_pair", z1=45, z2=20, m_n=2)
        + _rows(10, flank, m_n=3, z=40, b=30, A=6) + _rows(11, flank, m_n=3, A=6) + _rows(12, flank, m_n=90, d=100, A=6) + _rows(13, "transverse_module", m_n=3, beta=20) + _rows(14, None, z=1)
        + [(15, gear, "z", 20.0, "", "user_input", "user_input"), (15, gear, "m_n", 2.0, "mm", "extracted_value", "draft_extraction")] + _rows(16, gear, z=20, m_n=2) + [(16, gear, "z", 21.0, "", "user_input", "user_input"), (16, gear, "z", None, "", "user_input", "user_input")]
    )
    out = engine.run(spark.createDataFrame(asked, CHECKED), engine.need_table(spark), stated)
    got = {r.req_id: r for r in out.collect()}
    assert len(got) == out.count() == 16
    assert {i: (r.status, r.code) for i, r in got.items()} == {
        1: ("ok", None), 2: ("refused", "unsupported_formula"), 3: ("invalid_input", "invalid_input"), 4: ("invalid_input", "invalid_input"), 5: ("invalid_input", "invalid_input"), 6: ("invalid_input", "invalid_input"),
        7: ("ok", None), 8: ("error", "math_error"), 9: ("ok", None), 10: ("ok", None), 11: ("invalid_input", "invalid_input"), 12: ("refused", "rule_refusal"), 13: ("ok", None), 14: ("refused", "unsupported_formula"),
        15: ("invalid_input", "invalid_input"), 16: ("invalid_input", "invalid_input"),
    }
    value = lambda i: {o.key: o.value for o in got[i].outputs}
    assert value(1)["d"] == 40 and math.isclose(value(1)["d_b"], 40 * math.cos(math.radians(20))) and value(1)["d_a"] == 44 and value(1)["d_f"] == 35 and got[1].constants == ["alpha_n", "beta", "x", "k", "h_aP", "h_fP"]
    assert "iso53.table2" in [e.requirement_id for e in got[1].evidence] and len(got[1].evidence) == 13 and got[1].missing_sources == []
    assert got[3].missing == ["m_n"] and got[5].problems == ["z:not_integer"] and got[6].n_unknown == 1 and got[15].problems == ["m_n:draft_input_blocked"] and got[16].problems == ["z:invalid_value"]
    assert value(7)["u"] == 2.25 and math.isclose(value(7)["alpha_wt"], math.degrees(math.acos(130 / 132 * math.cos(math.radians(20))))) and "alpha_wt" not in value(9)
    assert value(10)["f_pT"] == 9 and value(10)["F_pT"] == 29 and value(10)["F_aT"] == 12 and math.isclose(value(13)["m_t"], 3 / math.cos(math.radians(20)))
    assert not any(r.outputs for r in got.values() if r.status != "ok")


def test_missing_sources_refuse(spark, stated):
    asked = spark.createDataFrame(_rows(1, "cylindrical_gear_geometry", z=20, m_n=2) + _rows(2, "cylindrical_gear_geometry", z=20, m_n=2, alpha_n=20, h_aP=1, h_fP=1.25) + _rows(3, "gear_pair", z1=20, z2=30, m_n=1, alpha_n=20), CHECKED)
    got = {r.req_id: r for r in engine.run(asked, engine.need_table(spark), stated.filter("requirement_id <> 'iso53.table2'")).collect()}
    assert (got[1].status, got[1].code, got[1].missing_sources) == ("refused", "missing_source", ["iso53.table2"]) and len(got[1].evidence) == 12 and got[1].outputs == []
    assert got[2].status == "ok" and got[3].status == "ok" and len(got[3].evidence) == 4
    none = engine.run(asked.limit(0), engine.need_table(spark), stated)
    assert none.count() == 0 and tuple(none.columns) == engine.RESULT
