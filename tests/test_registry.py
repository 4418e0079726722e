import pytest
from pyspark.sql import functions as F

from folioforge.functions import stem
from folioforge.operators import diagnosis, registry

# Examples of the paper.
STEMS = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate controll control roll roll".split()


@pytest.mark.parametrize("word, expected", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, expected):
    assert stem.stem(word) == expected


def test_weighted_index(spark):
    c = spark.createDataFrame([(1, "4.2", "Base circles", "doc", "the gears of a gear"), (2, None, None, None, "circle"), (3, None, None, None, None)], "chunk_id long, clause string, heading string, context string, text string")
    p = stem.weighted_postings(c)
    got = {(r.chunk_id, r.cfg, r.lexeme, r.weight): r.tf for r in p.collect()}
    assert got[1, "english", "gear", "D"] == 2 and got[1, "simple", "gears", "D"] == 1 and got[1, "english", "circl", "A"] == 1 and (1, "english", "the", "D") not in got
    ranked = stem.weighted_rank(p, spark.createDataFrame([(7, "english", "circl")], "qid long, cfg string, lexeme string")).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked] == [1, 2]


def test_structure():
    known = {"z", "m_n", "beta", "alpha_n", "x", "k", "h_aP", "h_fP"} | {r.output for r in registry.RULES}
    assert registry.structure_problems(registry.RULES, known) == []
    bad = (registry.Rule("a", "f", "spell", "d", "z * wobble", ("nobody",)), registry.Rule("a", "f", "formula", "d", "z *"))
    problems = [p for _, p in registry.structure_problems(bad, known)]
    assert {p.split(":")[0] for p in problems} == {"duplicate_id", "unknown_kind", "unknown_dependency", "unknown_variable", "expression"}


def test_statuses(spark):
    cases = diagnosis.cylindrical_cases(spark)
    wrong = registry.Rule("gear.wrong", "base_circle", "formula", "d_b", "d * sin(radians(alpha_t))", ("gear.d",), ("evidence.base_circle",))
    on_wrong = registry.Rule("gear.on_wrong", "base_pitch", "formula", "p_bt", "pi * d_b / z", ("gear.wrong",), ("evidence.base_pitch",))
    rules = (*registry.RULES, wrong, on_wrong)
    table, agreed = registry.rule_table(spark, rules), registry.agreement(cases, rules)
    evidence = spark.createDataFrame([(f"evidence.{f}",) for f in {r.family for r in rules} - {"pitch"}], "id string")
    got = {r.id: r.status for r in registry.statuses(table, agreed, evidence).collect()}
    assert got["gear.wrong"] == "rejected" and got["gear.on_wrong"] == "rejected" and got["gear.p_t"] == "candidate" and got["gear.d_b"] == "verified" and got["gear.p_bt"] == "candidate"
    assert agreed.filter("id = 'gear.d_b'").first().worst <= 1e-9
    assert registry.derivative_gap(cases, "z * m_n / cos(radians(beta))", "z", "m_n / cos(radians(beta))").agg(F.max("gap")).first()[0] < 1e-6
    seen = spark.createDataFrame([("gear.d_b", "repo", True), ("gear.d_b", "other", False)], "id string, source string, agrees boolean")
    p = registry.provenance(table, spark.createDataFrame([("evidence.base_circle", "21771", 9)], "evidence string, code string, page int"), seen).filter("id = 'gear.d_b'").first()
    assert p.conflicts == ["other"] and p.passages[0].page == 9


def test_corrections(spark):
    d = spark.createDataFrame([("d_b", "SIGN"), ("d_b", "SIGN"), ("p_bt", "UNKNOWN")], "key string, cls string")
    c = registry.corrections(d)
    assert [(r.key, r.occurrences) for r in c.collect()] == [("base_circle:SIGN", 2)]
    done = c.withColumns({"status": F.lit("VERIFIED"), "engine_version": F.lit("1"), "updated": F.lit(1)})
    assert registry.usable(done, "1", "targeted", F.lit("base_circle")).count() == 1 and registry.usable(done, "2").count() == 0 and registry.usable(c.withColumns({"engine_version": F.lit("1"), "updated": F.lit(1)}), "1", "all").count() == 0
