from folioforge.operators import critical, planning


def test_clauses(spark):
    chunks = spark.createDataFrame([(1, "5.1"), (1, "5.1"), (1, "51"), (1, "A.2.1"), (1, "Annex B"), (1, None), (1, ""), (2, "5")], "version_id long, clause string")
    wanted = spark.createDataFrame([(1, "5"), (1, "5"), (1, "5.1"), (1, "5.1.1"), (1, "Annex A"), (1, "A.2"), (1, "Annex B"), (1, "6"), (2, "5"), (3, "1")], "version_id long, clause string")
    got = {(r.version_id, r.clause): (r.n_chunks, r.preserved) for r in critical.clauses_preserved(wanted, chunks).collect()}
    assert got == {(1, "5"): (2, True), (1, "5.1"): (2, True), (1, "5.1.1"): (0, False), (1, "Annex A"): (1, True), (1, "A.2"): (1, True), (1, "Annex B"): (1, True), (1, "6"): (0, False), (2, "5"): (1, True), (3, "1"): (0, False)}


def test_tokens_and_gate(spark):
    texts = spark.createDataFrame([(1, "ISO 53", "the haP and (1), m.x"), (2, "ISO 53", "haPx _m (2)"), (3, "other", "text"), (4, "ISO 53", None)], "version_id long, code string, text string")
    required = spark.createDataFrame([("ISO 53", "haP"), ("ISO 53", "(1)"), ("ISO 53", "m"), ("ISO 53", "m.x"), ("ISO 53", "m")], "code string, token string")
    got = critical.tokens_missing(texts, required)
    assert {r.version_id: (r.n_required, r.missing) for r in got.collect()} == {1: (4, []), 2: (4, ["(1)", "haP", "m", "m.x"]), 3: (0, []), 4: (4, ["(1)", "haP", "m", "m.x"])}
    clauses = critical.clauses_preserved(spark.createDataFrame([(1, "5"), (3, "5")], "version_id long, clause string"), spark.createDataFrame([(3, "5.2")], "version_id long, clause string"))
    gates = {r.version_id: (r.status, r.lost) for r in critical.critical_gate(clauses, got).collect()}
    assert gates[1] == ("review", ["clause 5"]) and gates[3] == ("pass", []) and gates[2][0] == "review" and "token haP" in gates[2][1]


def test_letters_before_what_they_name():
    assert planning.symbols("A sınıfı nedir") == ["A"] and planning.symbols("D tipi kremayer") == ["D"] and planning.symbols("H temel sapmalı delik") == ["H"]
    assert planning.symbols("A gear and a D") == [] and planning.symbols("H temel daire") == []
    own = planning.tokens("sapma H ve deviation FE")
    assert planning._named(own)[0] == ["deviation H", "deviation FE"]


def test_texts_of_one_code_stay_where_they_are(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "A" if i % 9 else None, "the (c)" if i % 2 else None) for i in range(40)], "id int, code string, text string")
    required = spark.createDataFrame([("A", "the"), ("A", "of"), ("A", "(c)"), ("B", "x")], "code string, token string")
    out = critical.tokens_missing(texts, required)
    rows = sorted(map(str, out.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(critical, "CODE_ROWS", 1)
    sorted_ = critical.tokens_missing(texts, required)
    assert sorted(map(str, sorted_.collect())) == rows
