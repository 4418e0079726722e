import pytest
from pyspark.sql import functions as F

from folioforge.operators import grounding, planning, search

INTENTS = [
    ("Merhaba, nasılsın", "general"), ("standart nedir", "general"), ("ISO iyi bir şey mi", "general"), ("kaynak ver", "sources_only"), ("hatırla: modül 2 kullanıyoruz", "memory_command"), ("öneri notu: tabloyu ekle", "note_command"),
    ("hangi standartlar var", "corpus_inventory"), ("which standards do you have", "corpus_inventory"), ("hangi standartlar var 286", "general"), ("z = 20 ve m = 2 için bölüm dairesini hesapla", "calculation"),
    ("basınç açısı nasıl hesaplanır", "technical"), ("modül aralığı nedir", "technical"), ("basınç açısı kaç derece", "technical"), ("ISO 53 kapsamı nedir", "technical"),
    ("sende hangi belgeler yüklü, listele", "corpus_inventory"), ("dokümanları listele", "corpus_inventory"), ("neleri biliyorsun", "corpus_inventory"), ("list all documents", "corpus_inventory"), ("kaynaklarda ne var", "corpus_inventory"),
    ("hangi standart 40 mm için geçerli", "technical"), ("ISO 53 standardında hangi modüller var", "technical"), ("Kaynakları göster lütfen", "sources_only"), ("ISO 53 modül değeri nedir, kaynak ver", "technical"),
    ("ISO 286'ya göre 30 mm H7 toleransı nedir", "calculation"), ("30 mm anma ölçüsü için IT6 kaç µm", "calculation"), ("mn = 3 mm ve β = 20° için alın modülü mt hesapla", "calculation"), ("Dişli mukavemet hesabını yap, güç 25 kW", "calculation"),
    ("alın modülünü hesapla", "technical"), ("db nasıl hesaplanır", "technical"), ("What is the rim thickness", "technical"), ("bana kısaca kendini tanıt", "general"), ("ISO 53 Table 2 αP kaç derece", "technical"), ("M8 civata 10.9", "technical"),
]


def test_intent(spark):
    got = spark.createDataFrame(INTENTS, "t string, want string").select("t", "want", planning.intent(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_subtype(spark):
    rows = [("basınç açısı nasıl hesaplanır", "standards_formula_lookup"), ("modül aralığı nedir", "standards_range_lookup"), ("basınç açısı kaç derece", "standards_value_lookup"), ("merhaba", None), ("ISO 53'e göre alın modülünü hesapla", "standards_formula_lookup"), ("z = 20, m = 2 için hesapla", "numeric_calculation")]
    got = spark.createDataFrame(rows, "t string, w string").select(planning.subtype(F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_symbols_and_labels():
    assert planning.symbols("β ve αP, haP, 9B, H7, FD nedir, ISO 53 için beta") == ["β", "αP", "haP", "9B", "H7", "FD"]
    assert planning.variants("αP") == ["αP", "aP"] and planning.variants("aP") == ["aP", "αP"] and planning.variants("ρfP") == ["ρfP", "rfP"] and planning.variants("β") == ["β", "beta"] and planning.variants("FD") == ["FD"]


def test_labels_clauses_and_stems():
    p = planning.plan("Class FD, Class FE, 9B testi, Type A, tablo 4.2.4 madde 7 Ek B ISO 286-2:2010 Eşitlik (A.3)", planning.compiled())
    assert p["labels"] == ["class FD", "class FE", "test 9B", "type A", "annex B"] and p["clauses"] == ["4.2.4", "7", "Annex B"] and p["codes"] == ["286-2"] and p["equations"] == ["A.3"]
    assert "test" in planning.stems("testlerinin") and "standart" in planning.stems("standartlara") and len(planning.ENDINGS) == len(set(planning.ENDINGS)) == 29
    assert "hob" in planning.stems("hoblar") and "test" in planning.stems("testlerin") and planning.stems("çap") == [] and planning.stems("ada") == []


def test_plans(spark):
    q = spark.createDataFrame([(1, "civata için çekme dayanımı ve sıkma torku nedir?"), (2, "madde 5.4 ve Ek A.1, Eşitlik (2), Table 2, 286-2:2010 değeri 0,25"), (3, "50 mm H7 nedir"), (4, "hobların testlerin toleransı"), (5, None)], "qid long, text string")
    p = {r.qid: r for r in planning.plan_questions(q).collect()}
    assert sorted(map(tuple, p[1].concepts)) == [("bolt",), ("tensile strength",), ("tightening torque",)]
    assert p[2].clauses == ["5.4", "A.1"] and p[2].equations == ["2"] and "table 2" in p[2].labels
    assert p[3].literals == ["50", "mm", "h7"] and p[3].symbols == ["H7"] and p[5].concepts == []


def test_grounding(spark):
    rows = [
        (1, "Açı 25° olur.", ["açı 20 ve 1,25"], "açı?", "unsupported_numbers"), (2, "Değer 20 [S1].", ["20 ve 3"], "?", None), (3, "Evet [S7].", ["x"], "?", "invalid_citation:[7]"), (4, "Sayı 42.", ["x"], "42 nedir", None),
        (5, "1. önce 20\n2. sonra 20", ["20"], "?", None), (6, "  ", ["x"], "?", "empty_answer"), (7, "Bulunamadı.", ["x"], "?", "model_refused"), (8, None, [], "?", "empty_answer"),
    ]
    d = spark.createDataFrame(rows, "id int, answer string, passages array<string>, question string, want string")
    got = {r.id: r for r in grounding.validate(d, "bulunamadı").collect()}
    assert all(got[r[0]].reason == r[4] and got[r[0]].accepted == (r[4] is None) for r in rows)
    assert got[1].unsupported == ["25"] and got[2].shown == "Değer 20."


def test_search_pieces(spark):
    d = spark.createDataFrame([(1, "gear tooth module gear"), (2, "gear wheel"), (3, None), (4, "other")], "doc_id long, text string")
    ix = search.postings(d)
    assert {(r.doc_id, r.tf) for r in ix.filter("lexeme = 'gear'").collect()} == {(1, 2), (2, 1)}
    assert [r.doc_id for r in search.prefix_search(ix, ["ge", "to"]).collect()] == [1]
    ranked = spark.createDataFrame([(1, k, "p" if k < 4 else None, float(9 - k)) for k in range(1, 7)], "qid long, doc_id long, parent string, final double")
    assert [r.doc_id for r in search.diversify(ranked, "parent", 2, 5).orderBy("place").collect()] == [1, 2, 4, 5, 6]
    b = search.budgeted(spark.createDataFrame([(1, k, k, "x" * 2000) for k in (1, 2, 3, 4)], "qid long, place long, doc_id long, text string"), 3000)
    assert [r["share"] for r in b.orderBy("place").collect()] == [1400, 1400]
    m = search.retrieval_metrics(spark.createDataFrame([(1, 7, 2), (2, 8, 5)], "qid long, doc_id long, place long"), spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "qid long, doc_id long")).first()
    assert (m.n_questions, m.hit_1, m.hit_depth) == (3, 0.0, pytest.approx(1 / 3, abs=1e-6)) and m.mrr == pytest.approx((0.5 + 0.2) / 3, abs=1e-6)
