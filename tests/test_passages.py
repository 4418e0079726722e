import pytest
from pyspark.sql import functions as F

from folioforge.operators import passages, planning, tables, values

PATTERNS = planning.compiled()
SCHEMA = (
    "qid long, chunk_id long, question string, subtype string, concepts array<array<string>>, codes array<string>, literals array<string>, symbols array<string>, labels array<string>, clauses array<string>, equations array<string>, "
    "text string, heading_path array<string>, clause string, content_type string, code string, meanings map<string,string>"
)


def row(question, text, subtype=None, heading_path=(), clause=None, kind="general_text", code=None, meanings=None):
    q = planning.plan(question, PATTERNS)
    return [question, subtype, *(q[k] for k in ("concepts", "codes", "literals", "symbols", "labels", "clauses", "equations")), text, list(heading_path), clause, kind, code, meanings]


BOLT, H7 = "civata için çekme dayanımı ve sıkma torku nedir?", "50 mm H7 nedir"
LONG = "module once\n" + "filler words here\n" * 120 + "pressure angle 20 and module range\n" + "2 < m ≤ 3,5\n13\n—\n" + "Other prose that goes on for a while.\n" * 40
ROWS = {
    "far": row(BOLT, "The gear has a tooth profile and a reference diameter."), "near": row(BOLT, "tightening torques and tensile strengths of bolts"), "h7": row(H7, "the hole H7 of 50,0 mm"), "hx7": row(H7, "the feature hx7 of 500 cm"),
    "table": row("tablo nedir", "x", kind="table"), "no table": row("tablo nedir", "x"), "symbol": row("basınç açısı", "| αP | 20° |", kind="table", meanings={"αP": "Pressure angle"}),
    "boosted": row("ISO 53 madde 4.2 Table 2 αP formülü", "see Table 2 for aP = 20 (1)", "standards_formula_lookup", ["Annex A Profile"], "4.2.1", "formula", "ISO 53:1998"), "front": row("kapsam nedir", "x", kind="front_matter"),
    "heading": row("basınç açısı nedir", "the pressure angle is 20°", heading_path=["4 Pressure angle"], clause="4", kind="definition", code="ISO 53"), "nothing": [None] * 15,
    "quantity": row("temel çap", "db = d cos α", kind="formula", meanings={"db": "base diameter"}), "focus": row("basınç açısı 20 derece modül aralığı", LONG), "short": row("modül", "short"), "no hit": row("modül", "z" * 900),
    "stems": row("modül için hoblar ve testlerin", "Tests of a module range with one hob."), "labels": row("Class FD ve Class FE neyi temsil eder", "Figure 5 — Class FE with adjacent Class FD heavy tempering"), "no label": row("Class FD ve Class FE neyi temsil eder", "Class A feature list for a few items"),
}


@pytest.fixture(scope="module")
def scored(spark):
    names = list(ROWS)
    rows = [(i, i, *ROWS[n]) for i, n in enumerate(names)]
    assert all(len(r) == 17 for r in rows)
    return {names[r.qid]: r for r in passages.score(spark.createDataFrame(rows, SCHEMA), 300).collect()}


def test_coverage(scored):
    assert scored["far"].score < 0.4 and scored["near"].score == 1.0 and scored["h7"].score == 1.0 and scored["hx7"].score == 0.0
    assert scored["table"].matched == ["table"] and scored["no table"].matched == [] and scored["symbol"].matched == ["pressure angle"]
    assert scored["heading"].coverage == 1.0 and scored["nothing"].coverage == 1.0 and scored["nothing"].boost == 0.0
    assert scored["stems"].score == 1.0 and scored["labels"].score > 0.4 > scored["no label"].score  # an ending typed after a stem; short codes as whole tokens


def test_boosts(scored):
    b = scored["boosted"].boosts
    assert b["clause"] == 0.2 and b["standard_code"] == 0.25 and b["requested_structure"] == 0.2 and b["content_type"] == 0.1 and b["informative_annex"] == -0.05 and b["exact_tokens"] == pytest.approx(0.15)
    assert scored["front"].boosts["front_matter"] == -0.2 and scored["heading"].boosts["defines_term"] == 0.2 and scored["quantity"].boosts["defines_quantity"] == 0.3 and "defines_quantity" not in b


def test_focus(spark, scored):
    s, e = scored["focus"].start, scored["focus"].stop
    assert "pressure angle 20" in LONG[s:e] and LONG[s - 1] == "\n" and (scored["short"].start, scored["short"].stop) == (0, 5) and (scored["no hit"].start, scored["no hit"].stop) == (0, 300)
    d = spark.createDataFrame([(1, 1, *row("modül", "a\nb […]\nmodule\nc\nd\nmodule range"))], SCHEMA)
    kept = d.select(passages.focused_parent(F.col("text"), 40)).first()[0]
    assert "module" in kept and "[…]" in kept and len(kept) <= 44


def test_relevant(spark):
    d = spark.createDataFrame([(1, 1.0, 0.1, 1), (2, 0.5, 0.1, 2), (3, 0.4, 0.5, 2), (4, 0.4, 0.6, 2), (5, 0.5, 0.1, 1)], "qid long, coverage double, score double, n_concepts int")
    assert [r.qid for r in passages.relevant(d).orderBy("qid").collect()] == [1, 2, 4]


def test_values(spark):
    pages = spark.createDataFrame([(1, 1, "m = 2,5 mm, Ø 40 H7 ±0,02 mm; basınç açısı 20° and width 12 mm, z=30 m = 2,5 mm"), (2, 1, None)], "doc_id long, page long, text string")
    d = values.draft_values(pages)
    got = {(r.label, r.value, r.unit, r.quantity) for r in d.collect()}
    assert got == {("m", 2.5, "mm", "length"), ("Ø", 40.0, "mm", "length"), ("±", 0.02, "mm", "length"), ("basınç açısı", 20.0, "°", "angle"), ("width", 12.0, "mm", "length"), ("z", 30.0, None, "count")}
    z = d.filter("label = 'z'").first()
    decided = values.confirm(d, spark.createDataFrame([(1, 1, z.start, "confirm", 31.0)], "doc_id long, page long, start int, action string, value double")).filter("label = 'z'").first()
    assert (decided.status, decided.edited, decided.value) == ("user_confirmed", True, 31.0)


def test_tables(spark):
    rows = [["Size", "", "Limits"], ["above", "to", "mm"], *[[str(i), str(i + 1), str(i * 2)] for i in range(24)]]
    t = spark.createDataFrame([(1, "Table 1 — Limits", rows)], "table int, caption string, rows array<array<string>>").withColumn("n_header", tables.header_rows(F.col("rows")))
    names = t.select(tables.column_names(F.col("rows"), F.col("n_header")).alias("n")).withColumn("u", tables.column_units(F.col("n"))).first()
    assert names.n == ["Size / above", "Size / to", "Limits / mm"] and names.u == [None, None, "mm"]
    c = tables.row_groups(t, 100, 80).orderBy("n").collect()
    assert c[0].role == "overview" and len(c) > 2 and all(r.text.startswith("Table 1 — Limits\n| Size |") for r in c) and all(r.tokens <= 80 for r in c[1:])
    body = [x for r in c[1:] for x in r.text.split("\n") if x.startswith("| ") and x.split("|")[1].strip().isdigit()]
    assert len(body) == len(set(body)) == 24
    assert tables.row_groups(t, 10_000).count() == 1
    parts = spark.createDataFrame([(1, "2", 4, rows[:2] + rows[5:7], 2), (1, "2", 3, rows[:5], 2)], "doc_id int, number string, page int, rows array<array<string>>, n_header int")
    joined = tables.append_continued(parts).first()
    assert joined.rows == rows[:7] and (joined.page, joined.last_page) == (3, 4)
    words = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 5.0, "a", 0), (1, 11.0, 30.0, 15.0, 34.0, "b", 1), (1, 500.0, 1.0, 501.0, 2.0, "lost", 2), (1, 6.0, 1.0, 8.0, 5.0, "c", 3)], "table int, x0 double, y0 double, x1 double, y1 double, text string, ord int")
    grid = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 20.0), (1, 1, 1, 10.0, 20.0, 20.0, 40.0)], "table int, row int, col int, x0 double, y0 double, x1 double, y1 double")
    cells = {(r.row, r.col): (r.text, r.lost) for r in tables.cell_texts(tables.place_cells(words, grid)).collect()}
    assert cells == {(0, 0): ("a c", 0.25), (1, 1): ("b", 0.25)}
