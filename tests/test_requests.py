from pyspark.sql import functions as F

from folioforge.functions import requests as R
from folioforge.operators import calc

CASES = [
    ("z = 20, m = 2 mm için hesapla", "cylindrical_gear_geometry", {"z": 20, "m_n": 2}), ("z1 = 20, z2 = 45, modül 2 ve eksen mesafesi 66 mm", "gear_pair", {"z1": 20, "z2": 45, "m_n": 2, "a_w": 66}),
    ("50 mm H7", "iso286_hole_H", {"nominal_size": 50}), ("50 mm h6", "iso286_shaft_h", {"nominal_size": 50}), ("anma ölçüsü 30 IT7", "iso286_it_tolerance", {"nominal_size": 30, "grade": 7}),
    ("tolerans sınıfı 6, m = 3, z = 40, b = 30", "iso1328_flank_tolerance", {"A": 6, "m_n": 3, "z": 40, "b": 30}), ("merhaba", None, {}), ("30 dişli, modül 0,3 cm, helis açısı 15°", "cylindrical_gear_geometry", {"z": 30, "m_n": 0.3, "beta": 15}),
]


def test_requests(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(CASES)], "i int, t string").withColumn("g", R.inputs(F.col("t")))
    for r in rows.withColumn("k", R.calculation_type(F.col("t"), F.col("g"))).collect():
        _, kind, values = CASES[r.i]
        assert r.k == kind and values.items() <= {x.key: x.value for x in r.g}.items(), r.t


def test_request_to_result(spark):
    long = R.requests(spark.createDataFrame([(1, "z = 20, m = 0,2 cm")], "req_id int, text string"))
    wide = calc.wide(calc.validate(long, "cylindrical_gear_geometry"), "cylindrical_gear_geometry")
    assert calc.cylindrical(wide).first().d == 40


def test_requests_know_their_inputs(spark):
    d = spark.createDataFrame([(1, "50 mm H7, modül 2"), (2, "pinyon 20 diş, çark 41 diş, modül 2, x = 0,1")], "req_id int, text string")
    got = {(r.req_id, r.calc_type, r.key, r.value) for r in R.requests(d).collect()}
    assert got == {(1, "iso286_hole_H", "nominal_size", 50.0), (1, "iso286_hole_H", "grade", 7.0), (2, "gear_pair", "z1", 20.0), (2, "gear_pair", "z2", 41.0), (2, "gear_pair", "m_n", 2.0)}


def test_codes(spark):
    pages = spark.createDataFrame([(1, "BS ISO 53:1998 and ISO 53 and ISO 1990 ISO_TR 10064-1", "x.pdf"), (2, "nothing", "ISO_TR 10064, 1, 1992 -- a.pdf"), (3, None, "y")], "doc_id int, text string, name string")
    assert {r.doc_id: r.code for r in R.detect_codes(pages).collect()} == {1: "ISO 53:1998", 2: "ISO/TR 10064:1992", 3: None}
    rows = [("ISO 53:1998", "ISO 53, 2, 1998", []), ("ISO 53", "", ["not_canonical"]), ("ISO 54:1998", "ISO 53, 2, 1998", ["number_differs"]), ("ISO 53:1974", "ISO 53, 2, 1998", ["edition_differs"]), ("ISO 53:1066", "", ["bad_year"])]
    got = spark.createDataFrame(rows, "c string, n string, w array<string>").select(R.code_issues(F.col("c"), F.col("n")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    assert spark.range(1).select(R.title(F.lit("Gears_ part one -- 7.pdf"), F.lit("ISO 53"))).first()[0] == "ISO 53 — Gears: part one"
    assert spark.range(1).select(R.inline_equations(F.lit("it has a pitch p = π m. Also q = 3, x = y + 1"), F.array(F.lit("p"), F.lit("q")))).first()[0] == ["p = π m"]
