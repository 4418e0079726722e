from folioforge.operators import geometry


def g(text, x, base, size=10.0, font="Times"):
    return {"text": text, "x0": float(x), "x1": x + 0.5 * size * len(text), "y0": base - 0.7 * size, "y1": base + 0.2 * size, "size": float(size), "baseline": float(base), "font": font}


FRACTION = [g("c", 0, 50), g("=", 10, 50), g("a", 24, 42), g("n", 29.5, 44, 6.5), g("b", 26, 58)]
BAR = [{"kind": "h", "a": 22.0, "b": 36.0, "c": 47.0}]


def test_fraction():
    r = geometry.reconstruct(FRACTION, BAR)
    assert (r["plain"], r["latex"], r["lhs"], r["status"]) == ("c = an/b", r"c = \frac{a_{n}}{b}", "c", "exact")


def test_scripts_and_functions():
    r = geometry.reconstruct([g("d", 0, 50), g("b", 5.5, 52, 6), g("=", 14, 50), g("d", 24, 50), g("cos", 33, 50), g("α", 52, 50), g("t", 57.5, 52, 6)], [])
    assert r["plain"] == "db = d cos αt" and r["latex"].startswith("d_{b} =") and r"\cos" in r["latex"] and r"\alpha_{t}" in r["latex"]


def test_doubt():
    assert geometry.reconstruct([*FRACTION, g("∮", 60, 50)], BAR)["status"] == "needs_review"
    assert geometry.reconstruct(FRACTION, [*BAR, {"kind": "v", "a": 1.0, "b": 2.0, "c": 3.0}])["latex"] is None
    assert geometry.reconstruct([g("a", 0, 50), g("b", 10, 58)], [])["reasons"] == ["off_baseline"]
    assert "bar_without_fraction" in geometry.reconstruct([g("a", 0, 50)], BAR)["reasons"] and geometry.reconstruct([], [])["status"] == "needs_review"
    assert geometry.reconstruct([g("a", 0, 50, font="MathPi")], [])["reasons"] == ["math_font"]
    assert geometry.latex_problems("a_{b") == ["braces"] and geometry.latex_problems(r"\frac{a}{}") == ["empty_group"]


def test_tables(spark):
    cols = list(FRACTION[0])
    glyphs = spark.createDataFrame([(1, 1, "1", *r.values()) for r in FRACTION], "doc_id long, page int, eq string, " + ", ".join(f"{c} {'string' if c in ('text', 'font') else 'double'}" for c in cols))
    bars = spark.createDataFrame([(1, 1, "1", *BAR[0].values())], "doc_id long, page int, eq string, kind string, a double, b double, c double")
    assert geometry.equations(glyphs, bars).first().latex == r"c = \frac{a_{n}}{b}"
    letters = [(1, 1, x * 5.0, x * 5.0 + 4.5, 10.0 + (x % 2) * 0.5, c) for x, c in enumerate("gears") if c != " "] + [(1, 1, 30.0, 34.0, 10.0, "z"), (1, 1, 0.0, 4.0, 30.0, "x")]
    rows = geometry.words_of(spark.createDataFrame(letters, "doc_id int, page int, x0 double, x1 double, baseline double, text string")).orderBy("row").collect()
    assert [r.text for r in rows] == ["gears z", "x"]
    runs = [(1, 1, 0.0, 10.0, 0.0, 4.0, "ab", False), (1, 1, 11.0, 20.0, 0.0, 4.0, "cd", False), (1, 1, 40.0, 50.0, 0.0, 4.0, "ef", False), (1, 1, 0.0, 10.0, 40.0, 44.0, "t1", True), (1, 1, 11.0, 20.0, 40.0, 44.0, "t2", True)]
    merged = geometry.merge_fragments(spark.createDataFrame(runs, "doc_id int, page int, x0 double, x1 double, y0 double, y1 double, text string, in_table boolean"))
    assert sorted(r.text for r in merged.collect()) == ["abcd", "ef", "t1", "t2"]
    lines = [(1, 1, 0.0, 20.0, 10.0, "4.2", False), (1, 1, 40.0, 90.0, 11.0, "Base circle", False), (1, 1, 0.0, 20.0, 40.0, "7.1", True), (1, 1, 40.0, 60.0, 40.0, "cell", True)]
    joined = geometry.join_numbers(spark.createDataFrame(lines, "doc_id int, page int, x0 double, x1 double, baseline double, text string, in_table boolean"))
    assert sorted(r.text for r in joined.collect()) == ["4.2 Base circle", "7.1", "cell"]
