import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.functions.text import TOKEN_COEF
from folioforge.operators import calibration
from folioforge.operators.calibration import TERMS

SCHEMA = "doc_id long, text string, tokens long"


def _texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(1, 12)))
    text = lambda: rnd.choice([" ", "\n"]).join(rnd.choice([word(), str(rnd.randint(0, 9999)), "ä", "ß,", "(x)"]) for _ in range(rnd.randint(1, 40)))
    return [(i, t, len(t) // 3 + rnd.randint(1, 5)) for i, t in enumerate(text() for _ in range(120))]


def _matrix(rows):
    r = rows.select(*TERMS, "tokens").collect()
    return np.array([x[:-1] for x in r], float), np.array([x[-1] for x in r], float)


def test_fit_is_least_squares(spark):
    rows = calibration.samples(spark.createDataFrame(_texts(), SCHEMA))
    x, y = _matrix(rows)
    want, *_ = np.linalg.lstsq(x, y, rcond=None)
    got = calibration.fit(rows)
    assert np.allclose([got[t] for t in TERMS], want, atol=1e-8)


def test_counts_made_by_coefficients_give_them_back(spark):
    made = {"intercept": 2, "word": 3, "long": 1, "digit": 4, "non_ascii": 5, "punct": 6, "newline": 7}
    rows = calibration.samples(spark.createDataFrame(_texts(), SCHEMA)).withColumn("tokens", sum((F.col(t) * v for t, v in made.items()), F.lit(0)))
    assert calibration.fit(rows) == {t: float(v) for t, v in made.items()}
    fitted = calibration.errors(rows, calibration.fit(rows)).filter("estimator = 'fitted'").first()
    assert fitted.mean_abs_pct == 0 and fitted.p95_abs_pct == 0 and fitted.n == 120


def test_errors_against_a_plain_version(spark):
    rows = calibration.samples(spark.createDataFrame(_texts(), SCHEMA))
    coef = calibration.fit(rows)
    x, y = _matrix(rows)
    chars = np.array([r[0] for r in rows.select("n_chars").collect()], float)
    now = np.array([TOKEN_COEF[t] for t in TERMS])
    guess = {"current": np.ceil(np.maximum(1, x @ now)), "fitted": np.maximum(1, x @ np.array([coef[t] for t in TERMS])), "chars_4": chars / 4}
    got = {r.estimator: r for r in calibration.errors(rows, coef).collect()}
    assert set(got) == set(guess)
    for name, p in guess.items():
        rel = (p - y) / y
        in_order = np.sort(np.abs(rel))
        assert abs(got[name].mean_abs_pct - 100 * np.abs(rel).mean()) < 0.006
        assert abs(got[name].median_abs_pct - 100 * in_order[(len(rel) - 1) // 2]) < 0.0051
        assert abs(got[name].p95_abs_pct - 100 * in_order[(len(rel) - 1) * 19 // 20]) < 0.0051
        assert abs(got[name].underestimate_share - (rel < 0).mean()) < 0.0006


def test_nulls_empty_texts_dependent_features_and_nothing(spark):
    data = [(1, None, 4), (2, "a b", None), (3, "a b", 0), (4, "", 2), (5, "a b", 4), (6, "a b c", 5), (6, "a b c", 5)]
    rows = calibration.samples(spark.createDataFrame(data, SCHEMA).withColumn("n_chars", F.lit("clash")).withColumn("a.b", F.lit(1)))
    assert rows.count() == 4 and "a.b" in rows.columns
    coef = calibration.fit(rows)
    assert coef["intercept"] == 2.0 and coef["word"] == 1.0 and not any(coef[t] for t in TERMS[2:])  # no text has the other features
    none = calibration.samples(spark.createDataFrame([], SCHEMA))
    assert not any(calibration.fit(none).values()) and calibration.errors(none, coef).count() == 0
    assert [tuple(r) for r in calibration.density(rows.withColumn("k", F.lit("x")), "k").collect()] == [("x", 3, 1.111)]


def test_tokens_are_counted_once(spark, sf):
    from folioforge.functions.text import count_pieces
    from folioforge.plans import calibration_queries as Q

    texts = ["", " ", "\n", "a", "abcdefg", "  ab12 34567, ...\n\n", "abcdefghijklm0123!", "ğüş ab éèçà\U0001f600x", "\x00\x7f\t", "".join(map(chr, range(300))), None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select(count_pieces(F.col("text"), Q._COUNTED, Q._BETWEEN).alias("got"), F.regexp_count("text", F.lit(Q._PIECES)).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and got[5].want == 10
    plan = calibration.samples(docs.select("text", F.regexp_count("text", F.lit("QX")).alias("tokens")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("QX") == 1
