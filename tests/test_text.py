import math
import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import packing


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def estimate(text):
    """The estimate's definition, written plainly."""
    if not text:
        return 0
    w = re.findall("[A-Za-z]+", text)
    x = [1, len(w), sum(len(i) - 7 for i in w if len(i) > 7), sum(c in "0123456789" for c in text), sum(ord(c) > 127 for c in text), sum(33 <= ord(c) < 127 and not c.isalnum() for c in text), text.count("\n")]
    c = T.TOKEN_COEF
    return max(1, math.ceil(sum(a * b for a, b in zip(x, [c["intercept"], c["word"], c["long"], c["digit"], c["non_ascii"], c["punct"], c["newline"]], strict=True))))


@pytest.mark.parametrize("text", ["", "a", "Gears of normal module 2,5 mm", "αP = 20°\nsee Table 1", "internationalization 12345 | x"])
def test_token_estimate(spark, text):
    assert one(spark, T.token_estimate, text) == estimate(text)


@pytest.mark.parametrize(
    "text, expected",
    [("25° and 1,250 or 007.50", ["1.25", "25", "7.5"]), ("12.5mm", ["12"]), ("12mm", []), ("v1.2 x_3 0 0,0", ["0"]), ("", []), ("1.2.3", ["1.2"])],
)
def test_numbers(spark, text, expected):
    assert one(spark, T.numbers_in, text) == sorted(expected)


def test_normalize(spark):
    assert one(spark, T.normalize_text, "ISO‐1328­1 hy­\nphen \r\n\n\n\nx y\nNot for Resale\n") == "ISO-1328-1 hyphen\n\nx y"


def test_html(spark):
    assert one(spark, T.strip_html, "<p>a &amp;lt; b</p><script>x<y</script>c<br/>d") == " a &lt; b\n c\nd"


def test_sentences(spark):
    assert one(spark, T.sentences, "One two. Three; four: Five! 12 six? no") == ["One two.", "Three; four:", "Five!", "12 six? no"]


def test_page_quality_and_flags(spark):
    assert one(spark, T.page_quality, "") == 0.0
    assert one(spark, T.page_quality, "abc\n") == 1.0
    assert one(spark, T.page_quality, "a" * 99 + "�") == pytest.approx(0.8)
    assert one(spark, lambda c: T.page_quality(c, F.lit("ocr")), "abc") == 0.5
    assert one(spark, lambda c: T.quality_flags(c, F.lit("ocr")), "abc�") == ["ocr", "replacement_chars", "low_text"]


def test_turkish_and_symbols(spark):
    assert one(spark, T.tr_lower, "İIıi") == "iııi"
    assert one(spark, lambda c: T.recover_symbol_font(c, F.lit("SymbolMT")), "arp") == "αρπ"
    assert one(spark, lambda c: T.recover_symbol_font(c, F.lit("Symbol")), "•") == "•"
    assert one(spark, T.slugify, "Dişli çark: ölçüm (2)") == "disli-cark-olcum-2"
    assert one(spark, T.clause_key, "A.1.2") == [101, 1, 2]


def segments(text, size=3000):
    pages, buf = [], ""
    for p in re.split(r"\n\s*\n", text):
        if len(buf) + len(p) > size and buf:
            pages, buf = [*pages, buf], ""
        buf = f"{buf}\n\n{p}" if buf else p
        while len(buf) > 2 * size:
            pages, buf = [*pages, buf[:size]], buf[size:]
    return pages + [buf] if buf else pages


@pytest.mark.parametrize("text", ["", "a\n\nb", "x" * 50, "\n\n".join("p" * k for k in (3, 9, 30, 1, 55, 8)), "a" * 21 + "\n \n" + "b" * 20])
def test_segments(spark, text):
    assert one(spark, lambda c: packing.segments(c, 10), text) == segments(text, 10)


def test_pack_lines(spark):
    lines = ["alpha beta gamma", "", "δ 12,5 (x)", "internationalization of everything", "z"] * 4
    rows = packing.pack_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string"), 30).orderBy("chunk").collect()
    out, cur = [], []
    for x in lines:
        if cur and estimate("\n".join([*cur, x])) > 30:
            out, cur = [*out, "\n".join(cur)], []
        cur.append(x)
    out.append("\n".join(cur))
    assert [r.text for r in rows] == out and [r.tokens for r in rows] == [estimate(t) for t in out]


def test_anchored_windows(spark):
    times = [(k, t) for k, ts in enumerate(([0.0, 59.0, 60.0, 119.9, 200.0], [7.0], [0.0, 50.0, 100.0, 150.0, 199.0, 500.0, 500.0])) for t in ts]
    got = sorted(map(tuple, packing.anchored_windows(spark.createDataFrame(times, "k int, t double"), "k", "t", 60.0).collect()))
    assert got == [(0, 0, 2), (0, 1, 2), (0, 2, 1), (1, 0, 1), (2, 0, 2), (2, 1, 2), (2, 2, 1), (2, 3, 2)]
