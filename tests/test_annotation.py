import random
import re

from pyspark.sql import functions as F

from folioforge.operators import annotation as A


def _plain(text, glossary, generic, most=8):
    """The rule on one text, place by place."""
    low = text.translate(str.maketrans("İI", "iı")).lower()
    taken, edits = [], []
    letter = lambda c: c.isalnum() or c == "_"
    for phrase, term in A.ranked(glossary, generic):
        pattern = re.compile(A.phrase_pattern(phrase).replace(r"[\p{L}\p{N}_]", r"\w"))
        hit = None
        for i in range(len(low)):
            m = pattern.match(low, i)
            if m and not (i and letter(low[i - 1])) and not (m.end() < len(low) and letter(low[m.end()])):
                hit = m
                break
        if hit is None or len(edits) >= most or any(hit.start() < e and s < hit.end() for s, e in taken):
            continue
        taken.append(hit.span())
        end = hit.end()
        while end < len(text) and (text[end].isalnum() or text[end] in "'’"):
            end += 1
        if term.lower() not in text.lower() and not text[end : end + 2].lstrip(" ").startswith("("):
            edits.append((end, term))
    for end, term in sorted(edits, reverse=True):
        text = text[:end] + f" ({term})" + text[end:]
    return text


def _texts():
    rnd = random.Random(5)
    words = [w for k in A.GLOSSARY for w in k.split()] + ["ve", "için", "dişlinin", "basınç açısının", "modülü", "helis açısı'nda", "rulmanlar (", "torque", "Pinyon", "ÇARK", "x_modül"]
    return [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]


def test_against_a_plain_version(spark):
    texts = _texts()
    got = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select(A.annotate_first_use(F.col("t"))).collect()]
    want = [_plain(t, A.GLOSSARY, A.GENERIC) for t in texts]
    assert got == want and sum(a != b for a, b in zip(got, texts, strict=True)) > 30
    assert max(len(g.split(" (")) - len(t.split(" (")) for g, t in zip(got, texts, strict=True)) == 8


def test_cases(spark):
    rows = [
        ("Basınç açısı 20°. basınç açısı yine.", "Basınç açısı (pressure angle) 20°. basınç açısı yine."), ("Basınç açısının değeri", "Basınç açısının (pressure angle) değeri"), ("basınç açısı (pressure angle) 20", "basınç açısı (pressure angle) 20"),
        ("basınç açısı, Pressure Angle demektir", "basınç açısı, Pressure Angle demektir"), ("pinyon (küçük)", "pinyon (küçük)"), ("tablo ve formül", "tablo ve formül"), ("", ""), (None, None), ("düz dişli", "düz dişli (spur gear)"), ("altçark", "altçark"),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", A.annotate_first_use(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == rows
    assert spark.createDataFrame([("a b",)], "t string").select(A.annotate_first_use(F.col("t"), {})).first()[0] == "a b"
    two = spark.createDataFrame([("pinyon çark",)], "t string").select(A.annotate_first_use(F.col("t"), most=1)).first()[0]
    assert two == "pinyon (pinion) çark"


def test_each_phrase_is_looked_for_once(spark):
    texts = ["xund und", "bund", "und", "ünd und", "_und", "1und undes-und", "\U0001d400und und", "avec\n les", "avecles avecx  lesy", "undundund und", "und" + "a" * 70 + " x", "a" * 70 + " und" + "b" * 9]
    for phrase in ("und", "avec les", "kutu", "kutusu", "a.c"):
        old = f"(?<!{A._LETTER}){A.phrase_pattern(phrase)}(?!{A._LETTER})"
        df = spark.createDataFrame([(t.replace("und", phrase),) for t in texts] + [(t,) for t in texts], "t string")
        got = df.select(*[f(F.col("t"), F.lit(p)) for p in (old, A._anchored(phrase)) for f in (F.regexp_instr, F.regexp_substr)]).collect()
        assert all(r[:2] == r[2:] for r in got) and any(r[0] for r in got)
    ends = spark.createDataFrame([("x" + "a" * n + " b",) for n in (0, 62, 63, 64, 65, 200)], "t string").select(A._word_end(F.col("t"), F.lit(2)), F.length("t")).collect()
    assert all(r[0] == r[1] - 1 for r in ends)
    plan = spark.createDataFrame([("und",)], "t string").select(A.annotate_first_use(F.col("t"), {"und": ["x"], "mit": ["y"]}).alias("new"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr") + plan.count("regexpinstr") == 2
