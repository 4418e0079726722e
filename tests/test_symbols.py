import random

from pyspark.sql import functions as F

from folioforge.operators import symbols

LEXICON = {"haP", "hfP", "hFfP", "cP", "da", "df", "mn"}


def test_lexicon(spark):
    rows = [(1, "haP hfP hFfP cP da df mn and a basic rack"), (1, "αP, x9 Rack ABC of Toolong7"), (2, "plain Words only here"), (3, None), (4, "")]
    got = {r.doc_id: set(r.symbols) for r in symbols.lexicon(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: LEXICON | {"αP", "x9"}}


def test_rejoining():
    assert symbols.rejoined("| h aP | 1 m |", LEXICON) == "| haP | 1 m |"
    assert symbols.rejoined("h FfP and d a", LEXICON) == "hFfP and da"
    assert symbols.rejoined("a n example", LEXICON | {"an"}) == "a n example" and symbols.rejoined("x yz", LEXICON) == "x yz"
    assert symbols.rejoined("d F a", {"Fa", "dFa"}) == "dFa" and symbols.rejoined("x h aP", LEXICON) == "x haP"
    assert symbols.rejoined("a b c", {"ab", "bc"}) == "ab c" and symbols.rejoined("d  a, d\na", LEXICON) == "d  a, d\na"


def test_rejoining_against_single_steps():
    """One join at a time, the first that is possible in the text as it stands when a pass began."""
    r = random.Random(4)
    for _ in range(400):
        known = {"".join(r.choice("abC") for _ in range(r.randint(2, 4))) for _ in range(6)} - {"Cab"}
        text = " ".join("".join(r.choice("abC") for _ in range(r.choice([1, 1, 1, 2, 3]))) for _ in range(8))
        tokens = text.split(" ")
        while True:
            out, i, changed = [], 0, False
            while i < len(tokens):
                joined = tokens[i] + tokens[i + 1] if i + 1 < len(tokens) and len(tokens[i]) == 1 and len(tokens[i + 1]) <= 4 else None
                if joined in known and joined.lower() not in symbols.WORDS:
                    out.append(joined)
                    i, changed = i + 2, True
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
            if not changed:
                break
        assert symbols.rejoined(text, known) == " ".join(tokens)


def test_pages_use_their_own_document(spark):
    rows = [(1, 1, "haP"), (1, 2, "h aP"), (2, 1, "h aP"), (3, 1, None), (None, 1, "h aP haP")]
    out = symbols.rejoin(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    assert out.columns == ["doc_id", "page", "text"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 1, "haP"), (1, 2, "haP"), (2, 1, "h aP"), (3, 1, None), (None, 1, "h aP haP")], key=repr)
    assert symbols.rejoin(out.filter(F.lit(False))).count() == 0
