from pyspark.sql import functions as F

from folioforge.operators import context

UNIT = "doc_id long, section int, ord int, kind string, label string, text string, lead_in string, see_also string, review string"
GLOSSARY = "doc_id long, symbol string, description string, unit string, source string"
CHUNK = "doc_id long, idx int, title string, path array<string>, ords array<int>"


def _units():
    long = "First the teeth are counted. " * 30 + "The diameter is given by"
    return [
        (1, 1, 0, "paragraph", None, "Text", None, None, None),
        (1, 1, 1, "formula", "1", "d = z m_n / cos β", "The diameter is given by", None, None),
        (1, 1, 2, "formula", "2", "d_b = d cos α", long, "see also 4.2", "uncertain glyph"),
        (1, 1, 3, "legend", None, "where d is the reference diameter, mm\nz is the number of teeth\nnothing", None, None, None),
        (1, 1, 4, "formula", "3", "h = sin(x) + q", None, None, None),
        (1, 1, 5, "paragraph", None, "q is the load", None, None, None),
        (1, 2, 6, "table", "2", "| Item | Value |\n| hfP | 1,25 m |\n| a very long symbol cell | 1 |\n| x | 2 |", None, None, None),
        (1, 2, 7, "table", "3", "| Symbol | Meaning |\n| hfP | dedendum |", None, None, None),
        (1, 2, 8, "formula", None, None, None, None, None),
        (2, 1, 0, "formula", "1", "d = 1", "", None, None),
    ]


def _glossary():
    return [(1, "m_n", "normal module", "mm", "table"), (1, "β", "helix angle", "°", "table"), (1, "d", "another d", None, "table"), (1, "hfP", "dedendum of the rack", "mm", "table"), (1, "x", "", None, "table"), (1, "m_n", "zz", None, "a"), (None, "q", "nowhere", None, None)]


def test_formula_pieces(spark):
    got = {(r.doc_id, r.ord): r for r in context.formula_pieces(spark.createDataFrame(_units(), UNIT).withColumn("a.b", F.lit(1)), spark.createDataFrame(_glossary(), GLOSSARY)).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 4), (1, 8), (2, 0)}
    one, two = got[1, 1], got[1, 2]
    assert one.symbols == ["d", "z", "m_n", "β"] and one.legend == two.legend and one.legend.startswith("where d") and got[1, 4].legend is None and got[2, 0].legend is None
    assert [(v.symbol, v.description, v.unit, v.source) for v in one.variables] == [("d", "reference diameter", "mm", "legend"), ("z", "number of teeth", None, "legend"), ("m_n", "normal module", "mm", "table"), ("β", "helix angle", "°", "table")]
    assert one.text.split("\n")[:2] == ["The diameter is given by", "d = z m_n / cos β"] and two.lead == "… The diameter is given by" and two.text.endswith("see also 4.2")
    assert got[1, 4].symbols == ["h", "x", "q"] and got[1, 8].symbols == [] and got[1, 8].text == "" and got[2, 0].text == "d = 1" and got[2, 0].variables == []


def test_tables(spark):
    got = {r.ord: r for r in context.table_facts(spark.createDataFrame(_units(), UNIT), spark.createDataFrame(_glossary(), GLOSSARY)).collect()}
    assert got[6].columns == ["Item", "Value"] and got[6].symbols == ["hfP", "x"] and [v.symbol for v in got[6].meanings] == ["hfP", "x"]
    assert got[7].symbols == ["hfP"] and got[7].meanings == []


def test_chunk_context(spark):
    units, glossary = spark.createDataFrame(_units(), UNIT), spark.createDataFrame(_glossary(), GLOSSARY)
    chunks = [(1, 0, "ISO 53", ["4 Gears", "4.2 Diameters"], [0, 1, 2, 3]), (1, 1, "ISO 53", None, [6, 7]), (1, 2, "ISO 53", [], [0]), (1, 3, None, ["4"], []), (2, 0, "X", ["1"], None)]
    pieces, tables = context.formula_pieces(units, glossary), context.table_facts(units, glossary)
    got = {(r.doc_id, r.idx): r for r in context.chunk_context(spark.createDataFrame(chunks, CHUNK), pieces, tables).collect()}
    a, b = got[1, 0], got[1, 1]
    assert len(got) == 5
    assert a.context.split("\n") == ["ISO 53 › 4 Gears › 4.2 Diameters", "d: reference diameter [mm]", "z: number of teeth", "m_n: normal module [mm]", "β: helix angle [°]"]
    assert a.symbols == ["d", "z", "m_n", "β", "d_b", "α"] and a.units == ["mm", "°"] and a.equations == ["1", "2"] and a.reasons == ["formula (2): uncertain glyph"]
    assert b.context.split("\n") == ["ISO 53", "Columns: Item | Value", "hfP: dedendum of the rack [mm]"] and b.symbols == ["hfP", "x"] and b.reasons == []
    assert got[1, 2].context == "ISO 53" and got[1, 3].context == "4" and got[2, 0].context == "X › 1" and got[2, 0].symbols == []
    few = context.chunk_context(spark.createDataFrame(chunks, CHUNK), pieces, tables, most_lines=2, most_symbols=3).filter("doc_id = 1 and idx = 0").first()
    assert few.context.count("\n") == 1 and few.symbols == ["d", "z", "m_n"]


def test_nothing(spark):
    units, glossary = spark.createDataFrame([], UNIT), spark.createDataFrame([], GLOSSARY)
    pieces, tables = context.formula_pieces(units, glossary), context.table_facts(units, glossary)
    assert pieces.count() == tables.count() == 0 and context.chunk_context(spark.createDataFrame([], CHUNK), pieces, tables).count() == 0
