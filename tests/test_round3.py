"""Faults that the tables of sf0.001 don't show: rows of the kind that larger tables hold."""

import os
import random

import duckdb
import pytest

from folioforge.operators import ranking, relational
from folioforge.plans import catalog, engine_queries, evidence_queries, lineage, ranking_queries  # noqa: F401 (these register their queries)
from folioforge.plans.tables import NAMES
from tests.parity import same


@pytest.fixture
def tables(spark, sf, tmp_path):
    """A data folder with the given tables in place of those of ``sf``, and a connection that has them as views."""

    def made(**own):
        c = duckdb.connect()
        for n in NAMES:
            path = f"{tmp_path}/{n}.parquet"
            if n in own:
                own[n].coalesce(1).write.parquet(path)
            else:
                os.symlink(f"{sf}/{n}.parquet", path)
            c.sql(f"create view {n} as select * from '{path}{'/*.parquet' if n in own else ''}'")
        return str(tmp_path), c

    return made


def test_flank_tolerances_between_two_steps(spark, sf, tables):
    part = spark.read.parquet(f"{sf}/part.parquet").limit(1).drop("p_partkey", "p_size")
    keys = spark.createDataFrame([(k, s) for k in (484563, 374321, 634163, 673521, 1063845) for s in (1, 10, 25, 50)], "p_partkey long, p_size int")
    folder, duck = tables(part=keys.crossJoin(part))
    same(catalog.QUERIES["calc_flank_tolerance"](spark, folder), duck.sql(catalog.ORACLES["calc_flank_tolerance"]))


def test_labels_keep_the_digits_of_their_line(spark, tables):
    docs = spark.createDataFrame([(1, "Order 40\nRow 31\n  Blanks before 2 \nRow 3333"), (2, "0Ab\n1Cd\n Ef"), (3, ""), (4, None)], "doc_id long, text string")
    folder, duck = tables(documents=docs)
    got = catalog.QUERIES["label_lines"](spark, folder)
    same(got, duck.sql(catalog.ORACLES["label_lines"]))
    assert got.filter("doc_id = 1").first().labels == "Order 40 / Row 31 / Blanks before 2 / Row 3333"


def test_evidence_of_a_run_in_the_order_of_its_texts(spark, tables):
    items = spark.createDataFrame([(i, f"what item {i} states.") for i in (1, 3, 11, 16)], "item_id long, text string")
    docs = spark.createDataFrame([(100 * i + i % 3 + (3 - 100 * i % 3) % 3, f"Here stands what item {i} states, and more.", "en", "s", 1) for i in (1, 3, 11, 16)], "doc_id long, text string, lang string, source string, n_chars long")
    folder, duck = tables(benchmark=items, documents=docs)
    got = catalog.QUERIES["engine_run"](spark, folder)
    same(got, duck.sql(catalog.ORACLES["engine_run"]))
    assert got.filter("evidence like 'item 11@% item 1@%'").limit(1).count() == 1


def test_drafts_are_not_broadcast(spark, sf):
    for name in ("calc_diagnose", "calc_compare"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_phrases_straight_from_the_texts(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("a a a b b c d".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(rng.randint(0, 30)), say(3)) for i in range(60)] + [(60, "", ""), (61, None, "a b")], "doc_id long, text string, title string")
    asked = [(1, 0, ["a", "b"]), (1, 1, ["a", "b"]), (1, 2, ["c"]), (2, 0, ["a", "b"]), (2, 1, ["a", "a", "b", "d"]), (3, 0, ["zzz"]), (4, 0, [])]
    groups = spark.createDataFrame([(*r, True) for r in asked], "qid long, grp int, words array<string>, adjacent boolean")
    parts = {"title": "A", "text": "D"}
    by_covers = ranking.cover_density(ranking.places(docs, parts=parts), groups, top=20)
    straight = ranking.phrase_density(docs, groups, top=20, parts=parts)
    assert "SortMergeJoin" not in straight._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r.qid, r.doc_id): (r.n_covers, round(r.score, 8)) for r in df.collect()} for df in (straight, by_covers))
    assert got == want and len(got) > 30
    assert ranking.phrase_density(docs, groups.limit(0)).count() == 0


def test_chains_write_finished_items_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lineage, "cut", lambda df, label="cut", own=lineage.cut: written.append(own(df, label)) or written[-1])
    items = spark.createDataFrame([(i, None if i % 20 == 0 else i - 1) for i in range(100)] + [(200, 999), (201, 200)], "item_id long, replaces long")
    got = {r.item_id: (r.root, r.depth) for r in relational.chains(items).collect()}
    assert got == {i: (i // 20 * 20, i % 20) for i in range(100)} | {200: (999, 1), 201: (999, 2)}
    assert sum(df.count() for df in written) < 5 * len(got)
    with pytest.raises(ValueError):
        relational.chains(spark.createDataFrame([(1, 2), (2, 1)], items.schema), rounds=4)


def test_postings_are_made_where_their_text_is(spark, sf):
    plan = catalog.QUERIES["index_postings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
