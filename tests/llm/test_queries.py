import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioforge.llm import arrow_text, decontam, langid, line_dedup, mixing, queries
from folioforge.plans.tables import table
from tests.llm.test_methods import links, plain_language, shingles
from tests.parity import same


def least_edits(item, text):
    """Least edits of the item anywhere in the text, by the whole table, a row at a time."""
    t = np.frombuffer(text, np.uint8)
    row = np.zeros(len(t) + 1, np.int64)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != c))
        new[0] = i
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    same(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))


def test_line_dedup_by_join_matches_sql(spark, sf, duck):
    same(line_dedup.line_dedup(table(spark, sf, "documents"), broadcast_rows=0), duck.sql(line_dedup.ORACLE))


@pytest.mark.parametrize("name, truth, floor", [("op2_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, truth, floor):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got[truth]).mean() >= floor


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op3_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain0", "fr", "c", 1000), ("domain1", "en", "d", 1000)], "domain string, lang string, source string, avail long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, share=0.5, max_epochs=1).collect()}
    total = 1505  # half of all tokens: 4:3 between the domains, 860 and 645; en:fr as 4:2, 573 and 286; source a has only 10, b gets the rest
    assert got == {"a": 10, "b": 563, "c": 286, "d": 645} and abs(sum(got.values()) - total) <= 4


def test_pipeline_stages_against_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf)
        if name != "source_mixing":
            assert now.columns == docs.columns
        a, b = before.toPandas().sort_values("doc_id"), now.toPandas().sort_values("doc_id")
        if name == "language_id":
            model = langid.fit(docs)
            told = {i: (*plain_language(t, model), c) for i, t, c in zip(a.doc_id, a.text, a.lang, strict=True)}
            kept = {i: lang if c is None or s >= langid.SURE else c for i, (lang, s, c) in told.items() if lang != "und" and s >= langid.LEAST}
            assert dict(zip(b.doc_id, b.lang, strict=True)) == kept and len(b) >= 0.98 * len(a)
        if name == "line_dedup":
            held, total = {}, a.groupby("source").text.nunique()
            for s, t in set(zip(a.source, a.text, strict=True)):
                for line in {x.strip() for x in t.split("\n")} - {""}:
                    held[s, line] = held.get((s, line), 0) + 1
            gone = {k for k, n in held.items() if n >= line_dedup.MIN_PAGES and n > total[k[0]] * line_dedup.MAX_RATIO}
            want = ["\n".join(x for x in t.split("\n") if (s, x.strip()) not in gone) for s, t in zip(a.source, a.text, strict=True)]
            assert b.text.tolist() == want and b.n_chars.tolist() == [len(t) if t != o else n for t, o, n in zip(want, a.text, a.n_chars, strict=True)]
        if name == "ngram_jaccard_join":
            sets, label = [shingles(t) for t in a.text], list(a.doc_id)
            near = links(sets)
            for _ in range(len(sets)):
                last = list(label)
                for i, j in near:
                    label[i] = label[j] = min(label[i], label[j])
                if label == last:
                    break
            assert sorted(b.doc_id) == sorted(i for i, c in zip(a.doc_id, label, strict=True) if i == c)
        if name == "decontamination":
            items = table(spark, sf, "benchmark").toPandas()
            index = decontam.Index(items.item_id.tolist(), items.text.tolist())
            few = a.head(60)
            raw, off = arrow_text.fold(*arrow_text.utf8(pa.array(few.text.tolist())))
            texts = [raw[off[k] : off[k + 1] - 1].tobytes() for k in range(len(few))]
            leaked = {i for i, t in zip(few.doc_id, texts, strict=True) if any(least_edits(x, t) <= m for x, m in zip(index.items[:6], index.budget, strict=False))}
            whole = {i for i, t in zip(few.doc_id, texts, strict=True) if any(x in t for x in index.items)}
            assert not (leaked | whole) & set(b.doc_id) and set(b.doc_id) <= set(a.doc_id)
            clean = {i for i, t in zip(few.doc_id, texts, strict=True) if len(t) < 400 and all(least_edits(x, t) > m for x, m in zip(index.items, index.budget, strict=True))}
            assert clean <= set(b.doc_id)
        if name == "source_mixing":
            import duckdb

            relation = a[["doc_id", "text", "lang", "source"]]  # noqa: F841 (DuckDB finds it by name)
            want = duckdb.sql(mixing.oracle("relation")).fetchall()
            assert sorted(want) == sorted(b[["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]].itertuples(index=False, name=None))
        now = spark.createDataFrame(now.collect(), now.schema)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
