import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long"


def plain(rows, least):
    """Collocations of (text, lang) rows by plain dictionaries, with integers of any size."""
    count, n = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(ws)
            for d in range(1, 6):
                for i in range(len(ws) - d + 1):
                    key = lang, tuple(ws[i : i + d])
                    count[key] = count.get(key, 0) + 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(q != p and len(q) > len(p) and m == lang and c >= least and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (m, q), c in count.items())
        if not inside:
            ways = [(1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(ways)
            found.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], n[lang], s))
    return sorted((lang, i, *x[3:]) for lang, xs in found.items() for i, x in enumerate(sorted(xs), 1))


def mined(spark, rows, monkeypatch, least, shard=None):
    monkeypatch.setattr(phrases, "LEAST", least)
    if shard:
        monkeypatch.setattr(phrases, "SHARD", shard)
    df = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, phrases.collocations(df).collect()))


def test_against_plain(spark, monkeypatch):
    r = random.Random(3)
    words = "the a of cat CAT Ünal dog x-1 zeta été".split()
    rows = []
    for i in range(60):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(r.randint(0, 60)))
        rows.append((text, r.choice(["en", "de", None, "und"])))
    rows += [("", "en"), (None, "en"), ("...", None), ("one", "xx")] + [("New York state of mind", "en")] * 9
    want = plain(rows, 5)
    assert len(want) > 20 and {w[0] for w in want} >= {"en", "de", "und"}
    assert mined(spark, rows, monkeypatch, 5) == want


def test_repeats_overlap_and_containment(spark, monkeypatch):
    rows = [("a a a a a a a", "en")] * 2 + [("b c d", "en")] * 4 + [("b c", "en"), ("x\x01 y", "en"), ("x y", "en"), ("x y", "en"), ("x\x01 y", "en")]
    assert mined(spark, rows, monkeypatch, 2) == plain(rows, 2)


def test_ranks_stop_at_the_first(spark, monkeypatch):
    rows = [(f"p{i} q{i}. r{i} s{i}", "en") for i in range(8)] * 2
    monkeypatch.setattr(phrases, "LEAST", 2)
    df = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, phrases.collocations(df, first=5).collect()))
    assert got == plain(rows, 2)[:5]  # all tie: by phrase


def test_empty_table(spark, monkeypatch):
    assert mined(spark, [], monkeypatch, 2) == [] and mined(spark, [(None, None), ("", "en")], monkeypatch, 2) == []


def test_other_columns_may_clash(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 2)
    df = spark.createDataFrame([("k l", "en", 1, 2, "x")] * 3, "text string, lang string, key long, many long, `a.b` string")
    assert [tuple(r) for r in phrases.collocations(df).collect()] == [("en", 1, "k l", 3, 3, 3, 6, 2000)]


@pytest.mark.parametrize("size", [1, 40, 1 << 22])
def test_tries_of_any_shards_add_up(size):
    texts = ["a b c a b", "A b, c", None, "", "c" * 50 + " b c", "b"]
    whole = {}
    for shard in _shards_of(texts, size):
        rows = phrases.CountTrie(shard, np.ones(len(shard.hash), bool), shard.joined, np.ones(len(shard.hash), bool)).rows()
        assert rows == sorted(rows)
        for _, p, n in rows:
            whole[p] = whole.get(p, 0) + n
    assert whole["a b"] == 3 and whole["b c"] == 2 and whole["a b c a b"] == 1 and "b c b" not in whole and whole["c"] == 3


def _shards_of(texts, size):
    old, phrases.SHARD = phrases.SHARD, size
    try:
        yield from phrases._shards(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(["en"] * len(texts))], names=["text", "lang"])]))
    finally:
        phrases.SHARD = old


@pytest.mark.parametrize("size", [1, 1 << 22])
def test_edges_are_the_nodes_of_the_spelled_trie(size):
    for shard in _shards_of(["a b c a b c", "A b, c", None, "", "b c a b"], size):
        trie = phrases.CountTrie(shard, np.ones(len(shard.hash), bool), shard.joined, np.ones(len(shard.hash), bool))
        for depth in range(2, phrases.LONGEST + 1):
            parent, word, many = trie.edges(depth)
            keys = phrases._edge_key(parent, word)
            assert len(set(keys.tolist())) == len(keys)
            assert sorted(many.tolist()) == sorted(n for _, p, n in trie.rows() if p.count(" ") == depth - 1)


def _made(spark, monkeypatch, rows):
    """Collocations, the rows that the passes over the texts give out with letters, and the most that one of them gives out."""
    frame = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate(rows)], SCHEMA)
    kind, passes = type(frame), []
    plainly = kind.mapInArrow

    def counting(df, fn, schema, *more):
        if df.columns != ["text", "lang"]:
            return plainly(df, fn, schema, *more)
        n = spark.sparkContext.accumulator(0)
        passes.append((n, "phrase string" in schema or "word string" in schema))

        def run(batches):
            for batch in fn(batches):
                n.add(batch.num_rows)
                yield batch

        return plainly(df, run, schema, *more)

    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", counting)
        got = sorted(map(tuple, phrases.collocations(frame).collect()))
    return got, sum(n.value for n, letters in passes if letters), max(n.value for n, _ in passes)


def test_letters_given_out_grow_with_the_input(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    likely = [1 / (i + 1) for i in range(60)]
    rows = [(" ".join(r.choices(words, likely, k=30)), r.choice(["en", "de"])) for _ in range(400)]
    monkeypatch.setattr(phrases, "LEAST", 12)
    monkeypatch.setattr(phrases, "SHARD", 1)
    few, small, _ = _made(spark, monkeypatch, rows[:80])
    assert few == plain(rows[:80], 12)
    many, large, most = _made(spark, monkeypatch, rows)
    assert len(many) > 8 * len(few) and large <= 5.5 * small and most <= 30 * len(rows)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)  # nodes and words meet by shuffles
    assert _made(spark, monkeypatch, rows)[0] == many
