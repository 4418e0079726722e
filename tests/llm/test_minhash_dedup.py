import random

import numpy as np
import pytest

from folioforge.llm import minhash_dedup as md
from folioforge.llm.ngram_join import shingle_sets

SCHEMA = "doc_id long, text string, class string, n long"


def plain(rows):
    """Components from all pairs of sets, by definition."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for sep in "\t\n\x0b\x0c\r":
            low = low.replace(sep, " ")
        ws = [w for w in low.split(" ") if w]
        sets.append({tuple(ws[i : i + 2]) for i in range(len(ws) - 1)} if len(ws) >= 2 else {tuple(ws)} - {()})
    ids = [i for i, _ in rows]
    label = {i: i for i in ids if i is not None}
    pairs = [(ids[i], ids[j]) for i in range(len(rows)) for j in range(i) if None not in (ids[i], ids[j]) and (s := sets[i]) and (t := sets[j]) and 100 * len(s & t) >= 80 * len(s | t)]
    for _ in rows:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return sorted(((i, len(s), label.get(i), None if i is None else label[i] == i) for i, s in zip(ids, sets, strict=True)), key=repr)


def families(seed, many=14, size=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(many):
        base = [word() for _ in range(r.choice([3, 6, 12, 60, 150]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 7))):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own).upper() if r.random() < 0.1 else " ".join(own))
    out += [None, "", " \n", "one", "One", "two words", "two  words"] * 2
    return list(enumerate(out))


@pytest.mark.parametrize("part, sketches", [(1 << 19, 1 << 14), (400, 8)])
def test_against_all_pairs(spark, monkeypatch, part, sketches):
    monkeypatch.setattr(md, "PART", part)
    monkeypatch.setattr(md, "SKETCHES", sketches)
    rows = families(5) + [(None, "no id"), (None, "no id")]
    rows += rows[:3]  # repeated rows
    want = plain(rows)
    assert len({c for _, _, c, _ in want}) > 60
    got = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, md.near_duplicates(got).collect()), key=repr) == want


def test_empty_table(spark):
    assert md.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = md.near_duplicates(spark.createDataFrame([(1, None, "x", 0), (2, " ", "x", 0)], SCHEMA)).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_threshold_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert md.links(a[:8], np.arange(10, dtype=np.uint64)) and md.links(a[:4], a[:5]) and not md.links(a[:3], a[:4]) and not md.links(a[:0], a[:0])
    assert not md.links(np.arange(89, dtype=np.uint64), np.arange(10, 99, dtype=np.uint64)) and md.links(np.arange(90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64))


def test_sketches_estimate_high_similarities():
    r = np.random.default_rng(1)
    for similar in (0.7, 0.8, 0.9, 0.95):
        errors, bands = [], 0
        for _ in range(60):
            n = 400
            both = round(2 * n * similar / (1 + similar))
            x = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = md.samples(np.sort(x[:n])), md.samples(np.sort(x[n - both :]))
            ones = int(np.bitwise_count(md.odd_sketch(a).view(np.uint64) ^ md.odd_sketch(b).view(np.uint64)).sum())
            errors.append(float(md.estimate(ones)) - both / (2 * n - both))
            bands += bool((md.bands(a) == md.bands(b)).any())
            assert similar < 0.8 or ones <= md.MOST_ONES
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
        assert similar < 0.8 or bands == 60


def test_sets_are_two_word_shingles():
    import pyarrow as pa

    sizes = [len(s) for s in shingle_sets(pa.array(["a b a b", "A", "", None, "a b c"]), md.SIZE)]
    assert sizes == [2, 1, 0, 0, 2]
