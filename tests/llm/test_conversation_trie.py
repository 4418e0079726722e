import hashlib
import random
import zlib

import pytest

from folioforge.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string, key string"


def plain(rows):
    """Every node from its definition, all nodes against all conversations."""
    turns = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    nodes = {tuple(ts[:d]) for ts in whole.values() for d in range(len(ts) + 1)}
    members = {n: [c for c, ts in whole.items() if tuple(ts[: len(n)]) == n] for n in nodes}
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        ends = sorted(c for c in members[n] if len(whole[c]) == len(n))
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        leaves = sum(not kids[m] for m in below)
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["", "hé", "ok", None, "a longer text"]), "x"))
    rows += [(100, t, "user", f"base {t}", "x") for t in range(3)]  # a base with few turns
    rows += [(c, t, "user", f"same {t}", "x") for c in range(1000, 1040) for t in range(30)]  # a hot first turn, and equal conversations
    rows += [(c, t, "user", f"same {t}" if t < 20 else f"{c} {t}", "x") for c in range(1040, 1060) for t in range(25)]
    rows += [(305, t, "user", "no base", "x") for t in range(4)] + [(-7, 0, "user", "below", "x"), (-7, 1, "user", "zero", "x")]
    rows += [(400, None, "user", "null turn", "x"), (400, 2, "user", "twice", "x"), (400, 2, "user", "twice", "x"), (400, 2, "user", "tie", "x"), (None, 0, "user", "no id", "x")]
    return rows


@pytest.mark.parametrize("part", [1 << 16, 40])
def test_against_plain(spark, monkeypatch, part):
    monkeypatch.setattr(ct, "PART", part)
    rows = made(1)
    got = sorted(map(tuple, ct.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == plain(rows)


def test_hot_first_turns_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART", 40)
    same = [bytes([t]) * 16 for t in range(30)]
    seqs = [(1, 5, same[:k] + [bytes([200 + k]) * 16], [1] * (k + 1)) for k in range(1, 30)]
    df = spark.createDataFrame([(i, m, p, c) for i, (_, m, p, c) in enumerate(seqs)], "least long, many long, path array<binary>, points array<int>")
    tops = {r.least: (r.top, r.size) for r in ct._dealt(df).collect()}
    assert len(tops) == len(seqs) and len({t for t, _ in tops.values()}) > 3  # deeper each round
    assert {t for t, size in tops.values() if t <= size} <= {1, 2, 4, 8, 16, 32}


def test_no_rows(spark):
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = ct.prefix_trie(spark.createDataFrame([(7, 0, "user", "gone", "x")], SCHEMA)).collect()
    assert sorted(map(tuple, only), key=repr) == plain([(7, 0, "user", "gone", "x")])


def test_very_deep_sequences_take_no_recursion():
    trie = ct.PrefixTrie()
    path = [i.to_bytes(16, "big") for i in range(50_000)]
    trie.add(path, [1] * len(path), 1, 3, 9)
    trie.add(path[:10], [1] * 10, 1, 1, 4)
    leaves, saved = trie.sums()
    assert leaves[0] == 1 and trie.members[0] == 4 and trie.least[:11] == [4] * 10 + [9] and saved[0] == 3 * 10 + 2 * 49_990
