"""N-gram Jaccard join on 5-word shingles by prefix trees over globally ordered sets.

Semantics.  Words are runs without ASCII white space, A-Z lower-cased.  A set
holds the distinct 5-word shingles of a text (a shorter text is one shingle).
Two documents link when ``100 * |A and B| >= 80 * |A or B|``; the result has each
document's set size and the least ``doc_id`` that links reach.

The join is ``Trie``: the sets of a part are stored in the global order (rare
shingles first) as a tree, a query walks it once for all sets that share a
path, and leaves a subtree as soon as the overlap so far plus the most that can
follow is below what the subtree's smallest set needs.  Only links between
components that the part hasn't joined yet leave it, so what it gives out grows
with its sets and not with their pairs.

Plan.  (1) One pass fingerprints each set, counts shingles in a fixed-width
sketch that covers all rows, and takes each set's least shingle under two seeded
orders.  Exact copies are one class from here on.  (2) First deal: classes go to
tries by those two shingles; this finds most links cheaply, but not all.
(3) Every class posts the prefix that any partner must share several shingles
with; postings are dealt by shingle, those without another class of a size that
can link are dropped while streaming, then those of classes that share too few
with every size of partner.  (4) Second deal, which makes the result complete: a
shingle whose classes lie in more than one component sends them to the trie of
the largest of these.  There all classes outside that component
query, so any link that is still missing is found: its sets share such a shingle.

Skew.  A part holds about ``PART`` keys; a larger group is split by hash, and
then queries (first deal: the group's leader) visit each of its parts.

Defined cases: null or blank text gives the empty set, size 0, linked with
nothing; repeated rows link to themselves; a null ``doc_id`` takes no part in
links and returns a null component; very long texts are shingled whole; sets of
the threshold's exact similarity link; other columns are ignored; an empty table
gives no rows.  ``doc_id`` is otherwise taken to identify a text.  Shingles and
sets are known by 64-bit hashes (of 10^9 different sets, two would be taken for
one with a chance of about 3 %).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import keys64, mix64, release, slices, utf8, word_hashes, words
from folioforge.operators.graph import connected_components
from folioforge.plans.lineage import broadcast_if_small, cut, drop

#: Sketch width and the counters of one block; both fixed, whatever the input.
WIDTH, BLOCK = 1 << 22, 1 << 14
#: Shingles that the longer prefixes of linked sets must share (the l-prefix scheme), where sets are large enough.
SHARED = 6
#: Keys that one trie holds, about.
PART = 1 << 19
#: Bytes of text shingled at once.
SLICE = 1 << 19
#: Most bits of a Bloom filter of wanted ids (16 MB); fuller filters only let more sets through to the exact joins.
MOST_BITS = 1 << 27
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000
NUM, DEN = 80, 100
#: Sets of fewer shingles link only with their copies.
SMALLEST = 4
#: Length classes between the sizes of the smallest and the largest set that may link with one.
STEPS = 4
#: Seeds of the first deal's two orders.
SEEDS = (np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0x27D4EB2F165667C5))


def _need(n: int) -> int:
    """Least overlap of a set of n with any partner: ceil(n * NUM / DEN)."""
    return -(-n * NUM // DEN)


def _prefix(n: int) -> int:
    """Length of the prefix that holds SHARED of any partner's shingles, where sets are large enough."""
    return n - _need(n) + min(SHARED, _need(n))


def _length_class(n: Column) -> Column:
    """Four classes between a size and the largest partner's."""
    return F.floor(F.log(n) * (STEPS / np.log(DEN / NUM))).cast("int")


def _least_shared(n: Column, s: Column) -> Column:
    """Prefix shingles that a set of n shares at least with a linked one of length class s; null if none of that class can link.

    Behind the prefix that ends first in the global order lie need - SHARED
    shingles of its set, so the overlap is at most those shared plus that many.
    For a partner of size m this bound rises up to m = n and falls from there:
    its least value is at an end of the class.  Rounded down, for safety.
    """
    size = lambda c: F.exp(c * (np.log(DEN / NUM) / STEPS))
    low, high = F.greatest(size(s), n * (NUM / DEN)), F.least(size(s + 1), n * (DEN / NUM))
    bound = lambda m: (n + m) * (NUM / (NUM + DEN)) - F.greatest(n, m) * (NUM / DEN) + F.least(F.lit(float(SHARED)), n * (NUM / DEN) ** 2) - 1.5
    return F.when(low <= high * 1.001, F.greatest(F.lit(1.0), F.floor(F.least(bound(low), bound(high)))))


# ---------------------------------------------------------------- sets


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw_all, off_all = utf8(column)
    mult = keys64(size, 99)
    for i, j in slices(off_all, SLICE):
        raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
        starts, ends, first = words(raw, off)
        h = word_hashes(raw, starts, ends)
        total = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size if len(total) else 0):
            total += h[k : k + len(total)] * mult[k]
        total = mix64(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(total[a : b - size + 1])
            elif b > a:
                yield mix64(np.array([(h[a:b] * mult[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """The fingerprint of a set, by which exact copies are one class."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shingle(s: np.ndarray, k: int) -> int:
    """The least shingle of a set under the k-th seeded order."""
    return int(mix64(s ^ SEEDS[k]).min().astype(np.int64))


def ordered_keys(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys whose integer order is the global order: estimated frequency, then hash."""
    q = levels[(s >> np.uint64(42)).astype(np.int64)].astype(np.uint64)
    return np.sort((q << np.uint64(57)) | (s >> np.uint64(7))).astype(np.int64)


FACTS = "doc_id long, n long, class long, first long, second long, block int, counts binary"


def _pass_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each set, and at the end the task's part of the sketch in compressed blocks."""
    sketch = np.zeros(WIDTH, np.uint32)
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    names = ["doc_id", "n", "class", "first", "second", "block", "counts"]
    marked = False

    def add(held: list[np.ndarray]) -> None:
        at, many = np.unique(np.concatenate(held), return_counts=True)
        sketch[at] += many.astype(np.uint32)

    for batch in batches:
        facts: list[tuple] = []
        held, kept = [], 0
        for s in shingle_sets(batch.column(1)):
            facts.append((len(s), class_of(s), least_shingle(s, 0), least_shingle(s, 1)) if len(s) else (0, None, None, None))
            held.append((s >> np.uint64(42)).astype(np.int32))
            kept += len(s)
            if kept > 1 << 18:
                add(held)
                held, kept = [], 0
        if kept:
            add(held)
        if facts:
            cols = [pa.array(c, pa.int64()) for c in zip(*facts, strict=True)]
            marks = [batch.column(2)] if batch.num_columns > 2 else []
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols, pa.nulls(len(facts), types[5]), pa.nulls(len(facts), types[6]), *marks], names=[*names, "mark"][: 7 + len(marks)])
            marked = bool(marks)
    for b in range(WIDTH // BLOCK):
        part = sketch[b * BLOCK : (b + 1) * BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:5]), pa.array([b], types[5]), pa.array([zlib.compress(part.tobytes(), 1)], types[6]), *[pa.nulls(1, pa.int64())] * marked], names=[*names, "mark"][: 7 + marked])
    release()


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(c), np.uint32)
            total[b] = total[b] + part if b in total else part.astype(np.int64)
    for b, c in total.items():
        level = np.minimum(63, 2 * np.log2(c + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])


def _frequency_levels(blocks: DataFrame) -> np.ndarray:
    """The whole sketch as one byte a counter, WIDTH bytes whatever the input."""
    levels = np.zeros(WIDTH, np.uint8)
    for r in blocks.repartition("block").mapInArrow(_add_blocks, "block int, levels binary").collect():
        levels[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.levels, np.uint8)
    return levels


# ---------------------------------------------------------------- the trie


class Trie:
    """Sets of ordered keys as a tree; level k holds the keys between two of the strides 0, 16, 32, 64, ...

    Sets that agree up to a stride's end share its node.  Keys are numbered
    within the trie; shorter segments are filled with a number no query holds.
    """

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        off = np.concatenate(([0], np.cumsum(size)))
        self.vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = ids.astype(np.int32)
        self.mark = np.zeros(len(self.vocabulary) + 1, np.uint8)
        big = ids.astype(">u4")
        row = np.array(sorted(range(len(sets)), key=lambda i: big[off[i] : off[i + 1]].tobytes()), np.int64)
        size, first = size[row], off[row]
        node = np.zeros(len(row), np.int64)  # the node of the level before
        self.levels = []
        begin, end = 0, 16
        while len(row):
            place = np.arange(begin, min(end, int(size.max())))[None, :]
            seg = np.where(place < size[:, None], ids[np.minimum(first[:, None] + place, len(ids) - 1)], len(self.vocabulary))
            new = np.ones(len(row), bool)
            new[1:] = (node[1:] != node[:-1]) | (seg[1:] != seg[:-1]).any(axis=1)
            lead = np.flatnonzero(new)
            own = np.cumsum(new) - 1
            over = size <= end
            level = {"seg": seg[lead], "parent": node[lead], "last": seg[lead, -1], "end": end}
            level["least"], level["most"] = np.minimum.reduceat(size, lead), np.maximum.reduceat(size, lead)
            level["done"], level["done_node"], level["done_size"] = row[over], own[over], size[over]
            self.levels.append(level)
            row, size, first, node = row[~over], size[~over], first[~over], own[~over]
            begin, end = end, 2 * end

    def links(self, query: np.ndarray) -> list[int]:
        """Numbers of the stored sets that link with ``query``."""
        n, mark = len(query), self.mark
        at = np.minimum(np.searchsorted(self.vocabulary, query), len(self.vocabulary) - 1)
        known = at[self.vocabulary[at] == query]
        if len(known) < _need(n):
            return []
        mark[known] = 1
        found: list[int] = []
        alive = have = None
        for level in self.levels:
            nodes = np.arange(len(level["seg"])) if alive is None else np.flatnonzero(alive[level["parent"]])
            if not len(nodes):
                break
            here = mark[level["seg"][nodes]].sum(axis=1, dtype=np.int64)
            if have is not None:
                here += have[level["parent"][nodes]]
            have, seen = np.zeros(len(level["seg"]), np.int64), np.zeros(len(level["seg"]), bool)
            have[nodes], seen[nodes] = here, True
            e = level["done_node"]
            linked = seen[e] & (have[e] * (NUM + DEN) >= NUM * (n + level["done_size"]))
            found += level["done"][linked].tolist()
            follow = np.minimum(len(known) - np.searchsorted(known, level["last"][nodes], "right"), level["most"][nodes] - level["end"])
            keep = (here + follow) * (NUM + DEN) >= NUM * (n + level["least"][nodes])
            alive = np.zeros(len(level["seg"]), bool)
            alive[nodes[keep]] = True
        mark[known] = 0
        return found


def trie_links(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Indexes of the sets that link with ``query``."""
    return Trie(sets).links(query) if sets and len(query) else []


class _Joined:
    """Components within one part."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return a != b


def _meet(first_deal: bool):
    """Trie join of the parts of a deal: rows (group, part, role, class, comp, keys) in (group, part, role) order, links (a, b) between components out.

    First deal: each stored set that nothing has linked yet queries.  Second
    deal: roles 0 and 1 are stored, then roles 1 and 2, the classes outside the
    group's component, query, unless the part has joined them to it.
    """

    def part_of(stored: dict[int, tuple[int, np.ndarray]]) -> tuple[list[int], Trie]:
        return [c for c, _ in stored.values()], Trie([k for _, k in stored.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stored, asking, trie, comps, joined = None, {}, set(), None, [], _Joined()
        out: list[tuple[int, int]] = []

        def ask(comp: int, keys: np.ndarray) -> None:
            for i in trie.links(keys):
                if comps[i] != comp and joined.join(comp, comps[i]):
                    out.append((comp, comps[i]))

        def built() -> None:
            """The trie of the part, and the queries of its own sets."""
            nonlocal trie, comps
            if trie is None and len(stored) > 1:
                comps, trie = part_of(stored)
                for own, (comp, keys) in stored.items():
                    if comp not in joined.up if first_deal else own in asking and joined.root(comp) != joined.root(place[0]):
                        ask(comp, keys)

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out.clear()

        for batch in batches:
            off, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            for r, (group, part, role, own, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if (group, part) != place:
                    built()
                    place, stored, asking, trie, joined = (group, part), {}, set(), None, _Joined()
                if role < 2:
                    stored.setdefault(own, (comp, flat[off[r] : off[r + 1]].copy()))
                    asking |= {own} if role == 1 else set()
                elif stored:
                    built()
                    if trie is None:
                        comps, trie = part_of(stored)
                    if joined.root(comp) != joined.root(group):
                        ask(comp, flat[off[r] : off[r + 1]])
            yield from told()
        built()
        yield from told()
        release()

    return run


# ---------------------------------------------------------------- wanted sets


class Bloom:
    """Ids that are wanted for something (``salt``), and about one of 400 others: built in the tasks, joined by blocks, of a bounded size."""

    STEP, HASHES = 1 << 15, 4

    def __init__(self, wanted: DataFrame):
        """``wanted(id, salt)``."""
        n = wanted.count()
        self.log = log = max(20, min((16 * n).bit_length(), MOST_BITS.bit_length() - 1))
        step, places, kind = self.STEP, self.places, "block int, bits binary"

        def rows(blocks: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            for k, x in blocks.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x], pa.binary())], names=["block", "bits"])

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (log - 3), np.uint8)
            for batch in batches:
                for at in places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), log):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield from rows({k: zlib.compress(bits[k * step : (k + 1) * step].tobytes(), 1) for k in range(-(-len(bits) // step)) if bits[k * step : (k + 1) * step].any()})

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(zlib.decompress(x), np.uint8)
                    total[k] = total[k] | part if k in total else part
            yield from rows({k: x.tobytes() for k, x in total.items()})

        self.bits = np.zeros(1 << (log - 3), np.uint8)
        for r in wanted.select("id", F.col("salt").cast("long")).mapInArrow(own, kind).repartition("block").mapInArrow(joined, kind).collect():  # MOST_BITS at most
            self.bits[r.block * step : (r.block + 1) * step] = np.frombuffer(r.bits, np.uint8)

    @classmethod
    def places(cls, ids: np.ndarray, salts: np.ndarray | int, log: int) -> Iterator[np.ndarray]:
        """The bits of each id."""
        h = mix64(mix64(ids.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salts, np.uint64))
        for k in range(cls.HASHES):
            yield (mix64(h + np.uint64(k)) >> np.uint64(64 - log)).astype(np.int64)

    def holds(self, ids: np.ndarray, salt: int) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self.places(ids, salt, self.log):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _wanted_sets(levels: np.ndarray, bloom: Bloom, first_deal: bool):
    """Keys of the documents that the filter holds; for the first deal, once for each wanted order, with that order's least shingle."""
    names = ["group", "class", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            ids = known.column(0).to_numpy()
            held = [bloom.holds(ids, k) for k in ((0, 1) if first_deal else (0,))]
            some = held[0] | held[-1]
            chosen = known.filter(pa.array(some))
            held = [h[some].tolist() for h in held]
            rows, kept = [], 0
            for r, s in enumerate(shingle_sets(chosen.column(1))):
                keys, own = ordered_keys(s, levels), class_of(s)
                for k, h in enumerate(held):
                    if h[r] and len(s):
                        rows.append((least_shingle(s, k) if first_deal else 0, own, keys))
                        kept += len(keys)
                if kept > 1 << 18:
                    yield _packed(rows, names)
                    rows, kept = [], 0
            if rows:
                yield _packed(rows, names)
        release()

    return run


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    group, own, keys = zip(*rows, strict=True)
    off = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
    arrays = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys)))
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(own, pa.int64()), arrays], names=names)


# ---------------------------------------------------------------- the two deals


def _split(weights: DataFrame) -> DataFrame:
    """``(group, parts)`` of the groups whose weight needs several parts: at most one for each PART keys of the input."""
    return weights.withColumn("parts", F.ceil(F.col("weight") / F.lit(float(PART))).cast("int")).filter("parts > 1").drop("weight")


def _joined_parts(rows: DataFrame, first_deal: bool) -> DataFrame:
    dealt = rows.select("group", "part", "role", "class", "comp", "keys").repartition("group", "part").sortWithinPartitions("group", "part", "role", "class")
    return dealt.mapInArrow(_meet(first_deal), "a long, b long")


def _first_deal(src: DataFrame, classes: DataFrame, levels: np.ndarray) -> DataFrame:
    """Links ``(a, b)`` between classes that share a least shingle; a part of all links."""
    seeds = classes.filter(F.col("n") >= SMALLEST).select("class", "rep", "n", F.posexplode(F.array("first", "second")).alias("salt", "group"))
    meets = seeds.groupBy("group").agg(F.count("*").alias("many"), F.sum("n").alias("weight"), F.min("class").alias("lead")).filter("many > 1")
    meets = cut(meets.select("group", "weight", "lead"), "meets")
    # where both shingles lead a class to the same leader, one visit is enough; leaders pay both
    led = seeds.join(meets.select("group", "lead"), "group").groupBy("class", "lead").agg(F.collect_set("salt").alias("salts"), F.first("rep").alias("id"))
    visits = F.when(F.col("class") == F.col("lead"), F.col("salts")).otherwise(F.array(F.array_min("salts")))
    wanted = led.select("id", F.explode(visits).alias("salt"))
    bloom = Bloom(cut(wanted, "wanted"))
    large = cut(_split(meets), "large")
    large, _ = broadcast_if_small(large, BROADCAST_ROWS)
    sets = src.mapInArrow(_wanted_sets(levels, bloom, True), "group long, class long, keys array<long>")
    rows = sets.join(large, "group", "left").withColumn("role", F.when(F.col("class") == F.col("lead"), 0).otherwise(1)).withColumn("comp", F.col("class"))
    every = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("role") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")))
    return _joined_parts(rows.withColumn("part", F.explode(every)), True)


def _postings(levels: np.ndarray):
    """The prefix of each class in the task, once."""

    def rows(*columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["token", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            keys, owner, sizes, held = [], [], [], 0
            for s in shingle_sets(known.column(1)):
                if len(s) < SMALLEST or (own := class_of(s)) in met:
                    continue
                met.add(own)
                if len(met) > 200_000:
                    met.clear()
                k = ordered_keys(s, levels)[: _prefix(len(s))]
                keys.append(k)
                owner.append(np.full(len(k), own, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
                held += len(k)
                if held > 100_000:
                    yield rows(keys, owner, sizes)
                    keys, owner, sizes, held = [], [], [], 0
            if keys:
                yield rows(keys, owner, sizes)
        release()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in (token, n, class) order, each once, those whose token another class of a size that can link has too: the nearest in size is beside."""
    last: tuple[int, int, int, bool] | None = None  # the row before, and whether it was given out
    for batch in batches:
        t, c, n = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        if last is not None and len(t):
            new[0] = (t[0], c[0]) != last[:2]
        t, c, n = t[new], c[new], n[new].astype(np.int64)
        if not len(t):
            continue
        near = (t[1:] == t[:-1]) & (n[1:] * NUM <= n[:-1] * DEN)
        keep = np.zeros(len(t), bool)
        keep[1:] |= near
        keep[:-1] |= near
        lead = None
        if last is not None and last[0] == t[0] and n[0] * NUM <= last[2] * DEN:
            keep[0] = True
            lead = None if last[3] else last[:2]
        last = (int(t[-1]), int(c[-1]), int(n[-1]), bool(keep[-1]))
        out = [t[keep], c[keep]]
        if lead is not None:
            out = [np.concatenate(([v], x)) for v, x in zip(lead, out, strict=True)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["token", "class"])


def _second_deal(src: DataFrame, classes: DataFrame, comps: DataFrame, levels: np.ndarray) -> DataFrame:
    """Links ``(a, b)`` between the components ``comps(class, comp)`` that the first deal has left apart, all of them."""
    posted = src.mapInArrow(_postings(levels), "token long, class long, n int")
    runs = cut(posted.repartition("token").sortWithinPartitions("token", "n", "class").mapInArrow(_shared, "token long, class long"), "runs")
    known = classes.select("class", "n").join(comps, "class", "left").select("class", "n", F.coalesce("comp", "class").alias("comp"), _length_class(F.col("n")).alias("size"))
    held = cut(runs.join(known, "class").select("token", "class", "n", "comp", "size"), "held")
    drop(runs)
    # a link that is missing joins two components, so each shingle its sets share is in both; few length classes share a shingle
    spans = held.groupBy("token", "size").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    spans = spans.groupBy("token").agg(F.collect_list(F.struct("size", "low", "high")).alias("spans"), F.min("low").alias("low"), F.max("high").alias("high"))
    apart = cut(spans.filter("low <> high").select("token", "spans"), "apart")
    few, _ = broadcast_if_small(apart, BROADCAST_ROWS)
    others = F.filter("spans", lambda x: (F.abs(x["size"] - F.col("size")) <= STEPS + 1) & ((x["low"] != F.col("comp")) | (x["high"] != F.col("comp"))))
    met = cut(held.join(few, "token").select("token", "class", "n", "comp", F.explode(F.transform(others, lambda x: x["size"])).alias("other")), "met")
    drop(held)
    drop(apart)
    # a class stays with those of its shingles that sets of some length share with it often enough
    often = met.groupBy("class", "other").agg(F.count("*").alias("many"), F.first("n").alias("m")).filter(F.col("many") >= _least_shared(F.col("m"), F.col("other"))).select("class", "other")
    mixed = cut(met.join(often, ["class", "other"]).select("token", "class", "n", "comp").distinct(), "mixed")
    drop(met)
    sizes = mixed.groupBy("token", "comp").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("many", "comp")).alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    members = cut(mixed.join(largest.select("token", F.col("top.comp").alias("group")), "token").select("group", "class", "n", "comp").distinct(), "members")
    drop(mixed)
    large, _ = broadcast_if_small(cut(_split(members.groupBy("group").agg(F.sum("n").alias("weight"))), "large"), BROADCAST_ROWS)
    bloom = Bloom(members.select("class").distinct().join(classes, "class").select(F.col("rep").alias("id"), F.lit(0).alias("salt")))
    sets = src.mapInArrow(_wanted_sets(levels, bloom, False), "group long, class long, keys array<long>").drop("group")
    rows = members.join(sets, "class").join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    inside, home = F.col("comp") == F.col("group"), F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    at_home = F.array(F.struct(F.when(inside, 0).otherwise(1).alias("role"), home.alias("part")))
    elsewhere = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.lit(2).alias("role"), p.alias("part"))), lambda v: v["part"] != home)
    visits = F.when(inside, at_home).otherwise(F.concat(at_home, elsewhere))
    return _joined_parts(rows.withColumn("v", F.explode(visits)).select("group", "v.part", "v.role", "class", "comp", "keys"), False)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document, and a long ``mark`` of the caller's that tells rows of one id apart; see the module's docstring."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = [] if mark is None else ["mark"]
    read = src if mark is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.cast("long").alias("mark"))
    one = cut(read.mapInArrow(_pass_one, FACTS + ", mark long" * len(told)), "facts")
    levels = _frequency_levels(one.filter("block is not null").select("block", "counts"))
    facts = one.filter("block is null").select("doc_id", "n", "class", "first", "second", *told)
    live = facts.filter("doc_id is not null and class is not null")
    classes = cut(live.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second")), "classes")
    links = cut(_first_deal(src, classes, levels), "links")
    near = connected_components(links)
    comps = near.select(F.col("id").alias("class"), F.col("component").alias("comp"))
    more = cut(_second_deal(src, classes, comps, levels), "links")
    whole = connected_components(more)
    final = whole.select(F.col("id").alias("comp"), F.col("component").alias("least"))
    of = classes.select("class", "rep").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")).join(final, "comp", "left").select("class", "rep", F.coalesce("least", "comp").alias("comp"))
    least = of.groupBy("comp").agg(F.min("rep").alias("component"))
    labels = of.join(least, "comp").select("class", "component")
    out = facts.join(labels, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), *told)
    done = cut(out, "components")
    for table in (one, classes, links, near, more, whole):
        drop(table)
    return done


ORACLE = """
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as materialized (
  select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w
), fp as materialized (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), '|')) as f from s),
rep as materialized (select f, min(doc_id) as rep from fp where n > 0 group by f),
x as materialized (select id, n, md5_number_lower(t) as t from (select s.doc_id as id, len(g) as n, unnest(g) as t from s join rep on s.doc_id = rep.rep)),
common as materialized (select t from x group by t having count(*) >= 2),
x2 as materialized (select x.* from x join common using (t)),
pr as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from x2 a join x2 b on a.t = b.t and a.id < b.id
  where 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2),
e as materialized (select a, b from pr where 100 * i >= 80 * (na + nb - i)),
both_ as (select a, b from e union select b, a from e),
r(id, c) as (select rep, rep from rep union select b, c from r join both_ on r.id = both_.a),
lab as (select id, min(c) as c from r group by id)
select fp.doc_id, n::bigint as n_shingles, coalesce(lab.c, fp.doc_id) as component_id
from fp left join rep on fp.f = rep.f and fp.n > 0 left join lab on lab.id = rep.rep
"""
