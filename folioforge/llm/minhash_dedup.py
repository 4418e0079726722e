"""MinHash near-dedup on 2-word shingles: bands propose, odd sketches sift, full sets confirm.

Semantics.  Words are runs without ASCII white space, A-Z lower-cased.  A set
holds the distinct 2-word shingles of a text (one word is its own shingle).  Two
documents link when ``100 * |A and B| >= 80 * |A or B|``; the result has each
document's set size, the least ``doc_id`` that links reach, and whether the
document is that one and so is kept.

Odd sketch: each of the MinHash samples (number, least value) flips one bit of a
bitmap.  What two sets' samples share cancels out, so the ones in the XOR of two
bitmaps count what differs, precisely where similarity is high:
``1 + BITS / (4 * HASHES) * ln(1 - 2 * ones / BITS)``.  A pair estimated below
``LOOSE`` goes unconfirmed; at a similarity of 0.8 that is more than six standard
deviations off.

Plan.  (1) One pass shingles the texts and gives out each set's fingerprint,
bands and sketch; exact copies are one class from here on.  A filter of bounded
size lets only band keys through that several classes hold.  (2) Such a key has a leader; each class is compared with the leader it shares
most keys with, first by sketches, then on full sets: components of most groups
at the price of one visit a class.  (3) Only keys whose classes lie in several
components can still hide a link.  There, the classes outside the component that
most of them are in ask all others: first on sketches, which only marks the
classes that come near enough, then those on full sets, where links within what a
part has joined already aren't looked at.  So what is given out grows with
classes, not with pairs.

Every linked pair shares a band key but for a chance of 7e-8 (``BANDS`` bands of
``ROWS`` samples at a similarity of 0.8; less above).

Skew.  Copies are counted once; keys are counted by partial sums; groups are
split by hash, and those who ask visit each part.  The visits of step 3 grow
with askers times parts, in sketches of 128 bytes first, in sets only for marked
classes and only among sizes that can link.

Defined cases: null or blank text gives the empty set, size 0, linked with
nothing; repeated rows link to themselves; a null ``doc_id`` takes no part in
links, its component and ``kept`` are null; very long texts are shingled whole;
sets of exactly the threshold link; rows of one ``doc_id`` with several texts
count as one document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import keys64, mix64, release
from folioforge.llm.ngram_join import Bloom, _Joined, class_of, shingle_sets
from folioforge.operators.graph import connected_components
from folioforge.plans.lineage import broadcast_if_small, cut, drop

SIZE, NUM, DEN = 2, 80, 100
ROWS, BANDS, BITS = 6, 54, 1024
HASHES = ROWS * BANDS
#: Estimates below it are far from the threshold.
LOOSE = 0.62
#: Most ones in the XOR of two sketches whose estimate is LOOSE or more.
MOST_ONES = int(BITS / 2 * (1 - np.exp((LOOSE - 1) * 4 * HASHES / BITS)))
#: Shingle keys of one part of full sets, and sketches of one part of sketches.
PART, SKETCHES = 1 << 19, 1 << 14
BROADCAST_ROWS = 200_000

_XOR = (keys64(HASHES, 301) >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = ((keys64(HASHES, 302) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_ROW, _BAND, _SAMPLE = keys64(ROWS, 303), keys64(BANDS, 304), keys64(HASHES, 305)


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of shingle hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[None, i : i + 1024] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap of samples, as 64-bit numbers."""
    bit = mix64(least.astype(np.uint64) + _SAMPLE) >> np.uint64(54)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each band of samples."""
    return mix64((least.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).astype(np.int64)


def estimate(ones: np.ndarray | int) -> np.ndarray | float:
    """Similarity of two sets whose sketches differ in so many bits."""
    return 1 + BITS / (4 * HASHES) * np.log(np.maximum(1 - 2 * np.asarray(ones) / BITS, 1e-9))


def _ones(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) link."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or DEN * len(a) < NUM * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


FACTS = "doc_id long, n long, class long, sketch array<long>, bands array<long>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of each set; sketch and bands where the task meets a class first."""
    met: set[int] = set()
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
    for batch in batches:
        rows = []
        for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), SIZE), strict=True):
            own = class_of(s) if len(s) and doc is not None else None
            if own is None or own in met:
                rows.append((doc, len(s), own, None, None))
                continue
            met.add(own)
            if len(met) > 200_000:
                met.clear()
            least = samples(s)
            rows.append((doc, len(s), own, odd_sketch(least), bands(least)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "class", "sketch", "bands"])
    release()


def _shared_keys(bloom: Bloom):
    """``(key, class)`` of the band keys that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys, own = lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            some = bloom.holds(keys, 0)
            yield from _pairs_of(keys[some], own[some], ("key", "class"))
        release()

    return run


def _sets(bloom: Bloom):
    """Full sets of the documents that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            chosen = known.filter(pa.array(bloom.holds(known.column(0).to_numpy(), 0)))
            rows, kept = [], 0
            for s in shingle_sets(chosen.column(1), SIZE):
                if len(s):
                    rows.append((class_of(s), s.astype(np.int64)))
                    kept += len(s)
                if kept > 1 << 18:
                    yield _packed(rows)
                    rows, kept = [], 0
            if rows:
                yield _packed(rows)
        release()

    return run


def _packed(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    own, keys = zip(*rows, strict=True)
    off = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys)))], names=["class", "keys"])


def _unsigned(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The number lists of a column, as unsigned numbers."""
    lists = batch.column(column)
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return (flat[off[r] : off[r + 1]] for r in range(batch.num_rows))


def _pairs_of(one: np.ndarray, two: np.ndarray, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    if len(one):
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=names)


def _pairs(found: list[tuple[int, int]], names: tuple[str, str] = ("a", "b")) -> Iterator[pa.RecordBatch]:
    yield from _pairs_of([x[0] for x in found], [x[1] for x in found], names)


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with the leader; rows (group, part, role, class, keys) in (group, part, role) order, the leader's first."""
    place = leader = None
    for batch in batches:
        found = []
        for group, part, role, own, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), _unsigned(batch, 4), strict=True):
            if role == 0:
                place, leader = (group, part), keys.copy()
            elif place == (group, part) and links(keys, leader):
                found.append((own, group))
        yield from _pairs(found)
    release()


class _Part:
    """What a part stores, as (class, comp, n, sketch[, keys]), and those of it that ask."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.askers: list[tuple] = []
        self.closed = False
        self.marked: set[int] = set()
        self.joined = _Joined()

    def close(self) -> None:
        self.closed = True
        self.comps, self.sizes, self.sketches = (np.array([r[i] for r in self.rows]) for i in (1, 2, 3))

    def near(self, row: tuple) -> list[int]:
        """Numbers of those of other components that may link with an asker by size and sketch, the likeliest first."""
        _, comp, n, sketch = row[:4]
        some = np.flatnonzero((self.comps != comp) & (DEN * self.sizes >= NUM * n) & (DEN * n >= NUM * self.sizes))
        ones = np.bitwise_count(self.sketches[some] ^ sketch).sum(axis=1, dtype=np.int64)
        close = ones <= MOST_ONES
        return some[close][np.argsort(ones[close], kind="stable")].tolist()


def _parts(batches: Iterator[pa.RecordBatch], asked) -> Iterator[list]:
    """What ``asked(group, part, row)`` finds of each asker.

    Rows (group, part, role, class, comp, n, sketch[, keys]) come in (group, part,
    role) order: role 0 is stored, 1 is stored and asks, 2 comes to ask.
    """
    place, part = None, _Part()

    def own_askers() -> list:
        if part.closed or len(part.rows) < 2:
            return []
        part.close()
        return [x for row in part.askers for x in asked(place[0], part, row)]

    for batch in batches:
        found: list = []
        lists = [_unsigned(batch, i) for i in range(6, batch.num_columns)]
        for group, where, role, *plain_and_lists in zip(*(batch.column(i).to_pylist() for i in range(6)), *lists, strict=True):
            row = tuple(x.copy() if isinstance(x, np.ndarray) else x for x in plain_and_lists)
            if (group, where) != place:
                found += own_askers()
                place, part = (group, where), _Part()
            if role < 2:
                part.rows.append(row)
                if role == 1:
                    part.askers.append(row)
            elif part.rows:
                found += own_askers()
                if not part.closed:
                    part.close()
                found += asked(group, part, row)
        yield found
    yield own_askers()


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class) of askers and of those they come near to."""

    def asked(group: int, part: _Part, row: tuple) -> list[tuple[int, int]]:
        near = part.near(row)
        new = [i for i in near if i not in part.marked]
        part.marked.update(new)
        return [(group, row[0])] * bool(near) + [(group, part.rows[i][0]) for i in new]

    for found in _parts(batches, asked):
        yield from _pairs(found, ("group", "class"))
    release()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components that the part hasn't joined yet."""

    def asked(_: int, part: _Part, row: tuple) -> list[tuple[int, int]]:
        out = []
        for i in part.near(row):
            comp, keys = part.rows[i][1], part.rows[i][4]
            if part.joined.root(row[1]) != part.joined.root(comp) and links(row[4], keys):
                part.joined.join(row[1], comp)
                out.append((row[1], comp))
        return out

    for found in _parts(batches, asked):
        yield from _pairs(found)
    release()


def _wanted(src: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(class, keys)`` of the classes ``wanted(class)``, and of a few others."""
    ids = cut(wanted.distinct().join(classes, "class").select(F.col("rep").alias("id"), F.lit(0).alias("salt")), "wanted")
    bloom = Bloom(ids)
    drop(ids)
    return src.mapInArrow(_sets(bloom), "class long, keys array<long>")


def _split(weights: DataFrame, most: int) -> DataFrame:
    """``(group, parts)`` of the groups whose ``weight`` needs several."""
    large = weights.withColumn("parts", F.ceil(F.col("weight") / F.lit(float(most))).cast("int")).filter("parts > 1").select("group", "parts")
    return broadcast_if_small(large, BROADCAST_ROWS)[0]


def _part_of(c: str = "class") -> Column:
    return F.pmod(F.xxhash64(c), F.col("parts")).cast("int")


def _dealt(rows: DataFrame, run, kind: str) -> DataFrame:
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "role", "class").mapInArrow(run, kind)


def _leader_links(src: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of classes with the leader they share most keys with."""
    most = held.filter("class <> lead").groupBy("class", "lead").agg(F.count("*").alias("many")).groupBy("class").agg(F.max_by("lead", F.struct("many", "lead")).alias("lead"))
    one, two = classes.select("class", "n", "sketch"), classes.select(F.col("class").alias("lead"), F.col("n").alias("m"), F.col("sketch").alias("with"))
    alike = (F.col("n") * DEN >= F.col("m") * NUM) & (F.col("m") * DEN >= F.col("n") * NUM) & (_ones(F.col("sketch"), F.col("with")) <= MOST_ONES)
    near = cut(most.join(one, "class").join(two, "lead").filter(alike).select("class", F.col("lead").alias("group"), "n"), "near")
    leaders = near.select("group").distinct()
    sets = _wanted(src, classes, near.select("class").unionByName(leaders.select(F.col("group").alias("class"))))
    large = _split(near.groupBy("group").agg(F.sum("n").alias("weight")), PART)
    parts = lambda d: d.join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asking = parts(near.select("group", "class")).withColumn("role", F.lit(1)).withColumn("part", _part_of())
    leading = parts(leaders).select("group", F.col("group").alias("class"), "parts", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = asking.unionByName(leading).join(sets, "class").select("group", "part", "role", "class", "keys")
    return _dealt(rows, _with_leader, "a long, b long")


def _visits(members: DataFrame, most: int, weight: Column) -> DataFrame:
    """``members`` in the parts they are stored in, those outside their group's home in all parts of sizes that can link."""
    sized = members.withColumn("size", F.floor(F.log("n") / F.lit(float(np.log(DEN / NUM)))).cast("long"))
    stored = cut(sized.groupBy("group", "size").agg(F.sum(weight).alias("weight")).select("group", "size", F.ceil(F.col("weight") / F.lit(float(most))).cast("int").alias("parts")), "stored")
    own = ["class", "comp", "n", *[c for c in ("sketch", "keys") if c in members.columns]]
    home = _part_of()
    inside = sized.join(stored, ["group", "size"]).withColumn("role", F.when(F.col("comp") == F.col("home"), 0).otherwise(1)).withColumn("part", home)
    asking = sized.filter("comp <> home").withColumn("stays", F.col("size")).withColumn("size", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1))).join(stored, ["group", "size"])
    asking = asking.withColumn("role", F.lit(2)).withColumn("home_part", F.when(F.col("stays") == F.col("size"), home).otherwise(-1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> home_part")
    placed = lambda d: d.select("group", (F.col("size") * (1 << 32) + F.col("part")).alias("part"), "role", *own)
    return placed(inside).unionByName(placed(asking))


def _other_links(src: DataFrame, classes: DataFrame, held: DataFrame, comps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the components ``comps(class, comp)`` that leaders have left apart, all of them."""
    known = cut(held.select("key", "class").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "known")
    apart = known.groupBy("key", "comp").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("comp", F.struct("many", "comp")).alias("home"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    few, _ = broadcast_if_small(cut(apart.filter("low <> high").select("key", "home"), "apart"), BROADCAST_ROWS)
    members = cut(known.join(few, "key").select(F.col("home").alias("group"), "home", "class", "comp").distinct().join(classes.select("class", "n", "sketch"), "class"), "members")
    drop(known)
    marked = cut(_dealt(_visits(members, SKETCHES, F.lit(1)), _mark, "group long, class long").distinct(), "marked")
    near = cut(members.join(marked, ["group", "class"], "left_semi"), "near")
    sets = _wanted(src, classes, near.select("class"))
    out = cut(_dealt(_visits(near.join(sets, "class"), PART, F.col("n")), _confirm, "a long, b long"), "links")
    for done in (members, marked, near):
        drop(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document; see the module's docstring."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = cut(src.mapInArrow(_facts, FACTS), "facts")
    live = facts.filter("class is not null")
    known = live.filter("sketch is not null")
    classes = cut(live.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "classes")
    # tasks that met one class each gave out its keys, so a key is shared where its classes differ
    spans = known.select("class", F.explode("bands").alias("key")).groupBy("key").agg(F.min("class").alias("lead"), F.max("class").alias("high"))
    meets = cut(spans.filter("lead <> high").select("key", "lead"), "meets")
    shared = Bloom(meets.select(F.col("key").alias("id"), F.lit(0).alias("salt")))
    held = known.select("class", "bands").mapInArrow(_shared_keys(shared), "key long, class long")
    held = cut(held.join(broadcast_if_small(meets, BROADCAST_ROWS)[0], "key").distinct(), "held")
    drop(meets)
    first = cut(_leader_links(src, classes, held), "links")
    near = connected_components(first)
    comps = near.select(F.col("id").alias("class"), F.col("component").alias("comp"))
    more = _other_links(src, classes, held, comps)
    drop(held)
    whole = connected_components(more)
    final = whole.select(F.col("id").alias("comp"), F.col("component").alias("all"))
    of = classes.select("class", "rep").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")).join(final, "comp", "left").select("class", "rep", F.coalesce("all", "comp").alias("comp"))
    labels = of.join(of.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("class", "least")
    out = facts.select("doc_id", "n", "class").join(labels, "class", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    done = cut(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near")
    for t in (facts, classes, first, near, more, whole):
        drop(t)
    return done


ORACLE = """
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as materialized (
  select doc_id, case when len(ws) >= 2 then list_distinct(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' '))) else ws end as g from w
), fp as materialized (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), '|')) as f from s),
rep as materialized (select f, min(doc_id) as rep from fp where n > 0 group by f),
x as materialized (select s.doc_id as id, len(g) as n, unnest(g) as t from s join rep on s.doc_id = rep.rep),
df as (select t, count(*) as df from x group by t),
o as (select id, n, x.t, row_number() over (partition by id order by df, x.t) as place from x join df using (t)),
-- two linked sets share one of the rarest n - ceil(0.8 n) + 1 shingles of each
rare as materialized (select * from o where place <= n - ceil(n * 0.8) + 1),
pairs as materialized (select distinct a.id as a, b.id as b from rare a join rare b on a.t = b.t and a.id < b.id where 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
e as materialized (select a, b from (select p.a, p.b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as i from pairs p join x on x.id = p.a join x y on y.id = p.b and y.t = x.t group by 1, 2) where 100 * i >= 80 * (na + nb - i)),
both_ as (select a, b from e union select b, a from e),
r(id, c) as (select rep, rep from rep union select b, c from r join both_ on r.id = both_.a),
lab as (select id, min(c) as c from r group by id)
select fp.doc_id, n::bigint as n_shingles, coalesce(lab.c, fp.doc_id) as component_id, fp.doc_id = coalesce(lab.c, fp.doc_id) as kept
from fp left join rep on fp.f = rep.f and fp.n > 0 left join lab on lab.id = rep.rep
"""
