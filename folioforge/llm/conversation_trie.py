"""Conversation prefix trie: what conversations share, node by node.

Semantics.  Turns are ordered by ``turn`` (null first); a null role or text is
empty.  Every conversation c is rebuilt: the first h original turns of
c - c % 100, then c's own turns after its first h; h is the CRC-32 of c's decimal
text modulo 6.  Each distinct sequence of first d rebuilt turns is a node, from
the root of depth 0; conversations that begin with it are its members.  A node
returns its least member, its parent's, members, children, childless nodes below
it or itself, the tokens its subtree saves (for each node, members but one times
the code points of its last text) and the SHA-256 of the members that end there.

Plan.  (1) Turns become 16-byte digests before anything is shuffled, a
conversation one row of them, and its path the digests of its prefixes.  Equal
conversations are one sequence with a count from here on.  (2) Sequences are
dealt by the digest of their first turn; first turns whose sequences hold more
than ``PART`` turns are dealt again by a next turn, at twice the depth each time,
so that a hot one takes a logarithm of its depth in rounds.  (3) Each hash
partition of these subtries is built within ``applyInPandas`` as a pointer trie
of dictionaries and summed by an iterative postorder.  (4) The few nodes above
the subtries (the root, and what hot first turns share) are grouped sums; what
lies below reaches them along one sequence each, by a running sum.

Skew.  A hot conversation is one sequence; a hot first turn is split; a group
of ``applyInPandas`` holds about ``PART`` turns.  Ends are hashed from a stream
in sorted order, so a node where very many conversations end takes no memory.

Defined cases: rows without ``conv_id`` are left out; turns of the same number
are ordered by their MD5; repeated rows are turns of their own; a conversation
that keeps no turn ends at the root; very long texts are digested whole; other
columns are ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import release
from folioforge.plans.lineage import broadcast_if_small, cut, drop

#: Turns of one group of subtries, about; first turns with more are dealt again.
PART = 1 << 16
SHARED, FAMILY = 6, 100
BROADCAST_ROWS = 100_000
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, digests, points)``: the rebuilt turns as digests, and the code points of their texts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.unhex(F.md5(said)).alias("digest"), F.length(text("text")).alias("points")).alias("t")
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = cut(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["points"].alias("points"))).alias("turns")), "turns")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    all_ = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "base", "left")
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    whole = all_.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.expr("slice(head, 1, h)"), rest)).alias("turns"))
    return whole.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.points").alias("points"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the prefixes of each conversation, and that of the whole."""
    for batch in batches:
        paths = []
        for digests in batch.column(1).to_pylist():
            path, last = [], ROOT
            for d in digests:
                path.append(last := hashlib.md5(last + d, usedforsecurity=False).digest())
            paths.append(path)
        whole = [p[-1] if p else ROOT for p in paths]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array(paths, pa.list_(pa.binary())), batch.column(2)], names=["conv_id", "whole", "path", "points"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key; rows come in (key, id) order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(i).encode())
            else:
                digest.update(f",{i}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends"])
    release()


class PrefixTrie:
    """Pointer trie: each node a dictionary of its children; nodes are numbered as they come."""

    def __init__(self):
        self.tops: dict[bytes, int] = {}
        self.next: list[dict[bytes, int]] = []
        self.key, self.depth, self.points, self.up = [], [], [], []
        self.members, self.least = [], []

    def add(self, path: list[bytes], points: list[int], depth: int, many: int, least: int) -> int:
        """One sequence whose first node has ``depth``; returns that node."""
        children, up, top = self.tops, -1, -1
        for i, key in enumerate(path):
            node = children.get(key)
            if node is None:
                node = children[key] = len(self.next)
                self.next.append({})
                self.key.append(key)
                self.depth.append(depth + i)
                self.points.append(points[i])
                self.up.append(up)
                self.members.append(0)
                self.least.append(least)
            self.members[node] += many
            self.least[node] = min(self.least[node], least)
            top = node if i == 0 else top
            children, up = self.next[node], node
        return top

    def sums(self) -> tuple[list[int], list[int]]:
        """Childless nodes and saved tokens of each subtree, by an iterative postorder."""
        leaves, saved = [0] * len(self.next), [0] * len(self.next)
        for top in self.tops.values():
            stack = [(top, iter(self.next[top].values()))]
            while stack:
                node, children = stack[-1]
                child = next(children, None)
                if child is not None:
                    stack.append((child, iter(self.next[child].values())))
                    continue
                stack.pop()
                leaves[node] = leaves[node] or 1
                saved[node] += (self.members[node] - 1) * self.points[node]
                if stack:
                    leaves[stack[-1][0]] += leaves[node]
                    saved[stack[-1][0]] += saved[node]
        return leaves, saved


NODES = "key binary, depth long, conv_id long, parent_conv_id long, above binary, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _subtries(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries of one hash partition; ``above`` names the parent of their tops."""
    trie, above = PrefixTrie(), {}
    for top, parent, path, points, many, least in zip(*(group[c] for c in ("top", "above", "path", "points", "many", "least")), strict=True):
        above[trie.add(list(path), [int(p) for p in points], int(top), int(many), int(least))] = parent
    leaves, saved = trie.sums()
    parents = [None if u < 0 else trie.least[u] for u in trie.up]
    return pd.DataFrame({
        "key": trie.key, "depth": trie.depth, "conv_id": trie.least, "parent_conv_id": pd.array(parents, "Int64"), "above": [above.get(i) for i in range(len(trie.next))],
        "n_convs": trie.members, "n_children": [len(c) for c in trie.next], "n_leaves": leaves, "saved_tokens": saved,
    })


def _dealt(sequences: DataFrame) -> DataFrame:
    """``sequences`` with ``top``, the depth at which their subtrie begins; beyond their size if they end above all subtries."""
    done, live, held, depth = [], sequences.withColumn("size", F.size("path")), [], 1
    done.append(live.filter("size = 0").withColumn("top", F.lit(1)))
    live = live.filter("size > 0")
    while True:
        key = F.col("path")[depth - 1]
        weights = live.groupBy(key.alias("key")).agg(F.sum(F.col("size") - depth + 1).alias("weight"), F.count("*").alias("many"))
        large = cut(weights.filter((F.col("weight") > PART) & (F.col("many") > 1)).select("key"), "large")
        held.append(large)
        if large.isEmpty():
            done.append(live.withColumn("top", F.lit(depth)))
            break
        side, _ = broadcast_if_small(large.withColumn("again", F.lit(True)), BROADCAST_ROWS)
        joined = live.withColumn("key", key).join(side, "key", "left").drop("key")
        done.append(joined.filter("again is null").drop("again").withColumn("top", F.lit(depth)))
        depth *= 2
        again = joined.filter("again").drop("again")
        done.append(again.filter(F.col("size") < depth).withColumn("top", F.col("size") + 1))
        live = cut(again.filter(F.col("size") >= depth), "again")
        held.append(live)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = cut(out, "dealt")
    for d in held:
        drop(d)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node."""
    paths = cut(rebuilt(conversations).mapInArrow(_paths, "conv_id long, whole binary, path array<binary>, points array<int>"), "paths")
    sequences = cut(paths.groupBy("whole").agg(F.min("conv_id").alias("least"), F.count("*").alias("many"), F.first("path").alias("path"), F.first("points").alias("points")).drop("whole"), "sequences")
    dealt = _dealt(sequences)
    at = lambda d: F.when(d < 1, F.lit(ROOT)).otherwise(F.try_element_at("path", F.greatest(d, F.lit(1))))
    tail = lambda c: F.expr(f"slice({c}, top, size - top + 1)").alias(c)
    below = dealt.filter("top <= size").select("top", at(F.col("top") - 1).alias("above"), tail("path"), tail("points"), "many", "least")
    turns = dealt.agg(F.sum("size")).first()[0] or 0
    groups = below.withColumn("bucket", F.pmod(F.xxhash64(F.col("path")[0]), F.lit(max(1, -(-turns // PART)))))
    tries = cut(groups.groupBy("bucket").applyInPandas(lambda g: _subtries(g), NODES), "tries")
    # above the subtries
    d = F.col("d")
    rows = dealt.select("least", "many", "path", "points", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("d"))
    rows = cut(rows.select("least", "many", "d", at(d).alias("key"), F.when(d > 0, at(d - 1)).alias("above"), F.coalesce(F.try_element_at("points", F.greatest(d, F.lit(1))), F.lit(0)).alias("points")), "upper")
    upper = rows.groupBy("key").agg(F.first("d").alias("d"), F.first("above").alias("above"), F.first("points").alias("points"), F.sum("many").alias("n_convs"), F.min("least").alias("conv_id"))
    upper = cut(upper.withColumn("points", F.when(d > 0, F.col("points")).otherwise(0)), "nodes")
    tops = tries.filter("above is not null")
    children = upper.filter("above is not null").select("above").unionByName(tops.select("above")).groupBy("above").agg(F.count("*").alias("n_children"))
    upper = upper.join(children.withColumnRenamed("above", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # each node gives its sums to one sequence; those of the depths below it, over the node's sequences, are its subtree's
    given = upper.select(F.col("conv_id").alias("least"), "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    given = given.unionByName(tops.select(F.col("conv_id").alias("least"), (F.col("depth") - 1).cast("int").alias("d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    given = given.groupBy("least", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    deeper = Window.partitionBy("least").orderBy(d.desc())
    summed = rows.select("least", "d", "key").join(given, ["least", "d"], "left").select("key", *(F.sum(F.coalesce(c, F.lit(0))).over(deeper).alias(c) for c in ("leaves", "saved")))
    summed = summed.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    upper = upper.join(summed, "key").select("key", d.cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "above", "n_convs", "n_children", "n_leaves", "saved_tokens")
    upper = cut(upper, "summed")
    named = upper.select(F.col("key").alias("above"), F.col("conv_id").alias("named"))
    ends = paths.select("whole", "conv_id").repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(_hash_ends, "key binary, ends string")
    nodes = upper.unionByName(tries).join(named, "above", "left").join(ends, "key", "left")
    out = nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = cut(out, "trie")
    for done in (paths, sequences, dealt, tries, rows, upper):
        drop(done)
    return out


#: CRC-32 of a decimal text, bit by bit.
_CRC = """(xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({x}) + 1), lambda i: ascii({x}[i])::bigint)),
  lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295))""".format(x="(c::varchar)")

ORACLE = f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as materialized (select c, list({{'t': md5(length(role)::varchar || ':' || role || text), 'p': length(text)}} order by turn nulls first, md5(length(role)::varchar || ':' || role || text)) as turns from t group by c),
x as (select c, turns, {_CRC} % 6 as h from o),
r as materialized (select x.c, list_concat(coalesce(b.turns[1:x.h], []), x.turns[x.h + 1:]) as turns from x left join o b on b.c = x.c - x.c % 100),
pre as materialized (select c, d, array_to_string(list_transform(turns[1:d], lambda s: s.t), ',') as k, case when d = 0 then 0 else turns[d].p end as p, d = len(turns) as over_
  from (select c, turns, unnest(range(0, len(turns) + 1)) as d from r)),
n as materialized (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(p) as p, string_agg(c::varchar, ',' order by c) filter (over_) as ends from pre group by d, k),
up as materialized (select n.d, n.k, n.conv_id, q.k as pk from n left join pre q on q.c = n.conv_id and q.d = n.d - 1),
kids as materialized (select d - 1 as d, pk as k, count(*) as n_children from up where d > 0 group by 1, 2),
whole as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (d, k)),
below as (select q.d, q.k, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * w.p) as saved from whole w join pre q on q.c = w.conv_id and q.d <= w.d group by 1, 2)
select w.conv_id, w.d::bigint as depth, pn.conv_id as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from whole w join below using (d, k) join up using (d, k) left join n pn on pn.d = w.d - 1 and pn.k = up.pk
"""
