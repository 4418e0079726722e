"""Approximate nearest neighbours by inner product: adaptive dimension scan within probed lists.

Index.  Centroids come from k-means on a sample of about ``SAMPLE`` vectors, more
for many lists, ``MOST_SAMPLE`` at most (drawn by a hash of the id); every vector
is put in the list of its nearest centroid.  Lists grow with the square root of
the table, up to ``MOST_LISTS``.  The number of lists to probe is what reaches ``TARGET`` recall on the
sample against brute force.  A query probes at least as many lists as hold the
neighbours wanted.

Scan.  Vectors are rotated by a random orthonormal matrix and read in blocks of
``COLUMNS`` dimensions.  After a block, a candidate whose partial product p over
d of D dimensions contradicts the hypothesis "the product is at least t" is
abandoned: p < t * d/D - Z * |q||x| * sqrt(d/D * (1 - d/D) / D), the spread of a
random rotation's partial product.  The threshold t starts at the k-th best of
the query among ``GAUGE`` vectors of the sample, which are candidates
themselves, and rises with the k-th best found: a block is scanned in pieces of
``PIECE`` candidates.  What survives is scored in double precision on the
original vectors; ties go to the smaller id.

Scale.  Lists are dealt in blocks of about ``BLOCK`` vectors, so a list with a
third of all vectors (copies of one) is many tasks; queries are replicated to the
blocks of their lists only and pass a block together (a block is copied only
where more than ``ASKED`` components of queries come to its list), and each
block returns at most k rows a query, none below t.

Defined cases: vectors that are null, empty, zero, of another length than the
commonest one, or hold null or non-finite components take no part, nor do rows
with a null id; with fewer candidates than k all are returned; rows with the same
id are queries and candidates of their own, each finding the others; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.lineage import cut

K, COLUMNS, Z = 20, 16, 2.75
SAMPLE, MOST_SAMPLE, GAUGE, MOST_LISTS, TARGET, SEED = 16_000, 65_536, 6_000, 4096, 0.975, 11
BLOCK, PIECE, ASKED = 8192, 2048, 1 << 22
_GRAIN = 1 << 30


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == common.d) if common else v


def lists_for(n: int) -> int:
    """Lists of a table of n vectors."""
    return min(MOST_LISTS, int(n**0.5 / 2))


class Index:
    """Rotation, centroids, lists to probe, and the gauge vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int, k: int = K):
        rng = np.random.Generator(np.random.PCG64(SEED))
        d = x.shape[1]
        q, r = np.linalg.qr(rng.normal(size=(d, d)))
        self.rotation = q * np.sign(np.diag(r))
        lists = max(1, min(lists_for(n), len(x) // 8))
        c = x[rng.choice(len(x), lists, replace=False)].copy()
        for _ in range(8):
            own = self._nearest(x, c)
            count = np.bincount(own, minlength=lists)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            full = count > 0
            c[full] = total[full] / count[full, None]
        self.centroids = c
        gauge = min(GAUGE, n // 8)  # an eighth at most, so that many more than k vectors stay above the floor
        self.gauge_ids, self.gauge = ids[:gauge], x[:gauge].astype(np.float32)
        self.probe = self._calibrate(x, k)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        half = 0.5 * (c * c).sum(axis=1)
        for i in range(0, len(x), 8192):
            out[i : i + 8192] = (x[i : i + 8192] @ c.T - half).argmax(axis=1)
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centroids)

    def _calibrate(self, x: np.ndarray, k: int) -> int:
        if len(self.centroids) == 1 or len(x) <= k:
            return len(self.centroids)
        q = x[:: max(1, len(x) // 256)][:256]
        own = self.assign(x)
        score = q @ x.T
        best = np.argpartition(-score, min(k + 1, len(x) - 1), axis=1)[:, : k + 1]
        place = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1), axis=1)
        rank = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(rank[min(len(rank) - 1, int(np.ceil(TARGET * len(rank))))]) + 1

    def floor(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """A product that the k-th best of each query can't stay below."""
        if len(self.gauge) <= k:
            return np.full(len(q), -np.inf)
        s = q.astype(np.float32) @ self.gauge.T
        s[ids[:, None] == self.gauge_ids[None, :]] = -np.inf
        at = np.partition(s, -k, axis=1)[:, -k].astype(np.float64)
        return at - 1e-4 * np.abs(at) - 1e-9  # single precision is good for less than this

    def lists_of(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        many = np.maximum(self.probe, (held <= k).sum(axis=1) + 1)
        return [o[:m] for o, m in zip(order, many.tolist(), strict=True)]


def scan(x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int, z: float = Z, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of at most k candidates a query, none below its floor; a row never finds itself."""
    got = []
    xr, xn = (x @ rotation).astype(np.float32), np.sqrt((x * x).sum(axis=1))
    for i in range(0, len(q), 128):
        own, rows, t = q[i : i + 128], q_rows[i : i + 128], floor[i : i + 128].copy()
        qr, qn = (own @ rotation).astype(np.float32), np.sqrt((own * own).sum(axis=1))
        a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(x), PIECE):
            na, nb = _survivors(qr, qn, xr[j : j + PIECE], xn[j : j + PIECE], t, z, columns)
            nb = nb + j
            other = rows[na] != x_rows[nb]
            na, nb = na[other], nb[other]
            ns = (own[na] * x[nb]).sum(axis=1)
            good = ns >= t[na]
            a, b, s = np.concatenate((a, na[good])), np.concatenate((b, nb[good])), np.concatenate((s, ns[good]))
            order = np.lexsort((x_rows[b], x_ids[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, s, place = (c[place < k] for c in (a, b, s, place))
            last = place == k - 1  # queries with k found: nothing below their k-th matters any more
            t[a[last]] = np.maximum(t[a[last]], s[last])
        got.append((a + i, b, s))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _survivors(qr: np.ndarray, qn: np.ndarray, xr: np.ndarray, xn: np.ndarray, t: np.ndarray, z: float, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, candidate number) whose product, block of columns by block, never contradicts that it reaches t."""
    d = xr.shape[1]
    open_, z = ~np.isfinite(t), min(z, 1e9)

    def least(at: int, tt, q_norm, x_norm, free):
        share = at / d
        return np.where(free, -np.inf, np.where(free, 0.0, tt) * share - z * q_norm * x_norm * np.sqrt(share * (1 - share) / d) - 1e-6)

    at = min(columns, d)
    p = qr[:, :at] @ xr[:, :at].T
    a, b = np.nonzero(p >= least(at, t[:, None], qn[:, None], xn[None, :], open_[:, None]))
    p = p[a, b]
    while at < d and len(a):
        nxt = min(d, at + columns)
        p = p + np.einsum("ij,ij->i", qr[a, at:nxt], xr[b, at:nxt])
        at = nxt
        if at < d:
            keep = p >= least(at, t[a], qn[a], xn[b], open_[a])
            a, b, p = a[keep], b[keep], p[keep]
    keep = p >= np.where(open_[a], -np.inf, np.where(open_[a], 0.0, t[a]) - 1e-4 * np.abs(np.where(open_[a], 0.0, t[a])) - 1e-6)
    return a[keep], b[keep]


def build(vectors: DataFrame, k: int = K) -> Index | None:
    """Fit an index on a bounded sample; None if there is no vector."""
    n = vectors.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(_GRAIN))
    sample = min(MOST_SAMPLE, max(SAMPLE, 16 * lists_for(n)))
    got = vectors.filter(draw < int(_GRAIN * min(1.0, sample / n))).toArrow()
    if not got.num_rows:
        got = vectors.limit(1).toArrow()
    ids, x = np.array(got.column("vec_id").to_pylist(), np.int64), _matrix(got.column("v").combine_chunks())
    order = np.argsort((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    return Index(ids[order], x[order], n, k)


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k found nearest of each vector whose id is divisible by ``every``."""
    v = valid_vectors(rows, id_col, vector_col)
    kind = dict(v.dtypes)["v"]
    index = build(v, k)
    spark = rows.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = len(index.centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.assign(_matrix(batch.column(1))), pa.int64())], names=["vec_id", "v", "list"])

    placed = v.mapInArrow(assigned, f"vec_id long, v {kind}, list long")
    stored = cut(placed.withColumn("row", F.monotonically_increasing_id()), "lists")  # a row's number is fixed once it is written
    sizes = np.zeros(lists, np.int64)
    for r in stored.groupBy("list").count().collect():  # a row for each list, MOST_LISTS at most
        sizes[r.list] = r["count"]

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                q, ids = _matrix(part.column(2)), part.column(1).to_numpy()
                floor, probed = index.floor(ids, q, k), index.lists_of(q, sizes, k)
                at = np.repeat(np.arange(len(ids)), [len(p) for p in probed])
                own = [part.column(c).take(pa.array(at)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(floor[at]), pa.array(np.concatenate(probed).astype(np.int64))], names=["row", "vec_id", "v", "floor", "list"])

    queries = stored.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    met = _met(stored, queries.mapInArrow(probing, f"row long, vec_id long, v {kind}, floor double, list long"), index, sizes, k, Z)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    ranked = lambda m: m.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")
    result = ["query_id", "rank", "vec_id", "score"]
    found = cut(ranked(met), "found")
    full = found.groupBy("row").agg(F.count("*").alias("c")).filter(F.col("c") >= min(k, int(sizes.sum()) - 1)).select("row")
    short = cut(queries.join(full, "row", "left_anti"), "short")
    if short.isEmpty():
        return found.select(*result)
    # a query that found fewer than k candidates, which a floor too high can cause, is asked again of every list, without a test
    everywhere = short.select("row", "vec_id", "v", F.lit(float("-inf")).alias("floor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))).alias("list"))
    again = ranked(_met(stored, everywhere, index, sizes, k, float("inf")))
    return found.join(short.select("row"), "row", "left_anti").select(*result).unionByName(again.select(*result))


def _met(stored: DataFrame, asked: DataFrame, index: Index, sizes: np.ndarray, k: int, z: float) -> DataFrame:
    """``(row, query_id, vec_id, other, score)``: what each query finds in each block of the lists it probes; ``other`` is the candidate's row."""
    spark, lists = stored.sparkSession, len(index.centroids)
    per_list = np.zeros(lists, np.int64)
    for r in asked.select("list").groupBy("list").count().collect():
        per_list[r.list] = r["count"]
    most = max(1, ASKED // index.centroids.shape[1])
    parts = spark.createDataFrame([(i, int(max(1, -(-sizes[i] // BLOCK))), int(max(1, -(-per_list[i] // most)))) for i in range(lists)], "list long, blocks int, asks int")
    parts = F.broadcast(parts)  # MOST_LISTS rows at most
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    data = stored.join(parts, "list").withColumn("block", pick("row", "blocks")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("list", "block", "ask", "row", "vec_id", "v")
    asks = asked.join(parts, "list").withColumn("ask", pick("row", "asks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "ask", "row", "vec_id", "v", "floor")
    rotation = index.rotation

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["row", "query_id", "vec_id", "other", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        x, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        x_ids, x_rows, q_ids, q_rows = (t.column(c).to_numpy() for t in (left, right) for c in ("vec_id", "row"))
        a, b, s = scan(x, x_ids, x_rows, q, q_rows, right.column("floor").to_numpy(), rotation, k, z)
        return pa.table([pa.array(c) for c in (q_rows[a], q_ids[a], x_ids[b], x_rows[b], s)], names=names)

    keys = ["list", "block", "ask"]
    return data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(found, "row long, query_id long, vec_id long, other long, score double")
