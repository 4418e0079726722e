"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

An occurrence of an item of m characters with at most k edits shares at least
``m + 1 - q * (k + 1)`` character q-grams with it, all on neighbouring diagonals
(text position less item position).  Hits are counted in overlapping diagonal
bands of width 2w at stride w (w > k, so one band holds all diagonals of an
occurrence); bands below the bound can't hold one and are left.  The others are
verified by an alignment of the whole item within the band: at most k edits is a
leak.  Items that begin alike share the rows of a band's alignment up to where
they part, and rows over budget are given up, so a benchmark whose items share a
stem isn't aligned once for each item.  Nothing but the lemma filters, so every text and every item is covered.

Texts are compared folded: Latin letters lower-cased, everything but letters
and digits one space.  The edit budget is 6 % of the item's folded length (less
where the bound would fall below one).  Items shorter than q have no q-grams: they
are found by runs of words, at word bounds and without edits.

The benchmark is the query set: it goes to the executors in blocks of a bounded
number of items and characters, each a pass over the documents.

Defined cases: null and empty texts hold no leak; very long texts are searched
whole; of a text's bands for an item the one with the fewest edits is reported,
of these the one with most shared q-grams, then the first; null ``doc_id`` and
repeated rows are reported as they are; a null item text takes no part; other
columns are ignored; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import fold, mix64, release, slices, utf8, word_hashes, words

Q, EDIT_RATE = 12, 0.06
#: Items and characters of one block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Hits counted at once, and cells of alignments.
HITS, CELLS = 1 << 21, 1 << 22
_BITS = 22


def _grams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q bytes from each position (q of 9 to 16): two overlapping words of 8."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = b.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    return x[:n] * np.uint64(0x9E3779B97F4A7C15) + (x[q - 8 : q - 8 + n] ^ (x[q - 8 : q - 8 + n] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, of the words' hashes."""
    n = max(0, len(h) - k + 1)
    x = h[:n]
    for j in range(1, k):
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j])
    return x


class Index:
    """q-grams of a block of items, by hash."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, rate: float = EDIT_RATE):
        raw, off = fold(*utf8(pa.array(texts, pa.string())))
        self.q = q
        self.short: dict[bytes, list[int]] = {}
        long = []
        for k, i in enumerate(ids):
            b = raw[off[k] : off[k + 1] - 1].tobytes()
            if len(b) >= q:
                long.append((b, k))
            elif b:
                self.short.setdefault(b, []).append(i)
        self.items = [x for x, _ in long]
        long.sort()  # item numbers go by text, so items that begin alike are neighbours
        self.ids, self.ranked = [ids[k] for _, k in long], [x for x, _ in long]
        self.budget = [min(int(rate * len(x)), len(x) // q - 1) for x in self.items]
        self.size = np.array([len(x) for x in self.ranked], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(self.ranked), np.uint8)
        self.allowed = np.minimum((rate * self.size).astype(np.int64), self.size // q - 1)
        self.least = self.size + 1 - q * (self.allowed + 1)
        self.width = np.array([max(8, 1 << int(k).bit_length()) for k in self.allowed], np.int64)
        self.shared = np.zeros(len(long) + 1, np.int64)  # first bytes shared with the item before
        for k in range(1, len(long)):
            x, y = (np.frombuffer(v, np.uint8) for v in self.ranked[k - 1 : k + 1])
            m = min(len(x), len(y))
            apart = x[:m] != y[:m]
            self.shared[k] = apart.argmax() if apart.any() else m
        grams = [_grams(np.frombuffer(x, np.uint8), q) for x in self.ranked]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(long)), [len(g) for g in grams])
        order = np.argsort(h, kind="stable")
        self.hash, rank = np.unique(h[order], return_inverse=True)
        self.item = item[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.by_item = rank * max(1, len(long)) + self.item  # ascending: postings of a q-gram go by item
        self.runs: dict[int, list[int]] = {}  # hashes of the short items, by their words
        for x in self.short:
            b = np.frombuffer(x, np.uint8)
            k = x.count(b" ") + 1
            self.runs.setdefault(k, []).append(int(_runs(word_hashes(b, *words(b, np.array([0, len(b)]))[:2]), k)[0]))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(mix64(self.hash) >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, q-gram number, text number) of every q-gram of the texts that an item holds."""
        g = _grams(b, self.q)
        p = np.flatnonzero(self.bitmap[(mix64(g) >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, g[p]), len(self.hash) - 1)
        ok = self.hash[k] == g[p]
        p, k = p[ok], k[ok]
        text = np.searchsorted(off, p, "right") - 1
        ok = p + self.q <= off[text + 1] - 1  # within one text, before its closing space
        return p[ok], k[ok], text[ok]

    def postings(self, key: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last posting of q-grams among the items lo .. hi - 1."""
        n = len(self.ids)
        return np.searchsorted(self.by_item, key * n + lo), np.searchsorted(self.by_item, key * n + hi)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that items a and b begin with alike, b not before a."""
        pairs, back = np.unique(a * len(self.ids) + b, return_inverse=True)
        x, y = pairs // len(self.ids), pairs % len(self.ids)
        least = np.minimum.reduceat(self.shared, np.stack((np.minimum(x + 1, y), y + 1), axis=1).ravel())[::2]
        return np.where(x < y, least, self.size[y])[back]


def _candidates(b: np.ndarray, off: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, least diagonal, shared q-grams) of each double band that meets its item's bound.

    Items that share a stem are hit together at each of its places, so the hits
    of a slice are taken for ranges of items of at most ``HITS`` hits; one item
    alone is counted by stretches of the text.
    """
    place, key, text = index.matches(b, off)
    lead = int(index.size.max())
    n_bands = (np.diff(off) + 2 * lead) // index.width.min() + 3
    base = np.cumsum(n_bands) - n_bands  # of each text's bands in a table of all
    total = int(n_bands.sum())
    local = place - off[text]
    out = []
    todo = [(0, len(index.ids))] if len(place) else []
    while todo:
        lo, hi = todo.pop()
        first, last = index.postings(key, lo, hi)
        upto = np.cumsum(last - first)
        if not upto[-1]:
            continue
        if upto[-1] > HITS and hi - lo > 1:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
            continue
        counts: dict[str, np.ndarray] = {}
        dense = (hi - lo) * total <= max(1 << 16, 4 * int(upto[-1])) or hi - lo == 1
        cells = []
        begin = 0
        while begin < len(first):  # by stretches of at most HITS hits, or one place
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
            many = (last - first)[begin:end]
            e = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[begin:end], many)
            item = index.item[e]
            band = (np.repeat(local[begin:end], many) - index.at[e] + lead) // index.width[item]
            cell = (item - lo) * total + np.repeat(base[text[begin:end]], many) + band
            if dense:
                counts["all"] = counts.get("all", 0) + np.bincount(cell, minlength=(hi - lo) * total)
            else:
                cells.append(cell)
            begin = end
        if dense:
            both = counts["all"].copy()
            both[:-1] += counts["all"][1:]  # the last band of a text stays empty, so texts don't run together
            cell = np.flatnonzero(both)
            count = both[cell]
        else:
            cell = np.concatenate(cells)
            cell, count = np.unique(np.concatenate((cell, cell[cell > 0] - 1)), return_counts=True)
        item = cell // total + lo
        ok = count >= index.least[item]
        cell, count, item = cell[ok] % total, count[ok], item[ok]
        t = np.searchsorted(base, cell, "right") - 1
        out.append((t, item, (cell - base[t]) * index.width[item] - lead, count))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def banded_edits(index: Index, text: np.ndarray, item: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end in text) of alignments of whole items on diagonals low .. low + width - 1 of one text, ends in the text free.

    Candidates come by (low, item number), and items are numbered in their
    order as byte strings: those of a band that begin alike share the rows of
    their common beginning, as on a path of a prefix tree, and split behind it.
    A row whose least value exceeds the budgets of all that may still split
    from it is given up; its candidates get a number of edits over any budget.
    """
    n, far = len(item), 1 << 30
    edits, ends = np.full(n, far, np.int64), np.zeros(n, np.int64)
    share = np.zeros(n, np.int64)
    if n > 1:
        share[1:] = index.common(item[:-1], item[1:])
        share[1:][low[1:] != low[:-1]] = 0
        share[share < index.q] = 0
    run = np.flatnonzero(share == 0)
    top = np.repeat(np.maximum.reduceat(index.allowed[item], run), np.diff(np.append(run, n)))
    splits = np.argsort(share, kind="stable")
    split_at = share[splits]
    side = int(index.size[item].max()) + 2 * width + int(max(0, -low.min()))
    padded = np.concatenate((np.zeros(side, np.uint8), text, np.zeros(side, np.uint8)))  # no folded text holds a zero byte
    steps = np.arange(width)[:, None]
    slot = np.full(n, -1, np.int64)
    live, rows = np.zeros(0, np.int64), np.zeros((width, 0), np.int32)
    i = done = 0
    while done < n or len(live):
        here = splits[done : np.searchsorted(split_at, i, "right")]
        done += len(here)
        if len(here):
            leaders = np.flatnonzero(share < i)  # the nearest one before a candidate holds the row it splits from
            slots = slot[leaders[np.searchsorted(leaders, here) - 1]] if i else np.zeros(len(here), np.int64)
            ok = slots >= 0
            grown = rows[:, slots[ok]] if i else np.zeros((width, len(here)), np.int32)
            live, rows = np.concatenate((live, here[ok])), np.concatenate((rows, grown), axis=1)
        ended = index.size[item[live]] == i
        least = rows.min(axis=0) if len(live) else np.zeros(0, np.int32)
        if ended.any():
            c = live[ended]
            edits[c] = least[ended]
            ends[c] = np.clip(low[c] + i + rows[:, ended].argmin(axis=0), 0, len(text))
        keep = ~ended & (least <= top[live])
        if not keep.all():
            slot[live[~keep]] = -1
            live, rows = live[keep], rows[:, keep]
        if not len(live):
            break  # nothing is left to split from
        slot[live] = np.arange(len(live))
        own = index.letters[index.start[item[live]] + i]
        grown = rows + (padded[(side + low[live] + i)[None, :] + steps] != own)
        np.minimum(grown[:-1], rows[1:] + 1, out=grown[:-1])
        if len(live) > 64:
            for j in range(1, width):
                np.minimum(grown[j], grown[j - 1] + 1, out=grown[j])
        else:
            grown = (np.minimum.accumulate(grown - steps, axis=0) + steps).astype(np.int32)
        rows = grown
        i += 1
    return edits, ends


def _short_leaks(b: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """The first place of each item shorter than q in each text; such items share no q-grams."""
    if not index.short:
        return []
    starts, ends, first = words(b, off)
    h = word_hashes(b, starts, ends)
    place: dict[tuple[int, bytes], int] = {}
    for k, hashes in index.runs.items():
        p = np.flatnonzero(np.isin(_runs(h, k), np.array(hashes, np.uint64)))
        text = np.searchsorted(first, p, "right") - 1
        ok = p + k <= first[text + 1]
        p, text = p[ok], text[ok]
        for t, a, z in zip(text.tolist(), starts[p].tolist(), ends[p + k - 1].tolist(), strict=True):
            x = b[a:z].tobytes()
            if x in index.short:
                place.setdefault((t, x), z - int(off[t]))
    return [(t, i, 0, 0, end) for (t, x), end in place.items() for i in index.short[x]]


def find_leaks(b: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, edits, shared q-grams, end in the folded text), the best band of each text and item."""
    return _short_leaks(b, off, index) + _long_leaks(b, off, index)


def _long_leaks(b: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    if not len(index.ids) or len(b) < index.q:
        return []
    text, item, low, count = _candidates(b, off, index)
    edits, end = np.full(len(text), 1 << 30, np.int64), np.zeros(len(text), np.int64)
    for c in np.flatnonzero(count > index.size[item] - index.q).tolist():  # all its q-grams are there
        t, wanted = text[c], index.ranked[item[c]]
        at = b[off[t] : off[t + 1] - 1].tobytes().find(wanted, max(0, low[c]), max(0, low[c] + 2 * index.width[item[c]]) + len(wanted))
        if at >= 0:
            edits[c], end[c] = 0, at + len(wanted)
    pair = text * len(index.ids) + item
    open_ = np.flatnonzero(~np.isin(pair, pair[edits == 0]))
    order = open_[np.lexsort((item[open_], low[open_], index.width[item[open_]], text[open_]))]
    cut = np.flatnonzero((np.diff(text[order]) != 0) | (np.diff(index.width[item[order]]) != 0)) + 1
    for group in np.split(order, cut) if len(order) else []:
        t, width = text[group[0]], 2 * int(index.width[item[group[0]]])
        for part in np.array_split(group, max(1, -(-len(group) * width // CELLS))):
            edits[part], end[part] = banded_edits(index, b[off[t] : off[t + 1] - 1], item[part], low[part], width)
    ok = np.flatnonzero(edits <= index.allowed[item])
    ok = ok[np.lexsort((low[ok], -count[ok], edits[ok], pair[ok]))]
    ok = ok[np.diff(pair[ok], prepend=-1) != 0]
    return [(t, index.ids[i], e, c, x) for t, i, e, c, x in zip(text[ok].tolist(), item[ok].tolist(), edits[ok].tolist(), count[ok].tolist(), end[ok].tolist(), strict=True)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the benchmark's blocks; only one block at a time is in the driver."""
    src = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    n, chars = src.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS), 1)
    for k in range(blocks):
        part = src.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else src
        rows = sorted((r.item_id is None, r.item_id, r.text) for r in part.collect())
        yield Index([r[1] for r in rows], [r[2] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, edits, shared_qgrams, end_at)``: one row for each document and item it holds."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = utf8(batch.column(1))
                for i, j in slices(off):
                    found = find_leaks(*fold(raw[off[i] : off[j]], off[i : j + 1] - off[i]), index)
                    if found:
                        ids = batch.column(0).take(pa.array([i + f[0] for f in found]))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5))], names=["doc_id", "item_id", "edits", "shared_qgrams", "end_at"])

        return run

    out = None
    for index in _blocks(benchmark, item_id, item_text):
        part = src.mapInArrow(scan(index), "doc_id long, item_id long, edits long, shared_qgrams long, end_at long")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns and texts as they were."""
    fields, out = docs.schema, docs

    def keep(index: Index, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = utf8(batch.column(k))
                good = np.ones(batch.num_rows, bool)
                for i, j in slices(off):
                    for f in find_leaks(*fold(raw[off[i] : off[j]], off[i : j + 1] - off[i]), index):
                        good[i + f[0]] = False
                yield batch.filter(pa.array(good))
            release()

        return run

    for index in _blocks(benchmark, "item_id", "text"):
        out = out.mapInArrow(keep(index, docs.columns.index(text_col)), fields)
    return out
