"""Phrase collocation mining by depth-limited count tries.

Semantics.  A-Z are lower-cased, texts split at ``. , ; : ! ?`` and line ends
(0x0A to 0x0D) into pieces, pieces into words at blanks and tabs.  Everything is
per ``lang``.  ``a`` counts a phrase's contiguous occurrences within pieces,
overlaps included.  Candidates are phrases of 2 to 5 words with ``a >= 100``.  A
cut after the first k words has ``l`` and ``r``, the counts of both parts, and
``floor(1000 * a * n / (l * r))`` where ``n`` counts the language's words; the
cut that scores lowest counts.  A candidate within a longer one of the same
count goes.  The first 2000 of each language stay.

Plan.  The count trie of a whole language is built level by level.  (1) A pass
over the texts counts words, by their letters; those of 100 and more are the first
level.  (2) Further passes count edges: a node's key and the word that goes on from
it, both as 64-bit hashes.  One looks for pairs, one for triples, the last one
builds, for each shard of texts, a depth-limited count trie over runs whose triples
passed and gives out its two deepest levels.  What is rare at one level can't be
part of a candidate, so filters of the frequent runs keep the long tail out of the
next; they have a bounded size, and fuller ones only let more through.  Edges are
summed by both, whole, and cut at 100; only words or runs that share a 64-bit hash
would be taken for one.  (3) An edge that is left meets its node and
its word once, by equality, and so gets its phrase.  (4) The trie is walked in
order, range by range: a stack of at most five counts gives each phrase the counts
of its left parts.  Suffix links, as equality joins on the phrase, give those of the
right parts.

Size.  Shards give out letters only in the first pass, whose rows don't depend on
what is frequent.  A pass gives out one row a word of text at most (the last one
two).  Below that, the edges' rows grow faster than the input, as more runs of a
shard reach 100 in all.  Walks and joins work on frequent phrases only, fewer than
one of 100 words read for each length.

Skew.  A shard gives out an edge once, however often it stands there, and edges are
grouped by node and word, so that no word or prefix is a group.

Defined cases: a null text is empty; a null ``lang`` is ``und``; repeated rows
count each; very long texts are read whole; ties go to the smallest k, and in
the ranking to the larger count, then to the lesser phrase by its UTF-8 bytes;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import LOWER, mix64, release, slices, utf8, word_hashes
from folioforge.llm.ngram_join import BROADCAST_ROWS, Bloom
from folioforge.plans.lineage import broadcast_if_small, cut, drop

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bytes of text of one shard's trie, about; a longer text is a shard of its own.
SHARD = 1 << 22
#: Words hashed at once.
WORDS = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _edge_key(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the node that a word leads to."""
    return mix64(parent * _STEP + word)


def _counts(order: np.ndarray, *sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each run of equals, and their number; ``order`` brings equals together."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in sorted_by:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


class Shard:
    """The words of some texts: hash, language and bytes of each, and whether the piece goes on after it."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.raw, offsets = utf8(texts)
        raw = self.raw
        inside = ~(_BLANK | _STOP)[raw]
        first = offsets[:-1][offsets[:-1] < len(raw)]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[first] = inside[first]
        closes[:-1] &= ~inside[1:]
        closes[first[first > 0] - 1] = inside[first[first > 0] - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        n = len(self.starts)
        self.first = np.searchsorted(self.starts, offsets)
        stops = np.concatenate(([0], np.cumsum(_STOP[raw], dtype=np.int64)))
        self.joined = np.zeros(n, bool)  # with the word after it
        self.joined[:-1] = stops[self.starts[1:]] == stops[self.ends[:-1]]
        last = self.first[1:] - 1
        self.joined[last[last >= 0]] = False
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(self.first))
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        parts = [word_hashes(raw, self.starts[i : i + WORDS], self.ends[i : i + WORDS], seed=13) for i in range(0, n, WORDS)]
        self.hash = mix64(np.concatenate(parts) ^ salts[self.lang]) if n else np.zeros(0, np.uint64)

    def keys(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Keys of the ``depth`` words that begin at the places ``at``."""
        key = self.hash[at]
        for d in range(1, depth):
            key = _edge_key(key, self.hash[at + d])
        return key

    def frequent(self, passing: Bloom, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``depth`` words of a piece begin that pass, and their keys."""
        at = np.arange(len(self.hash))
        for d in range(1, depth):
            at = at[self.joined[at + d - 1]]
        key = self.keys(at, depth)
        held = passing.holds(key, 0)
        return at[held], key[held]

    def word(self, at: int) -> str:
        return LOWER[self.raw[self.starts[at] : self.ends[at]]].tobytes().decode()

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at the places ``at``."""
        starts, size = self.starts[at], self.ends[at] - self.starts[at]
        offsets = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LOWER[self.raw[place]]))


class CountTrie:
    """Counts of the phrases of up to ``LONGEST`` words that begin at the words ``begins``.

    They go on to a second word where ``pairs`` holds of the first, and to each
    further one where ``pairs`` and, a word before, ``triples`` hold.

    Level d is kept as arrays: each node's parent on the level above, a place
    where its phrase begins, and its count.  A place finds its node by that of
    the level above and its next word.
    """

    def __init__(self, shard: Shard, begins: np.ndarray, pairs: np.ndarray, triples: np.ndarray):
        self.shard, self.levels = shard, []
        at = np.flatnonzero(begins)
        node = np.zeros(len(at), np.int64)
        for depth in range(LONGEST):
            if depth:
                follow = pairs[at + depth - 1] if depth == 1 else pairs[at + depth - 1] & triples[at + depth - 2]
                at, node = at[follow], node[follow]
            if not len(at):
                break
            key = mix64(node.astype(np.uint64) * _STEP + shard.hash[at + depth])
            _, place, own, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.levels.append({"parent": node[place], "place": at[place], "count": count})
            node = own

    def edges(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of ``depth`` words: key of the node above, last word, count."""
        if len(self.levels) < depth:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = self.levels[depth - 1]["place"]
        return self.shard.keys(at, depth - 1), self.shard.hash[at + depth - 1], self.levels[depth - 1]["count"]

    def rows(self) -> list[tuple[str, str, int]]:
        """The trie serialised: (lang, phrase, count), sorted."""
        shard, out, above = self.shard, [], [""]
        known: dict[int, str] = {}
        for depth, level in enumerate(self.levels):
            here = []
            for up, place, count in zip(level["parent"].tolist(), level["place"].tolist(), level["count"].tolist(), strict=True):
                h = int(shard.hash[place + depth])
                if (word := known.get(h)) is None:
                    word = known[h] = shard.word(place + depth)
                here.append(f"{above[up]} {word}" if depth else word)
                out.append((shard.langs[shard.lang[place]], here[-1], count))
            above = here
        return sorted(out)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Of (text, lang) batches."""
    for batch in batches:
        _, offsets = utf8(batch.column(0))
        for i, j in slices(offsets, SHARD):
            yield Shard(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))


COUNTED = "lang string, word string, many long"
KEYED = "key long, lang string, phrase string, a long"
EDGES = "depth int, parent long, word long, many long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and the number of words of each language (of the word null)."""
    total: dict[str, int] = {}
    for shard in _shards(batches):
        if len(shard.hash):
            at, many = _counts(np.argsort(shard.hash), shard.hash)
            yield pa.RecordBatch.from_arrays([pa.array(shard.langs, pa.string()).take(pa.array(shard.lang[at])), shard.words(at), pa.array(many)], names=["lang", "word", "many"])
        for lang, n in zip(shard.langs, np.bincount(shard.lang, minlength=len(shard.langs)).tolist(), strict=True):
            total[lang] = total.get(lang, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.nulls(len(total), pa.string()), pa.array(list(total.values()))], names=["lang", "word", "many"])
    release()


def _word_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of (lang, word, many): a word is a text of one word."""
    for batch in batches:
        lang, word, many = batch.columns
        yield pa.RecordBatch.from_arrays([pa.array(Shard(word, lang).hash.view(np.int64)), lang, word, many], names=["key", "lang", "phrase", "a"])


def _edge_rows(depth: int, parent: np.ndarray, word: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(many), depth, np.int32)), pa.array(parent.view(np.int64)), pa.array(word.view(np.int64)), pa.array(many)], names=["depth", "parent", "word", "many"])


def _count_runs(passing: Bloom, depth: int):
    """Counts of the runs of ``depth`` words of which both runs of one word less pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            at, key = shard.frequent(passing, depth - 1)
            on = (at[1:] == at[:-1] + 1) & shard.joined[at[:-1]]
            parent, word = key[:-1][on], shard.hash[at[:-1][on] + depth - 1]
            if len(parent):
                one, many = _counts(np.argsort(_edge_key(parent, word)), parent, word)
                yield _edge_rows(depth, parent[one], word[one], many)
        release()

    return run


def _count_tries(triples: Bloom):
    """Counts of the longest runs, by each shard's trie over the triples that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            three = np.zeros(len(shard.hash), bool)
            three[shard.frequent(triples, 3)[0]] = True
            trie = CountTrie(shard, three, shard.joined, three)
            for depth in range(4, LONGEST + 1):
                yield _edge_rows(depth, *trie.edges(depth))
        release()

    return run


def _edge_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that (parent, word, lang, phrase, a) lead to."""
    for batch in batches:
        parent, word = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(_edge_key(parent, word).view(np.int64)), *batch.columns[2:]], names=["key", "lang", "phrase", "a"])


WALKED = "lang string, phrase string, words array<string>, a long, lefts array<long>"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left parts' counts of the phrases of two words and more; rows (lang, words, a) come in trie order, a prefix before what it begins."""
    path: list[tuple[str, int]] = []
    of = None
    for batch in batches:
        out = []
        for lang, words, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if lang != of:
                of, path = lang, []
            while len(path) >= len(words) or any(w != p[0] for w, p in zip(words, path, strict=False)):
                path.pop()
            if path:
                out.append((lang, " ".join(words), words, a, [n for _, n in path]))
            path.append((words[-1], a))
        if out:
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["lang", "phrase", "words", "a", "lefts"])


def _passing(nodes: DataFrame) -> Bloom:
    """The filter of nodes."""
    return Bloom(nodes.select(F.col("key").alias("id"), F.lit(0).alias("salt")))


def _frequent_edges(counted: DataFrame) -> DataFrame:
    """Edges counted ``LEAST`` times and more."""
    return counted.groupBy("depth", "parent", "word").agg(F.sum("many").alias("a")).filter(F.col("a") >= LEAST)


def _nodes(edges: DataFrame, above: DataFrame, words: DataFrame) -> DataFrame:
    """The nodes that ``edges`` lead to, with their phrases; ``above`` are those that they come from."""
    above, _ = broadcast_if_small(above.select(F.col("key").alias("parent"), "lang", F.col("phrase").alias("head")), BROADCAST_ROWS)
    last, _ = broadcast_if_small(words.select(F.col("key").alias("word"), F.col("phrase").alias("last")), BROADCAST_ROWS)
    spelled = edges.join(above, "parent").join(last, "word").select("parent", "word", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "a")
    return cut(spelled.mapInArrow(_edge_nodes, KEYED), "nodes")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", first: int = FIRST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``; see the module's docstring."""
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counted = src.mapInArrow(_count_words, COUNTED).groupBy("lang", "word").agg(F.sum("many").alias("many"))
    counted = cut(counted.filter(F.col("word").isNull() | (F.col("many") >= LEAST)), "words")
    words = cut(counted.filter("word is not null").mapInArrow(_word_nodes, KEYED), "nodes")
    pairs = _nodes(_frequent_edges(src.mapInArrow(_count_runs(_passing(words), 2), EDGES)), words, words)
    triples = _nodes(_frequent_edges(src.mapInArrow(_count_runs(_passing(pairs), 3), EDGES)), pairs, words)
    longest = cut(_frequent_edges(src.mapInArrow(_count_tries(_passing(triples)), EDGES)), "edges")
    levels = [words, pairs, triples]
    for depth in range(4, LONGEST + 1):
        levels.append(_nodes(longest.filter(F.col("depth") == depth), levels[-1], words))
    trie = reduce(DataFrame.unionAll, (x.select("lang", "phrase", "a") for x in levels))
    # sorted by words, not by the joined phrase, a prefix comes right before what it begins
    nodes = trie.select("lang", F.split("phrase", " ").alias("words"), "a").repartitionByRange("lang", F.col("words")[0]).sortWithinPartitions("lang", "words")
    walked = cut(nodes.mapInArrow(_walk, WALKED), "walked")
    # suffix links
    ways = walked.select("lang", "phrase", "words", "a", F.posexplode("lefts").alias("i", "l")).withColumn("k", F.col("i") + 1)
    ways = ways.withColumn("rest", F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ")).drop("words")
    ends = trie.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    totals = counted.filter("word is null").select("lang", F.col("many").alias("n"))
    totals, _ = broadcast_if_small(totals, BROADCAST_ROWS)
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = ways.join(ends, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("up", F.lit(1000).cast("decimal(4,0)") * exact("a", 16) * exact("n", 17)).withColumn("down", exact("l", 18) * exact("r", 18)).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # a longer candidate of the same count holds one of one word more that has it too
    m = F.size("words")
    inner = walked.filter(m > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice("words", F.lit(1), m - 1), " "), F.array_join(F.slice("words", F.lit(2), m - 1), " "))).alias("phrase")).distinct()
    kept = best.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    out = cut(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for done in (counted, longest, *levels, walked):
        drop(done)
    return out


ORACLE = """
with p as materialized (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), w as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
total as (select lang, sum(len(ws))::hugeint as n from w group by lang),
spot as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 0),
g as (select lang, array_to_string(ws[i:i + d - 1], ' ') as phrase, d from spot, range(1, 6) t(d) where i + d - 1 <= len(ws)),
f as materialized (select lang, phrase, d, count(*)::hugeint as a from g group by all having count(*) >= 100),
c as (select lang, phrase, d, a, string_split(phrase, ' ') as ws from f where d > 1),
cuts as (select c.*, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as rest from c, range(1, 5) t(k) where k < d),
s as (select cuts.lang, cuts.phrase, cuts.d, cuts.a, k, x.a as l, y.a as r, n, (1000 * cuts.a * n) // (x.a * y.a) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = head join f y on y.lang = cuts.lang and y.phrase = rest join total on total.lang = cuts.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select distinct lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, a from c, range(2, 5) t(m), range(1, 5) u(i) where m < d and i + m - 1 <= d),
kept as (select b.* from b anti join inside on inside.lang = b.lang and inside.phrase = b.phrase and inside.a = b.a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""
