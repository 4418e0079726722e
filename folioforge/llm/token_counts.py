"""Token counts by a linear longest-match automaton over a vocabulary trie.

Greedy word pieces: a word (a run without ASCII white space, as UTF-8 bytes) is
cut from the left into the longest pieces the vocabulary has; pieces at a
word's start are those marked as such, others continue a word.  Only the number
of pieces is wanted, so none is built: each trie node knows its failure link and
how many pieces are popped on the way there, as in linear-time longest-match
tokenisation.  A byte that no piece starts with is a piece of its own, so every
word has a length and the count is never cut.

The vocabulary is a byte-level one in the public ``tokenizers`` JSON format,
whose path is a parameter.  The driver reads it and sends the automaton to the
executors: its size is the vocabulary's, whatever the corpus.

Defined cases: null and blank texts count 0; very long texts and words are counted
whole; null ``doc_id`` and repeated rows pass through; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import SEPARATOR, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Distinct words whose lengths a task keeps.
CACHE = 400_000
_BLANK = bytes(b if SEPARATOR[b] else 0 for b in range(256))


def _byte_of() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, without the leading space; pieces that continue one)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = _byte_of()
    start, inner = [], []
    for token in vocab:
        if not all(c in byte for c in token):
            continue
        raw = bytes(byte[c] for c in token)
        if raw[:1] == b" " and len(raw) > 1 and not any(SEPARATOR[b] for b in raw[1:]):
            start.append(raw[1:])
        elif not any(SEPARATOR[b] for b in raw):
            inner.append(raw)
    return start, inner


class Automaton:
    """Trie of the vocabulary with failure links and popped-piece counts.

    Nodes 0 and 1 are the roots: word start, and continuation.  ``fail[v]`` and
    ``pops[v]``: where matching goes on when v has no fitting child, and the
    pieces it emits for that.  A node on the way to no piece has fail -1; then
    the word's bytes so far can't be cut and each is its own piece (only for
    vocabularies that lack single bytes).
    """

    def __init__(self, start: list[bytes], inner: list[bytes]):
        inner = list(dict.fromkeys([*inner, *(bytes([b]) for b in range(256) if not SEPARATOR[b])]))
        start = list(dict.fromkeys([*start, *(bytes([b]) for b in range(256) if not SEPARATOR[b])]))
        self.next: list[dict[int, int]] = [{}, {}]
        final, depth_order = {0: False, 1: False}, [0, 1]
        for root, words in ((0, start), (1, inner)):
            for w in words:
                v = root
                for b in w:
                    if b not in self.next[v]:
                        self.next[v][b] = len(self.next)
                        self.next.append({})
                    v = self.next[v][b]
                final[v] = True
        n = len(self.next)
        self.fail, self.pops = [1] * n, [0] * n
        self.fail[1] = -1
        self.fail[0] = -1
        level = [(v, 0, b) for b, v in self.next[0].items()] + [(v, 1, b) for b, v in self.next[1].items()]
        while level:
            deeper = []
            for v, parent, b in level:
                if final.get(v):  # v itself is the longest piece: pop it and go on at the continuation root
                    self.fail[v], self.pops[v] = 1, 1
                else:  # pop what the parent would, then what it takes to read b from there
                    z, popped = self.fail[parent], self.pops[parent]
                    while z >= 0 and b not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = (self.next[z][b], popped) if z >= 0 else (-1, 0)
                deeper += [(u, v, c) for c, u in self.next[v].items()]
            level = deeper

    def length(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word."""
        follow, fail, pops = self.next, self.fail, self.pops
        v = count = 0
        for b in word:
            u = follow[v].get(b)
            while u is None:
                count += pops[v]
                v = fail[v]
                u = follow[v].get(b)
            v = u
        while v > 1:
            count += pops[v]
            v = fail[v]
        return count


def greedy_length(word: bytes, start: set[bytes], inner: set[bytes]) -> int:
    """The same by trying every end from the right: for tests."""
    count = i = 0
    while i < len(word):
        own = start if not i else inner
        j = next((j for j in range(len(word), i + 1, -1) if word[i:j] in own), i + 1)
        count, i = count + 1, j
    return count


def _counter(vocab: tuple[list[bytes], list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = Automaton(*vocab).length  # a task builds it in half a second
        known: dict[bytes, int] = {}
        for batch in batches:
            raw, off = utf8(batch.column(1))
            ends = off.tolist()
            n_words, n_tokens = [], []
            view = memoryview(raw)
            for a, b in zip(ends, ends[1:], strict=False):
                words = bytes(view[a:b]).split()
                if len(known) > CACHE:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = length(w)
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | tuple[list[bytes], list[bytes]] = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every document."""
    vocab = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_counter(vocab), "doc_id long, n_words long, n_tokens long")
