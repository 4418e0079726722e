"""Toxicity by noisy-channel deobfuscation: restore the text, then score it.

A token is suspect when a digit or sign stands among its letters or for one at
its edge, when a letter repeats three times or more, or when letters stand alone
one after another, with blanks or signs between them.  Its
character lattice offers every reading of each position: the character as it
is, the letters that leetspeak writes so, a run of a letter as one or two of it,
separators as nothing, and for spaced letters a word break.  Viterbi decoding
under a character 4-gram language model, counted over the words of all documents,
picks the reading; reading a character otherwise costs a channel penalty.  All
other tokens have one reading and pass as they are.

The restored text is scored by a logistic model over its words and their
beginnings (3 to 8 characters; log counts), learned from a sample of about
``PER_CLASS`` labelled documents a class whose crc32 fold isn't held out.  Of all
words and beginnings only those serve that stand in toxic documents too often
for chance: so often that about ``BY_CHANCE`` of all would by chance.
lang, source and doc_id are never inputs of a score.

Defined cases: a null text is empty and gets the score of an empty text; with
no labels, or labels of one class, every score is 0; a very long text is restored
and scored whole, in slices of bounded size; of readings with equal costs the
alphabetically last is taken; a score equal to the threshold predicts 1; null
``doc_id`` isn't held out and isn't learned from; repeated rows are scored
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import LOWER, SEPARATOR, fold, slices, utf8, words
from folioforge.llm.sampling import fold_of, logistic, per_class

PER_CLASS, FOLDS, HELD_OUT, THRESHOLD = 1500, 3, 1, 0.7
FEATURES, LEAST_DOCS, BY_CHANCE, SHORTEST, LONGEST = 3000, 2, 20, 3, 8
#: Words whose features a task keeps.
CACHE = 600_000
#: Distinct words or n-grams that a task counts before it passes the counts on.
HELD_COUNTS = 200_000
# Letters that leetspeak writes as a digit or sign.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATES = ".-_*~,'`^"
ORDER = 4
SUBSTITUTE, COLLAPSE, DROP, BREAK, UNCHANGED = -1.0, -0.7, -0.2, -1.5, -6.0


def grams_of(words: Iterable[tuple[str, int]]) -> Counter:
    """Counts of the n-grams of 1 to ORDER characters; a word weighs 1 + log2 of its count."""
    out: Counter = Counter()
    for w, n in words:
        n = n.bit_length()
        s = " " * (ORDER - 1) + w + " "
        for i in range(ORDER - 1, len(s)):
            for k in range(ORDER):
                out[s[i - k : i + 1]] += n
    return out


class Letters:
    """Character n-gram model with interpolated shorter contexts; words are padded with a blank."""

    def __init__(self, words: dict[str, int], grams: dict[str, int] | None = None):
        self.count: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for g, n in (grams_of(words.items()) if grams is None else grams).items():
            self.count[len(g)][g] = n
        self.context: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for k in range(1, ORDER + 1):
            for g, n in self.count[k].items():
                self.context[k][g[:-1]] += n
        self.kept: dict[str, float] = {}

    def cost(self, context: str, c: str) -> float:
        """Log probability of ``c`` after ``context`` (its last ORDER - 1 characters)."""
        key = context[-(ORDER - 1) :] + c
        if key not in self.kept:
            p = 1e-5
            for k in range(1, ORDER + 1):
                g = key[-k:]
                n = self.context[k][g[:-1]]
                if n:
                    mass = n / (n + 4.0)
                    p = (1 - mass) * p + mass * self.count[k][g] / n
            self.kept[key] = math.log(p)
        return self.kept[key]

    def restore(self, token: str, spaced: bool = False) -> str:
        """Viterbi decoding of a token's lattice; ``spaced``: its letters stood alone, so words may end between them."""
        runs: list[list] = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        # the state is the last ORDER - 1 characters; each keeps its best reading
        states = {" " * (ORDER - 1): (0.0, "")}
        for c, n in runs:
            readings: dict[str, float] = {}

            def offer(s: str, cost: float, readings=readings) -> None:
                readings[s] = max(cost, readings.get(s, -math.inf))

            if c.isalpha():
                offer(c, 0.0 if n == 1 else COLLAPSE)
                if n > 1:
                    offer(c * 2, 0.0 if n == 2 else COLLAPSE)
            elif c in LEET:
                for x in LEET[c]:
                    offer(x, SUBSTITUTE if n == 1 else SUBSTITUTE + COLLAPSE)
                    if n > 1:
                        offer(x * 2, 2 * SUBSTITUTE)
                offer(c * min(n, 2), UNCHANGED)
            elif c in SEPARATES:
                offer("", DROP)
            else:
                offer(c, UNCHANGED)
            after: dict[str, tuple[float, str]] = {}
            for state, (score, out) in states.items():
                for s, cost in readings.items():
                    for gap in ("", " ") if spaced and s and state[-1] != " " else ("",):
                        context, total, text = state, score + cost + (BREAK if gap else 0.0), gap + s
                        for x in text:
                            total += self.cost(context, x)
                            context = (context + x)[-(ORDER - 1) :]
                            if x == " ":
                                context = " " * (ORDER - 1)
                        if context not in after or total > after[context][0]:
                            after[context] = (total, out + text)
            states = after
        return max(states.items(), key=lambda kv: (kv[1][0] + self.cost(kv[0], " "), kv[1][1]))[1][1]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True
_STRONG = np.zeros(256, bool)  # leet wherever it touches a letter
_STRONG[list(b"0123456789@$")] = True
_WEAK = np.zeros(256, bool)  # leet or separators only between letters
_WEAK[list(b"!|+(" + SEPARATES.replace(",", "").replace("'", "").encode())] = True
_AT_START, _AT_END = np.zeros(256, bool), np.zeros(256, bool)  # leet at a word's edge, where prose has no such sign
_AT_START[list(b"!|+")] = True
_AT_END[list(b"|+")] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def blank_decoration(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with runs of three or more of a sign, or two of '!', made white space."""
    b = LOWER[b]
    same = np.zeros(len(b) + 1, bool)
    same[1:-1] = (b[1:] == b[:-1]) & _SIGN[b[1:]]
    same[off] = False
    three = same[1:-1] & same[2:] if len(b) > 1 else np.zeros(0, bool)
    out = b.copy()
    at = np.flatnonzero(three)  # b[at] == b[at + 1] == b[at + 2], as at + 1 and at + 2 equal those before them
    for k in range(3):
        out[at + k] = 32
    two = np.flatnonzero(same[1:-1] & (b[1:] == ord("!"))) if len(b) > 1 else at
    out[two] = 32
    out[two + 1] = 32
    return out


def suspects(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, spaced) of the suspect stretches of lower-cased bytes, in order and apart."""
    empty = np.zeros(0, np.int64)
    if not len(b):
        return empty, empty, empty.astype(bool)
    letter, strong, weak = _LETTER[b], _STRONG[b], _WEAK[b]
    before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
    readable = letter | strong
    before[1:], after[:-1] = readable[:-1], readable[1:]
    lb, la = np.zeros(len(b), bool), np.zeros(len(b), bool)
    lb[1:], la[:-1] = letter[:-1], letter[1:]
    odd = (strong & (lb | la)) | (weak & before & after & (lb | la))
    odd[1:-1] |= _ASCII_LETTER[b[1:-1]] & (b[1:-1] == b[:-2]) & (b[1:-1] == b[2:])
    for sign in b",'":  # i,d,i,o,t
        between = b[1:-3] == sign
        chain = np.flatnonzero(letter[:-4] & between & letter[2:-2] & (b[3:-1] == sign) & letter[4:]) if len(b) > 4 else empty
        odd[chain] = True
    starts, ends, first = words(b, off)
    if not len(starts):
        return empty, empty, empty.astype(bool)
    long = np.flatnonzero(ends - starts > 2)
    odd[starts[long]] |= _AT_START[b[starts[long]]] & letter[starts[long] + 1]  # !diot
    odd[ends[long] - 1] |= _AT_END[b[ends[long] - 1]] & letter[ends[long] - 2]  # shi+
    hit = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
    # three or more one-character words in a row
    one = (ends - starts == 1) & readable[starts]
    lead = np.zeros(len(starts), bool)
    lead[first[:-1][first[:-1] < len(starts)]] = True
    group = np.cumsum(~one | lead | np.concatenate(([True], ~one[:-1])))
    size = np.bincount(group[one], minlength=group[-1] + 1)
    run = one & (size[group] >= 3)
    f = np.flatnonzero(run)
    if len(f):
        cut = np.flatnonzero(np.diff(group[f])) + 1
        head, tail = f[np.concatenate(([0], cut))], f[np.concatenate((cut - 1, [len(f) - 1]))]
    else:
        head = tail = empty
    hit = hit[~run[hit]]
    s = np.concatenate((starts[hit], starts[head]))
    e = np.concatenate((ends[hit], ends[tail]))
    k = np.concatenate((np.zeros(len(hit), bool), np.ones(len(head), bool)))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], k[order]


def restored(raw: np.ndarray, off: np.ndarray, letters: Letters, kept: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the restored, lower-cased texts."""
    low = blank_decoration(raw, off)
    s, e, spaced = suspects(low, off)
    if not len(s):
        return low, off
    data, parts, last = low.tobytes(), [], 0
    grown = np.zeros(len(off), np.int64)
    own = np.searchsorted(off, s, "right")
    for a, z, sp, k in zip(s.tolist(), e.tolist(), spaced.tolist(), own.tolist(), strict=True):
        word = data[a:z]
        key = (word, sp)
        if key not in kept:
            if len(kept) > CACHE:
                kept.clear()
            text = word.decode(errors="replace")
            kept[key] = letters.restore("".join(text.split()) if sp else text.strip("".join(SEPARATES)), sp).encode()
        parts += [data[last:a], kept[key]]
        grown[k] += len(kept[key]) - (z - a)
        last = z
    parts.append(data[last:])
    return np.frombuffer(b"".join(parts), np.uint8), off + np.cumsum(grown)


class Model:
    """Weights of words and word beginnings (bytes; a whole word ends with a blank)."""

    def __init__(self, letters: Letters, weights: dict[bytes, float], bias: float):
        self.letters, self.weights, self.bias = letters, weights, bias

    def features_of(self, word: bytes) -> tuple[bytes, ...]:
        own = tuple(f for f in beginnings(word) if f in self.weights)
        if not own and any(x == y for x, y in zip(word, word[1:], strict=False)):
            single = bytes(y for x, y in zip(b"\0" + word, word, strict=False) if x != y) + b" "
            own = (single,) if single in self.weights else ()
        return own


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + b" "]


def surprise(k: int, n: int, share: float) -> float:
    """Minus the log of a bound on the chance that k or more of n documents are toxic where a share of all is (Chernoff)."""
    p = k / n
    if p <= share:
        return 0.0
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def texts_of(raw: np.ndarray, off: np.ndarray, letters: Letters, kept: dict) -> Iterator[list[bytes]]:
    """Words of each restored text."""
    for i, j in slices(off):
        b, at = fold(*restored(raw[off[i] : off[j]], off[i : j + 1] - off[i], letters, kept))
        data, at = b.tobytes(), at.tolist()
        for k in range(j - i):
            yield data[at[k] : at[k + 1]].split()


def scores(texts: pa.Array, model: Model, kept: dict, seen: set, hot: dict) -> list[float]:
    """Probabilities that the texts are toxic; kept, seen and hot are the task's caches."""
    out = []
    for own in texts_of(*utf8(texts), model.letters, kept):
        if len(seen) > CACHE:
            seen.clear()
            hot.clear()
        for w in set(own) - seen:
            seen.add(w)
            if f := model.features_of(w):
                hot[w] = f
        count: dict[bytes, int] = {}
        for w in own:
            if w in hot:
                for f in hot[w]:
                    count[f] = count.get(f, 0) + 1
        z = model.bias + sum(model.weights[f] * math.log1p(count[f]) for f in sorted(count))
        out.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def _counts(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["s", "n"])


def count_letters(docs: DataFrame) -> Letters:
    """The character model of all documents: words without digits are counted, then their n-grams; only n-grams come to the driver."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out: Counter = Counter()
            for w, n in held.items():
                if w.isalpha() or not any(48 <= x < 58 for x in w):
                    out[w.decode(errors="replace")] += n
            held.clear()
            return _counts(out)

        for batch in batches:
            raw, off = utf8(batch.column(0))
            for i, j in slices(off):
                b, _ = fold(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                held.update(b.tobytes().split())
                if len(held) > HELD_COUNTS:
                    yield told()
        yield told()

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 1000):
                held.update(grams_of(zip(words.slice(i, 1000).to_pylist(), counts.slice(i, 1000).to_pylist(), strict=True)))
                if len(held) > HELD_COUNTS:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    src = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    total = F.sum("n").alias("n")
    words = src.mapInArrow(count_words, "s string, n long").groupBy("s").agg(total)
    grams = words.mapInArrow(count_grams, "s string, n long").groupBy("s").agg(total).toArrow()
    return Letters({}, dict(zip(grams.column("s").to_pylist(), grams.column("n").to_pylist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, per_class_rows: int = PER_CLASS) -> Model | None:
    """Learn from a bounded sample of labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).dropDuplicates(["doc_id"])
    drawn = per_class(known, "y", "doc_id", per_class_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    got = rows.join(F.broadcast(drawn), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(got.column("y").to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return None
    texts = got.column("text").combine_chunks()
    raw, off = utf8(texts)
    letters = count_letters(docs)
    vocab: dict[bytes, int] = {}
    held = [np.unique(np.array([vocab.setdefault(w, len(vocab)) for w in own], np.int32), return_counts=True) for own in texts_of(raw, off, letters, {})]
    names = list(vocab)
    in_docs = [Counter(), Counter()]
    for (ids, _), t in zip(held, y.tolist(), strict=True):
        in_docs[int(t)].update({f for k in ids.tolist() for f in beginnings(names[k])})
    n1, n0 = max(1, int(y.sum())), max(1, len(y) - int(y.sum()))
    told = {f: surprise(k, k + in_docs[0][f], n1 / (n1 + n0)) for f, k in in_docs[1].items() if k >= LEAST_DOCS}
    least = math.log(max(1.0, len(in_docs[1]) / BY_CHANCE))
    rank = sorted((f for f in told if told[f] > 0 and told[f] >= least), key=lambda f: (-told[f], f))[:FEATURES]
    if not rank:
        return None
    place = {f: k for k, f in enumerate(rank)}
    of_word = [[place[f] for f in beginnings(w) if f in place] for w in names]
    x = np.zeros((len(y), len(rank)), np.float32)
    for r, (ids, counts) in enumerate(held):
        for k, n in zip(ids.tolist(), counts.tolist(), strict=True):
            for f in of_word[k]:
                x[r, f] += n
    x = np.log1p(x)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)  # both classes weigh the same: one clear insult should do
    w, b = logistic(x, y, l2=5e-5, steps=400, weight=share)
    return Model(letters, {f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-4}, float(b))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, hot = {}, set(), {}
        for batch in batches:
            p = scores(batch.column(1), model, kept, seen, hot) if model else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = src.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out and score every document."""
    return score_documents(docs, fit(docs, labels))
