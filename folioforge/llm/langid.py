"""Language ID by hierarchical discrimination.

First the language family, then one-versus-one linear support vector machines
among the languages of that family.  Features are hashed letter trigrams (bytes
of the folded text, digits and signs as word ends) as shares of the text's
trigrams, so a text of any length is scored whole in one pass of table look-ups.

Families are fixed values for common codes; any other learned language is a
family of its own.  Where all learned languages are of one family, that level
is skipped.  ``score`` is the share of confidence: the family's times that of
the language's weakest duel, each a logistic of the margin.

It learns from a sample of about ``PER_LANG`` documents of each language, drawn
by a hash of the id from those whose ``lang`` isn't null and whose crc32 fold
isn't held out.  lang, source and doc_id are never inputs of a prediction.

Defined cases: a null text, or one without any Unicode letter, is ``und`` with
score 0; with no learned language every text is ``und``; a very long text is
scored whole, in one pass over its trigrams; null ``doc_id`` isn't held out and
isn't learned from; repeated rows are scored alike; ties go to the alphabetically
first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import fold, release, slices, utf8
from folioforge.llm.sampling import fold_of, linear_svm, per_class

BUCKETS, PER_LANG, FOLDS, HELD_OUT = 1 << 12, 500, 4, 2
#: Scores below which a document counts as told by nothing, and from which a prediction outweighs a given language.
LEAST, SURE = 0.2, 0.9
# Families of common language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"alone:{lang}")


def _trigrams(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte but the texts' closing spaces, and each text's first such byte."""
    x = b.astype(np.uint32)
    left = np.concatenate((np.array([32], np.uint32), x[:-1]))
    right = np.concatenate((x[1:], np.array([32], np.uint32)))
    h = (((left << np.uint32(16)) | (x << np.uint32(8)) | right) * np.uint32(2654435761)) >> np.uint32(32 - 12)
    keep = np.ones(len(x), bool)
    keep[off[1:] - 1] = False
    return h[keep].astype(np.int64), off - np.arange(len(off))


class Model:
    """Family machines (one against the rest) and pair machines, as one table of weights for each bucket."""

    def __init__(self, langs: list[str], x: np.ndarray, y: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(c) for c in self.langs})
        of = np.array([self.langs.index(c) for c in y], np.int64)
        fam = np.array([self.families.index(family_of(c)) for c in y], np.int64)
        self.pairs = [(a, b) for i, a in enumerate(self.langs) for b in self.langs[i + 1 :] if family_of(a) == family_of(b)]
        scale = 1.0 / (x.std(axis=0) + 1e-4) if len(x) else np.ones(BUCKETS)
        z = (x * scale / np.sqrt(BUCKETS)).astype(np.float32)
        tables, bias = [], []

        def fit(rows: np.ndarray, sign: np.ndarray) -> None:
            share = np.where(sign > 0, 1.0 / max(1, (sign > 0).sum()), 1.0 / max(1, (sign < 0).sum()))
            w, b = linear_svm(z[rows], sign.astype(np.float32), c=1.0, weight=share)
            tables.append(w * scale / np.sqrt(BUCKETS))
            bias.append(b)

        if len(self.families) > 1:
            for k in range(len(self.families)):
                fit(np.arange(len(y)), np.where(fam == k, 1, -1))
        for a, b in self.pairs:
            rows = np.flatnonzero((of == self.langs.index(a)) | (of == self.langs.index(b)))
            fit(rows, np.where(of[rows] == self.langs.index(a), 1, -1))
        self.table = np.array(tables, np.float32).T.copy() if tables else np.zeros((BUCKETS, 0), np.float32)
        self.bias = np.array(bias, np.float64)

    def margins(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row of margins for each text."""
        h, at = _trigrams(b, off)
        n = np.diff(at)
        if not len(h) or not self.table.shape[1]:
            return np.tile(self.bias, (len(n), 1))
        out = np.zeros((len(n), self.table.shape[1]))
        full = np.flatnonzero(n > 0)
        for m in range(self.table.shape[1]):
            out[full, m] = np.add.reduceat(self.table[:, m][h].astype(np.float64), at[:-1][full]) / n[full]
        return out + self.bias

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        sure = lambda m: 1.0 / (1.0 + np.exp(-np.clip(3.0 * m, -30, 30)))
        if len(self.families) > 1:
            own = margins[:, : len(self.families)]
            family = own.argmax(axis=1)
            first, p_family = len(self.families), sure(own.max(axis=1))
        else:
            family, first, p_family = np.zeros(n, np.int64), 0, np.ones(n)
        votes, weakest = np.zeros((n, len(self.langs))), np.ones((n, len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            p = sure(margins[:, first + k])
            i, j = self.langs.index(a), self.langs.index(b)
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
            weakest[:, i] = np.minimum(weakest[:, i], p)
            weakest[:, j] = np.minimum(weakest[:, j], 1 - p)
        member = np.array([self.families.index(family_of(c)) for c in self.langs])
        rank = votes + 0.5 * weakest
        rank[member[None, :] != family[:, None]] = -1
        best = rank.argmax(axis=1)
        return [self.langs[k] for k in best], p_family * weakest[np.arange(n), best]


def features(texts: pa.Array) -> np.ndarray:
    """Shares of trigram buckets of each text, for fitting."""
    raw, off = utf8(texts)
    out = np.zeros((len(off) - 1, BUCKETS), np.float32)
    for i, j in slices(off):
        h, at = _trigrams(*fold(raw[off[i] : off[j]], off[i : j + 1] - off[i], digits=False))
        for k in range(j - i):
            own = h[at[k] : at[k + 1]]
            if len(own):
                out[i + k] = np.bincount(own, minlength=BUCKETS) / len(own)
    return out


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from a bounded sample of the documents that aren't held out; None if no document has a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    sample = per_class(rows, "lang", "doc_id", per_lang).toArrow().sort_by("doc_id")
    if not sample.num_rows:
        return None
    y = sample.column("lang").to_pylist()
    return Model(sorted(set(y)), features(sample.column("text").combine_chunks()), y)


def _has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    count = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = count[off[1:]] > count[off[:-1]]
    for k in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[k] = any(c.isalpha() for c in raw[off[k] : off[k + 1]].tobytes().decode())
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = label(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = src.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def label(texts: pa.Array, model: Model | None) -> tuple[list[str], list[float]]:
    """Languages and scores of a column of texts."""
    raw, off = utf8(texts)
    lang, score = [], []
    for i, j in slices(off):
        own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if model is None:
            lang += ["und"] * (j - i)
            score += [0.0] * (j - i)
            continue
        names, p = model.predict(model.margins(*fold(own, at, digits=False)))
        real = _has_letter(own, at)
        lang += [c if ok else "und" for c, ok in zip(names, real, strict=True)]
        score += np.where(real, p, 0.0).tolist()
    return lang, score


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the documents' own labels and predict every document."""
    return identify(docs, fit(docs))


def keep_known(docs: DataFrame, model: Model | None, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """``docs`` without those whose language isn't told: ``und``, or a score below ``least``.

    The prediction becomes ``lang`` where that is null, or differs from a
    prediction whose score is ``sure`` at least.
    """
    fields, at, own = docs.schema, docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, score = label(batch.column(at).cast(pa.string()), model)
            given = batch.column(own).to_pylist()
            lang = [p if g is None or s >= sure else g for g, p, s in zip(given, told, score, strict=True)]
            cols = list(batch.columns)
            cols[own] = pa.array(lang, batch.column(own).type)
            keep = pa.array([c != "und" and s >= least for c, s in zip(told, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep)
        release()

    return docs.mapInArrow(run, fields)
