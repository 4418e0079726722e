"""English stems by the rules of Porter's paper of 1980, as an Arrow map over distinct words.

The rules of each step are tables of (ending, what it becomes) with a condition
on the measure of what stands before: the number of vowel-consonant runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings and replacements of steps 2, 3 and 4, and words too common to index.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
STOP = frozenset("a an and are as at be by for from has he in is it its of on or that the to was were will with this these those which".split())
_PAIRS2 = dict(zip(STEP2[::2], STEP2[1::2], strict=True))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Whether a stem ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word of a to z."""
    if len(word) <= 2:
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_PAIRS2, STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, [*STEP4, "ion"])
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(words: DataFrame, column: str = "lexeme") -> DataFrame:
    """``(lexeme, stem)`` of distinct words; other scripts and numbers are their own stem, stop words have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            out = [None if w is None or w in STOP else stem(w) if re.fullmatch("[a-z]+", w) else w for w in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["lexeme", "stem"])

    return words.select(F.col(column).alias("lexeme")).distinct().mapInArrow(run, "lexeme string, stem string")


# Weights of the parts of a chunk.
WEIGHTS = {"A": 1.0, "C": 0.2, "D": 0.1}


def weighted_postings(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, cfg, lexeme, weight, tf, positions)`` of ``chunks(chunk_id, clause, heading, context, text)``.

    Clause and heading weigh A, the context C, the text D; configuration
    'simple' keeps words, 'english' has their stems without stop words.  Only
    distinct words go through Python.
    """
    from folioforge.operators.search import lexemes

    parts = F.array(F.struct(F.lit("A").alias("weight"), F.concat_ws(" ", "clause", "heading").alias("t")), F.struct(F.lit("C").alias("weight"), F.coalesce("context", F.lit("")).alias("t")), F.struct(F.lit("D").alias("weight"), F.coalesce("text", F.lit("")).alias("t")))
    words = chunks.select("chunk_id", F.explode(parts).alias("p")).select("chunk_id", "p.weight", F.posexplode(lexemes(F.col("p.t"))).alias("pos", "lexeme"))
    simple = words.withColumn("cfg", F.lit("simple"))
    english = words.join(stems(words), "lexeme").filter("stem is not null").select("chunk_id", "weight", "pos", F.col("stem").alias("lexeme"), F.lit("english").alias("cfg"))
    both = simple.select("chunk_id", "cfg", "lexeme", "weight", "pos").unionByName(english.select("chunk_id", "cfg", "lexeme", "weight", "pos"))
    return both.groupBy("chunk_id", "cfg", "lexeme", "weight").agg(F.count("*").alias("tf"), F.slice(F.sort_array(F.collect_list("pos")), 1, 256).alias("positions"))


def weighted_rank(postings: DataFrame, terms: DataFrame, top: int = 60) -> DataFrame:
    """``(qid, chunk_id, rank, score)``: sum of weight * tf / (tf + 1) over ``terms(qid, cfg, lexeme)``, as r / (r + 1)."""
    from pyspark.sql import Window

    from folioforge.plans.lineage import broadcast_if_small

    weight = F.lit(0.0)
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("weight") == k, F.lit(v)).otherwise(weight)
    terms, _ = broadcast_if_small(terms, 500_000)
    r = postings.join(terms, ["cfg", "lexeme"]).groupBy("qid", "chunk_id").agg(F.sum(weight * F.col("tf") / (F.col("tf") + 1.0)).alias("r"))
    scored = r.select("qid", "chunk_id", F.round(F.col("r") / (F.col("r") + 1.0), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
