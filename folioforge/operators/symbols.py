"""Symbols of a document and their rejoining: text layers often split a subscript off ("h aP" for haP).

A document's lexicon holds the tokens of its own text that look like symbols.  A
single letter, one blank and a token of up to four letters or digits become one
token where the lexicon has it; this is repeated until nothing changes, so that
what was split twice ("d F a") comes together too.

Plan.  The lexicon is an expression over tokens, made distinct within a page and
then within the document; only a document's symbols are grouped, never its text.
Pages meet their document's lexicon by a join on the document, and are rewritten
in one Arrow pass that is linear in the text.

Defined cases: null texts stay null and have no symbols; a document without
symbols stays as it is; a letter that has just been joined to what follows isn't
joined to what stands before it in the same pass; more blanks than one, or a line
break, are no split; long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short English words that a join never makes.
WORDS = (
    "as", "at", "an", "is", "in", "be", "on", "of", "or", "to", "it", "by", "if", "no", "so", "we", "up",
    "do", "go", "me", "my", "us", "am", "he", "the", "and", "for", "are", "see", "per",
)
LONGEST = 6


def looks_like_symbol(token: Column) -> Column:
    """Two to six letters or digits, a letter first: Greek, of mixed case, with a digit, or short and small; no common word."""
    first = F.substring(token, 1, 1)
    greek = F.regexp_like(F.lower(token), F.lit("[α-ω]"))
    mixed = F.regexp_like(token, F.lit("^.+[A-Z]")) & F.regexp_like(token, F.lit("[a-z]"))
    short = (F.length(token) <= 3) & (F.lower(token) == token)
    shape = F.length(token).between(2, LONGEST) & F.regexp_like(first, F.lit("\\p{L}")) & ~F.lower(token).isin(*WORDS)
    return shape & (greek | mixed | short | F.regexp_like(token, F.lit("[0-9]")))


def symbols_in(text: Column) -> Column:
    """The distinct symbols of a text, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}]+)")), looks_like_symbol)))


def lexicon(pages: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, symbols)`` of each document that has any."""
    each = pages.select(by, F.explode(symbols_in(F.col(text))).alias("symbol")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))


_LEFT = re.compile(r"(?<![^\W_])([^\W\d_]) (?=([^\W_]{1,4})(?![^\W_]))")


def rejoined(text: str, known: frozenset | set) -> str:
    """``text`` with its split symbols whole again."""
    while True:
        out, copied, end = [], 0, -1
        for m in _LEFT.finditer(text):
            token = m[1] + m[2]
            if m.start() != end and token in known and token.lower() not in WORDS:
                out.append(text[copied : m.end() - 1])
                copied = end = m.end()  # a single letter that was just taken stays with what took it
        if not out:
            return text
        text = "".join(out) + text[copied:]


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None or not known else rejoined(t, set(known)) for t, known in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=batch.schema.names[:-1])


def rejoin(pages: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """``pages`` with the split symbols of ``text`` rejoined by the document's own lexicon."""
    rest = [c for c in pages.columns if c != text]
    held = pages.select(*rest, F.col(text).cast("string").alias(text)).join(lexicon(pages, by, text).withColumnRenamed(by, "_of"), F.col(by) == F.col("_of"), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*rest, text).schema.fields)
    return held.select(*rest, text, "symbols").mapInArrow(_rewrite, schema).select(*pages.columns)
