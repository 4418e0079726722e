"""Grounded answers: every number an answer states must stand in its sources, its question or a list's own numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import canonical_number, numbers_in

MARKER = "(?i)\\[\\s*S\\s*([0-9]{1,2})\\s*\\]"


def cited(answer: Column) -> Column:
    """Numbers of the passages an answer cites, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARKER)), lambda x: x.cast("int"))))


def enumerators(answer: Column) -> Column:
    """Numbers that only number a list: at the start of a line, before a point or bracket and white space."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("(?m)^[ \\t]*([0-9]{1,2})[.)]\\s")), canonical_number))


def without_markers(answer: Column) -> Column:
    return F.regexp_replace(answer, MARKER, "")


def unsupported(answer: Column, allowed: Column) -> Column:
    """Stated numbers that neither ``allowed`` (an array) nor the list numbering holds."""
    body = without_markers(answer)
    return F.array_sort(F.array_except(F.array_except(numbers_in(body), allowed), enumerators(body)))


def clean(answer: Column) -> Column:
    """The shown text: markers and LaTeX delimiters gone, spaces before signs and doubled signs repaired."""
    t = F.regexp_replace(without_markers(answer), "\\\\\\(\\s*(.*?)\\s*\\\\\\)", "$1")
    t = F.regexp_replace(t, "(?s)\\\\\\[\\s*(.*?)\\s*\\\\\\]", "$1")
    t = F.regexp_replace(t, "[ \\t]+([.,;:])", "$1")
    t = F.regexp_replace(t, "([.!?])\\s*[,;]+", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \\t]{2,}", " "), "^\\s+", ""), "\\s+$", "")


def validate(answers: DataFrame, refusal: str) -> DataFrame:
    """``answers(answer, passages array<string>, question)`` with ``accepted, reason, cited, unsupported, shown``."""
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    refused = F.contains(F.lower("answer"), F.lit(refusal.lower()))
    marks = cited(F.col("answer"))
    n = F.size("passages")
    invalid = F.filter(marks, lambda c: (c < 1) | (c > n))
    allowed = F.array_distinct(F.concat(F.flatten(F.transform("passages", numbers_in)), numbers_in(F.coalesce("question", F.lit("")))))
    left = unsupported(F.col("answer"), allowed)
    reason = F.when(blank, "empty_answer").when(refused, "model_refused").when(F.size(invalid) > 0, F.concat(F.lit("invalid_citation:["), F.array_join(invalid.cast("array<string>"), ", "), F.lit("]"))).when(F.size(left) > 0, "unsupported_numbers")
    out = answers.withColumn("cited", marks).withColumn("unsupported", F.when(reason == "unsupported_numbers", left).otherwise(F.array().cast("array<string>"))).withColumn("reason", reason)
    return out.withColumn("accepted", F.col("reason").isNull()).withColumn("shown", F.when(F.col("accepted"), clean(F.col("answer"))).otherwise(F.lit(refusal)))
