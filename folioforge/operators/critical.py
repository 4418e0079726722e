"""Critical content of a version: required clauses that must live on in its chunks, required tokens in its text.

A required clause is preserved where it or a clause below it is the clause of a
chunk.  Chunks give out each clause on the way up from theirs, once a version, so
the check is an equality join of prefixes and its counts are those of the clause
tree; no chunk is compared with all requirements.  Tokens are searched in each
text for the requirements of its own code only, as one array beside it; these
arrays go to the texts, so that texts of one code don't meet in one task.

Defined cases: an annex ("Annex A") lives on in "A.1"; a chunk without a clause
preserves none; a requirement without any chunk is missing with zero below; null
texts hold no token; a token in parentheses is searched as it stands, others
where no letter, digit or low line touches them; a code without requirements
passes; repeated requirements count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.plans.lineage import broadcast_if_small

#: Codes whose requirements are sent to all tasks; those of more codes are joined by sorting.
CODE_ROWS = 100_000


def clause_path(clause: Column) -> Column:
    """A clause and all above it: 5.1.2 gives 5, 5.1, 5.1.2; annexes go by their letter."""
    parts = F.split(F.regexp_replace(F.trim(clause), "^Annex\\s+", ""), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def clauses_preserved(required: DataFrame, chunks: DataFrame, by: str = "version_id") -> DataFrame:
    """``required(by, clause)`` with ``n_chunks`` at or below the clause, and ``preserved``."""
    ways = chunks.filter(F.trim("clause") != "").select(by, F.explode(clause_path(F.col("clause"))).alias("_key")).groupBy(by, "_key").agg(F.count("*").alias("n_chunks"))
    wanted = required.select(by, "clause").distinct().withColumn("_key", F.element_at(clause_path(F.col("clause")), -1))
    out = wanted.join(ways, [by, "_key"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return out.select(by, "clause", "n_chunks", (F.col("n_chunks") > 0).alias("preserved"))


def holds_token(text: Column, token: Column) -> Column:
    """Whether a text holds a token whole."""
    quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return F.when(F.startswith(token, F.lit("(")), F.contains(text, token)).otherwise(F.regexp_like(text, quoted))


def tokens_missing(texts: DataFrame, required: DataFrame, code: str = "code", text: str = "text") -> DataFrame:
    """``texts`` with ``n_required`` and ``missing``, the tokens of ``required(code, token)`` that its text doesn't hold, in order."""
    wanted, _ = broadcast_if_small(required.groupBy(F.col(code).alias("_code")).agg(F.array_sort(F.collect_set("token")).alias("_wanted")), CODE_ROWS)
    none = F.array().cast("array<string>")
    held = texts.join(wanted, F.col(code) == F.col("_code"), "left").withColumn("_wanted", F.coalesce("_wanted", none))
    missing = F.filter("_wanted", lambda t: ~F.coalesce(holds_token(F.col(text), t), F.lit(False)))
    return held.withColumn("n_required", F.size("_wanted").cast("long")).withColumn("missing", missing).drop("_wanted", "_code")


def critical_gate(clauses: DataFrame, tokens: DataFrame, by: str = "version_id") -> DataFrame:
    """``(by, gate, status, lost)``: ``critical_content`` is ``review`` where a clause or a token is lost, else ``pass``."""
    lost = clauses.filter("not preserved").select(by, F.concat(F.lit("clause "), "clause").alias("lost")).unionByName(tokens.select(by, F.explode("missing").alias("t")).select(by, F.concat(F.lit("token "), "t").alias("lost")))
    every = clauses.select(by).unionByName(tokens.select(by)).distinct()
    held = every.join(lost.groupBy(by).agg(F.array_sort(F.collect_set("lost")).alias("lost")), by, "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    return held.select(by, F.lit("critical_content").alias("gate"), F.when(F.size("lost") > 0, "review").otherwise("pass").alias("status"), "lost")
