"""Hybrid retrieval over a postings table: exact and lexical channels, rank fusion, coverage, diversity, budget, metrics.

Whole batches of questions run in one plan.  Every ranking has an id as its last
key, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.lineage import broadcast_if_small

#: Pairs of question and term up to which the question side is broadcast.
QUESTION_ROWS = 500_000


def lexemes(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """``(doc_id, lexeme, tf, first_pos)``: the inverted index of the plain configuration; ``only(lexeme)`` keeps the words of some questions, before anything is counted."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if only is None:  # whole texts are dealt by document, as they are smaller than their postings, which then needn't be shuffled
        texts = texts.repartition("doc_id")
    words = texts.select("doc_id", F.posexplode(lexemes(F.col("text"))).alias("pos", "lexeme"))
    if only is not None:
        wanted, _ = broadcast_if_small(only.select("lexeme").distinct(), QUESTION_ROWS)
        words = words.join(wanted, "lexeme", "left_semi")
    return words.groupBy("doc_id", "lexeme").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"))


def phrase_candidates(docs: DataFrame, phrases: DataFrame, phrase: str) -> DataFrame:
    """Documents that may hold a phrase, as rows of both: ``docs(doc_id, text)`` and ``phrases``, whose key is all its columns.

    A phrase's inner words stand whole in any text that holds it (its outer ones
    may be parts of words): the longest of them finds the documents by equality.
    Phrases without an inner word meet every document; they are a stated set,
    which stands in the plan in blocks.
    """
    inner = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.lower(phrase), "^[\\p{L}\\p{N}]+", " "), "[\\p{L}\\p{N}]+$", " "), F.lit("([\\p{L}\\p{N}]+)"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = phrases.withColumn("lexeme", longest)
    near = postings(docs, only=keyed.filter("lexeme is not null")).select("doc_id", "lexeme").join(keyed.filter("lexeme is not null"), "lexeme").drop("lexeme")
    out = near.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", *phrases.columns)
    bare = phrases.join(keyed.filter("lexeme is null").select(*phrases.columns), phrases.columns, "left_semi")
    rest = [r.asDict() for r in bare.toLocalIterator()]
    for i in range(0, len(rest), 1000):
        block = F.array(*(F.struct(*(F.lit(r[c]).cast(t).alias(c) for c, t in phrases.dtypes)) for r in rest[i : i + 1000]))
        out = out.unionByName(docs.select("doc_id", "text", F.explode(block).alias("p")).select("doc_id", "text", "p.*"))
    return out


def question_terms(questions: DataFrame, least: int = 1) -> DataFrame:
    """``(qid, lexeme)``: distinct words of each question of at least ``least`` characters."""
    return questions.select("qid", F.explode(F.array_distinct(lexemes(F.col("text")))).alias("lexeme")).filter(F.length("lexeme") >= least)


def _matched(index: DataFrame, terms: DataFrame) -> DataFrame:
    terms, _ = broadcast_if_small(terms, QUESTION_ROWS)
    return index.join(terms, "lexeme")


def lexical_channel(index: DataFrame, terms: DataFrame, top: int = 60) -> DataFrame:
    """``(qid, doc_id, score, rank)``: sum of tf/(tf+1) over the question's terms, best ``top`` a question."""
    score = F.sum(F.col("tf") / (F.col("tf") + 1.0))
    found = _matched(index, terms).groupBy("qid", "doc_id").agg(F.round(score, 9).alias("score"))
    return _ranked(found, top)


def exact_channel(index: DataFrame, terms: DataFrame, least: int = 9, top: int = 40) -> DataFrame:
    """``(qid, doc_id, score, rank)``: number of the question's long terms, taken as exact codes, that a document holds."""
    found = _matched(index, terms.filter(F.length("lexeme") >= least)).groupBy("qid", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return _ranked(found, top)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def prefix_search(index: DataFrame, prefixes: list[str], top: int = 50) -> DataFrame:
    """``(doc_id, n_hits)``: documents with a word for every prefix (up to eight), most hits first."""
    wanted = [p.lower() for p in prefixes[:8]]
    hit = F.array(*[F.when(F.col("lexeme").startswith(p), F.lit(i)) for i, p in enumerate(wanted)])
    held = index.filter(_any([F.col("lexeme").startswith(p) for p in wanted])).select("doc_id", "tf", F.explode(F.array_compact(hit)).alias("p"))
    found = held.groupBy("doc_id").agg(F.countDistinct("p").alias("n"), F.sum("tf").alias("n_hits")).filter(F.col("n") == len(wanted))
    return found.select("doc_id", "n_hits").orderBy(F.desc("n_hits"), "doc_id").limit(top)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def fuse(channels: dict[str, DataFrame], constant: int = 60) -> DataFrame:
    """``(qid, doc_id, fused, fused_norm, n_channels)``: reciprocal rank fusion, min-max scaled within a question (1 if all are equal)."""
    every = None
    for name, c in channels.items():
        part = c.select("qid", "doc_id", F.lit(name).alias("channel"), (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 12).alias("fused"), F.count("*").alias("n_channels"))
    w = Window.partitionBy("qid")
    low, high = F.min("fused").over(w), F.max("fused").over(w)
    return fused.withColumn("fused_norm", F.when(high > low, (F.col("fused") - low) / (high - low)).otherwise(F.lit(1.0)))


def coverage(fused: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``coverage``: the share of a question's terms that the document holds."""
    wanted = terms.groupBy("qid").agg(F.count("*").alias("n_terms"))
    held = fused.select("qid", "doc_id").join(terms, "qid").join(index.select("doc_id", "lexeme"), ["doc_id", "lexeme"]).groupBy("qid", "doc_id").agg(F.count("*").alias("n_held"))
    out = fused.join(held, ["qid", "doc_id"], "left").join(wanted, "qid")
    return out.withColumn("coverage", F.coalesce("n_held", F.lit(0)) / F.col("n_terms")).drop("n_held", "n_terms")


def rerank(covered: DataFrame, least: float = 0.6, weight: float = 0.15) -> DataFrame:
    """Adds ``final`` (coverage + weight * fused_norm + boosts, if there is such a column) and keeps those covered enough."""
    boost = F.col("boost") if "boost" in covered.columns else F.lit(0.0)
    return covered.filter(F.col("coverage") >= least).withColumn("final", F.round(F.col("coverage") + F.lit(weight) * F.col("fused_norm") + boost, 9))


def diversify(ranked: DataFrame, parent: str, per_parent: int = 2, top: int = 8, score: str = "final") -> DataFrame:
    """``place`` 1 .. top within a question: at most ``per_parent`` of a parent first, others fill what is left; a null parent is exempt."""
    own = Window.partitionBy("qid", parent).orderBy(F.desc(score), "doc_id")
    spill = F.when(F.col(parent).isNull(), F.lit(0)).otherwise((F.row_number().over(own) > per_parent).cast("int"))
    order = Window.partitionBy("qid").orderBy("spill", F.desc(score), "doc_id")
    return ranked.withColumn("spill", spill).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)


def budgeted(passages: DataFrame, budget: int = 6000, low: int = 400, high: int = 1400) -> DataFrame:
    """``share`` of characters for each passage in order: min(high, what is left) but at least ``low``; none once less is left."""
    ordered = passages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", F.length("text").alias("n")))).alias("items"))  # a question has few passages
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<place:bigint,doc_id:bigint,share:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        share = F.least(p["n"], F.greatest(F.lit(low), F.least(F.lit(high), acc["left"])))
        take = acc["left"] >= low
        item = F.struct(p["place"].alias("place"), p["doc_id"].alias("doc_id"), share.alias("share"))
        return F.struct(F.when(take, acc["left"] - share).otherwise(acc["left"]).alias("left"), F.when(take, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    return ordered.select("qid", F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("x")).select("qid", "x.place", "x.doc_id", F.col("x.share").cast("long").alias("share"))


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, place: str = "place", depth: int = 4) -> DataFrame:
    """One row: questions, Hit@1, Hit@depth, Recall@depth, MRR over ``truth(qid, doc_id)``."""
    wanted = truth.select("qid", "doc_id").distinct()
    n_true = wanted.groupBy("qid").agg(F.count("*").alias("n_true"))
    hits = ranked.select("qid", "doc_id", F.col(place).alias("p")).join(wanted, ["qid", "doc_id"])
    by = hits.groupBy("qid").agg(F.min("p").alias("first"), F.sum((F.col("p") <= depth).cast("int")).alias("held"))
    each = n_true.join(by, "qid", "left")
    flag = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return each.agg(
        F.count("*").alias("n_questions"), F.round(flag(F.col("first") == 1), 6).alias("hit_1"), F.round(flag(F.col("first") <= depth), 6).alias("hit_depth"),
        F.round(F.avg(F.coalesce(F.col("held") / F.col("n_true"), F.lit(0.0))), 6).alias("recall_depth"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def gate(best: Column, requested_missing: Column | None = None, least: float = 0.4) -> Column:
    """Relevance gate before an answer: refuse when all requested codes are missing or the best score is too low."""
    refuse = F.coalesce(best, F.lit(0.0)) < least
    out = F.when(refuse, F.lit("insufficient_relevance")).otherwise(F.lit("ok"))
    return out if requested_missing is None else F.when(requested_missing, F.lit("requested_source_missing")).otherwise(out)
