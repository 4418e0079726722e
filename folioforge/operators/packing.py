"""Greedy packing of ordered pieces as folds over arrays: page segments, token-bounded chunks, anchored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import estimate_from, let, token_features

_NAMES = ("word", "long", "digit", "non_ascii", "punct", "newline")


def segments(text: Column, size: int = 3000) -> Column:
    """Pages of a plain text: paragraphs packed to ``size`` characters; what exceeds twice that is cut every ``size``."""
    start = F.struct(F.array().cast("array<string>").alias("pages"), F.lit("").alias("buf"))

    def cuts(pages: Column, buf: Column) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.length(buf) - 2 * size) / F.lit(float(size))).cast("int"))
        pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(buf, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(pages, pieces).alias("pages"), F.substring(buf, n * size + 1, F.length(buf)).alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["buf"]) + F.length(p) > size) & (acc["buf"] != "")
        pages = F.when(full, F.concat(acc["pages"], F.array(acc["buf"]))).otherwise(acc["pages"])
        buf = F.when(full | (acc["buf"] == ""), p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p))
        return cuts(pages, buf)

    return F.aggregate(F.split(text, "\n\\s*\n"), start, step, lambda acc: F.when(acc["buf"] != "", F.concat(acc["pages"], F.array(acc["buf"]))).otherwise(acc["pages"]))


def pack_runs(pieces: Column, limit: int, joint: str = "newline") -> Column:
    """Runs (first, size, tokens) of an array of texts: pieces join while the estimate of the joined text stays within ``limit``.

    Features are taken once a piece; the fold carries their integer sums, so the
    estimate of a joined text is exactly that of its characters, and it writes a
    run when one closes.  ``joint`` is 'newline' or 'space'.
    """
    more = 1 if joint == "newline" else 0
    features = F.transform(pieces, lambda p: F.struct(*(c.alias(n) for n, c in token_features(p).items()), (F.length(p) == 0).alias("blank")))
    none = F.array().cast("array<struct<first:int,size:int,tokens:bigint>>")
    start = F.struct(*(F.lit(0).cast("long").alias(n) for n in _NAMES), F.lit(True).alias("blank"), F.lit(1).alias("first"), F.lit(0).alias("size"), none.alias("out"))

    def closed(acc: Column) -> Column:
        tokens = F.when(acc["blank"] & (acc["size"] == 1), F.lit(0).cast("long")).otherwise(estimate_from({n: acc[n] for n in _NAMES}))
        return F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["size"].alias("size"), tokens.alias("tokens"))))

    def step(acc: Column, own: Column) -> Column:
        joined = F.struct(*((acc[n] + own[n] + (more if n == "newline" else 0)).alias(n) for n in _NAMES))

        def grown(j: Column) -> Column:
            fits = (acc["size"] > 0) & (estimate_from({n: j[n] for n in _NAMES}) <= limit)
            join = F.struct(*(j[n].alias(n) for n in _NAMES), F.lit(False).alias("blank"), acc["first"].alias("first"), (acc["size"] + 1).alias("size"), acc["out"].alias("out"))
            new = F.struct(*(own[n].alias(n) for n in _NAMES), own["blank"].alias("blank"), (acc["first"] + acc["size"]).alias("first"), F.lit(1).alias("size"), F.when(acc["size"] > 0, closed(acc)).otherwise(acc["out"]).alias("out"))
            return F.when(fits, join).otherwise(new)

        return let(joined, grown)

    return F.aggregate(features, start, step, lambda acc: F.when(acc["size"] > 0, closed(acc)).otherwise(acc["out"]))


def pack_lines(docs: DataFrame, limit: int = 160) -> DataFrame:
    """``(doc_id, chunk, text, n_lines, tokens)``: the lines of each text packed to ``limit`` tokens."""
    lines = docs.filter("text is not null and text <> ''").select("doc_id", F.split("text", "\n").alias("lines"))
    runs = lines.select("doc_id", "lines", F.posexplode(pack_runs(F.col("lines"), limit)).alias("chunk", "run"))
    text = F.array_join(F.slice("lines", F.col("run.first"), F.col("run.size")), "\n")
    return runs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), text.alias("text"), F.col("run.size").cast("long").alias("n_lines"), F.col("run.tokens").alias("tokens"))


def anchored_sizes(times: Column, width: float) -> Column:
    """Sizes of the windows of a sorted array of times: a window starts at its first time and takes those less than ``width`` later."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        inside = t - acc["anchor"] < width
        new = F.struct(t.alias("anchor"), F.lit(1).cast("long").alias("n"), F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]).alias("out"))
        return F.when(inside, F.struct(acc["anchor"].alias("anchor"), (acc["n"] + 1).alias("n"), acc["out"].alias("out"))).otherwise(new)

    return F.aggregate(F.transform(times, lambda t: t.cast("double")), start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]))


def anchored_windows(rows: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """``(key, win, n)``: each key's times in windows that start at the first time behind the window before.

    A gap of ``width`` starts a window wherever the one before began, so only the
    times between two such gaps have to meet in one fold.
    """
    order = Window.partitionBy(key).orderBy(time)
    apart = rows.select(key, time).withColumn("_new", (F.col(time) - F.lag(time).over(order) >= width).cast("int")).withColumn("_stretch", F.coalesce(F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    sizes = apart.groupBy(key, "_stretch").agg(F.sort_array(F.collect_list(time)).alias("_times")).select(key, "_stretch", anchored_sizes(F.col("_times"), width).alias("_sizes"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.withColumn("_base", F.coalesce(F.sum(F.size("_sizes")).over(before), F.lit(0)))
    return based.select(key, "_base", F.posexplode("_sizes").alias("_pos", "n")).select(key, (F.col("_base") + F.col("_pos")).cast("long").alias("win"), "n")


def chunk_summary(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Counts, upper median and maximum of tokens by group; the median is exact: counts by token value, then a running sum."""
    values = chunks.groupBy(*by, "tokens").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    run = values.withColumn("upto", F.sum("k").over(w.orderBy("tokens"))).withColumn("n", F.sum("k").over(w))
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("tokens")))
    return run.groupBy(*by).agg(F.sum("k").alias("n_chunks"), upper.alias("median_tokens"), F.max("tokens").alias("max_tokens"))
