"""Token calibration: coefficients of the token estimate, fitted to counted tokens of all texts.

Least squares over six integer features needs only sums of products, so the fit
is one aggregation whose partial sums have 35 exact numbers, whatever the
number of texts; the 7 x 7 system is solved in exact fractions.  Errors are
counted by hundredths of a percent, so median and 95th percentile come from
counts by value and nothing is sorted but these.

Defined cases: rows without a text or without a positive count take no part;
repeated rows count as often as they stand there; a feature that the texts lack,
or that the features before it determine, gets the coefficient 0; with no rows
at all every coefficient is 0 and there are no errors to tell.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import TOKEN_COEF, token_features

TERMS = ("intercept", "word", "long", "digit", "non_ascii", "punct", "newline")
_EXACT = "decimal(19,0)"


def samples(texts: DataFrame) -> DataFrame:
    """Features beside the counted ``tokens`` of ``texts(text, tokens, ...)``, without the texts themselves."""
    features = token_features(F.col("text"))
    others = [F.col(f"`{c}`") for c in texts.columns if c not in ("text", "tokens", "n_chars", *TERMS)]
    row = F.struct(F.col("tokens").cast("long").alias("tokens"), F.length("text").cast("long").alias("n_chars"), F.lit(1).cast("long").alias("intercept"), *[features[t].alias(t) for t in TERMS[1:]])
    # unpacked from an array, as the filter would otherwise be pushed below what counts the tokens and count them once more
    return texts.filter("text is not null").select(*others, F.inline(F.array(row))).filter("tokens > 0")


def moments(rows: DataFrame) -> DataFrame:
    """One row: the sums ``a_b`` of products of each two terms, and ``a_tokens``; exact."""
    product = lambda a, b: F.coalesce(F.sum(F.col(a).cast(_EXACT) * F.col(b).cast(_EXACT)), F.lit(0)).alias(f"{a}_{b}")
    return rows.agg(*[product(a, b) for i, a in enumerate(TERMS) for b in (*TERMS[i:], "tokens")])


def solve(sums: dict[str, int]) -> dict[str, float]:
    """Coefficients of the normal equations, by elimination in fractions; dependent terms are left at 0."""
    m = [[Fraction(int(sums[f"{a}_{b}" if i <= j else f"{b}_{a}"])) for j, b in enumerate(TERMS)] + [Fraction(int(sums[f"{a}_tokens"]))] for i, a in enumerate(TERMS)]
    kept = []
    for k in range(len(TERMS)):
        if m[k][k] == 0:  # what is left of a dependent term is exactly nothing
            continue
        kept.append(k)
        for i in range(len(TERMS)):
            if i != k and m[i][k] != 0:
                share = m[i][k] / m[k][k]
                m[i] = [x - share * y for x, y in zip(m[i], m[k], strict=True)]
    return {t: float(m[k][-1] / m[k][k]) if k in kept else 0.0 for k, t in enumerate(TERMS)}


def fit(rows: DataFrame) -> dict[str, float]:
    """Least-squares coefficients of ``samples``, by term."""
    return solve(moments(rows).first().asDict())


def predicted(coef: dict[str, float]) -> Column:
    """Tokens by a set of coefficients, at least 1."""
    total = F.lit(coef["intercept"])
    for t in TERMS[1:]:
        total = total + F.lit(coef[t]) * F.col(t).cast("double")
    return F.greatest(F.lit(1.0), total)


def errors(rows: DataFrame, coef: dict[str, float]) -> DataFrame:
    """``(estimator, n, mean_abs_pct, median_abs_pct, p95_abs_pct, underestimate_share)`` of the present estimate, the fitted one, and a quarter of the characters.

    A quantile q is the value at place floor(q (n - 1)) of the errors in order, to hundredths of a percent.
    """
    ways = {"current": F.ceil(predicted(TOKEN_COEF)).cast("double"), "fitted": predicted(coef), "chars_4": F.col("n_chars").cast("double") / 4.0}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("estimator"), v.alias("predicted")) for name, v in ways.items()])).alias("e")
    off = (F.col("e.predicted") - F.col("tokens")) / F.col("tokens")
    told = rows.select("*", each).select("e.estimator", off.alias("off"), F.round(F.abs(off) * 10000.0).cast("long").alias("bp"))
    counts = told.groupBy("estimator", "bp").agg(F.count("*").alias("c"), F.sum(F.abs("off")).alias("total"), F.sum((F.col("off") < 0).cast("long")).alias("under"))
    upto = Window.partitionBy("estimator").orderBy("bp").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("estimator")))
    at = lambda num, den: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * num / den), F.col("bp"))) / 100.0
    return placed.groupBy("estimator").agg(
        F.max("n").alias("n"), F.round(100 * F.sum("total") / F.max("n"), 2).alias("mean_abs_pct"), at(1, 2).alias("median_abs_pct"), at(19, 20).alias("p95_abs_pct"), F.round(F.sum("under") / F.max("n"), 3).alias("underestimate_share")
    )


def density(rows: DataFrame, by: str) -> DataFrame:
    """``(by, n, tokens_per_char)``: the mean over the texts of each kind; empty texts have none."""
    return rows.filter("n_chars > 0").groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("tokens") / F.col("n_chars")), 3).alias("tokens_per_char"))
