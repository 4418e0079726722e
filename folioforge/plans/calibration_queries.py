"""Queries of token calibration with their SQL; registered with those of ``catalog``.

Counted tokens come from a plain splitting of the texts (letters by six, digits
by three, other scripts by two, signs and line feeds by one): a rule that both
engines can count, in place of a model's tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import TOKEN_COEF, count_pieces
from folioforge.operators import calibration
from folioforge.operators.calibration import TERMS
from folioforge.plans.catalog import _FEATURES, query
from folioforge.plans.lineage import cut
from folioforge.plans.tables import table

_PIECES = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x00-\x7F]{1,2}|[!-/:-@\[-`{-~]|\n"
_COUNTED = _PIECES.replace(r"[!-/:-@\[-`{-~]", r"\p{Punct}")  # the same signs, by a table
_BETWEEN = r"[\x00-\x09\x0B-\x20\x7F]"  # what begins no piece
_SHORT = dict(zip(TERMS, ("one", "w", "l", "d", "n", "p", "nl"), strict=True))
_ROWS = f"f as materialized (select doc_id, lang, len(regexp_extract_all(text, '{_PIECES}')) as y, length(text) as c, 1 as one, {_FEATURES} from documents where text is not null), s as materialized (select * from f where y > 0)"
# the normal equations as rows (i, j, v), the counts as the last column; one elimination step a term
_SUMS = "m0 as materialized (" + " union all ".join(
    f"select {i} as i, {j} as j, sum({_SHORT[a]}::hugeint * {b}::hugeint)::double as v from s" for i, a in enumerate(TERMS) for j, b in enumerate([*(_SHORT[t] for t in TERMS), "y"])
) + ")"
_STEPS = ", ".join(
    f"m{k + 1} as materialized (select m.i, m.j, case when m.i = {k} then m.v / p.v else m.v - c.v * r.v / p.v end as v from m{k} m join m{k} p on p.i = {k} and p.j = {k} join m{k} r on r.i = {k} and r.j = m.j join m{k} c on c.j = {k} and c.i = m.i)"
    for k in range(len(TERMS))
)
_FIT = f"with {_ROWS}, {_SUMS}, {_STEPS}, coef as materialized (select i, v from m{len(TERMS)} where j = {len(TERMS)})"


def _linear(coef: dict[str, str]) -> str:
    return " + ".join(f"{coef[t]} * {_SHORT[t]}::double" for t in TERMS)


def _samples(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", count_pieces(F.col("text"), _COUNTED, _BETWEEN).alias("tokens"))
    return cut(calibration.samples(docs), "samples")


@query(_FIT + " select ['" + "','".join(TERMS) + "'][i + 1] as term, round(v, 4) as coefficient from coef")
def token_calibration(spark, sf_dir):
    """Coefficients fitted to all documents."""
    coef = calibration.fit(_samples(spark, sf_dir))
    return spark.createDataFrame([(t, round(coef[t], 4)) for t in TERMS], "term string, coefficient double")


@query(_FIT + f""", wide as materialized (select {', '.join(f'max(v) filter (i = {i}) as k{i}' for i in range(len(TERMS)))} from coef),
e as materialized (select u.name as estimator, (u.v - y) / y as off from (select s.*, unnest([
  {{name: 'current', v: greatest(1.0::double, ceil({_linear({t: f'{TOKEN_COEF[t]}::double' for t in TERMS})}))}}, {{name: 'fitted', v: greatest(1.0::double, {_linear({t: f'k{i}' for i, t in enumerate(TERMS)})})}}, {{name: 'chars_4', v: c / 4.0::double}}]) as u from s, wide)),
r as (select estimator, off, row_number() over (partition by estimator order by abs(off)) as place, count(*) over (partition by estimator) as n from e)
select estimator, max(n)::bigint as n, round(100 * sum(abs(off)) / max(n), 2) as mean_abs_pct, max(round(abs(off) * 10000.0::double) / 100.0::double) filter (place = (n - 1) // 2 + 1) as median_abs_pct,
  max(round(abs(off) * 10000.0::double) / 100.0::double) filter (place = (n - 1) * 19 // 20 + 1) as p95_abs_pct, round(count(*) filter (off < 0)::double / max(n), 3) as underestimate_share from r group by 1""")
def token_calibration_errors(spark, sf_dir):
    """Errors of the present estimate, the fitted one and a quarter of the characters over all documents."""
    rows = _samples(spark, sf_dir)
    return calibration.errors(rows, calibration.fit(rows))


@query(f"with {_ROWS} select lang, count(*)::bigint as n, round(avg(y / c::double), 3) as tokens_per_char from s where c > 0 group by 1")
def token_density(spark, sf_dir):
    """Counted tokens a character, by language."""
    return calibration.density(_samples(spark, sf_dir), "lang")
