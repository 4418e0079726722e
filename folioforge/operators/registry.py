"""A registry of formula rules as a table: structure checks, agreement with the engine, derivatives, provenance, what may be used.

Statuses are computed, never declared: a rule is verified when its evidence is
found, its expression agrees with the engine on every case and its identities
hold; a candidate when evidence is missing; rejected when anything disagrees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.expr import ExpressionError, compile_column, names, parse
from folioforge.operators.calc import CYLINDRICAL, cylindrical

KINDS = ("formula", "identity", "constant", "range", "table")


@dataclass(frozen=True)
class Rule:
    """One rule: what it gives, its expression over inputs and other outputs, what it rests on."""

    id: str
    family: str
    kind: str
    output: str
    expression: str
    depends: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()


_FAMILY = {"m_t": "module", "alpha_t": "pressure_angle", "d": "reference_circle", "d_b": "base_circle", "p_n": "pitch", "p_t": "pitch", "p_bt": "base_pitch", "h_a": "tooth_depth", "h_f": "tooth_depth", "h": "tooth_depth", "d_a": "tip_root_diameter", "d_f": "tip_root_diameter"}
#: Rules of the cylindrical gear, derived from the engine's own table; they rest on the outputs they use.
RULES = tuple(
    Rule(f"gear.{key}", _FAMILY[key], "formula", key, text, tuple(f"gear.{n}" for n in sorted(names(parse(text)) & {k for k, _, _ in CYLINDRICAL})), (f"evidence.{_FAMILY[key]}",)) for key, _, text in CYLINDRICAL
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.id, r.family, r.kind, r.output, r.expression, list(r.depends), list(r.evidence)) for r in rules]
    return spark.createDataFrame(rows, "id string, family string, kind string, output string, expression string, depends array<string>, evidence array<string>")


def structure_problems(rules: tuple[Rule, ...], known: set[str]) -> list[tuple[str, str]]:
    """(rule, problem): duplicates, unknown kinds, variables and dependencies, unreadable expressions."""
    ids, out = [r.id for r in rules], []
    for r in rules:
        if ids.count(r.id) > 1:
            out.append((r.id, "duplicate_id"))
        if r.kind not in KINDS:
            out.append((r.id, f"unknown_kind:{r.kind}"))
        out += [(r.id, f"unknown_dependency:{d}") for d in r.depends if d not in ids]
        try:
            out += [(r.id, f"unknown_variable:{v}") for v in sorted(names(parse(r.expression)) - known)]
        except ExpressionError as e:
            out.append((r.id, f"expression:{e}"))
    return sorted(set(out))


def agreement(cases: DataFrame, rules: tuple[Rule, ...] = RULES, rel: float = 1e-9) -> DataFrame:
    """``(id, n_cases, n_differ, worst)``: each rule's expression against the engine's output over a case matrix."""
    wide = cylindrical(cases)
    checks = F.array(*[F.struct(F.lit(r.id).alias("id"), compile_column(r.expression).alias("own"), F.col(r.output).alias("engine")) for r in rules])
    rows = wide.select(F.explode(checks).alias("c")).select("c.*")
    error = F.abs(F.col("own") - F.col("engine")) / F.greatest(F.abs("engine"), F.lit(1e-12))
    return rows.groupBy("id").agg(F.count("*").alias("n_cases"), F.sum((~F.coalesce(error <= rel, F.lit(False))).cast("long")).alias("n_differ"), F.max(error).alias("worst"))


def derivative_gap(cases: DataFrame, expression: str, variable: str, claimed: str, step: float = 1e-6) -> DataFrame:
    """Relative gap between a claimed derivative and the central difference, one row a case."""
    wide = cylindrical(cases)
    columns = {n: F.col(n).cast("double") for n in names(parse(expression)) | {variable}}
    h = F.lit(step) * F.greatest(F.abs(columns[variable]), F.lit(1.0))
    up, down = (compile_column(expression, columns | {variable: columns[variable] + s * h}) for s in (1, -1))
    slope, said = (up - down) / (2 * h), compile_column(claimed)
    return wide.select(F.try_divide(F.abs(slope - said), F.greatest(F.abs(said), F.lit(1e-9))).alias("gap"))


def statuses(rules: DataFrame, agreed: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(id, status)``: two passes, since a rule is no better than what it depends on. ``evidence(id)``: what was found."""
    found = rules.select("id", F.explode_outer("evidence").alias("e")).join(evidence.select(F.col("id").alias("e"), F.lit(True).alias("there")), "e", "left").groupBy("id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("sourced"))
    own = rules.join(found, "id", "left").join(agreed, "id", "left")
    first = own.withColumn("status", F.when(F.col("n_cases").isNull(), "unverified").when(F.col("n_differ") > 0, "rejected").when(F.col("sourced"), "verified").otherwise("candidate"))
    under = first.select("id", F.explode("depends").alias("d")).join(first.select(F.col("id").alias("d"), F.col("status").alias("s")), "d", "left").groupBy("id").agg(F.bool_or(F.col("s") == "rejected").alias("bad"), F.bool_and(F.col("s") == "verified").alias("good"))
    second = first.join(under, "id", "left")
    status = F.when((F.col("status") == "verified") & F.coalesce("bad", F.lit(False)), "rejected").when((F.col("status") == "verified") & ~F.coalesce("good", F.lit(True)), "candidate").otherwise(F.col("status"))
    return second.select("id", "family", status.alias("status"))


def provenance(rules: DataFrame, passages: DataFrame, observations: DataFrame) -> DataFrame:
    """One row a rule with its passages ``(evidence, code, page)`` and observations ``(id, source, agrees)``; conflicts are those that don't agree."""
    p = rules.select("id", F.explode_outer("evidence").alias("evidence")).join(passages, "evidence", "left").groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("code").isNotNull(), F.struct("code", "page")))).alias("passages"))
    o = observations.groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("observed"), F.array_sort(F.collect_set(F.when(~F.col("agrees"), F.col("source")))).alias("conflicts"))
    return rules.select("id", "output", "expression").join(p, "id", "left").join(o, "id", "left")


def corrections(diagnosed: DataFrame) -> DataFrame:
    """``(key, family, root_cause, occurrences, status)``: one candidate correction for each family and cause seen."""
    family = F.lit(None)
    for k, v in _FAMILY.items():
        family = F.when(F.col("key") == k, F.lit(v)).otherwise(family)
    named = diagnosed.withColumn("family", family).filter("cls not in ('UNKNOWN', 'LLM_ARITHMETIC_ERROR')")
    return named.groupBy("family", F.col("cls").alias("root_cause")).agg(F.count("*").alias("occurrences")).select(F.concat_ws(":", "family", "root_cause").alias("key"), "family", "root_cause", "occurrences", F.lit("CANDIDATE").alias("status"))


def usable(corrections_: DataFrame, engine_version: str, mode: str = "targeted", family: Column | None = None, top: int = 3) -> DataFrame:
    """Verified corrections that aren't stale, most frequent first; never candidates. Modes: targeted (a family), all, off."""
    live = corrections_.filter((F.col("status") == "VERIFIED") & (F.col("engine_version") == engine_version))
    if mode == "off":
        return live.limit(0)
    if mode == "targeted" and family is not None:
        live = live.filter(F.col("family") == family)
    return live.orderBy(F.desc("occurrences"), F.desc("updated"), "key").limit(top)
