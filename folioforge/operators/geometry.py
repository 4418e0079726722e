"""Glyphs to text: words of a page from single glyphs, fragments on a line, and displayed equations from their geometry.

Rows and words are window expressions over glyph tables.  An equation is a small
tree read from a few dozen glyphs and bars, one Arrow call for each batch of
equations: fractions by their bars, roots, scripts by size and baseline.  What
can't be explained makes the equation ``needs_review``, without LaTeX; every
glyph must come out exactly once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATEX = {"α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\varepsilon", "ρ": "\\rho", "π": "\\pi", "φ": "\\varphi", "ψ": "\\psi", "μ": "\\mu", "Σ": "\\Sigma", "≤": "\\le", "≥": "\\ge", "×": "\\times", "·": "\\cdot", "−": "-", "√": "\\sqrt"}
NAMES = ("arctan", "arccos", "arcsin", "cos", "sin", "tan", "inv", "log", "ln", "max", "min")
KNOWN = re.compile(r"[A-Za-z0-9α-ωΑ-Ω=+\-−×·/().,\[\]|≤≥<>°'*:;∞√]+")


def words_of(glyphs: DataFrame, row: float = 2.0, gap: float = 0.33) -> DataFrame:
    """``glyphs(doc_id, page, x0, x1, baseline, text)`` -> ``(doc_id, page, row, text)``: lines rebuilt of single glyphs.

    A row is a run of baselines less than ``row`` apart; a space stands where
    the distance to the glyph before exceeds ``gap`` of the row's median width.
    """
    down = Window.partitionBy("doc_id", "page").orderBy("baseline")
    new = F.coalesce(F.col("baseline") - F.lag("baseline").over(down) > row, F.lit(True)).cast("int")
    g = glyphs.withColumn("_new", new).withColumn("row", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy("doc_id", "page", "row")
    across = line.orderBy("x0", "x1")
    g = g.withColumn("_w", F.percentile(F.col("x1") - F.col("x0"), 0.5).over(line)).withColumn("_gap", F.col("x0") - F.lag("x1").over(across)).withColumn("n", F.row_number().over(across))
    piece = F.concat(F.when(F.col("_gap") > F.col("_w") * gap, " ").otherwise(""), F.col("text"))
    rows = g.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("t")))).alias("p"))
    return rows.select("doc_id", "page", "row", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def merge_fragments(runs: DataFrame, touch: float = 3.0, row: float = 4.0) -> DataFrame:
    """``runs(doc_id, page, x0, x1, y0, y1, text, in_table)`` that touch on one visual row, joined; cells of tables never are."""
    bucket = F.round((F.col("y0") + F.col("y1")) / 2 / row).cast("long")
    w = Window.partitionBy("doc_id", "page", "band").orderBy("x0", "x1")
    apart = F.col("x0") - F.lag("x1").over(w) > touch
    g = runs.withColumn("band", bucket).withColumn("_new", (F.coalesce(apart, F.lit(True)) | F.col("in_table") | F.coalesce(F.lag("in_table").over(w), F.lit(False))).cast("int"))
    g = g.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = g.groupBy("doc_id", "page", "band", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("p"))
    return joined.select("doc_id", "page", "x0", "x1", "y0", "y1", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def join_numbers(lines: DataFrame, near: float = 2.5, gap: float = 120.0) -> DataFrame:
    """``lines(doc_id, page, x0, x1, baseline, text, in_table)``: a bare clause number joins the title that follows on its baseline."""
    w = Window.partitionBy("doc_id", "page", F.round(F.col("baseline") / (2 * near))).orderBy("x0")
    number = F.regexp_like("text", F.lit("^(?:[0-9]{1,2}(?:\\.[0-9]{1,2})*|[A-Z](?:\\.[0-9]{1,2})+)$")) & ~F.col("in_table")
    follows = F.coalesce((F.lead("x0").over(w) - F.col("x1") < gap) & (F.abs(F.lead("baseline").over(w) - F.col("baseline")) <= near) & ~F.lead("in_table").over(w), F.lit(False))
    m = lines.withColumn("_takes", number & follows).withColumn("_title", F.lead("text").over(w)).withColumn("_taken", F.coalesce(F.lag(number & follows).over(w), F.lit(False)))
    return m.filter(~F.col("_taken")).withColumn("text", F.when(F.col("_takes"), F.concat_ws(" ", "text", "_title")).otherwise(F.col("text"))).drop("_takes", "_title", "_taken")


# ------------------------------------------------------------------ equations


@dataclass
class _Box:
    """Something placed: a glyph or a finished part, with its plain and LaTeX forms."""

    x0: float
    x1: float
    y0: float
    y1: float
    size: float
    base: float
    plain: str
    latex: str
    glyphs: list[str] = field(default_factory=list)


def _glyph(g: dict) -> _Box:
    t = g["text"]
    return _Box(g["x0"], g["x1"], g["y0"], g["y1"], g["size"], g["baseline"], t, "".join(LATEX.get(c, c) + (" " if c in LATEX and len(LATEX[c]) > 1 else "") for c in t).strip(), list(t))


def _group(plain: str) -> str:
    return plain if re.fullmatch(r"[\w.,*°]+", plain) else f"({plain})"


def _sequence(boxes: list[_Box], problems: list[str]) -> _Box:
    """Boxes of one line from left to right; smaller ones off the line's baseline are scripts of what stands before."""
    boxes = sorted(boxes, key=lambda b: (b.x0, b.x1))
    full = max(b.size for b in boxes)
    main = [b for b in boxes if b.size > 0.8 * full]
    line = sorted(b.base for b in main)[len(main) // 2]
    plain, latex, held, script = "", "", [], ""
    last = None
    for b in boxes:
        small = b.size <= 0.8 * full
        kind = "_" if small and b.base > line + 0.5 else "^" if small and b.base < line - 0.5 else ""
        if small and not kind:
            problems.append("small_glyph_on_baseline")
        if not small and abs(b.base - line) > 0.35 * full:
            problems.append("off_baseline")
        if kind != script and script:
            latex += "}"
        if kind and kind != script:
            if not plain:
                problems.append("script_without_base")
            latex += kind + "{"
            plain += "^" if kind == "^" else ""
        spaced = last is not None and b.x0 - last.x1 > 0.2 * full and not kind
        plain += (" " if spaced or b.plain in ("=", "+", "−", "-", "≤", "≥") and not kind and plain else "") + b.plain + (" " if b.plain in ("=", "+", "−", "≤", "≥") and not kind else "")
        latex += (" " if spaced or b.plain in ("=", "≤", "≥") and not kind else "") + b.latex + (" " if b.plain in ("=", "≤", "≥") and not kind else "")
        held += b.glyphs
        script, last = kind, b
    latex += "}" if script else ""
    for n in NAMES:
        latex = re.sub(rf"(?<![A-Za-z\\]){n}(?![A-Za-z])", rf"\\{n}" if n != "inv" else r"\\operatorname{inv}", latex)
    tidy = lambda s: re.sub(r"\s+", " ", s).strip()
    return _Box(min(b.x0 for b in boxes), max(b.x1 for b in boxes), min(b.y0 for b in boxes), max(b.y1 for b in boxes), full, line, tidy(plain), tidy(latex), held)


def _region(boxes: list[_Box], bars: list[tuple[float, float, float]], problems: list[str]) -> _Box | None:
    """A region: its widest bar splits what lies over and under it into a fraction, which then is one box of the line."""
    for x0, x1, y in sorted(bars, key=lambda b: b[0] - b[1]):
        over = [b for b in boxes if x0 - 1 <= (b.x0 + b.x1) / 2 <= x1 + 1 and (b.y0 + b.y1) / 2 < y]
        under = [b for b in boxes if x0 - 1 <= (b.x0 + b.x1) / 2 <= x1 + 1 and (b.y0 + b.y1) / 2 > y]
        rest = [b for b in bars if b != (x0, x1, y)]
        if not over or not under:
            problems.append("bar_without_fraction")
            continue
        inner = [b for b in rest if x0 - 1 <= (b[0] + b[1]) / 2 <= x1 + 1]
        top = _region(over, [b for b in inner if b[2] < y], problems)
        bottom = _region(under, [b for b in inner if b[2] > y], problems)
        size = max(b.size for b in boxes)
        made = _Box(min(x0, top.x0, bottom.x0), max(x1, top.x1, bottom.x1), top.y0, bottom.y1, size, y + 0.3 * size, f"{_group(top.plain)}/{_group(bottom.plain)}", f"\\frac{{{top.latex}}}{{{bottom.latex}}}", top.glyphs + bottom.glyphs)
        inside = {id(b) for b in over + under}
        return _region([b for b in boxes if id(b) not in inside] + [made], [b for b in rest if b not in inner], problems)
    return _sequence(boxes, problems) if boxes else None


def latex_problems(latex: str) -> list[str]:
    """Why LaTeX can't be trusted: braces that don't match, empty groups, double scripts."""
    out, depth = [], 0
    for c in latex:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            break
    if depth:
        out.append("braces")
    if "{}" in latex:
        out.append("empty_group")
    if re.search(r"[_^]\{[^{}]*\}[_^]\{[^{}]*\}[_^]", latex):
        out.append("double_script")
    return out


def reconstruct(glyphs: list[dict], bars: list[dict]) -> dict:
    """Plain text, LaTeX, left-hand side, symbols and status of one equation."""
    problems: list[str] = []
    boxes = [_glyph(g) for g in glyphs if g["text"].strip()]
    if not boxes:
        return {"plain": "", "latex": None, "lhs": None, "symbols": [], "status": "needs_review", "reasons": ["no_glyphs"]}
    if any(not KNOWN.fullmatch(b.plain) for b in boxes):
        problems.append("unknown_glyph")
    if any(re.search("(?i)math|wingdings", g.get("font") or "") for g in glyphs):
        problems.append("math_font")
    lines = [(b["a"], b["b"], b["c"]) for b in bars if b["kind"] == "h"]
    if len(lines) < len(bars):
        problems.append("unexplained_line")
    whole = _region(boxes, lines, problems)
    if Counter(whole.glyphs) != Counter(c for b in boxes for c in b.glyphs):
        problems.append("glyphs_lost")
    problems += latex_problems(whole.latex)
    symbols = re.findall(r"(?<![A-Za-z0-9α-ω])([A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ω]{0,5})", whole.plain)
    left = re.match(r"\s*([^=]{1,12}?)\s*=", whole.plain)
    bad = sorted(set(problems))
    return {"plain": whole.plain, "latex": None if bad else whole.latex, "lhs": left and left[1], "symbols": sorted({s for s in symbols if s not in NAMES}), "status": "needs_review" if bad else "exact", "reasons": bad}


def equations(glyphs: DataFrame, bars: DataFrame) -> DataFrame:
    """``glyphs(doc_id, page, eq, text, x0, y0, x1, y1, size, baseline, font)`` and ``bars(doc_id, page, eq, kind, a, b, c)`` -> one row an equation."""
    key = ["doc_id", "page", "eq"]
    g = glyphs.groupBy(*key).agg(F.collect_list(F.struct("text", "x0", "y0", "x1", "y1", "size", "baseline", "font")).alias("glyphs"))
    b = bars.groupBy(*key).agg(F.collect_list(F.struct("kind", "a", "b", "c")).alias("bars"))
    rows = g.join(b, key, "left").select(F.col("doc_id").cast("string"), F.col("page").cast("int"), F.col("eq").cast("string"), "glyphs", "bars")
    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("eq", pa.string()), ("plain", pa.string()), ("latex", pa.string()), ("lhs", pa.string()), ("symbols", pa.list_(pa.string())), ("status", pa.string()), ("reasons", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{k: r[k] for k in key} | reconstruct(r["glyphs"], r["bars"] or []) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "doc_id string, page int, eq string, plain string, latex string, lhs string, symbols array<string>, status string, reasons array<string>")
