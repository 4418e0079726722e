"""The English term behind the first use of each specialist phrase: edits found longest phrase first, applied in one fold.

Everything is a Column over the text, so a batch of answers is one projection.
For each phrase the first place is found, then one fold over the phrases decides
which places are taken and which get their term, and one over the places writes
the text.

Defined cases: null stays null; a phrase whose first place lies in a longer one's
is left out; a term that the text has anywhere, in any case, or that would stand
before an opening bracket, isn't written; at most ``most`` terms are; a text
whose lower case has another length is left as it is.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import let, tr_lower
from folioforge.operators.planning import GLOSSARY

# Phrases too general to be given a term.
GENERIC = frozenset(
    ("adım", "tablo", "formül", "eşitlik", "tanım", "sembol", "kapsam", "uygulama alanı", "kontrol", "form", "toplam", "referans", "yüzey", "malzeme", "ölçüm", "ölçme", "yük", "güç", "açı", "çap", "boşluk", "yağ",
     "genişlik", "kalınlık", "yükseklik", "katsayı", "devir", "ömür", "moment", "sapma", "doğruluk", "hassasiyet", "dişli", "profil", "helis", "eğim", "freze", "delik", "mil", "datum")
)
_LETTER = r"[\p{L}\p{N}_]"


def phrase_pattern(phrase: str) -> str:
    """A phrase with endings: a word of up to four letters takes up to four more, a longer one may lose its last vowel and takes any."""
    parts = []
    for w in phrase.split():
        parts.append(f"{w}{_LETTER}{{0,4}}" if len(w) <= 4 else (w[:-1] if w[-1] in "ıiuü" else w) + f"{_LETTER}*")
    return r"\s+".join(parts)


def ranked(glossary: dict[str, list[str]], generic=GENERIC) -> list[tuple[str, str]]:
    """(phrase, term), longest phrases first, then as the glossary has them."""
    return [(k, v[0]) for k, v in sorted(glossary.items(), key=lambda kv: -len(kv[0])) if k not in generic]


def _stem(w: str) -> str:
    """What every form of a phrase's word begins with."""
    return w[:-1] if len(w) > 4 and w[-1] in "ıiuü" else w


def _plain(phrase: str) -> bool:
    """Whether a phrase stands for itself in a pattern."""
    return bool(re.fullmatch(r"[\w\s]*\w[\w\s]*", phrase))


def _anchored(phrase: str) -> str:
    """The pattern of a phrase between other signs; it looks for the first letters and only behind them at what stands before."""
    pattern = phrase_pattern(phrase)
    first = _stem(phrase.split()[0]) if _plain(phrase) else ""
    return f"{first}(?<!{_LETTER}{first}){pattern[len(first):]}(?!{_LETTER})"


def _word_end(text: Column, at: Column) -> Column:
    """The end of the word that goes on at a place; only one of 64 letters and more is looked for in the whole rest."""
    rest = lambda n: F.length(F.regexp_extract(F.substring(text, at, n), r"^[\p{L}\p{N}'’]*", 0))
    return at + let(rest(F.lit(64)), lambda n: F.when(n < 64, n).otherwise(rest(F.length(text))))


def _places(text: Column, low: Column, plain: Column, entries: list[tuple[str, str]]) -> Column:
    """(start, stop, behind, term, wanted) of each phrase that is there, in the order of the phrases; places count from 1, ``behind`` is the end of the word; ``plain`` is the text in lower case."""

    def place(phrase: str, term: str) -> Column:
        pattern = F.lit(_anchored(phrase))

        def told(start: Column, stop: Column, behind: Column) -> Column:
            opened = F.startswith(F.ltrim(F.substring(text, behind, F.lit(2))), F.lit("("))
            return F.struct(start.alias("start"), stop.alias("stop"), behind.alias("behind"), F.lit(term).alias("term"), (~F.contains(plain, F.lit(term.lower())) & ~opened).alias("wanted"))

        stop_of = lambda start: start + F.length(F.regexp_substr(low, pattern))
        found = let(F.regexp_instr(low, pattern).cast("int"), lambda start: F.when(start > 0, let(stop_of(start), lambda stop: let(_word_end(text, stop), lambda behind: told(start, stop, behind)))))
        words = phrase.split()
        return F.when(reduce(and_, [F.contains(low, F.lit(_stem(w))) for w in words]), found) if _plain(phrase) else found

    return F.filter(F.array(*[place(*e) for e in entries]), lambda p: p.isNotNull())


def annotate_first_use(text: Column, glossary: dict[str, list[str]] = GLOSSARY, generic=GENERIC, most: int = 8) -> Column:
    """The text with the first term of each phrase in brackets behind its first use."""
    entries = ranked(glossary, generic)
    if not entries:
        return text
    span, edit = "array<struct<start:int,stop:int>>", "array<struct<behind:int,term:string>>"
    zero = F.struct(F.array().cast(span).alias("taken"), F.array().cast(edit).alias("edits"))

    def step(a: Column, p: Column) -> Column:
        free = (F.size(a["edits"]) < most) & ~F.exists(a["taken"], lambda t: (p["start"] < t["stop"]) & (t["start"] < p["stop"]))
        taken = F.when(free, F.concat(a["taken"], F.array(F.struct(p["start"].alias("start"), p["stop"].alias("stop"))))).otherwise(a["taken"])
        edits = F.when(free & p["wanted"], F.concat(a["edits"], F.array(F.struct(p["behind"].alias("behind"), p["term"].alias("term"))))).otherwise(a["edits"])
        return F.struct(taken.alias("taken"), edits.alias("edits"))

    def written(t: Column, edits: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        part = lambda a, e: F.struct(F.concat(a["out"], F.substring(t, a["at"], e["behind"] - a["at"]), F.lit(" ("), e["term"], F.lit(")")).alias("out"), e["behind"].alias("at"))
        return F.aggregate(edits, start, part, lambda a: F.concat(a["out"], F.substring(t, a["at"], F.length(t))))

    low = let(text, tr_lower)
    edits_of = lambda lo, plain: F.array_sort(F.aggregate(_places(text, lo, plain, entries), zero, step, lambda a: a["edits"]))
    chosen = let(low, lambda lo: F.when(F.length(lo) == F.length(text), let(F.lower(text), lambda plain: edits_of(lo, plain))))
    return let(chosen, lambda edits: F.when(F.coalesce(F.size(edits), F.lit(0)) > 0, written(text, edits)).otherwise(text))
