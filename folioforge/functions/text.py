"""Text functions as Column builders: every one stays inside whole-stage code generation or a higher-order fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the token estimate.
TOKEN_COEF = {"intercept": 0.217, "word": 0.842, "long": 0.276, "digit": 1.249, "non_ascii": 1.327, "punct": 0.987, "newline": 1.108}
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
# Stop words by which a language is told, in the order that decides ties.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "is", "shall", "for", "with", "to"],
    "de": ["der", "die", "und", "ist", "mit", "für", "den", "das"],
    "fr": ["le", "la", "les", "et", "est", "pour", "des", "du"],
    "tr": ["ve", "bir", "bu", "ile", "için", "olan", "de", "da"],
}
UNICODE_SPACES = "[  -​  　﻿]"
#: Lines that are dropped wherever they stand alone; callers may pass their own.
BOILERPLATE = ("^Not for Resale\\s*$", "^--`[`,\\-]*---\\s*$")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_pieces(text: Column, piece: str, between: str) -> Column:
    """How often ``piece`` stands in a text, where a character that begins none is one of ``between`` and those begin none.

    Each piece shrinks to one character together with what follows it; no piece is made a string of its own.
    """
    shrunk = F.regexp_replace(text, f"(?:{piece}){between}*", "a")
    return (F.length(shrunk) - F.length(F.regexp_extract(text, f"^{between}*", 0))).cast("long")


def token_features(text: Column) -> dict[str, Column]:
    """Integer features; those of two texts joined by white space add up (a line feed adds one newline)."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    longer = F.regexp_extract_all(text, F.lit("([A-Za-z]{8,})"))
    return {
        "word": count("[A-Za-z]+"),
        "long": (F.length(F.array_join(longer, "")) - 7 * F.size(longer)).cast("long"),
        "digit": count("[0-9]"),
        "non_ascii": count("[^\\x00-\\x7F]"),
        "punct": count(ASCII_PUNCT),
        "newline": count("\n"),
    }


def estimate_from(features: dict[str, Column]) -> Column:
    """Tokens from feature sums, at least 1."""
    total = F.lit(TOKEN_COEF["intercept"])
    for name in ("word", "long", "digit", "non_ascii", "punct", "newline"):
        total = total + F.lit(TOKEN_COEF[name]) * features[name].cast("double")
    return F.greatest(F.lit(1).cast("long"), F.ceil(total).cast("long"))


def token_estimate(text: Column) -> Column:
    """Model tokens of a text, from character classes; 0 if it is empty."""
    return F.when(text == "", F.lit(0).cast("long")).otherwise(estimate_from(token_features(text)))


def normalize_hyphens(text: Column) -> Column:
    """U+2010 to U+2012 become '-'; a soft hyphen joins a word over a line break and is '-' elsewhere."""
    t = F.translate(text, "‐‑‒", "---")
    return F.replace(F.regexp_replace(t, "­[ \\t]*\\r?\\n", ""), F.lit("­"), F.lit("-"))


def normalize_text(text: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Hyphens, spaces and line ends unified, boilerplate lines gone, at most one blank line in a row, trimmed."""
    t = F.regexp_replace(normalize_hyphens(text), UNICODE_SPACES, " ")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, "\\s+$", ""))
    if boilerplate:
        lines = F.filter(lines, lambda x: ~F.regexp_like(F.trim(x), F.lit("|".join(f"(?:{p})" for p in boilerplate))))
    t = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, "^\\s+", ""), "\\s+$", "")


def strip_html(html: Column) -> Column:
    """Text of a page: script and style gone, block ends as line feeds, other tags as spaces, common entities as characters."""
    t = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>|</p>|</div>|</li>|</h[0-9]>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


#: Entities that are decoded; the ampersand's own comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def sentences(text: Column) -> Column:
    """Pieces that end in . ! ? ; : before a capital, an opening sign or a number, without blank ones."""
    parts = F.split(text, "(?<=[.!?;:])\\s+(?=[A-Z(\"“—–-]|[0-9]+\\s)")
    return F.filter(parts, lambda x: F.trim(F.regexp_replace(x, "\\s", "")) != "")


def canonical_number(n: Column) -> Column:
    """Decimal comma as point, no trailing zeros of a fraction, no leading zeros, '0' if nothing is left."""
    s = F.replace(n, F.lit(","), F.lit("."))
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    s = F.regexp_replace(s, "^0+", "")
    return F.when(s == "", F.lit("0")).otherwise(s)


def numbers_in(text: Column) -> Column:
    """Distinct canonical numbers that stand alone in a text, sorted."""
    runs = F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}_.,]+)"))
    decimal = lambda r: F.regexp_extract(r, "^([0-9]+[.,][0-9]+)(?:$|[.,])", 1)
    whole = lambda r: F.regexp_extract(r, "^([0-9]+)(?:$|[.,])", 1)
    found = F.transform(runs, lambda r: F.when(decimal(r) != "", decimal(r)).otherwise(whole(r)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda n: n != ""), canonical_number)))


def language(text: Column, most_words: int | None = None) -> Column:
    """Language of a text by stop words: at least five, else 'und'; ``most_words`` reads only so many first words."""
    low = F.lower(text) if most_words is None else F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("(\\p{L}+)")), 1, most_words), " ")
    counts = let(low, lambda x: F.array(*(F.regexp_count(x, F.lit("(?<!\\p{L})(?:" + "|".join(v) + ")(?!\\p{L})")) for v in LANGUAGE_WORDS.values())))
    names = F.array(*map(F.lit, LANGUAGE_WORDS))
    told = let(counts, lambda c: F.when(F.array_max(c) >= 5, F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))  # the first of equals
    return F.coalesce(told, F.lit("und"))


def page_quality(text: Column, method: Column | None = None, ocr_confidence: Column | None = None) -> Column:
    """Printable share less 20 times the share of replacement characters, times the confidence of OCR (0.5 unknown) or 0.95 if rebuilt."""
    n = F.length(text).cast("double")
    odd = F.regexp_count(F.translate(text, "\n\t ", ""), F.lit("[\\p{Cc}\\p{Cf}\\p{Co}\\p{Z}]"))
    bad = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    score = (n - odd) / n * (F.lit(1.0) - F.least(F.lit(1.0), F.lit(20.0) * bad / n))
    if method is not None:
        score = F.when(method == "ocr", score * F.coalesce(ocr_confidence if ocr_confidence is not None else F.lit(None), F.lit(0.5))).when(method == "native_text_rebuilt", score * 0.95).otherwise(score)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(score)


def quality_flags(text: Column, method: Column, least: int = 200) -> Column:
    """Flags of a page, in a fixed order."""
    flags = F.array(
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "no_text"),
        F.when((F.length(text) > 0) & (method == "ocr"), "ocr"),
        F.when((F.length(text) > 0) & (method == "native_text_rebuilt"), "rebuilt_text_layer"),
        F.when(F.contains(text, F.lit("�")), "replacement_chars"),
        F.when((F.length(text) > 0) & (F.length(text) < least), "low_text"),
    )
    return F.array_compact(flags)


def tr_lower(text: Column) -> Column:
    """Lower case by Turkish rules: dotted and dotless i first."""
    return F.lower(F.translate(text, "İI", "iı"))


def squash(text: Column) -> Column:
    """A text without any white space."""
    return F.regexp_replace(text, "[\\s ]+", "")


def degenerate_layer(text: Column) -> Column:
    """Whether more than 45 % of at least 30 tokens are single letters: a text layer that has lost its words."""
    tokens = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    return (F.size(tokens) >= 30) & (F.size(F.filter(tokens, lambda x: F.regexp_like(x, F.lit("^\\p{L}$")))) > F.size(tokens) * 0.45)


def recover_symbol_font(text: Column, font: Column) -> Column:
    """Greek letters of spans set in a Symbol font whose text layer holds ASCII letters."""
    latin, greek = "abgdezhqiklmnxprstufcyw", "αβγδεζηθικλμνξπρστυφχψω"
    symbol = F.lower(font).contains("symbol") & ~F.regexp_like(text, F.lit("[^\\x00-\\x7F]"))
    return F.when(symbol, F.translate(text, latin, greek)).otherwise(text)


def clause_key(clause: Column) -> Column:
    """'4.2.4' as (4, 2, 4); annex letters count from 101."""
    return F.transform(F.split(clause, "\\."), lambda p: F.when(F.regexp_like(p, F.lit("^[A-Z]$")), F.ascii(p) - 64 + 100).otherwise(p.try_cast("int")))


def slugify(text: Column, most: int = 60) -> Column:
    """ASCII slug: letters and digits in lower case, other runs as one hyphen."""
    s = F.regexp_replace(F.lower(F.translate(text, "çğıöşüÇĞİÖŞÜ", "cgiosucgiosu")), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")


def time_label(seconds: Column) -> Column:
    """hh:mm:ss of a number of seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def format_number(x: Column, decimals: int = 4) -> Column:
    """Fixed decimals without trailing zeros, decimal comma."""
    s = F.format_string(f"%.{decimals}f", x)
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    return F.replace(F.when(s == "-0", F.lit("0")).otherwise(s), F.lit("."), F.lit(","))


def redact_secrets(text: Column) -> Column:
    """Log text with the values of secret-looking keys masked."""
    return F.regexp_replace(text, "(?i)((?:password|passwd|token|secret|api[_-]?key|authorization)[\"']?\\s*[:=]\\s*[\"']?)[^\\s\"',;}]+", "$1***")
