"""Secret scans: fixed base patterns, and sliding-window entropy over candidate strings.

Base spans, leftmost and non-overlapping for each kind, of the whole match:
``assign`` (a secret's name, an assignment sign, a value of 6+ characters),
``access`` (AKIA and upper-case letters or digits, 20+ characters) and ``hex``
(lower-case hexadecimal digits, 24+ characters).

The method adds ``entropy`` spans.  A candidate is a maximal run of 20+
characters of one class (base64-like ``[A-Za-z0-9+/_-]``, with up to two ``=``
behind it) that holds a digit and a letter; a run of hexadecimal digits of one
case is judged in the hexadecimal class.  Shannon entropy is taken in each window
of 20 characters, moved by one with counts that are raised and lowered, and the
candidate is a secret when any window reaches its class's threshold.  Every
candidate is judged, also one within a base span: its span then stands beside
the base one.  Suppressed by the allow-list: UUIDs, dates and times, version and
path words, and repeated or sequential examples.

Defined cases: a null text is empty and has no spans (the digest is that of the
empty string); offsets are code points, ends exclusive; spans that start
together stand in the order of the kinds; very long texts and runs are scanned
whole; null ``doc_id`` and repeated rows pass through; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import slices, utf8

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character: thresholds for hexadecimal digits and for the base64-like class (at most 4 and log2(20)).
HEX_BITS, BASE64_BITS = 3.0, 3.7
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"\d{4}[-_/]\d{2}[-_/]\d{2}.*"),  # dates
    re.compile(r"(?i).*(example|sample|dummy|placeholder|xxxx|0123456789|abcdefghij).*"),
    re.compile(r"(?:[A-Za-z]+|\d{1,4})(?:[-_/](?:[A-Za-z]+|\d{1,4}))+"),  # words and short numbers joined by signs: paths, slugs
)

_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: Terms of the entropy of a window, by count.
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def best_entropy(s: str, window: int = WINDOW) -> float:
    """Greatest Shannon entropy of a window of ``s`` (all of ``s`` if shorter), in bits a character."""
    w = min(window, len(s))
    if not w:
        return 0.0
    term = _TERM if w <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    least = math.inf
    for i, x in enumerate(s):
        if i >= w:  # the character that leaves goes first, so no count exceeds the window
            y = s[i - w]
            c = counts[y]
            total += term[c - 1] - term[c]
            counts[y] = c - 1
        c = counts.get(x, 0)
        total += term[c + 1] - term[c]
        counts[x] = c + 1
        if i >= w - 1:
            least = min(least, total)
    return math.log2(w) - least / w


def is_secret(s: str) -> bool:
    """Whether a candidate's entropy reaches its class's threshold and no allow-list rule holds."""
    bits = HEX_BITS if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else BASE64_BITS
    return best_entropy(s) >= bits and not any(a.fullmatch(s) for a in ALLOW)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` bytes within one text."""
    m = np.zeros(len(mask) + 2, np.int8)
    m[1:-1] = mask
    d = np.diff(m)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if len(starts):  # runs that cross from one text to the next are cut there
        inner = offsets[1:-1]
        k = np.searchsorted(starts, inner, "right") - 1
        inside = (k >= 0) & (starts[np.maximum(k, 0)] < inner) & (ends[np.maximum(k, 0)] > inner)
        if inside.any():
            at = np.unique(inner[inside])
            starts, ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
    ok = ends - starts >= least
    return starts[ok], ends[ok]


def _assign(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def _access(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]


_NAMES = re.compile(rb"passw|secret|token|api_?key", re.I)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, off_all = utf8(batch.column(1))
        for i, j in slices(off_all):
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            data = raw.tobytes()
            found: dict[int, list[tuple[int, int, int]]] = {}
            touched = {int(np.searchsorted(off, m.start(), "right")) - 1 for m in _NAMES.finditer(data)}
            at = data.find(b"AKIA")
            while at >= 0:
                touched.add(int(np.searchsorted(off, at, "right")) - 1)
                at = data.find(b"AKIA", at + 4)
            hs, he = _runs(_HEX[raw], off, 24)
            ws, we = _runs(_WORDY[raw], off, WINDOW)
            if len(ws):
                digits, letters = np.concatenate(([0], np.cumsum(_DIGIT[raw]))), np.concatenate(([0], np.cumsum(_LETTER[raw])))
                ok = (digits[we] > digits[ws]) & (letters[we] > letters[ws])
                ws, we = ws[ok], we[ok]
            by_hex = np.searchsorted(off, hs, "right") - 1
            by_word = np.searchsorted(off, ws, "right") - 1
            touched |= set(by_hex.tolist()) | set(by_word.tolist())
            for d in touched:
                a, b = int(off[d]), int(off[d + 1])
                own = raw[a:b]
                text = data[a:b].decode()
                spans = _assign(text) + _access(text)
                plain = len(text) == b - a
                place = None if plain else np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                point = (lambda x, a=a: x - a) if plain else (lambda x, a=a, place=place: int(place[x - a]))
                spans += [(point(int(s)), 2, point(int(e))) for s, e in zip(hs[by_hex == d], he[by_hex == d], strict=True)]
                for s, e in zip(ws[by_word == d].tolist(), we[by_word == d].tolist(), strict=True):
                    if is_secret(data[s:e].decode()):
                        padding = len(data[e : min(e + 2, b)]) - len(data[e : min(e + 2, b)].lstrip(b"="))
                        spans.append((point(s), 3, point(e + padding)))
                found[d] = sorted(spans)
            n, base_text, all_text = [], [], []
            for d in range(j - i):
                spans = found.get(d, [])
                n.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                base_text.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < 3).encode()).hexdigest())
                all_text.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
            cols = [batch.column(0).slice(i, j - i), *(pa.array([x[k] for x in n], pa.int64()) for k in range(4)), pa.array(base_text), pa.array(all_text)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)`` of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Documents with every found span replaced by ``mask``; the order and the other columns stay."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k)
            two = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), texts], names=["doc_id", "text"])
            out = texts.to_pylist()
            for part in _scan(iter([two])):
                for d, spans in zip(part.column(0).to_pylist(), part.column(6).to_pylist(), strict=True):
                    end = None
                    for s, e in sorted(((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x), reverse=True):
                        e = min(e, end) if end is not None else e
                        if s < e:
                            out[d] = out[d][:s] + mask + out[d][e:]
                            end = s
            cols = list(batch.columns)
            cols[k] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, fields)
