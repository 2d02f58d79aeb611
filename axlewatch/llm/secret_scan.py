"""Secret scanning: a keyword automaton first, anchored patterns only at its hits, then checksums.

One Aho-Corasick automaton finds every keyword of a text in a single pass. Only where one starts is
the pattern of its kind tried. Tokens that carry a checksum (a base-62 CRC-32 over the random part)
count only if it holds. Runs of hex digits have no keyword and are found by their own run pattern.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without a retry: `assign`,
`access`, `hex`. Added kinds: `forge` and `registry` tokens with a valid checksum.

Defined results: a null or empty text has no spans; equal rows give equal rows; an empty table gives
no rows; positions are code points, end exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import arrow_rows

KINDS = ("assign", "access", "hex", "forge", "registry")
BASE = 3
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# fixed values: keyword (lower case) -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge",
    "ghr_": "forge", "npm_": "registry",
}
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_text(body: str) -> str:
    """CRC-32 of an ASCII text in base 62, six digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def keyword_automaton():
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def lower_ascii(text: str) -> str:
    """A-Z in lower case, everything else (and so every position) as it was."""
    return text.encode().lower().decode()


def secret_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), in order."""
    spans = []
    past = dict.fromkeys(KINDS, 0)
    hits = sorted((last - size + 1, kind) for last, (kind, size) in automaton.iter(lower_ascii(text)))
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            found = ASSIGN.match(text, start)
            valid = found and len(found[1]) >= 6
        elif kind == "access":
            found = ACCESS.match(text, start)
            valid = found and len(found[0]) >= 20
        else:
            found = CHECKED.match(text, start)
            valid = found and crc_text(found[1]) == found[2] and not text[start - 1:start].isalnum()
        if found:
            past[kind] = found.end()
            if valid:
                spans.append((start, KINDS.index(kind), found.end()))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text of (doc_id, text)."""

    def work(columns):
        automaton = keyword_automaton()
        rows = []
        for doc, text in zip(*columns, strict=True):
            spans = secret_spans(text or "", automaton)
            base = [s for s in spans if s[1] < BASE]
            counts = [sum(s[1] == k for s in base) for k in range(BASE)]
            rows.append((doc, *counts, hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(spans, KINDS)))
        return rows

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, SCANNED)
