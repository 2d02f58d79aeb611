"""Personal data: fixed patterns, and a skip-chain conditional random field over candidate tokens.

The base patterns (email, ip, card, phone) give spans that always stay. A random field then labels
looser candidates (number groups, spelled-out addresses, names of known mailboxes). Each candidate
has a potential from its shape; neighbours in the text share a chain potential; candidates with the
same normalised key anywhere in the document (last seven digits, mailbox name) share a skip
potential: each with the first one that a base pattern labels, else with the next one. Loopy message passing over both kinds of links labels all candidates of a document
together, so a bare number that ends like a known phone number becomes a phone number too.

Weights are fitted by pseudo-likelihood on the base spans of at most `train_docs` documents (those
with the smallest hash of their id); in half of the training copies the tell-tale features (sign,
check digit, mail sign) are hidden, so that links have to speak.

Defined results: a null or empty text has no spans; equal rows give equal rows; an empty table gives
no rows; positions are code points, end exclusive; other columns are ignored. An added span never
overlaps a base span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import arrow_rows

KINDS = ("email", "ip", "card", "phone")
FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
         "n_added long")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole, so starting inside one is never tried
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# candidates beyond the base patterns
NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().-]{0,3}[0-9]){6,24}(?![0-9])")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT|\.)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}")
RUN = re.compile(r"[A-Za-z0-9._%+-]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
FEATURES = 16
STATES = len(KINDS) + 1     # the last one is "none"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    spans, past, at = [], 0, text.find("@")
    while at >= 0:
        name = text[past:at]
        start = past + len(name.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            past = found.end()
        else:
            past = at + 1
        at = text.find("@", past)
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# ---------------------------------------------------------------- candidates and their features

def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, base kind or "none", key of the skip links), in order and without overlaps."""
    taken = [(a, b, k, mail_key(text[a:b]) if k == 0 else NOT_DIGIT.sub("", text[a:b])[-7:]) for a, k, b in base]
    boxes = {text[a:b].split("@")[0] for a, k, b in base if k == 0}
    boxes = {box for box in boxes if len(box) >= 6 and not box.isdigit()}
    more = [(m.start(), m.end(), NOT_DIGIT.sub("", m[0])[-7:]) for m in NUMBER.finditer(text)]
    if "[" in text or "(" in text:
        more += [(m.start(), m.end(), "@" + m[1].lower()) for m in SPELLED.finditer(text)]
    if boxes:
        # all mailbox names in one pass over whole runs
        more += [(m.start(), m.end(), "@" + m[0].lower()) for m in RUN.finditer(text)
                 if m[0] in boxes and text[m.end():m.end() + 1] != "@"]
    out, ends = list(taken), np.array([s[1] for s in taken], dtype=np.int64)
    starts = np.array([s[0] for s in taken], dtype=np.int64)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    last = 0
    for a, b, key in sorted(more):
        before = int(np.searchsorted(starts, b, side="left"))
        if a >= last and (before == 0 or reach[before - 1] <= a):
            out.append((a, b, STATES - 1, key))
            last = b
    return sorted(out)


def mail_key(mail: str) -> str:
    return "@" + mail.split("@")[0].lower()


def shape(piece: str) -> np.ndarray:
    digits = NOT_DIGIT.sub("", piece)
    n = len(digits)
    x = np.zeros(FEATURES)
    x[0] = 1
    x[1 + (0 if n < 7 else 1 if n < 9 else 2 if n < 12 else 3 if n < 16 else 4 if n < 20 else 5)] = 1
    x[7] = piece.startswith("+")
    x[8] = "(" in piece
    x[9] = " " in piece or "-" in piece
    x[10] = piece.count(".") == 3 and "@" not in piece
    x[11] = "@" in piece
    x[12] = 12 <= n <= 19 and luhn(digits)
    x[13] = any(c.isalpha() for c in piece)
    x[14] = n == len(piece)
    x[15] = max(map(len, NOT_DIGIT.sub(" ", piece).split()), default=0) <= 4
    return x


HIDDEN = (7, 11, 12)
AGREEMENT = 6.0
FIRM = 1e6


def skip_links(keys: list[str], fixed: list[int]) -> list[tuple[int, int]]:
    """Links each candidate to its key's hub, the first mention that a base pattern labels.

    A key without one has a chain instead: each candidate is linked to the next one.
    """
    hub: dict[str, int] = {}
    for i, (key, kind) in enumerate(zip(keys, fixed, strict=True)):
        if kind < STATES - 1:
            hub.setdefault(key, i)
    last: dict[str, int] = {}
    links = []
    for i, key in enumerate(keys):
        if len(key) >= 7 or key.startswith("@") and len(key) > 3:
            near = hub.get(key, last.get(key, i))
            if near != i:
                links.append((near, i))
            last[key] = i
    return links


def fit_field(rows: list[tuple[list[list[float]], list[int], list[str]]], steps: int = 300) -> dict[str, np.ndarray]:
    """Pseudo-likelihood: each label given its features and the labels linked to it."""
    xs, ys = [], []
    for feats, labels, keys in rows:
        n = len(labels)
        around = np.zeros((n, 2 * STATES))
        for i in range(n - 1):
            around[i, labels[i + 1]] += 1
            around[i + 1, labels[i]] += 1
        for i, j in skip_links(keys, labels):
            around[i, STATES + labels[j]] += 1
            around[j, STATES + labels[i]] += 1
        plain = np.array(feats)
        hidden = plain.copy()
        hidden[:, HIDDEN] = 0
        xs += [np.hstack([plain, around]), np.hstack([hidden, around])]
        ys += [labels, labels]
    # the prior: linked mentions agree, nothing else is known
    prior = np.zeros((FEATURES + 2 * STATES, STATES))
    prior[FEATURES + STATES:] = AGREEMENT * np.eye(STATES)
    weights = prior.copy()
    if xs:
        x, y = np.vstack(xs), np.eye(STATES)[np.concatenate(ys)]
        step = 4.0 / max(1.0, float((x * x).sum(axis=1).mean()))
        for _ in range(steps):
            score = x @ weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += step * (x.T @ (y - p) / len(x) - 1e-3 * (weights - prior))
    chain, skip = weights[FEATURES:FEATURES + STATES], weights[FEATURES + STATES:]
    return {"node": weights[:FEATURES], "chain": (chain + chain.T) / 2, "skip": (skip + skip.T) / 2}


def label(field: dict[str, np.ndarray], feats: np.ndarray, fixed: list[int], keys: list[str],
          rounds: int | None = None) -> np.ndarray:
    """Marginals by loopy message passing; candidates of the base patterns keep their label.

    Messages pass until they settle, within a bound in proportion to the number of candidates.
    """
    n = len(fixed)
    node = feats @ field["node"]
    for i, k in enumerate(fixed):
        if k < STATES - 1:
            # no number of links moves it
            node[i] = -FIRM
            node[i, k] = FIRM
    links = [(i, i + 1, "chain") for i in range(n - 1)] + [(i, j, "skip") for i, j in skip_links(keys, fixed)]
    if not links:
        return np.exp(node - np.logaddexp.reduce(node, axis=1, keepdims=True))
    source = np.array([e for i, j, _ in links for e in (i, j)])
    target = np.array([e for i, j, _ in links for e in (j, i)])
    pair = np.array([field[kind] for *_, kind in links for _ in (0, 1)])
    back = np.arange(len(source)) ^ 1
    message = np.zeros((len(source), STATES))
    for _ in range(100 + 4 * n if rounds is None else rounds):
        belief = node.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + pair
        fresh = np.logaddexp.reduce(out, axis=1)
        fresh -= np.logaddexp.reduce(fresh, axis=1, keepdims=True)
        moved = np.abs(fresh - message).max()
        message = 0.5 * message + 0.5 * fresh
        if moved < 1e-4:
            break
    belief = node.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def added_spans(text: str, base: list[tuple[int, int, int]], field: dict[str, np.ndarray],
                sure: float = 0.5) -> list[tuple[int, int, int]]:
    found = candidates(text, base)
    fixed = [k for _, _, k, _ in found]
    if all(k < STATES - 1 for k in fixed):
        return []
    chance = label(field, np.array([shape(text[a:b]) for a, b, *_ in found]), fixed, [key for *_, key in found])
    return [(a, int(chance[i, :-1].argmax()), b) for i, (a, b, k, _) in enumerate(found)
            if k == STATES - 1 and chance[i, :-1].max() > sure]


# ---------------------------------------------------------------- the operator

def sampled(docs: DataFrame, limit: int) -> DataFrame:
    """At least `limit` documents (if there are), those with the smallest hashes of their ids."""
    near = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return docs.where(F.xxhash64("doc_id") <= F.lit(near if near is not None else 0)).limit(2 * limit)


def train_field(docs: DataFrame, train_docs: int = 4000, tokens: int = 50) -> dict[str, np.ndarray]:
    """Fits the field on base spans of a bounded sample (at most `tokens` candidates of a document)."""

    def work(columns):
        rows = []
        for text in columns[0]:
            found = candidates(text or "", base_spans(text or ""))[:tokens]
            if found:
                rows.append(([shape(text[a:b]).tolist() for a, b, *_ in found], [k for _, _, k, _ in found],
                             [key for *_, key in found]))
        return rows

    seen = arrow_rows(sampled(docs, train_docs).select(F.col("text").cast("string")), work,
                      "feats array<array<double>>, labels array<int>, keys array<string>")
    return fit_field(sorted(map(tuple, seen.collect())))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, field: dict[str, np.ndarray] | None = None, train_docs: int = 4000) -> DataFrame:
    """Personal data of every whole text of (doc_id, text)."""
    field = field or train_field(docs, train_docs)

    def work(columns):
        rows = []
        for doc, text in zip(*columns, strict=True):
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, base, field)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(sorted(base + more)), len(more)))
        return rows

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, FOUND)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, past = [], 0
    for a, k, b in sorted(spans):
        if a >= past:
            out += [text[past:a], f"<{KINDS[k].upper()}>"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def mask_personal_data(docs: DataFrame, field: dict[str, np.ndarray] | None = None,
                       train_docs: int = 4000) -> DataFrame:
    """The same documents with personal data masked in `text` (a null text stays null); `n_chars` follows it."""
    field = field or train_field(docs, train_docs)
    column = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = []
            for text in batch.column(column).to_pylist():
                base = base_spans(text or "")
                spans = base + added_spans(text or "", base, field)
                texts.append(masked(text, spans) if spans else text)
            columns = list(batch.columns)
            fresh = pa.array(texts, type=batch.schema.field(column).type)
            if length is not None:
                changed = [len(t) if t is not None and a != t else n for a, t, n in zip(
                    batch.column(column).to_pylist(), texts, batch.column(length).to_pylist(), strict=True)]
                columns[length] = pa.array(changed, type=batch.schema.field(length).type)
            columns[column] = fresh
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
