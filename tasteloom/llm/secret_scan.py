"""Secret scan: three patterns, and sliding-window entropy over candidate strings.

``scan_text`` finds every span of the kinds below in a whole text. Spans are in code points, the end
is exclusive.

* ``assign`` / ``access`` / ``hex``: patterns, leftmost and non-overlapping within a kind.
* ``entropy``: a candidate (a run of key-like characters holding letters and digits) in which some
  window of ``WINDOW`` characters has Shannon entropy at or above its class's threshold. The counts
  of a window change by one character in and one out per step, and so does the sum of c*log2(c), so a
  candidate costs time linear in its length. Allow-listed candidates are suppressed, as are
  candidates that a pattern span covers already.

A null text is an empty one: no spans. Repeated rows each get their own result; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame

from .words import map_batches

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20  # characters in a window
MIN_CANDIDATE = 20
# Bits for each character that a window has to reach, by the candidate's class of characters.
THRESHOLDS = {"hex": 3.1, "upper": 3.5, "lower": 3.6, "base64": 3.8}

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# "AKIA[A-Z0-9]+" of 20 characters or more, and "[0-9a-f]+" of 24 or more: both runs are maximal, so
# asking for the length inside the pattern drops the same matches as a test after it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)

# Candidates that look random but are no secrets.
_ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"sha(1|256|384|512)-[A-Za-z0-9+/=]+"),  # integrity digest of a public file
    re.compile(r"[A-Za-z]+([/_-][A-Za-z]+)*[0-9]{0,4}"),  # words, paths and numbered names
    re.compile(r"[0-9]+([/_=-][0-9]+)*"),  # numbers and dates
    re.compile(r"(?i:.*(example|placeholder|your[_-]?(key|token)|xxxx).*)"),
)
_PLOGP = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def character_class(candidate: str) -> str | None:
    """The class whose threshold holds, or None for a string without both letters and digits."""
    has = {
        "digit": any(c.isdigit() for c in candidate),
        "lower": any("a" <= c <= "z" for c in candidate),
        "upper": any("A" <= c <= "Z" for c in candidate),
    }
    if not has["digit"] or not (has["lower"] or has["upper"]):
        return None
    if all(c in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    if has["lower"] and has["upper"]:
        return "base64"
    return "lower" if has["lower"] else "upper"


def peak_entropy(candidate: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy (bits for each character) of any window, by incremental counts."""
    window = min(window, len(candidate))
    if not window:
        return 0.0
    plogp = _PLOGP if window <= WINDOW else [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = least = 0.0
    for i, char in enumerate(candidate):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += plogp[c + 1] - plogp[c] if c < window else 0.0
        if i >= window:
            gone = candidate[i - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += plogp[c - 1] - plogp[c] if c <= window else 0.0
        if i == window - 1:
            least = total
        elif i >= window:
            least = min(least, total)
    return log2(window) - least / window


def allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in _ALLOWED)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def entropy_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``known`` is in order of start; both lists are gone through once."""
    found, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(known) and known[at][1] <= m.start():
            reach = max(reach, known[at][2])  # how far the known spans go that begin before the candidate
            at += 1
        candidate = m[0]
        kind = character_class(candidate)
        if kind is None or allowed(candidate):
            continue
        start, end = m.span()
        if end <= reach:
            continue
        if peak_entropy(candidate) >= THRESHOLDS[kind]:
            found.append(("entropy", start, end))
    return found


def scan_text(text: str | None) -> tuple[list, list]:
    """``(pattern spans, all spans)``, each in order of start and then kind."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(pattern_spans(text), key=order)
    return base, sorted(base + entropy_spans(text, base), key=order)


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base digest and all spans of each row."""

    def make():
        def one(cols: dict) -> dict:
            out = {key: cols[key], "n_assign": [], "n_access": [], "n_hex": [], "n_entropy": []}
            out |= {"base_sha256": [], "spans": []}
            for value in cols[text]:
                base, spans = scan_text(value)
                for kind in KINDS:
                    out["n_" + kind].append(sum(s[0] == kind for s in spans))
                out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                out["spans"].append(join_spans(spans))
            return out

        return one

    key_type = docs.schema[key].dataType.simpleString()
    schema = (
        f"{key} {key_type}, n_assign long, n_access long, n_hex long, n_entropy long, "
        "base_sha256 string, spans string"
    )
    return map_batches(docs, (key, text), make, schema)
