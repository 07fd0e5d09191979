"""PII by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass; each hit goes to a
deterministic parser that looks left and right from it and validates what it finds. Hits inside what a kind has matched are passed over, so each
kind's matches are leftmost and don't overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "key", "secret", "url")

#: The parts of each kind that are read from an anchor on.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:account|acct)(?:\x20?(?:no|number|id))?[\x20.:#=]{1,3}([0-9]{6,17})(?![0-9A-Za-z])", re.I)
IBAN = re.compile(r"iban[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)
KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?:password|passwd|token|secret|api_key|apikey)\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/.-]{8,})", re.I)
URL = re.compile(r"://[^\s<>\"']+")
DIGITS = "0123456789"
#: Cues are looked for in the lower-cased text, every place as it was; where a letter would become two, only A-Z are lower-cased.
CUES = {"://": "url", "akia": "key"} | dict.fromkeys(("password", "passwd", "token", "secret", "api_key", "apikey"), "secret") | dict.fromkeys(("account", "acct"), "account") | {"iban": "iban"}
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

_AUTOMATON = None


def automaton():
    """All anchors; a hit gives (kind, length of the anchor)."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        a.add_word("+", ("phone", 1))
        for d in DIGITS:
            a.add_word(d, ("digit", 1))
        for cue, kind in CUES.items():
            a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then by start. Null: none.

    The first four kinds are exactly those of the contract; the others (accounts and IBANs behind their cue, access keys, secrets behind their
    cue, urls) come besides and replace nothing.
    """
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys((*KINDS, "run"), 0)  # behind the last match of each kind, dropped ones too
    low = text.lower()
    if len(low) != len(text):  # a letter that becomes two
        low = text.translate(LOWER)
    for last, (kind, size) in automaton().iter(low):
        at = last + 1 - size
        if kind == "digit":
            if at >= end["card"] and (m := CARD.match(text, at)):
                end["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= end["ip"] and at >= end["run"] and (m := IP.match(text, at)):
                end["ip"] = m.end()
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                    out["ip"].append(m.span())
            if at >= end["run"]:  # a run of digits is tried from its first digit only
                stop = at + 1
                while stop < len(text) and text[stop] in DIGITS:
                    stop += 1
                end["run"] = stop
        elif kind == "email":
            if at >= end["email"] and (m := DOMAIN.match(text, at)):
                left = at
                while left > end["email"] and text[left - 1] in LOCAL:
                    left -= 1
                if left < at:
                    out["email"].append((left, m.end()))
                    end["email"] = m.end()
        elif kind == "phone":
            if at >= end["phone"] and (m := PHONE.match(text, at)):
                end["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif at >= end[kind]:
            _cue(kind, text, at, out, end)
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def _cue(kind: str, text: str, at: int, out: dict, end: dict) -> None:
    """What stands behind a scheme or cue that begins at ``at``."""
    if kind == "url":
        left = at
        while left > end["url"] and text[left - 1] in SCHEME:
            left -= 1
        while left < at and not (text[left].isascii() and text[left].isalpha()):
            left += 1
        if left < at and (m := URL.match(text, at)):
            stop = at + len(m.group().rstrip(".,;:!?)"))
            if stop > at + 3:
                out["url"].append((left, stop))
                end["url"] = stop
        return
    if kind == "key":
        if (at == 0 or not text[at - 1].isalnum()) and (m := KEY.match(text, at)):
            out["key"].append(m.span())
            end["key"] = m.end()
        return
    if at and text[at - 1].isalnum():
        return
    m = {"account": ACCOUNT, "iban": IBAN, "secret": SECRET}[kind].match(text, at)
    if m and (kind != "iban" or iban_valid(m.group(1))) and (kind != "secret" or any(c in DIGITS for c in m.group(1))):
        out[kind].append(m.span(1))
        end[kind] = m.end()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans (array of kind, start, end).

    Null and empty texts have no spans. Each row is read by itself: repeated ids and null ids give rows like others. An empty table gives no
    rows. Columns other than id and text are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str | None, mask: str = "<{}>") -> str | None:
    """The text with every span replaced by its kind; overlapping spans are replaced together, under the first one's kind."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mask.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame) -> DataFrame:
    """n_<kind> of the four base kinds, base_sha256 and spans as a string, from what ``find_pii`` gives."""
    s = F.col("spans")
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    of = lambda kind: F.filter(s, lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(s).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """The sha256 of spans written as kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
