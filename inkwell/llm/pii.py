"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, URL schemes and identifier cues. From each anchor a
deterministic parser expands to the boundaries of what may stand there and validates it. Nothing else of the text is parsed, and
every character is expanded over a bounded number of times, so a pass is linear in the text.

Base kinds, leftmost and non-overlapping within a kind; what fails its validation is dropped and not tried again:
email, ip (parts to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits).
Added kinds, both behind an anchor alone: address (the user part of a URL, where it has one, behind a scheme) and account (behind a cue, in any case: an IBAN that
passes mod 97, a number of 8 to 20 digits, or a ddd-dd-dddd number). An IBAN without a cue is not looked for. secret: the value behind a credential cue and = or :, of 8 characters or more, whatever
their number, with a digit in it or behind it before the next blank or quote; or an access key's identifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import mapped, own_worker, text_slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account", "secret")
CUES = ("account no", "account number", "acct", "iban", "ssn", "social security", "kontonummer", "numéro de compte", "número de cuenta", "passport no", "passport number")
CREDENTIALS = ("password", "passwd", "secret", "token", "api key", "api_key", "apikey", "access key", "access_key")
KEY_IDS = ("akia", "asia")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER = re.compile(r"[A-Za-z0-9._%+~-]++(?::[^\s/@:]*+)?@(?=[A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NUMBER = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9](?:[ -]?[0-9]){7,19}(?![0-9])")
VALUE = re.compile(r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_.~!@#$%^&*-]{8,}+)")
RUN = re.compile(r"[^\s\"']*")
KEY_ID = re.compile(r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])")
BETWEEN = re.compile(r"[ \t]{0,3}(?:number|no|nr|is)?[.:#= \t]{0,4}", re.I)
NOT_DIGIT = re.compile(r"[^0-9]")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("credential", CREDENTIALS), ("key", KEY_IDS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _lowered(text: str) -> str:
    """Lower case, each character in its place: the few that would become several stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    done, run, digit = dict.fromkeys(out, 0), 0, 0
    for last, (kind, size) in _anchors().iter(_lowered(text)):
        at = last + 1 - size
        if kind == "digit":
            if at >= done["ip"]:
                m = DOTTED.match(text, at)
                done["ip"] = m.end()
                parts, start = m[0].split("."), at
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                        out["ip"].append((start, end))
                    start = end + 1
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and 13 <= len(m[0]) <= 37 and 13 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "plus":
            if m := PHONE.match(text, at):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            if last + 1 > done["address"] and (m := USER.match(text, last + 1)):
                out["address"].append((m.start(), m.end() - 1))
                done["address"] = m.end()
        elif kind in ("credential", "key"):
            m = KEY_ID.match(text, at) if kind == "key" else VALUE.match(text, last + 1)
            if m and kind == "credential" and m.end() > run:  # up to the next blank or quote; each such run is read once
                run = RUN.match(text, m.start(1)).end()
                digit = max(text.rfind(d, m.start(1), run) for d in "0123456789")
            if m and m.start(m.lastindex or 0) >= done["secret"] and (kind == "key" or digit >= m.start(1)):
                out["secret"].append(m.span(m.lastindex or 0))
                done["secret"] = m.end()
        elif last + 1 > done["account"]:
            start = BETWEEN.match(text, last + 1).end()
            m = IBAN.match(text, start)
            m = m if m and iban(m[0]) else NUMBER.match(text, start)
            if m:
                out["account"].append(m.span())
                done["account"] = m.end()
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null or empty text has no span (base_sha256 is that of the empty string). Repeated rows and null ids come back as they are;
    other columns, whatever their names, are ignored; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, texts in (s for batch in batches for s in text_slices(batch)):
            found = [find(t) for t in texts.to_pylist()]
            counts = [pa.array([len(x[k]) for x in found], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(_joined(x, BASE).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([source.column(0), *counts, sha, pa.array([_joined(x, BASE + ADDED) for x in found], pa.string())], names=names)

    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, is replaced."""
    spans = sorted(((a, -b, k) for k, x in find(text).items() for a, b in x))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = -b
        elif -b > at:
            at = -b  # the rest of an overlapping span goes too
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind in brackets.

    A null text stays null and an empty one empty; rows of equal ids or texts are each changed alike, and other columns, whatever their names, stay as they
    are; an empty table gives an empty result.
    """

    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("pii", lambda: None)
        for source, _ in (s for batch in batches for s in text_slices(batch, at)):
            clean = pa.array([None if t is None else redacted_text(t) for t in source.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if c == at else column for c, column in enumerate(source.columns)], names=source.schema.names)

    return mapped(docs, work)
