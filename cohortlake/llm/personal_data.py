"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a text and stops at anchors: at-signs,
plus signs, digits, schemes and words that announce an identifier. Around each anchor
a local parser walks to the borders of what may stand there and validates it. The
parsers never look at the text between anchors.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import spare_name

# Kinds in the order in which spans at one place are listed. The first
# four follow given patterns; the others are what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
# Words that announce an account or identity number.
CUES = ("iban", "account", "acct", "passport", "ssn")
# Blanks and marks between the cue and an international number.
CUE_REACH = 16
# Letters and digits of an international number, at least and at most.
IBAN_SIZE = (15, 34)
# Characters of any other number that are looked at, before and behind its first digit.
NUMBER_REACH = 40

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = frozenset("0123456789")
_HOST = frozenset("0123456789-" + _LOWER + _LOWER.upper())
_LOCAL = _HOST | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_USER = _LOCAL | frozenset("~!$&'()*,;=:")
_GAP = frozenset(" :#.-\t")
_BETWEEN = _GAP | frozenset(",'\"()/")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_end(text: str, start: int) -> int:
    """Where the longest international account number at ``start`` ends; ``start`` if there is none.

    The first four characters move behind the others, and 97 must divide the number so
    formed with a rest of one. The rest follows the characters as they are read, blanks
    apart, so no more than 34 of them are.
    """
    head, rest, count, at, found = [], 0, 0, start, start
    while at < len(text) and count < IBAN_SIZE[1]:
        char = text[at]
        at += 1
        if char == " ":
            continue
        if char not in _HOST or char == "-":
            break
        value = int(char, 36)
        count += 1
        if count <= 4:
            if (count <= 2 and not char.isupper()) or (count > 2 and char not in _DIGITS):
                break
            head.append(value)
            continue
        rest = (rest * (100 if value > 9 else 10) + value) % 97
        if count >= IBAN_SIZE[0]:
            whole = rest
            for first in head:
                whole = whole * (100 if first > 9 else 10) + first
            if whole % 97 == 1:
                found = at
    return found


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


class Finder:
    """Spans of one text: start, end (exclusive), number of the kind in ``KINDS``."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for mark in ("@", "+", "://"):
            self.automaton.add_word(mark, mark)
        for digit in _DIGITS:
            self.automaton.add_word(digit, "0")
        for cue in CUES:
            for spelling in itertools.product(*[(c, c.upper()) for c in cue]):
                self.automaton.add_word("".join(spelling), cue)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[Span]:
        out: list[Span] = []
        ends = [0] * len(KINDS)
        self.walked = (0, -1)
        # where chains of digits that have been read end
        dotted = chained = 0
        for last, mark in self.automaton.iter(text):
            if mark == "0":
                if last >= chained:
                    chained = self._card(text, last, out)
                if last >= dotted:
                    dotted = self._ip(text, last, out)
            elif mark == "@":
                ends[0] = self._email(text, last, ends[0], out)
            elif mark == "+":
                if last >= ends[3]:
                    ends[3] = self._phone(text, last, out)
            elif mark == "://":
                ends[4] = self._url(text, last, ends[4], out)
            else:
                ends[5] = self._account(text, last, ends[5], mark, out)
        out.sort(key=lambda span: (span[0], span[2]))
        return out

    def _email(self, text: str, at: int, free: int, out: list[Span]) -> int:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _run(text, at + 1, _HOST)
        if start == at or end == at + 1:
            return free
        labels = 0
        while end < len(text) and text[end] == ".":
            further = _run(text, end + 1, _HOST)
            if further == end + 1:
                break
            end, labels = further, labels + 1
        if not labels:
            return free
        out.append((start, end, 0))
        return end

    def _ip(self, text: str, start: int, out: list[Span]) -> int:
        """Reads the whole chain of numbers joined by dots; every four are one address."""
        places = []
        at = start
        while True:
            end = _run(text, at, _DIGITS)
            places.append((at, end))
            if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS):
                break
            at = end + 1
        for i in range(0, len(places) - 3, 4):
            four = places[i : i + 4]
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in four):
                out.append((four[0][0], four[3][1], 1))
        return places[-1][1]

    def _card(self, text: str, start: int, out: list[Span]) -> int:
        """Reads the whole chain of digits with at most one blank or hyphen between two."""
        end, count = start + 1, 1
        while end < len(text):
            if text[end] in _DIGITS:
                end += 1
            elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
                end += 2
            else:
                break
            count += 1
        if 14 <= count <= 19 and luhn("".join(c for c in text[start:end] if c in _DIGITS)):
            out.append((start, end, 2))
        return end

    def _phone(self, text: str, start: int, out: list[Span]) -> int:
        if not (start + 1 < len(text) and text[start + 1] in _DIGITS):
            return start
        end = _run(text, start + 2, _PHONE)
        while end > start + 3 and text[end - 1] not in _DIGITS:
            end -= 1
        if end <= start + 3 or text[end - 1] not in _DIGITS:
            return start
        if 10 <= sum(c in _DIGITS for c in text[start:end]) <= 15:
            out.append((start, end, 3))
        return end

    def _url(self, text: str, last: int, free: int, out: list[Span]) -> int:
        """An address with a user's name and password before its host."""
        scheme = last - 2
        start = scheme
        while start > free and text[start - 1] in _HOST:
            start -= 1
        user = _run(text, last + 1, _USER)
        end = _run(text, user + 1, _HOST | frozenset("."))
        if start == scheme or user >= len(text) or text[user] != "@" or ":" not in text[last + 1 : user] or end == user + 1:
            return free
        out.append((start, end, 4))
        return end

    def _ahead(self, text: str, at: int) -> int:
        """The first place from ``at`` on that is neither letter nor gap, or ends the sentence.

        A walk that passes over further cues is not made again for them.
        """
        if not self.walked[0] <= at <= self.walked[1]:
            stop = at
            while stop < len(text) and (text[stop] in _BETWEEN or text[stop].isalpha()):
                if text[stop : stop + 2] == ". " and text[stop + 2 : stop + 3].isupper() and text[stop + 3 : stop + 4].islower():
                    break
                stop += 1
            self.walked = (at, stop)
        return self.walked[1]

    def _account(self, text: str, last: int, free: int, cue: str, out: list[Span]) -> int:
        """The first number behind a cue on its line, nothing but words and gaps between.

        Passport and account numbers may hold letters.
        """
        first = last + 1 - len(cue)
        if first and text[first - 1].isalnum() or last + 1 < len(text) and text[last + 1].isalnum():
            return free
        if cue == "iban":
            start = last + 1
            limit = min(len(text), start + CUE_REACH)
            while start < limit and text[start] in _GAP:
                start += 1
            end = iban_end(text, start) if start >= free else start
        else:
            start = self._ahead(text, last + 1)
            if start < free or text[start : start + 1] not in _DIGITS:
                return free
            end = self._ssn_end(text, start) if cue == "ssn" else start
            if end == start:
                start, end = self._number(text, max(last + 1, free, start - NUMBER_REACH), start)
        if end == start:
            return free
        out.append((start, end, 5))
        return end

    def _ssn_end(self, text: str, start: int) -> int:
        """Three, two and four digits with a blank or hyphen between."""
        some = text[start : start + 12]
        shape = "".join("0" if c in _DIGITS else "-" if c in " -" else c for c in some)
        return start + 11 if shape[:11] == "000-00-0000" and shape[11:] != "0" else start

    def _number(self, text: str, least: int, digit: int) -> tuple[int, int]:
        """The word of letters, digits and inner hyphens around a digit, if it can be a number."""
        start, end = digit, digit
        while start > least and text[start - 1] in _HOST and text[start - 1] != "-":
            start -= 1
        most = min(len(text), digit + NUMBER_REACH)
        while end < most and (text[end] in _HOST and (text[end] != "-" or text[end + 1 : end + 2] in _DIGITS)):
            end += 1
        plain = text[start:end].replace("-", "")
        digits = sum(c in _DIGITS for c in plain)
        good = 7 <= len(plain) <= 17 and (digits >= 5 or digits >= 3 and plain.isupper())
        return (start, end) if good and (end == len(text) or text[end] not in _HOST or text[end] == "-") else (digit, digit)


def listed(spans: Sequence[Span]) -> str:
    """Spans as ``kind:start:end``, joined by commas."""
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans])


def find_spans(text: Column) -> Column:
    """All spans of a text as an array of structs ``start, end, kind``, in order.

    Places are code points, ``end`` is exclusive. A null text has no spans. Texts are
    read whole, once, in batches; spans of different kinds may overlap.
    """

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for batch in batches:
            found = [finder(value) if isinstance(value, str) else [] for value in batch]
            yield pd.Series([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans] for spans in found])

    return work(text.cast("string"))


def digest(text: Column) -> Column:
    """Counts per base kind, the hash of the base spans and the list of all spans."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            rows = []
            for value in batch:
                spans = finder(value) if isinstance(value, str) else []
                base = [span for span in spans if span[2] < len(BASE_KINDS)]
                counts = [sum(span[2] == kind for span in base) for kind in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return work(text.cast("string"))


def redact_text(text: str, spans: Sequence[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows, personal data in their texts replaced by ``[KIND]``.

    The column ``length``, where there is one and it is not null, gets the new number of characters.
    Null texts stay null, texts without personal data stay as they are.
    """

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for batch in batches:
            yield pd.Series([redact_text(v, finder(v)) if isinstance(v, str) else None for v in batch], dtype=object)

    name = spare_name(docs, "redacted")
    done = docs.withColumn(name, work(F.col(text).cast("string")))
    columns = []
    for column in docs.columns:
        if column == text:
            columns.append(F.col(name).alias(text))
        elif column == length:
            kind = docs.schema[length].dataType
            new = F.when(F.col(name).isNull() | F.col(length).isNull(), F.col(length)).otherwise(F.length(name))
            columns.append(new.cast(kind).alias(length))
        else:
            columns.append(F.col(column))
    return done.select(*columns)
