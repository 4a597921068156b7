"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order; those after `phone` are the method's own.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "url", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Nothing is given back: what follows a run of digits isn't a digit.
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[^0-9]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_URL_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@:]+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"[^0-9A-Za-z\n]{0,6}(?:(?:no|nr|number|num)\b[^0-9A-Za-z\n]{0,4})?([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Whether an account number passes the international check (modulo 97)."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Spans:
    """Spans that may overlap, asked by bisection."""

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def allow(self, a: int, b: int, holds: bool) -> bool:
        """Whether no span overlaps (a, b); with `holds` those inside may."""
        at, end = bisect_left(self.starts, a), bisect_left(self.starts, b)
        if at and self.reach[at - 1] > a:
            return False
        return at == end or holds and all(y <= b for _, y in self.spans[at:end])


class _Apart:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def put(self, a: int, b: int) -> bool:
        """Adds (a, b) unless it overlaps one."""
        i = bisect_left(self.spans, (a, b))
        if i and self.spans[i - 1][1] > a or i < len(self.spans) and self.spans[i][0] < b:
            return False
        self.spans.insert(i, (a, b))
        return True


class PiiFinder:
    """Finds spans (start, end, kind index) of personal data in code points.

    Anchors: at-signs, plus signs, digits, url schemes and identifier cues. Around an at-sign the parser grows left over the local part and
    right over the domain; at other anchors it parses to the right. Matches of a kind never overlap, and a candidate that fails its check is
    passed over as a whole, as a scan from left to right would. The method adds account numbers (IBAN with its check; a number after an
    account cue), social security numbers after their cue, and urls with user and password. Its spans don't overlap each other or those of
    the four base kinds, but for urls, which hold the email that their user, password and host read as.
    """

    def __init__(self):
        self.cues = ahocorasick.Automaton()
        for kind, words in {"at": ["@"], "plus": ["+"], "scheme": ["http://", "https://", "ftp://"], "ssn": ["ssn", "social security"], "account": ["account", "acct", "konto", "cuenta", "compte"], "iban": ["iban"]}.items():
            for w in words:
                self.cues.add_word(w, (kind, len(w)))
        for d in "0123456789":
            self.cues.add_word(d, ("digit", 1))
        self.cues.make_automaton()

    @staticmethod
    def _runs(text: str, places: list[int], pattern: re.Pattern, good) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches that begin at one of the sorted places; failing ones are consumed too."""
        out, after = [], 0
        for at in places:
            if at >= after and (m := pattern.match(text, at)):
                after = m.end()
                if good(m[0]):
                    out.append(m.span())
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """All spans, sorted by kind as listed, then start."""
        if not text:
            return []
        low = text if text.isascii() and text.islower() else "".join(map(_lower_one, text)) if not text.isascii() else text.lower()
        seen: dict[str, list[int]] = {}
        for end, (kind, n) in self.cues.iter(low):
            seen.setdefault(kind, []).append(end + 1 - (n if kind not in ("ssn", "account", "iban", "scheme") else 0))
        if not seen:
            return []
        found: list[tuple[int, int, int]] = []
        put = lambda kind, spans: found.extend((a, b, KINDS.index(kind)) for a, b in spans)
        put("email", self._emails(text, seen.get("at", [])))
        digits = seen.get("digit", [])
        # A match can't begin later in a run of digits than at its first, or it could begin there too.
        first = [at for before, at in zip([-2, *digits], digits) if at != before + 1]  # noqa: B905
        put("ip", self._runs(text, first, _IP, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))))
        put("card", self._runs(text, digits, _CARD, lambda s: 13 <= len(d := _NOT_DIGIT.sub("", s)) <= 19 and luhn(d)))
        put("phone", self._runs(text, seen.get("plus", []), _PHONE, lambda s: 9 <= len(_NOT_DIGIT.sub("", s)) <= 15))
        if seen.keys() & {"ssn", "account", "iban", "scheme"}:
            base = _Spans((a, b) for a, b, _ in found)
            extra: list[tuple[int, int, int]] = []
            own = _Apart()

            def add(kind: str, a: int, b: int) -> None:
                if base.allow(a, b, kind == "url") and own.put(a, b):
                    extra.append((a, b, KINDS.index(kind)))

            for at in seen.get("iban", []):
                if (m := _IBAN.search(text, at, at + 60)) and not any(map(str.isalnum, text[at : m.start()].replace("no", "").replace("nr", ""))):
                    self._iban(m, add)
            for at in seen.get("ssn", []):
                if m := _SSN.match(text, at):
                    add("ssn", *m.span(1))
            for at in seen.get("scheme", []):
                if m := _URL_USER.match(text, at):
                    add("url", *m.span())
            for at in seen.get("account", []):
                if m := _ACCOUNT.match(text, at):
                    add("account", *m.span(1))
            found += extra
        return sorted(found, key=lambda s: (s[2], s[0]))

    @staticmethod
    def _iban(m: re.Match, add) -> None:
        s = m[0]
        while len(s) > 14:  # the run may have taken words behind the number
            if iban_valid(s):
                add("iban", m.start(), m.start() + len(s))
                return
            s = s[:-1].rstrip()

    @staticmethod
    def _emails(text: str, places: list[int]) -> list[tuple[int, int]]:
        out, after = [], 0
        for at in places:
            start = at
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                after = m.end()
        return out


def _lower_one(c: str) -> str:
    """Lower case where it is one character, so that places stay."""
    low = c.lower()
    return low if len(low) == 1 else c


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans), a row for each row of `docs`; see PiiFinder.

    spans lists kind:start:end by kind as listed, then start. Null texts count as empty. Repeated rows and null ids stay. Columns
    besides doc_id and text don't matter.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PiiFinder()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = finder.spans(text.as_py())
                base = [s for s in spans if s[2] < 4]
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)), len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_more long, base_sha256 string, spans string")
