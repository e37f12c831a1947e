"""Format-preserving pseudonyms for personal data (operator 3).

Values are found by pattern, validated (Luhn for cards, mod 97 for IBANs, ranges for addresses, social
security numbers and dates), and replaced by a keyed permutation of all values of their format: a Feistel
network over the format's numbering, walked until it lands inside. Equal values get equal pseudonyms in
every document, different ones stay different, and the result is valid in the same format. The kind and
the format are the tweak, so that no pattern carries over from one format to another.

Kinds: email (letters and digits of the address, its top-level domain kept), ip (IPv4), card, iban, ssn,
phone (international, or with an area code in brackets; the country code kept), date (years 1900 to 2099,
the form kept), secret (access keys, and values of password=, secret=, token= and api_key=, with "=" or ":",
the value bare or in quotes, the name in quotes as in JSON; in quotes all that they hold up to the end of
the line is the value, and the quotes and escapes stay).

The key is a secret of the caller's, an argument or a setting of the session; there is no key in the program.

A null text stays null; empty texts are unchanged. Texts of any length are searched whole. Repeated rows
give repeated results. Columns that are named like results are replaced. Values that fail validation are
no personal data and stay.
"""

from __future__ import annotations

import hmac
import re
import secrets
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The setting of the session that holds the key, as a text.
KEY_SETTING = "spark.tidemark.pseudonyms.key"
ROUNDS = 8
#: Pseudonyms that a worker remembers.
REMEMBERED = 200_000
KINDS = ("email", "ip", "card", "iban", "ssn", "phone", "date", "secret")

_FIRST, _LAST = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (_LAST - _FIRST).days + 1

#: Between the name of a secret and its value.
_GIVES = r"[\"']?(?:[ \t]*|\s)[=:](?:[ \t]*|\s)"
#: One pattern, tried from left to right; the kinds are named groups.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
    r"|(?P<secret>\bAKIA[A-Z0-9]{16}\b|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key)" + _GIVES + r"(?:\"(?:[^\"\\\nA-Za-z0-9]|\\.)*+[A-Za-z0-9](?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\nA-Za-z0-9]|\\.)*+[A-Za-z0-9](?:[^'\\\n]|\\.)*+'|[\"']?[A-Za-z0-9_+/.-]*[A-Za-z0-9_+/-]))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9./-]*[0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]*[0-9]))"
    r"|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9]))"
)
#: What any of them holds.
MIGHT = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|api)")


def luhn(digits: str) -> int:
    """The check digit that digits ask for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


class Pseudonyms:
    """The keyed permutations of one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, str], str | None] = {}

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A permutation of range(size): a balanced Feistel network, walked until it lands inside."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        at = value
        while True:
            left, right = at >> half, at & mask
            for r in range(ROUNDS):
                said = hmac.digest(self.key, b"%s|%d|%d|" % (tweak.encode(), size, r) + right.to_bytes(width, "big"), "sha256")
                left, right = right, left ^ (int.from_bytes((said * (width // 32 + 1))[:width], "big") & mask)
            at = left << half | right
            if at < size:
                return at

    def characters(self, text: str, tweak: str) -> str:
        """Letters and digits permuted together within their classes; everything else stays."""
        kinds = [0 if not c.isascii() else 26 if c.islower() else -26 if c.isupper() else 10 if c.isdigit() else 0 for c in text]
        value, size = 0, 1
        for c, k in zip(text, kinds):
            if k:
                value = value * abs(k) + (ord(c) - (97 if k == 26 else 65 if k == -26 else 48))
                size *= abs(k)
        shape = "".join("a" if k == 26 else "A" if k == -26 else "0" if k else c for c, k in zip(text, kinds))
        at, out = self.permute(value, size, f"{tweak}|{shape}") if size > 1 else 0, []
        for c, k in zip(reversed(text), reversed(kinds)):
            if k:
                at, d = divmod(at, abs(k))
                c = chr(d + (97 if k == 26 else 65 if k == -26 else 48))
            out.append(c)
        return "".join(reversed(out))

    # -- the kinds: a pseudonym, or None where the value is not valid

    def email(self, v: str) -> str:
        body, _, top = v.rpartition(".")
        return self.characters(body, "email|" + top.lower()) + "." + top

    def ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        at = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ip")
        return ".".join(map(str, at.to_bytes(4, "big")))

    def card(self, v: str) -> str | None:
        d = re.sub(r"[^0-9]", "", v)
        if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = str(self.permute(int(d[:-1]), 10 ** (len(d) - 1), f"card|{len(d)}")).zfill(len(d) - 1)
        return _into(v, body + str(luhn(body)))

    def iban(self, v: str) -> str | None:
        s = v.replace(" ", "")
        if not 15 <= len(s) <= 34 or int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 != 1:
            return None
        body = self.characters(s[4:], "iban|" + s[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        it = iter(f"{s[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in v)

    def ssn(self, v: str) -> str | None:
        def valid(n: int) -> bool:
            a, g, s = n // 10**6, n // 10**4 % 100, n % 10**4
            return a not in (0, 666) and a < 900 and g > 0 and s > 0

        n = int(v.replace("-", ""))
        if not valid(n):
            return None
        n = self.permute(n, 10**9, "ssn")
        while not valid(n):
            n = self.permute(n, 10**9, "ssn")
        return f"{n // 10**6:03d}-{n // 10**4 % 100:02d}-{n % 10**4:04d}"

    def phone(self, v: str) -> str | None:
        head = re.match(r"\+[0-9]{1,3}(?![0-9])|\+[0-9]{1,2}|", v)[0]
        rest = re.sub(r"[^0-9]", "", v[len(head) :])
        if not 7 <= len(rest) + len(head) <= 16:
            return None
        return head + _into(v[len(head) :], str(self.permute(int(rest), 10 ** len(rest), f"phone|{head}|{len(rest)}")).zfill(len(rest)))

    def date(self, v: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"[-/.]", v))
        sep = v[4] if v[4] == "-" else "/" if "/" in v else "."
        if sep == "-":
            y, m, d, form = a, b, c, "ymd"
        elif sep == "/" and a <= 12:
            y, m, d, form = c, a, b, "mdy"
        else:
            y, m, d, form = c, b, a, "dmy"
        try:
            n = (date(y, m, d) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= n < _DAYS:
            return None
        # A form is kept: with "/" a first number over 12 says that the day comes first, so only such days are drawn.
        fits = (lambda x: x.day > 12) if sep == "/" and form == "dmy" else (lambda x: True)
        while True:
            n = self.permute(n, _DAYS, f"date|{sep}|{form}")
            at = _FIRST + timedelta(n)
            if fits(at):
                break
        return f"{at.year:04d}-{at.month:02d}-{at.day:02d}" if form == "ymd" else f"{at.month:02d}/{at.day:02d}/{at.year}" if form == "mdy" else f"{at.day:02d}{sep}{at.month:02d}{sep}{at.year}"

    def secret(self, v: str) -> str:
        if v.startswith("AKIA"):
            return "AKIA" + self.characters(v[4:], "secret|AKIA")
        head = re.match(r"[A-Za-z_-]+" + _GIVES + "[\"']?", v)[0]
        body = v[len(head) :].removesuffix(head[-1] if head[-1] in "\"'" else "")
        tail = v[len(head) + len(body) :]
        parts = re.split(r"(\\(?:u[0-9A-Fa-f]{4}|.))", body)  # every second piece is an escape and stays
        new, at = self.characters("".join(parts[::2]), "secret"), 0
        for i in range(0, len(parts), 2):
            parts[i], at = new[at : at + len(parts[i])], at + len(parts[i])
        return head + "".join(parts) + tail

    def of(self, kind: str, value: str) -> str | None:
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[at] = getattr(self, kind)(value)
        return self.known[at]

    def replaced(self, text: str | None) -> tuple[str | None, dict[str, int], list[tuple[str, int, int]]]:
        """The text with pseudonyms, how many of each kind, and (kind, start, end) in the text as it was."""
        counts, spans = dict.fromkeys(KINDS, 0), []
        if not text or not MIGHT.search(text):
            return text, counts, spans

        def put(m: re.Match) -> str:
            kind, value = m.lastgroup, m[0]
            new = self.of(kind, value)
            if new is None:
                return value
            counts[kind] += 1
            spans.append((kind, m.start(), m.end()))
            return new

        return PATTERN.sub(put, text), counts, spans


def _into(form: str, digits: str) -> str:
    """form with its digits replaced, one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


_OWN_KEY = secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where that is unset, a random one of this driver: its pseudonyms link all that it writes, and nothing else."""
    said = spark.conf.get(KEY_SETTING, None)
    return said.encode() if said else _OWN_KEY


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, pii_spans (kind, start, end in the old text) and n_<kind> for every row. No shuffle. key: else that of the session."""
    common.prepare(docs.sparkSession)
    key = key or key_of(docs.sparkSession)
    names = ["doc_id", "text", "pii_spans", *(f"n_{k}" for k in KINDS)]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.string(), span] + [pa.int64()] * len(KINDS)

    def run(batches):
        p = Pseudonyms(key)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, counts, spans = p.replaced(text)
                rows.append((i, new, [{"kind": k, "start": a, "end": b} for k, a, b in spans], *counts.values()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, text string, pii_spans array<struct<kind:string,start:int,end:int>>, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.in_worker()(run), schema)
