"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

A span is (kind, start, end, score, base): code points, end exclusive. Base spans are the matches of four fixed patterns
that pass the check of their kind: e-mail addresses, IPv4 addresses with parts up to 255, payment cards of 14 to 19 digits
by Luhn, telephone numbers with a plus sign and 10 to 15 digits. They are always kept. The other spans are proposed by more patterns;
each starts from the score of its pattern, a checksum that fails rejects it and one that holds raises it, words of its
kind nearby raise it, words that speak against it lower it, and it is kept at ``LEAST`` or more, unless it overlaps a
base span or a better one.

Null texts count as empty and have no span. Texts are read whole, in time linear in their length, however long. Rows are
read one by one, so ties and repeated rows get the same spans each. An empty table gives an empty one. ``spans`` and
``redact`` are functions of a column, so the other columns of the table, whatever their names, stay as they are.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

LEAST = 0.5
BEFORE, AFTER = 60, 30  # code points around a span in which words count

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "nir", "steuer_id", "dni")
_rank = {kind: i for i, kind in enumerate(KINDS)}

# The length of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Words that speak for a kind, in English, German, French and Spanish, and words that speak against any number.
WORDS = {
    "ip": r"ip|ipv6|host|server|address|adresse|serveur|dirección|servidor",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|pan|cvv|cvc",
    "phone": r"phone|telephone|tel|call|mobile|cell|fax|telefon|handy|anruf|téléphone|portable|appeler|teléfono|móvil|llamar|whatsapp",
    "iban": r"iban|account|bank|bic|konto|compte|cuenta|banque|banco",
    "ssn": r"ssn|social|security|taxpayer",
    "nir": r"nir|insee|sécurité|sociale|sécu|assuré",
    "steuer_id": r"steuer|steuernummer|steuerid|steuer-id|identifikationsnummer|idnr|tin",
    "dni": r"dni|nif|documento|identidad|identificación",
}
AGAINST = r"isbn|issn|doi|order|invoice|version|part|sku|serial|model|bestellung|rechnung|facture|commande|pedido|factura|lot"
_for = {kind: re.compile(rf"\b(?:{words})\b").search for kind, words in WORDS.items()}
_against = re.compile(rf"\b(?:{AGAINST})\b").search


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """The check of payment cards over a string of the digits 0 to 9."""
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10


def mod97(iban: str) -> bool:
    """The check of IBANs over capital letters and digits without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    """ISO 7064 MOD 11,10 with the check digit last."""
    p = 10
    for d in map(int, digits[:-1]):
        p = ((p + d) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# The base patterns. None looks back over what another start has read: time stays linear in long runs of one character.
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").finditer
_local = re.compile(r"[A-Za-z0-9._%+-]*+").match  # over the reversed text
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost, longest local part before each domain, from the end of the match before."""
    done = 0
    for found in _domain(text):
        at = found.start()
        if local := _local(text[done:at][::-1]).end() if at - done < 256 else _long_local(text, done, at):
            yield at - local, found.end()
            done = found.end()


def _long_local(text: str, done: int, at: int) -> int:
    """Length of the local part before ``at``; reads doubling pieces, so no more than twice the part."""
    size = 256
    while True:
        low = max(done, at - size)
        local = _local(text[low:at][::-1]).end()
        if local < at - low or low == done:
            return local
        size *= 2


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans, and the number sequences that are no card."""
    out, left = [], []
    if "@" in text:
        out += [Span("email", s, e, 1.0, True) for s, e in _emails(text)]
    for m in _ip(text):
        if all(len(n := part.lstrip("0")) < 4 and int(n or 0) <= 255 for part in m.groups()):
            out.append(Span("ip", m.start(), m.end(), 1.0, True))
    for m in _card(text):
        if m.end() - m.start() < 8:
            continue
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", m.start(), m.end(), 1.0, True))
        else:
            left.append(m.span())
    if "+" in text:
        out += [Span("phone", m.start(), m.end(), 1.0, True) for m in _phone(text) if 10 <= len(_digits(m[0])) <= 15]
    return out, left


_groups = re.compile(r"[0-9]+").finditer
_layouts = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
_issuer = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6").match


def _cards(text: str, left: list[tuple[int, int]]) -> Iterator[Span]:
    """Cards beside other numbers: one group, or groups in a layout that cards are printed in, by Luhn and the issuer's first digits."""
    for start, end in left:
        groups = [m.span() for m in _groups(text, start, end)]
        at = 0
        while at < len(groups):
            for n in (5, 4, 3, 1):
                some = groups[at : at + n]
                sizes = tuple(e - s for s, e in some)
                if len(some) == n and (sizes in _layouts or n == 1 and 13 <= sizes[0] <= 19):
                    digits = "".join(text[s:e] for s, e in some)
                    if _issuer(digits) and luhn(digits):
                        yield Span("card", some[0][0], some[-1][1], 0.6, False)
                        at += n - 1
                        break
            at += 1


_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}").finditer


def _ibans(text: str) -> Iterator[Span]:
    for m in _iban(text):
        length, n = IBAN_LENGTHS.get(m[0][:2], 0), 0
        for i, c in enumerate(m[0]):
            n += c not in " -"
            if n == length:
                end = m.start() + i + 1
                code = m[0][: i + 1].replace(" ", "").replace("-", "")
                if not (end < len(text) and text[end].isalnum()) and mod97(code):
                    yield Span("iban", m.start(), end, 0.9, False)
                break


def _ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text).exploded.count("0000") < 7
    except ValueError:
        return False


#: kind, what it looks like, the score of that, the checksum or None, the score it adds.
PATTERNS: tuple[tuple[str, Callable, float, Callable[[str], bool] | None, float], ...] = (
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.]*[0-9A-Za-z:])").finditer, 0.2, _ipv6, 0.4),
    ("phone", re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])").finditer, 0.3, None, 0.0),
    ("phone", re.compile(r"(?<![0-9A-Za-z+().-])00?[1-9][0-9]{0,4}(?:[\x20/.-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z-])").finditer, 0.25, lambda t: 9 <= len(_digits(t)) <= 15, 0.0),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])").finditer, 0.4, None, 0.0),
    ("nir", re.compile(r"(?<![0-9A-Za-z])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2]|[2-9][0-9])\x20?[0-9][0-9AB]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9A-Za-z])").finditer, 0.2, lambda t: _nir(t), 0.3),
    ("steuer_id", re.compile(r"(?<![0-9A-Za-z])[1-9][0-9](?:\x20?[0-9]{3}){3}(?![0-9A-Za-z])").finditer, 0.15, lambda t: mod11_10(_digits(t)), 0.15),
    ("dni", re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z](?![0-9A-Za-z])").finditer, 0.2, lambda t: _dni(t), 0.25),
)


def _nir(text: str) -> bool:
    code = text.replace(" ", "")
    number = code[:13].replace("2A", "19").replace("2B", "18")  # Corsica's departments count as 19 and 18
    return number.isdigit() and 97 - int(number) % 97 == int(code[13:])


def _dni(text: str) -> bool:
    code = text.replace("-", "")
    number = code[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == code[-1]


def _proposed(text: str, left: list[tuple[int, int]]) -> Iterator[Span]:
    yield from _cards(text, left)
    yield from _ibans(text)
    for kind, pattern, score, check, more in PATTERNS:
        for m in pattern(text):
            if check is None or check(m[0]):
                yield Span(kind, m.start(), m.end(), score + (more if check else 0.0), False)


def _weighed(text: str, span: Span) -> Span:
    """The span with its score by the words around it; the nearest side's words count once."""
    around = (text[max(0, span.start - BEFORE) : span.start] + " \n " + text[span.end : span.end + AFTER]).lower()
    score = span.score + 0.3 * bool(_for[span.kind](around)) - 0.3 * bool(_against(around))
    return span._replace(score=round(min(1.0, max(0.0, score)), 3))


_any_digit = re.compile(r"[0-9]").search


def spans_of(text: str, *, least: float = LEAST) -> list[Span]:
    """All spans of a text, by start, then kind as listed in KINDS."""
    if "@" not in text and not _any_digit(text):
        return []
    out, left = base_spans(text)
    if _any_digit(text):
        taken = sorted((s.start, s.end) for s in out)
        found = [s for p in _proposed(text, left) if (s := _weighed(text, p)).score >= least]
        out += _apart(found, taken)
    return sorted(out, key=lambda s: (s.start, _rank[s.kind], s.end))


def _apart(found: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap neither what is taken nor a better span: of those that overlap, the highest score, then the longest, then the first stays."""
    kept: list[Span] = []
    edge = 0
    group: list[Span] = []

    def settle() -> None:
        mine: list[Span] = []
        for s in sorted(group, key=lambda s: (-s.score, s.start - s.end, s.start, _rank[s.kind])):
            if all(s.end <= t.start or t.end <= s.start for t in mine):
                mine.append(s)
        kept.extend(mine)

    at = 0
    for s in sorted(found, key=lambda s: (s.start, s.end)):
        while at < len(taken) and taken[at][1] <= s.start:
            at += 1
        # base spans of different kinds may overlap each other; those from ``at`` on that start before the end decide
        if any(b > s.start for a, b in _until(taken, at, s.end)):
            continue
        if group and s.start >= edge:
            settle()
            group, edge = [], 0
        group.append(s)
        edge = max(edge, s.end)
    settle()
    return kept


def _until(taken: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(taken) and taken[at][0] < end:
        yield taken[at]
        at += 1


_SPAN = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()).add("score", DoubleType()).add("base", BooleanType())


def _spans(text: pa.Array) -> pa.Array:
    offsets, flat = [0], []
    for t in text.to_pylist():
        flat += spans_of(t or "")
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) or [[], [], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(Span._fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def spans(text: Column | str) -> Column:
    """All spans of a text column: an array of (kind, start, end, score, base), empty for null."""
    return F.arrow_udf(_spans, ArrayType(_SPAN))(F.col(text) if isinstance(text, str) else text)


def redact(text: Column | str, *, least: float = LEAST) -> Column:
    """The text with each personal span of at least this score as its kind in angle brackets; overlapping spans go as one, under the kind of the first."""

    def masked(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _redacted(t, least) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(masked, StringType())(F.col(text) if isinstance(text, str) else text)


def _redacted(text: str, least: float) -> str:
    out, done = [], 0
    for s in spans_of(text, least=least):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, score, base, value): a row for each span, its text in ``value``; ``key`` keeps its type, null or not. Other columns aren't read."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("spans", spans("text"))
    rows = rows.select("doc_id", "text", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.end", "s.score", "s.base", F.expr("substring(text, cast(s.start + 1 as int), cast(s.end - s.start as int))").alias("value"))
