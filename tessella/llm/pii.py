"""Personal data: offset-preserving deobfuscation.

Identifiers are found twice: in the text as it stands (the base), and in a
normalised text in which transducers have undone disguises. A transducer is a
list of edits (start, end, replacement) of the source; the normalised text
remembers for each of its characters which source characters it stands for, so
a span found there maps back to source offsets. Offsets are code points.

Transducers, in this order: homoglyphs, other scripts' digits and invisible
characters; bracketed and spelled at/dot; runs of spelled digits. Plain words
"at" and "dot" count only where together they form an address.

Nulls and empty texts have no spans. Repeated rows are treated alike, an empty
table gives none, extra columns are ignored. Scans are linear in the text; all
quantifiers inside which a scan may start anew are bounded.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns, released

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Every ip, card and phone number lies within one such stretch.
_STRETCH = re.compile(r"[0-9+][\x20().0-9+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _passes_luhn(digits)


def _is_phone(s: str) -> bool:
    return 9 <= sum(c.isdigit() for c in s) <= 15


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from their at signs."""
    spans: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (domain := _DOMAIN.match(text, at)):
            start, size = at, 64
            while start > end:  # look back in growing steps for the start of the run of local characters
                low = max(end, at - size)
                start = low + len(text[low:at].rstrip(_LOCAL_CHARS))
                if start > low or low == end:
                    break
                size *= 4
            if start < at:
                end = domain.end()
                spans.append((start, end))
        at = text.find("@", at + 1)
    return spans


def find_spans(text: str) -> dict[str, list[Span]]:
    """Base spans of each kind."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    for stretch in _STRETCH.finditer(text):
        low, high = stretch.span()
        if high - low < 7:
            continue
        for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            for m in pattern.finditer(text, low, high):
                if valid(m[0]):
                    found[kind].append(m.span())
    return found


# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аАвВсСеЕНіІјЈкКмМоОрРѕЅтТуУхХԁԛԝһ", "aABBcCeEHiIjJkKmMoOpPsStTyYxXdqwh")) | dict(
    zip("αΑΒΕΖΗΙιΚκΜΝΟοΡρΤυΥΧνχ", "aABEZHIiKkMNOoPpTuYXvx")
)
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Dashes of other widths.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
# Names of the digits 0 to 9 in the languages of the corpus.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
# Names of the full stop and the at sign.
DOT_NAMES = "dot point punkt punto"
AT_NAMES = "at arobase arroba"

_DIGIT = {w: str(i) for names in DIGIT_NAMES.values() for i, w in enumerate(names.split())} | {"oh": "0"}
_names = "|".join(sorted(map(re.escape, _DIGIT), key=len, reverse=True))
_dots, _ats = DOT_NAMES.replace(" ", "|"), AT_NAMES.replace(" ", "|")
_ODD = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\u024f\u2016-\u2027\u2030-\u205e\u20a0-\u20bf]")
_BRACKETED = re.compile(rf"[\[({{<]\x20*(?:(@|(?:{_ats}))|(\.|(?:{_dots})))\x20*[\])}}>]", re.I)
_dot = rf"(?:\.|\x20\.\x20|\x20(?:{_dots})\x20)"
#: local AT label (DOT label)+ with plain words; at least the at or one dot is spelled or stands alone.
_SPOKEN = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_dot}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:@|\x20@\x20|\x20(?:{_ats})\x20)"
    rf"[A-Za-z0-9-]{{1,63}}(?:{_dot}[A-Za-z0-9-]{{2,63}})+",
    re.I,
)
_SPOKEN_PART = re.compile(rf"\x20(?:(@|{_ats})|(\.|{_dots}))\x20", re.I)
#: four numerals with dots, of which at least one is spelled
_SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:{_dot}[0-9]{{1,3}}){{3}}(?!\w)", re.I)
_DIGIT_RUN = re.compile(rf"\b(?:{_names})(?:[\x20.,-]{{1,2}}(?:{_names}|{_dots}|[0-9]+))*[\x20.,-]{{1,2}}(?:{_names})\b", re.I)
_DIGIT_PART = re.compile(rf"({_names})|[\x20.,-]*({_dots})[\x20.,-]*|([0-9]+)|([\x20.,-]+)", re.I)
_PLUS = re.compile(r"\bplus[\x20-](?=[0-9])", re.I)
#: Whatever _SPOKEN_PART, _DIGIT_RUN or _PLUS lead to an edit of has one of these: a spelled at before a host, a spelled dot; a digit's name
#: before another part of a run, a plus before a digit.
_SPOKEN_HINT = re.compile(rf"\x20(?:(?:@|{_ats})\x20[A-Za-z0-9-]{{1,63}}{_dot}[A-Za-z0-9-]{{2}}|(?:{_dots})\x20)", re.I)
_NUMBER_HINT = re.compile(rf"\b(?:(?:{_names})[\x20.,-]{{1,2}}(?:{_names}|{_dots}|[0-9])|plus[\x20-][0-9])", re.I)


class Normalised:
    """A text and, for each of its characters, the source characters that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1
        self.changed = np.zeros(len(text) + 1, np.int64)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint stretches, given in order."""
        texts, starts, ends, changed, at = [], [], [], [], 0
        flags = self.changed[:-1]
        for low, high, new in [*edits, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:low], new]
            n = len(new)
            starts += [self.starts[at:low], np.full(n, self.starts[low] if n else 0)]
            ends += [self.ends[at:low], np.full(n, self.ends[high - 1] if n else 0)]
            changed += [flags[at:low], np.ones(n, np.int64)]
            if not n and low < high and low:  # a deletion marks the character before it
                changed[-2] = changed[-2].copy()
                changed[-2][-1:] = 1
            at = high
        self.text = "".join(texts)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.changed = np.append(np.concatenate(changed), 0)

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])

    def touched(self, span: Span) -> bool:
        return bool(self.changed[span[0] : span[1]].any())


def _plain(c: str) -> str:
    """What an odd character stands for; itself where that is unknown."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in DASHES:
        return "-"
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def _odd_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), p) for m in _ODD.finditer(text) if (p := _plain(m[0])) != m[0]]


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits, end = [], 0
    for m in _BRACKETED.finditer(text):
        low, high = m.span()
        # blanks around belong to it, those between two brackets to the first
        while low > end and text[low - 1] == " ":
            low -= 1
        while high < len(text) and text[high] == " ":
            high += 1
        edits.append((low, high, "@" if m[1] else "."))
        end = high
    return edits


def _spoken_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPOKEN.finditer(text):
        parts = [(*p.span(), "@" if p[1] else ".") for p in _SPOKEN_PART.finditer(text, *m.span())]
        said = [p for p in parts if text[p[0] + 1 : p[1] - 1] not in "@."]
        said = [p for p in said if p[2] == "."]
        at_spelled = any(p[2] == "@" for p in parts)
        local = text[m.start() : parts[0][0]] if parts else ""
        # "at" beside plain dots is common prose, unless the word before it looks like an address's
        odd = at_spelled and re.search(r"[0-9._+]", local) and re.search(r"\.[A-Za-z]{2,}\Z", m[0]) and text[m.end() : m.end() + 1] != "@"
        if said or odd or (at_spelled and " @ " in m[0]):
            out += parts
    for m in _SPOKEN_IP.finditer(text):
        parts = [(*p.span(), ".") for p in _SPOKEN_PART.finditer(text, *m.span())]
        if any(text[a + 1 : b - 1] != "." for a, b, _ in parts):
            out += parts
    return sorted(out)


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _DIGIT_RUN.finditer(text):
        if len(re.findall(rf"\b(?:{_names})\b", run[0], re.I)) < 3:
            continue
        for p in _DIGIT_PART.finditer(text, *run.span()):
            out.append((*p.span(), _DIGIT[p[1].lower()] if p[1] else "." if p[2] else p[3] or ("." if p[4].strip() == "." else "")))
    return out


def _may_hide(text: str) -> bool:
    """False only where no transducer would change the text."""
    if _ODD.search(text):
        return True
    if ("[" in text or "(" in text or "{" in text or "<" in text) and _BRACKETED.search(text):
        return True
    return bool(_SPOKEN_HINT.search(text) or _NUMBER_HINT.search(text))


def find_disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of identifiers that only the normalised text shows; none overlaps a base span of its kind."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _may_hide(text):
        return found
    n = Normalised(text)
    for transduce in (_odd_edits, _address_edits, _spoken_edits, _digit_edits):
        if edits := transduce(n.text):
            n.apply(edits)
    if edits := [(m.start(), m.end(), "+") for m in _PLUS.finditer(n.text)]:
        n.apply(edits)
    if n.text == text:
        return found
    for kind, spans in find_spans(n.text).items():
        starts = [a for a, _ in base[kind]]  # base spans of a kind are disjoint and ascending
        for span in spans:
            low, high = n.source(span)
            before = bisect_left(starts, high) - 1
            if n.touched(span) and (before < 0 or base[kind][before][1] <= low):
                found[kind].append((low, high))
    return found


def all_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base and disguised ones together."""
    base = find_spans(text or "")
    more = find_disguised(text or "", base)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str | None) -> str | None:
    """The text with every identifier replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, v in all_spans(text)[1].items() for a, b in v)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): base counts, digest of the base spans, all spans, and how many were disguised."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(rows: dict) -> dict:
        found = [all_spans(t) for t in rows["text"]]
        out = {"doc_id": rows["doc_id"]} | {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [joined(s) for _, s in found]
        out["n_disguised"] = [sum(len(s[k]) - len(b[k]) for k in KINDS) for b, s in found]
        return out

    return map_columns(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with identifiers in text replaced; n_chars, if there, is the new length. Other columns pass unchanged."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(docs.schema)
    counted = "n_chars" in docs.columns

    def run(batches):
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            at, text = batch.schema.get_field_index("text"), [redacted(t) for t in batch.column("text").to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(text, target.field("text").type)
            if counted:
                columns[batch.schema.get_field_index("n_chars")] = pa.array([None if t is None else len(t) for t in text], target.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)
