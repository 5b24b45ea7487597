"""Personal data, also where it is disguised.

Plain identifiers are found in the text as it stands. Then transducers rewrite the disguises (look-alike letters, invisible
characters, spelled digits, "at" and "dot") and carry along, for each character, the stretch of source it came from; what is
found in the rewritten text is mapped back, so that all spans are offsets in the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, rewrite_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: what fails at a run's first digit fails at its others too.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")

#: Letters of other scripts that look like these ASCII letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "τ": "t", "ε": "e", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
#: Characters that are not seen.
UNSEEN = frozenset("­​‌‍⁠﻿")
#: Spelled digits of English.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Last labels of domains that make a bare "at" believable without a spelled "dot".
LAST_LABELS = "com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu"

FAR = re.compile("[^\x00-\xff]|­|·")
DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
ONE = rf"(?:(?:double|triple)[ -]+)?(?:{DIGIT_WORD}|[0-9])"
RUN = re.compile(rf"(?<![A-Za-z0-9])(?:(plus)[ ,-]+)?({ONE}(?:[ ,.-]{{0,2}}(?<![A-Za-z])(?={ONE}(?![A-Za-z])){ONE})+)(?![A-Za-z])", re.I)
PART = rf"{ONE}(?:[ -]{ONE}|(?<=[0-9])[0-9]){{0,2}}"
#: Four numbers of up to three digits, spelled or not, between spelled dots.
SPELLED_IP = re.compile(rf"(?<![A-Za-z0-9]){PART}(?:[ ]*(?:\.|dot|point)[ ]*{PART}){{3}}(?![A-Za-z0-9])", re.I)
UNIT = re.compile(rf"(?:(double|triple)[ -]+)?({DIGIT_WORD}|[0-9])", re.I)
# The look-behinds change no match: one that fails at the first blank or mark of a run fails at its others too. They keep the
# time linear in the run.
BRACKET_AT = re.compile(r"(?<![ ])[ ]*(?:\[[ ]*(?:at|@)[ ]*\]|\([ ]*(?:at|@)[ ]*\)|\{[ ]*(?:at|@)[ ]*\}|<[ ]*(?:at|@)[ ]*>|(?<![_*-])[_*-]+at[_*-]+)[ ]*", re.I)
BRACKET_DOT = re.compile(r"(?<![ ])[ ]*(?:\[[ ]*(?:dot|\.|point)[ ]*\]|\([ ]*(?:dot|\.|point)[ ]*\)|\{[ ]*(?:dot|\.|point)[ ]*\}|<[ ]*(?:dot|\.)[ ]*>|(?<![_*-])[_*-]+dot[_*-]+)[ ]*", re.I)
DOMAIN_WORDS = r"[A-Za-z0-9-]+"
BARE_AT = re.compile(
    rf"(?<=[A-Za-z0-9])[ ]+(?:at|@)[ ]+(?={DOMAIN_WORDS}(?:\.{DOMAIN_WORDS})*[ ]+dot[ ]+[A-Za-z]|{DOMAIN_WORDS}(?:\.{DOMAIN_WORDS})*\.(?:{LAST_LABELS})(?![A-Za-z0-9]))", re.I
)
#: What stands before a bare "at" with a plain domain: a name that is no mere word, or a word of this kind not far before.
NO_WORD = re.compile(r"[A-Za-z0-9._%+-]*[0-9._%+][A-Za-z0-9._%+-]*\Z")
INVITES = re.compile(r"(?:e-?mail|mail|contact|write|reach|message|address|ping)", re.I)
NEARBY = 48
SPELLED_DOT = re.compile(rf"{DOMAIN_WORDS}(?:\.{DOMAIN_WORDS})*[ ]+dot[ ]", re.I)
LOCAL_DOT = re.compile(r"(?<=[A-Za-z0-9])[ ]+dot[ ]+(?=[A-Za-z0-9._-]+@)", re.I)
DOTTED_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+(?:[ ]+dot[ ]+(?=[A-Za-z0-9])[A-Za-z0-9.-]+)+", re.I)
DOMAIN_DOT = re.compile(r"[ ]+dot[ ]+(?=[A-Za-z0-9])", re.I)
NUMBER_DOT = re.compile(r"(?<=[0-9])[ ]*(?:dot|point)[ ]*(?=[0-9])", re.I)
AT_HINTS = ("[at", "(at", "{at", "<at", "[ at", "( at", "-at-", "_at_", "*at*", "[@", "(@", " at ", " @ ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The identifiers of a text as it stands: by kind, then by place."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@lru_cache(4096)
def plain_letter(c: str) -> str:
    """The ASCII that a character stands for, or the character."""
    if c in UNSEEN:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if ord(c) < 256:
        return c
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide.isascii() else c


class Rewritten:
    """A text under rewriting: its characters' stretches of source, and which of them a transducer made."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = list(range(len(text))), list(range(1, len(text) + 1))
        self.made = bytearray(len(text))

    def letters(self) -> None:
        """Look-alike and unseen characters."""
        found = [(m.start(), m.end(), new) for m in FAR.finditer(self.text) if (new := plain_letter(m[0])) != m[0]]
        self.replace(found)

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Puts new characters in the place of stretches (in order, apart from one another)."""
        if not found:
            return
        text, starts, ends, made, at = [], [], [], bytearray(), 0
        for a, b, new in found:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            made += self.made[at:a] + b"\1" * len(new)
            if not new and a > at:  # a removed character marks the one before it
                made[-1] = 1
            at = b
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        self.made = made + self.made[at:]

    def every(self, pattern: re.Pattern, new: str) -> None:
        self.replace([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])

    def every_in(self, around: re.Pattern, pattern: re.Pattern, new: str) -> None:
        """The same for what stands inside the matches of another pattern."""
        self.replace([(m.start(), m.end(), new) for a in around.finditer(self.text) for m in pattern.finditer(self.text, a.start(), a.end())])


def believable(text: str, m: re.Match) -> bool:
    """Whether a bare "at" joins a name to a domain: the domain's dot is spelled, or what stands before is no ordinary word, or mail is
    spoken of not far before it."""
    before = text[max(m.start() - NEARBY, 0) : m.start()]
    return bool(SPELLED_DOT.match(text, m.end()) or NO_WORD.search(before) or INVITES.search(before))


def spelled_runs(text: str) -> list[tuple[int, int, str]]:
    """Runs of two or more digits of which some are spelled, as digits."""
    out = []
    for m in RUN.finditer(text):
        units = UNIT.findall(m[2])
        if not any(w.lower() in SPELLED for _, w in units):
            continue
        digits = digits_of(m[2])
        out.append((m.start() if m[1] else m.start(2), m.end(), ("+" if m[1] else "") + digits))
    return out


def digits_of(text: str) -> str:
    return "".join(SPELLED.get(w.lower(), w) * {"double": 2, "triple": 3}.get(k.lower(), 1) for k, w in UNIT.findall(text))


def spelled_ips(text: str) -> list[tuple[int, int, str]]:
    """Dotted numbers with a spelled digit, also parts of a single one, as digits and dots."""
    found = [(m.start(), m.end(), re.split(r"\.|dot|point", m[0], flags=re.I)) for m in SPELLED_IP.finditer(text)]
    return [(a, b, ".".join(map(digits_of, parts))) for a, b, parts in found if any(w.lower() in SPELLED for p in parts for _, w in UNIT.findall(p))]


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the source that only the rewritten text shows and that don't touch a plain span of their kind."""
    low = text.lower()
    far = not text.isascii() and FAR.search(text)
    dots = "dot" in low or "[.]" in low or "(.)" in low or "point" in low
    ats = any(h in low for h in AT_HINTS) and (dots or re.search(rf"\.(?:{LAST_LABELS})\b", low))
    numbers = any(w in low for w in SPELLED) or (far is not None and far is not False)
    if not (far or dots or ats or numbers):
        return []
    r = Rewritten(text)
    if far:
        r.letters()
    if dots or far:
        r.every(BRACKET_DOT, ".")
    if ats or dots or far:
        r.every(BRACKET_AT, "@")
        r.replace([(m.start(), m.end(), "@") for m in BARE_AT.finditer(r.text) if believable(r.text, m)])
        r.every(LOCAL_DOT, ".")
        r.every_in(DOTTED_DOMAIN, DOMAIN_DOT, ".")
    runs: set[str] = set()
    if numbers:
        if dots:
            r.replace(spelled_ips(r.text))
        found = spelled_runs(r.text)
        runs = {d for _, _, d in found if 9 <= len(d.lstrip("+")) <= 15}
        r.replace(found)
    if numbers or dots:
        r.every(NUMBER_DOT, ".")
    spans = plain_spans(r.text)
    if runs:
        taken = bytearray(len(r.text))
        for _, a, b in spans:
            taken[a:b] = b"\1" * (b - a)
        for m in re.finditer(r"(?<![0-9+])[0-9]{9,15}(?![0-9])", r.text):
            # a spelled number needs no plus sign to be a telephone number
            if m[0] in runs and all(r.made[m.start() : m.end()]) and not any(taken[m.start() : m.end()]):
                spans.append(("phone", *m.span()))
    # Spans of one kind don't overlap, so that the nearest one before a span's end is the one to look at.
    known = {k: [(a, b) for kind, a, b in plain if kind == k] for k in KINDS}
    out: list[tuple[str, int, int]] = []
    last, done = "", 0
    for kind, a, b in in_order(spans):
        if kind != last:
            last, done = kind, 0
        if any(r.made[a:b]):
            start, end = r.starts[a], r.ends[b - 1]
            near = bisect_left(known[kind], (end,)) - 1
            if start >= done and (near < 0 or known[kind][near][1] <= start):
                out.append((kind, start, end))
                done = end
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """(keep…, plain, disguised: array<struct<kind, start, end>>) for every row's whole text; offsets are code points, ends
    exclusive. Null text counts as empty; repeated rows and null ids stay; other columns are not read."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    fields = "array<struct<kind:string,start:bigint,end:bigint>>"

    def each(texts, _):
        plain, more = [], []
        for t in texts:
            p = plain_spans(t)
            plain.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order(p)])
            more.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order(disguised_spans(t, p))])
        return [pa.array(plain, kind), pa.array(more, kind)]

    return map_texts(docs, keep, f"plain {fields}, disguised {fields}", each)


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of plain spans by kind, SHA-256 of the plain spans, all spans as text, number of disguised ones."""

    def each(texts, _):
        rows = []
        for t in texts:
            p = in_order(plain_spans(t))
            more = disguised_spans(t, p)
            counts = [sum(s[0] == k for s in p) for k in KINDS]
            rows.append((*counts, hashlib.sha256(written(p).encode()).hexdigest(), written(in_order([*p, *more])), len(more)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    return map_texts(docs, ["doc_id"], "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", each)


def redact(text: str) -> str:
    """The text with each span replaced by the name of its kind; of overlapping spans the first, then longest."""
    p = plain_spans(text)
    spans = sorted([*p, *disguised_spans(text, p)], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:  # the rest of an overlapping span goes too
            at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, with each text redacted and n_chars, where there is such a column, set anew. Null texts stay
    null (n_chars too); empty texts, repeated rows and null ids stay as they are."""

    def each(batch, _, at):
        new = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if "n_chars" in batch.schema.names:
            k = batch.schema.names.index("n_chars")
            columns[k] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rewrite_rows(docs, each)
