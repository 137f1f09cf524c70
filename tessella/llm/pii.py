"""Personal data in texts, also where it is disguised; spans are of the text as it stands."""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordhash import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def _emails(text: str) -> list[Span]:
    """Each ``@`` with the longest local part before it and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of plainly written data, leftmost and non-overlapping within a kind; by kind, then start."""
    out = _emails(text)
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like the Latin letter they stand beside.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
_INVISIBLE = frozenset("­​‌‍⁠﻿")

# The digits in English, Spanish, French and German, and the words for at, dot and plus.
_SPELLED = {w: str(k) for words in (
    "zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun",
) for k, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"}
_AT_WORD, _DOT_WORD, _PLUS_WORD = "(?:at|arroba|arobase)", "(?:dot|punto|point|punkt)", "(?:plus|más)"
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
#: A longest run of number words and digits, read once; ``plus`` may stand before it.
_NUMBERS = re.compile(rf"(?i)(?:\b(?:{_PLUS_WORD}[\s,-]+)?|\+)(?:{_WORD}|[0-9]+)\b(?:[\s,-]+(?:{_WORD}|[0-9]+)\b)*+")
#: Digits are spelled where a run has three number words in a row; other runs only count as a card or phone.
_THREE = re.compile(rf"(?i)\b{_WORD}[\s,-]+{_WORD}[\s,-]+{_WORD}\b")
#: What any run that counts holds: two number words, or one and a digit, side by side.
_WORDS_CLOSE = re.compile(rf"\b{_WORD}[\s,-]++(?:{_WORD}|[0-9])|[0-9][\s,-]++{_WORD}\b")
_PART = re.compile(rf"(?i){_WORD}|{_PLUS_WORD}|[0-9]+")
_BRACKETED_AT = re.compile(rf"(?i)(?:(?<!\s)\s++)?[\[({{<]\s*(?:{_AT_WORD}|@)\s*[\])}}>]\s*")
_BRACKETED_DOT = re.compile(rf"(?i)(?:(?<!\s)\s++)?[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]\s*")
#: An at with the domain after it, whose dots are spoken or plain; the local part is found from there on to the left.
_SPOKEN = re.compile(rf"(?i)((?<!\s)\s++{_AT_WORD}\s++|@)([A-Za-z0-9-]++(?:(?:\s++{_DOT_WORD}\s++|\.)[A-Za-z0-9-]++)++)")
#: The last label of a domain with plain dots after a spoken at, so that times and numbers are none.
_TOP = re.compile(r"\.[A-Za-z]{2,}\Z")
#: What a spoken at needs before a domain whose dots are plain.
_AT = re.compile(rf"\s{_AT_WORD}\s+[a-z0-9-]++\.[a-z0-9-]")
#: What a spoken at needs before a domain with a spoken dot.
_AT_DOT = re.compile(rf"\s{_AT_WORD}\s+[a-z0-9-]++(?:\.[a-z0-9-]++)*+\s+{_DOT_WORD}\s")
_SPOKEN_DOT = re.compile(rf"(?i)\s+{_DOT_WORD}\s+")
#: A spoken dot at the end of a local part's left side.
_DOT_END = re.compile(rf"(?i)\s{_DOT_WORD}\Z")
_DOTS = ("dot", "punto", "point", "punkt")


class Tape:
    """A text being rewritten, with the place in the source of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces non-overlapping ranges; each new character stands for the whole range it came from."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in sorted(edits):
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _plain_characters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for k, c in enumerate(text):
        if c < "\x80":
            continue
        if c in _INVISIBLE:
            edits.append((k, k + 1, ""))
        elif c in _LOOKALIKES:
            edits.append((k, k + 1, _LOOKALIKES[c]))
        else:
            new = unicodedata.normalize("NFKC", c)  # full-width and styled letters and digits
            if new != c and new.isascii() and len(new) == 1 and not new.isspace():
                edits.append((k, k + 1, new))
    return edits


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Each run of number words becomes its digits, one edit per word; what separates words goes.

    A run that mixes digits and words without three words in a row is taken only if it then is a card or phone.
    """
    edits = []
    for m in _NUMBERS.finditer(text):
        own, end, words, new = [], None, 0, "+" if m[0][0] == "+" else ""
        for p in _PART.finditer(text, m.start(), m.end()):
            if end is not None and end < p.start():
                own.append((end, p.start(), ""))
            word = p[0].lower()
            if not word[0].isdigit():
                words += word in _SPELLED
                own.append((*p.span(), _SPELLED.get(word, "+")))
            new += own[-1][2] if not word[0].isdigit() else word
            end = p.end()
        if words and (_THREE.search(text, *m.span()) or _is_number(new)):
            edits += own
    return edits


def _is_number(text: str) -> bool:
    """Whether digits, perhaps after a plus, are a phone or card as a whole."""
    if text[0] == "+":
        return 9 <= len(text) - 1 <= 15
    return 13 <= len(text) <= 19 and _luhn(text)


def _local_parts(text: str, at: int, free: int) -> list[tuple[int, int]]:
    """The spoken dots of the local part that ends at ``at``, from the right; nothing before ``free`` is read."""
    dots, end = [], at
    while True:
        start = end
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start == end:
            return dots[:-1]  # no local part before that dot
        if dots and text[start:end].lower() in _DOTS:
            return dots[:-1]
        word = start
        while word > free and text[word - 1].isspace():
            word -= 1
        dot = _DOT_END.search(text, max(free, word - 6), word)
        if word == start or not dot:
            return dots
        left = dot.start() + 1
        while left > free and text[left - 1].isspace():
            left -= 1
        dots.append((left, start))
        end = left


def _spoken(text: str) -> list[tuple[int, int, str]]:
    edits, free = [], 0
    for m in _SPOKEN.finditer(text):
        at = m.start()
        if at == free or text[at - 1] not in _LOCAL:
            continue
        dots = list(_SPOKEN_DOT.finditer(text, *m.span(2)))
        if m[1].strip().lower() == "at" and any(d[0].strip().lower() == "point" for d in dots):
            continue  # "at this point in time"; French has its own word for at
        spoken = [d.span() for d in dots]
        if m[1] != "@":
            if not spoken and not _TOP.search(m[2]):
                continue
            edits.append((*m.span(1), "@"))
        edits += [(a, b, ".") for a, b in [*_local_parts(text, at, free), *spoken]]
        free = m.end()
    return edits


def normalised(text: str) -> Tape | None:
    """The text without its disguises; None if there are none."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_plain_characters(text))
    if any(b in tape.text for b in "[({<"):
        for pattern, new in ((_BRACKETED_AT, "@"), (_BRACKETED_DOT, ".")):
            tape.rewrite([(*m.span(), new) for m in pattern.finditer(tape.text)])
    lower = tape.text.lower()
    if "@" in lower and any(d in lower for d in _DOTS) or _AT.search(lower) or _AT_DOT.search(lower):
        tape.rewrite(_spoken(tape.text))
    if _WORDS_CLOSE.search(lower):
        tape.rewrite(_spelled_digits(tape.text))
    return None if tape.text == text else tape


def pii_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those of the normalised text that reach beyond them; by kind, then start."""
    base = base_spans(text)
    tape = normalised(text)
    if tape is None:
        return base, base
    starts, reach = [], []  # of base spans by start, with the farthest end so far
    for a, b, _ in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    more: set[Span] = set()
    for a, b, kind in base_spans(tape.text):
        span = (tape.starts[a], tape.ends[b - 1], kind)
        k = bisect.bisect_right(starts, span[0])
        if not k or reach[k - 1] < span[1]:  # no base span holds it
            more.add(span)
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[2]), s[0], s[1]))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    Spans are in code points, end exclusive, of the whole text as it stands; a null text counts as
    empty. Counts and hash are of plainly written data; ``spans`` also has what shows once homoglyphs,
    spelled digits and at/dot disguises are undone. Null and repeated ids are scanned like any other;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = pii_spans(text or "")
                rows.append((*[sum(k == s[2] for s in base) for k in KINDS], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans)))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
