"""Personal data in texts, also where it is disguised; spans point into the text as it stands.

Plain identifiers are found in the text itself. A text with signs of a disguise is then rewritten
by transducers, which turn look-alike characters into ASCII, spelled digits into digits and
spelled or bracketed "at" and "dot" into their signs, and which keep for every character written the
source characters it stands for. Identifiers found in the rewritten text that rest on at least one
rewriting are added with their source spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import whole

FOUND = T.StructType([T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# An address starts where a run of digits does: what fails from there fails from inside the run too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = "".join(DIGIT.findall(m[0]))
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def plain(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


# Look-alikes of Latin letters in Cyrillic and Greek.
LOOKS = dict(
    zip(
        "аеорсухіјѕһԁԛАВЕКМНОРСТУХІЈЅ"
        "αονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqABEKMHOPCTYXIJS" "aovpABEZHIKMNOPTYX",
    )
)
SPELLED = {
    w: str(d)
    for names in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(names.split())
}
SPELLED["oh"] = "0"
LEAST_DIGITS = 7  # in a row, before spelled ones count as a number
AT, DOT = "at|arroba", "dot|punkt|punto|point"
TOP = "com|org|net|edu|gov|mil|int|info|biz|name|dev|app|io|ai|co|eu|uk|us|ca|au|de|at|ch|fr|be|es|mx|ar|it|nl|pt|pl|se"
WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
NUMBER = re.compile(rf"(?<!\w)(?:(?:{WORDS}|[0-9])(?:[\x20,.-]{{1,2}}|(?<=[0-9])(?=[0-9])|(?!\w))){{{LEAST_DIGITS},}}+", re.I)
NUMERAL = re.compile(rf"{WORDS}|[0-9]|[\x20,.-]+", re.I)
PLUS = re.compile(r"(?<!\w)plus\x20(?=[0-9(])", re.I)
MARK = re.compile(
    rf"\s*[\[({{<]\s*(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s*[\])}}>]\s*"
    rf"|(?<=\w)\x20(?P<bare_at>{AT})\x20(?=[A-Za-z0-9-]+(?:(?:\.|\x20(?:{DOT})\x20)[A-Za-z0-9-]+)*?\x20(?:{DOT})\x20(?:{TOP})(?!\w))"
    rf"|(?<=\w)\s+(?P<bare_dot>dot)\s+(?=[A-Za-z0-9])",
    re.I,
)
BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
BRACKETED = re.compile(rf"[\[({{<]\s*(?:{AT}|@|{DOT}|\.)\s*[\])}}>]", re.I)
SPELT = re.compile(rf"(?<!\w)(?:{WORDS})(?:[\x20,.-]{{1,2}}(?:{WORDS}|[0-9])(?!\w)){{2}}", re.I)
APART = str.maketrans("-,.", "   ")


def disguised(text: str) -> bool:
    """Whether anything in the text could be rewritten; cheap for the many texts where nothing can."""
    if not text.isascii() and BEYOND.search(text):
        return True
    low = text.lower()
    if BRACKETED.search(low) or any(f" {d} " in low for d in DOT.split("|")):
        return True
    return not SPELLED.keys().isdisjoint(low.translate(APART).split()) and bool(SPELT.search(low))


class Rewritten:
    """A text under rewriting: its characters, and for each the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, new) edits, in order and apart; each new character stands for all of its edit."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]

    def source(self, span: Span) -> Span | None:
        """The source span, or None if nothing in it was rewritten."""
        a, b = span
        return (self.starts[a], self.ends[b - 1]) if any(self.changed[a:b]) else None


def looks_like(c: str) -> str | None:
    if c in LOOKS:
        return LOOKS[c]
    flat = unicodedata.normalize("NFKC", c)
    if len(flat) == 1 and "!" <= flat <= "~":
        return flat
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


def rewritten(text: str) -> Rewritten:
    work = Rewritten(text)
    flat = [(i, i + 1, new) for i, c in enumerate(text) if ord(c) > 0x24F and (new := looks_like(c))]
    work.replace(flat)
    numbers = []
    for m in NUMBER.finditer(work.text):
        for part in NUMERAL.finditer(m[0]):
            word = part[0].lower()
            new = SPELLED.get(word, word if word.isdigit() else ("-" if "-" in word else " "))
            if new != part[0] and not (part.end() == len(m[0]) and word not in SPELLED):
                numbers.append((m.start() + part.start(), m.start() + part.end(), new))
    work.replace(numbers)
    work.replace([(*m.span(), "+") for m in PLUS.finditer(work.text)])
    marks = [(*m.span(), "@" if m["at"] or m["bare_at"] else ".") for m in MARK.finditer(work.text)]
    work.replace(marks)
    return work


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and those that only show once the text is rewritten, by kind."""
    base = plain(text)
    more: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if disguised(text):
        work = rewritten(text)
        for kind, found in FINDERS.items():
            for span in found(work.text):
                there = work.source(span)
                if there and not any(a <= there[0] and there[1] <= b for a, b in base[kind]):
                    more[kind].append(there)
    return base, more


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


@F.pandas_udf(FOUND)
def spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        out = []
        for text in batch:
            base, more = find(text)
            out.append((listed(base), listed({k: base[k] + more[k] for k in KINDS})))
        yield pd.DataFrame(out, columns=["base", "spans"])


def personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """All rows with a struct ``into`` (replaced if there): base and spans, as "kind:start:end,...".

    Spans count code points, end exclusive, by kind as in KINDS and then by start. Null is empty.
    """
    return docs.withColumn(into, spans_of(whole(text)))


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones become one."""
    parts = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at, upto = [], 0, 0
    for a, b, kind in parts:
        if a >= upto:
            out += [text[at:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redacted(t, s) if s else t for t, s in zip(texts, spans)])


@F.pandas_udf(T.StringType())
def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with all their personal data replaced; null stays null."""

    def clean(text: str) -> str:
        base, more = find(text)
        return redacted(text, listed({k: base[k] + more[k] for k in KINDS}))

    for batch in texts:
        yield batch.map(clean, na_action="ignore")
