"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found by fixed patterns. Then small transducers undo disguises, each giving
the rewritten text together with segments that map every place back to the source: look-alike and
full-width characters and invisible ones; letters drawn like digits; spelled digits; words and brackets that stand for the
at sign and the dot. The same patterns run on the rewritten text, and what they find is mapped
through all transducers to spans of source characters. A span is added if it covers a rewritten
character and overlaps no plain span of its kind. Texts without any trace of a disguise, nearly
all, skip the transducers after one scan.

Defined results. Null text is the empty text: no spans. Whole texts are read, however long. Offsets
count code points, the end is exclusive. Repeated rows give repeated result rows. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import map_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")

#: The base patterns.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can't begin inside a run of digits; so each run is read a few times, not once per digit
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Cyrillic and Greek letters drawn like Latin ones, dots and at signs of other scripts.
LOOKALIKES = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαοντιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。．﹒·＠﹫", "aeopcyxijsdhABEKMHOPCTXIJSaovtiABEZHIKMNOPTYX.....@@", strict=True))
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_ODD = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT = re.compile(rf"(?i:\b(?:{_WORD})\b)|[0-9]+")
_SPELLED = re.compile(rf"\b(?:{_WORD}|plus)\b")  # of lower-cased text
_BETWEEN = re.compile(r"[\s,.-]{1,3}")
_LEET = re.compile(r"(?<![A-Za-z])[OIl]?[0-9][0-9OIl]*(?![A-Za-z])")
_LEET_HINT = re.compile(r"[0-9][OIl]|[OIl][0-9]")
_PLUS = re.compile(r"(?i)(?:\bplus\b|\+)[\s]{0,3}\Z")
_SIGN = re.compile(
    r"(?i)\s{0,3}[\[({<]\s{0,2}(?P<at>at|arobase|arroba|klammeraffe|@|a)\s{0,2}[\])}>]\s{0,3}"
    r"|\s{0,3}[\[({<]\s{0,2}(?P<dot>dot|punkt|point|punto|\.)\s{0,2}[\])}>]\s{0,3}"
    r"|(?P<at2>&#64;|&commat;|%40)|(?P<dot2>&#46;|&period;)"
    r"|(?<=[A-Za-z0-9_%+-])\s{1,3}(?P<at3>at|arobase|arroba)\s{1,3}(?=[A-Za-z0-9-]{1,64}(?:\.|\s{1,3}(?:dot|punkt|point|punto)\s|\s{0,3}[\[({<]\s{0,2}(?:dot|punkt|point|punto|\.)))"
    r"|(?<=[A-Za-z0-9_-])\s{1,3}(?P<dot3>dot|punkt|punto|point)\s{1,3}(?=[A-Za-z0-9-])"
    r"|(?<=[A-Za-z0-9_%+-])(?:\s{1,3}(?P<at4>@)\s{0,3}|(?P<at5>@)\s{1,3})(?=[A-Za-z0-9-])"
    r"|(?<=[A-Za-z0-9])[-_](?P<at6>at)[-_](?=[A-Za-z0-9-]{1,64}?[-_]dot[-_])|(?<=[A-Za-z0-9])[-_](?P<dot4>dot)[-_](?=[A-Za-z])"
    r"|(?<=[A-Za-z0-9-])\s{1,3}(?P<dot5>\.)\s{1,3}(?=(?-i:[a-z0-9]))"
)
#: Matches in every text that _SIGN matches in, and costs less.
_SIGN_HINT = re.compile(
    r"(?i)[\[({<]|&#|&commat|&period|%40|\s@|@\s|\s\.\s|[-_]dot[-_]"
    r"|\s(?:dot|punkt|punto|point)\s|\s(?:at|arobase|arroba)\s{1,3}[a-z0-9-]{1,64}\."
)
#: Words before a bare "at" that make it a preposition, not a sign.
BEFORE_AT = frozenset("is was are were be been am me us it him her them you look looking available hosted located found and or visit website site page online".split())


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs so that plain prose costs nothing."""
    found: list[tuple[int, int]] = []
    if "@" not in text:
        return found
    free = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > free and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octet(part: str) -> bool:
    """Whether the number, however long, is 255 at most."""
    value = part.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    ips = [m.span() for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


@dataclass
class Rewritten:
    """A rewritten text and its segments: (place here, place before, length before, rewritten or copied)."""

    text: str
    at: list[int]
    segments: list[tuple[int, int, int, bool]]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span before rewriting, and whether it covers anything rewritten."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        (here, before, _, new), last = self.segments[i], self.segments[j]
        first = before if new else before + start - here
        stop = last[1] + last[2] if last[3] else last[1] + end - last[0]
        return first, stop, any(s[3] for s in self.segments[i : j + 1])


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> Rewritten:
    """``text`` with ascending, disjoint (start, end, replacement) applied."""
    out: list[str] = []
    segments: list[tuple[int, int, int, bool]] = []
    here = done = 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        for piece, before, length, is_new in ((text[done:start], done, start - done, False), (new, start, end - start, True)):
            if piece:
                segments.append((here, before, length, is_new))
                out.append(piece)
                here += len(piece)
        done = end
    return Rewritten("".join(out), [s[0] for s in segments], segments)


def undo_lookalikes(text: str) -> list[tuple[int, int, str]]:
    def plain(c: str) -> str:
        if c in INVISIBLE:
            return ""
        if c in LOOKALIKES:
            return LOOKALIKES[c]
        return str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else chr(ord(c) - 0xFEE0)

    return [(m.start(), m.end(), plain(m[0])) for m in _ODD.finditer(text)]


def undo_spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digits and digit words, of any length and with a word in them, as digits in a row."""
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match[str]] = []
    for m in itertools.chain(_DIGIT.finditer(text), [None]):
        if run and (m is None or not _BETWEEN.fullmatch(text, run[-1].end(), m.start())):
            if not all(x[0].isdecimal() for x in run):
                edits += _joined(text, run)
            elif (plus := _plus(text, run[0].start())) and plus[0] != "+":  # spelled before written digits
                edits.append((plus.start(), run[0].start(), "+"))
            run = []
        if m is not None:
            run.append(m)
    return edits


def _plus(text: str, at: int) -> re.Match[str] | None:
    """A plus, sign or word, just before ``at``."""
    return _PLUS.search(text, max(0, at - 8), at)


def _joined(text: str, run: list[re.Match[str]]) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    at = run[0].start()
    if plus := _plus(text, at):
        edits.append((plus.start(), at, "+"))
    new = [DIGIT_WORDS.get(m[0].lower(), m[0]) for m in run]
    octets = sum(map(len, new)) <= 12  # then single dots may be those of an IP
    for m, digits in zip(run, new, strict=True):
        if at < m.start() and not (octets and text[at : m.start()] == "."):
            edits.append((at, m.start(), ""))
        if digits != m[0]:
            edits.append((m.start(), m.end(), digits))
        at = m.end()
    return edits


def undo_letter_digits(text: str) -> list[tuple[int, int, str]]:
    """O, I and l between digits, as the digits they are drawn like."""
    return [
        (m.start() + i, m.start() + i + 1, "0" if c == "O" else "1") for m in _LEET.finditer(text) for i, c in enumerate(m[0]) if c in "OIl"
    ]


def undo_signs(text: str) -> list[tuple[int, int, str]]:
    return [
        (m.start(), m.end(), "@" if m.lastgroup.startswith("at") else ".")
        for m in _SIGN.finditer(text)
        if m.lastgroup != "at3" or text[max(0, m.start() - 64) : m.start()].split()[-1].lower() not in BEFORE_AT
    ]


def may_spell(text: str) -> bool:
    """Whether any digit word, or a plus in letters, is there."""
    return _SPELLED.search(text.lower()) is not None


def may_sign(text: str) -> bool:
    """Whether anything that could stand for an at sign or a dot is there at all."""
    return _SIGN_HINT.search(text) is not None


def disguised_spans(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of source characters that only show once disguises are undone."""
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    layers: list[Rewritten] = []
    now = text
    steps = (
        (_ODD.search, undo_lookalikes),
        (_LEET_HINT.search, undo_letter_digits),
        (may_spell, undo_spelled_digits),
        (may_sign, undo_signs),
    )
    for hint, undo in steps:
        if hint(now) and (edits := undo(now)):
            layers.append(rewrite(now, edits))
            now = layers[-1].text
    if not layers:
        return added
    for kind, spans in plain_spans(now).items():
        taken = sorted(plain[kind])
        for start, end in spans:
            new = False
            for layer in reversed(layers):
                start, end, hit = layer.back(start, end)
                new |= hit
            at = bisect.bisect(taken, (start, end))
            if new and (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                added[kind].append((start, end))
                taken.insert(at, (start, end))
    return added


def spans_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, counts and digest of the base spans, all spans as text, and how many the disguises hid."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for text in batch.column("body"):
                text = text.as_py()
                plain = plain_spans(text)
                more = disguised_spans(text, plain)
                digest = hashlib.sha256(spans_text(plain).encode()).hexdigest()
                every = spans_text({k: plain[k] + more[k] for k in KINDS})
                out.append((*(len(plain[k]) for k in KINDS), digest, every, sum(map(len, more.values()))))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            arrays = [batch.column("id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_disguised", T.LongType()),
        ]
    )
    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")), search, schema)
