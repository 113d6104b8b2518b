"""Personal data, found through disguises.

Plain identifiers are found in the text as it is.  Then transducers rewrite a
text into the one it stands for: look-alike characters become ASCII and
invisible ones vanish, spelled digits become digits, "at" and "dot" in their
disguises become @ and full stops.  Spoken without brackets, "dot" counts
between four numbers or more, in a host and left of an "at" before such a host;
fewer than seven spelled digits count only with three dots between them.  Each rewritten character knows the part of
the source it came from, so that an identifier found after rewriting is
reported where it stands in the source.

Defined results: a null text is the empty text and has no spans; spans are in
code points, end exclusive; a span found after rewriting is left out where it
contains nothing rewritten or meets a plain one of its kind; repeated rows are
searched alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hirelake.llm.common import slices
from hirelake.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_plus = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")
_local = re.compile(r"[A-Za-z0-9._%+-]").match
_no_digit = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """The local part is sought backwards from each @, so that long words cost
    no more than they are long."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _not_local.match(text, start - 1):
            start -= 1
        if start < at and (match := _domain(text, at + 1)):
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[Span]:
    """Runs of dotted numbers, four at a time."""
    found = []
    for run in _dotted(text):
        if run[0].count(".") < 3:
            continue
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for run in _digits(text):
        if run.end() - run.start() >= 13:
            digits = _no_digit.sub("", run[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(run.span())
    return found


def phones(text: str) -> list[Span]:
    return [run.span() for run in _plus(text) if 9 <= len(_no_digit.sub("", run[0])) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


# Look-alikes of ASCII letters and signs, in pairs.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ı": "i", "ℓ": "l",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".", "\uff61": ".",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
    "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "",
}
# Full-width forms stand 0xFEE0 above ASCII; decimal digits of all scripts have a value.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
LOOKALIKES |= {
    chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"
}
_lookalike = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")

NUMERALS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
            "seven": "7", "eight": "8", "nine": "9"}
_numeral = "|".join(NUMERALS)
# Seven numerals or more in a row, some of them spelled.
_spelled = re.compile(
    rf"\b(?:plus[\s,-]+)?(?:{_numeral}|[0-9])(?:[\s,-]*(?:\s(?:dot|point)\s+)?\b(?:{_numeral}|[0-9])\b){{6,}}", re.IGNORECASE
)
_spelled_hint = re.compile(rf"\b(?:{_numeral})[\s,-]+(?:(?:dot|point)\s+)?(?:{_numeral}|[0-9])\b", re.IGNORECASE)
_spelled_token = re.compile(rf"plus|dot|point|{_numeral}|[0-9]", re.IGNORECASE)
_spoken = NUMERALS | {"plus": "+", "dot": ".", "point": "."}

# Four numbers or more with spoken dots between them, written or spelled.
_octet = rf"(?:[0-9]{{1,3}}|(?:{_numeral})(?:[\s,-]++(?:{_numeral})\b){{0,2}})\b"
_spoken_ip = re.compile(rf"\b{_octet}(?:(?:\s++(?:dot|point)\s++|\.){_octet}){{3,}}", re.IGNORECASE)
_spoken_part = re.compile(rf"\s+(?P<dot>dot|point)\s+|(?P<numeral>{_numeral})(?:[\s,-]+(?=(?:{_numeral})\b))?", re.IGNORECASE)

# Found by its bracket; the blanks before it are taken by hand, so that a run of blanks is read once.
_sign = r"[\[({<][ \t]*(?:%s)[ \t]*[\])}>][ \t]*"
_bracketed = re.compile(rf"(?P<at>{_sign % 'at|@'})|(?P<dot>{_sign % r'dot|punkt|punto|point|\.'})", re.IGNORECASE)
# Without brackets, "at" counts only before a host whose dots are spelled too.
_name = r"[A-Za-z0-9-]+"
_spaced = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?={_name}(?:\.{_name}){{0,4}}[ \t]+dot[ \t]+(?!dot\b)[A-Za-z]{{2,}})", re.IGNORECASE)
_spaced_dot = re.compile(rf"@{_name}(?:(?:[ \t]+dot[ \t]+|\.){_name})*", re.IGNORECASE)
_dot = re.compile(r"[ \t]+dot[ \t]+", re.IGNORECASE)


@dataclass
class Rewritten:
    """A text, and for each character the part of the source it stands for."""

    text: str
    start: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @staticmethod
    def of(source: str) -> Rewritten:
        at = np.arange(len(source))
        return Rewritten(source, at, at + 1, np.zeros(len(source), bool))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace parts (in order, apart); an empty replacement's source joins
        the character before."""
        if not edits:
            return self
        texts, starts, ends, changed, at = [], [], [], [], 0
        for lo, hi, new in edits:
            texts += [self.text[at:lo], new]
            starts += [self.start[at:lo], np.full(len(new), self.start[lo])]
            ends += [self.end[at:lo], np.full(len(new), self.end[hi - 1])]
            changed += [self.changed[at:lo], np.ones(len(new), bool)]
            at = hi
        texts.append(self.text[at:])
        return Rewritten(
            "".join(texts),
            np.concatenate([*starts, self.start[at:]]),
            np.concatenate([*ends, self.end[at:]]),
            np.concatenate([*changed, self.changed[at:]]),
        )


def plain_letters(text: Rewritten) -> Rewritten:
    edits = [(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _lookalike.finditer(text.text)]
    out = text.replace(edits)
    # Where an invisible character went, what follows counts as rewritten.
    if any(not new for _, _, new in edits) and len(out.text) > 1:
        out.changed[1:] |= out.start[1:] != out.end[:-1]
    return out


def plain_digits(text: Rewritten) -> Rewritten:
    edits = []
    for run in _spelled.finditer(text.text):
        tokens = list(_spelled_token.finditer(text.text, *run.span()))
        if all(t[0].isdigit() for t in tokens):
            continue
        for i, t in enumerate(tokens):
            # What separates two numerals goes with the first.
            stop = tokens[i + 1].start() if i + 1 < len(tokens) else t.end()
            edits.append((t.start(), stop, _spoken.get(t[0].lower(), t[0])))
    return text.replace(edits)


def plain_addresses(text: Rewritten) -> Rewritten:
    return text.replace(
        [
            (t.start(), t.end(), "." if t["dot"] else NUMERALS[t["numeral"].lower()])
            for run in _spoken_ip.finditer(text.text)
            if any(word in run[0].lower() for word in ("dot", "point"))
            for t in _spoken_part.finditer(text.text, *run.span())
        ]
    )


def _local_dots(text: Rewritten) -> list[tuple[int, int, str]]:
    """Spoken dots in the local part of each rewritten @, sought backwards."""
    edits, now, floor = [], text.text, 0

    def back(at: int, fits: Callable[[str], object]) -> int:
        while at > floor and fits(now[at - 1]):
            at -= 1
        return at

    at = now.find("@")
    while at >= 0:
        found: list[tuple[int, int, str]] = []
        word = back(at, _local) if text.changed[at] else at
        end = at
        while word < end:
            stop = back(word, " \t".__contains__)
            end = back(stop - 3, " \t".__contains__) if stop - 3 > floor and now[stop - 3 : stop].lower() == "dot" else stop
            if stop == word or end >= stop - 3:
                break
            dot, word = (end, word, "."), back(end, _local)
            if word < end and now[word:end].lower() != "dot":
                found.append(dot)
            else:
                break
        edits += reversed(found)
        floor = at + 1
        at = now.find("@", floor)
    return edits


def _bracketed_signs(now: str) -> list[tuple[int, int, str]]:
    edits, floor = [], 0
    for m in _bracketed.finditer(now):
        start = m.start()
        while start > floor and now[start - 1] in " \t":
            start -= 1
        edits.append((start, m.end(), "@" if m["at"] else "."))
        floor = m.end()
    return edits


def plain_signs(text: Rewritten) -> Rewritten:
    text = text.replace(_bracketed_signs(text.text))
    text = text.replace([(m.start(), m.end(), "@") for m in _spaced.finditer(text.text)])
    text = text.replace(_local_dots(text))
    return text.replace(
        [(d.start(), d.end(), ".") for m in _spaced_dot.finditer(text.text) for d in _dot.finditer(text.text, *m.span())]
    )


def rewrite(source: str) -> Rewritten | None:
    """The text that ``source`` stands for; None if nothing is disguised."""
    out = None
    if not source.isascii() and _lookalike.search(source):
        out = plain_letters(Rewritten.of(source))
    now = out.text if out else source
    if _spelled_hint.search(now):
        out = plain_digits(out or Rewritten.of(source))
    now = out.text if out else source
    low = now.lower()
    if ("dot" in low or "point" in low) and _spoken_ip.search(now):
        out = plain_addresses(out or Rewritten.of(source))
    now = out.text if out else source
    if _bracketed.search(now) or _spaced.search(now):
        out = plain_signs(out or Rewritten.of(source))
    return out


def spans(source: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans by kind, and those found only after rewriting."""
    source = source or ""
    base = {kind: find(source) for kind, find in FINDERS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if (seen := rewrite(source)) is not None:
        for kind, find in FINDERS.items():
            taken, at = base[kind], 0
            for lo, hi in find(seen.text):
                start, end = int(seen.start[lo]), int(seen.end[hi - 1])
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if seen.changed[lo:hi].any() and not (at < len(taken) and taken[at][0] < end):
                    added[kind].append((start, end))
    return base, added


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in sorted(found[kind]))


def find_personal_data(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, plain spans counted by kind, the digest of their list,
    all spans as a list, and the number of those found by rewriting."""
    schema = docs.select(*keep).schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS]
            columns += [
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([listed({k: base[k] + added[k] for k in KINDS}) for base, added in found], pa.string()),
                pa.array([sum(map(len, added.values())) for _, added in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
