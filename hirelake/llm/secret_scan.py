"""Secrets, found by fixed patterns and by a linear-chain conditional random field.

Patterns find assignments, access keys and long hexadecimal runs.  The random field
tags every token of a text as begin, inside or outside of a secret, from the token's
shape, the words and signs beside it and figures of the whole file, and finds what
has no pattern: other key formats, other names, values behind other signs.

It is trained at each run on a sample of the corpus: windows of at most SAMPLE_DOCS
documents of at most SAMPLE_CHARS characters (least digests of distinct texts), labelled
by the patterns, and copies of them into which made-up secrets, and things that look
like secrets and are none, are written.  Prediction reads whole texts.

Decoding is Viterbi's, exactly: a token whose score as outside leads by more than
transitions could ever make good is outside in every best path, so the best path
is sought between such tokens only, for all stretches of a batch side by side.

Defined results: a null text is the empty text and has no spans; spans are in code
points, end exclusive; spans of the random field are named ``crf``, have eight characters
or more and meet no pattern's span; repeated rows are searched alike; a table without usable
sample rows trains on made-up lines alone; an empty table gives an empty result;
further columns are ignored or, with ``keep``, passed through.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm.common import slices
from hirelake.llm.registry import query, table

KINDS = ("assign", "access", "hex")
SAMPLE_DOCS = 1200
SAMPLE_CHARS = 20_000
# Characters of a training window, and its tokens, over which it is left out.
WINDOW = 240
WINDOW_TOKENS = 120
# Characters that are read at a time.
PIECE = 1 << 20
# Tokens that are scored at a time.
BLOCK = 1 << 17
LEAST = 8

Span = tuple[int, int]

_assign = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
).finditer
_access = re.compile(r"AKIA[A-Z0-9]+").finditer
_hex = re.compile(r"[0-9a-f]{32,}").finditer


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the patterns; a match that is too short is dropped."""
    return {
        "assign": [m.span() for m in _assign(text) if m.end(2) - m.start(2) >= 8],
        "access": [m.span() for m in _access(text) if m.end() - m.start() >= 16],
        # A run of 32 or more is found whole, as a shorter run never starts within one.
        "hex": [m.span() for m in _hex(text)],
    }


def values(text: str) -> list[Span]:
    """What the patterns take for the secret itself, in order, apart."""
    found = [m.span(2) for m in _assign(text) if m.end(2) - m.start(2) >= 8]
    found += [m.span() for m in _access(text) if m.end() - m.start() >= 16]
    found += [m.span() for m in _hex(text)]
    out: list[Span] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


# ---- tokens and their features ----

SPACE, LOWER, UPPER, DIGIT, SIGN, OTHER = range(6)
_CLASS = np.full(129, SIGN, np.uint8)
_CLASS[:33] = SPACE
_CLASS[128] = OTHER
for _first, _last, _name in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
    _CLASS[ord(_first) : ord(_last) + 1] = _name
_HEX = np.zeros(129, bool)
_HEX[[ord(c) for c in string.hexdigits]] = True
_VOWEL = np.zeros(129, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_VOWEL[128] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))

WORDS = 1 << 14
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 40, 64])
_CHANGES = np.array([1, 2, 3, 5, 9])
KIND_COUNT = 16 + 128
TEMPLATES = {
    "letters": 17 * 12,
    "changes": 6 * 12,
    "hex": 4 * 12,
    "vowels": 5 * 12,
    "sign": 128 * 4,
    "word": WORDS + 1,
    "word_before": WORDS + 1,
    "word_behind": WORDS + 1,
    "second_before": WORDS + 1,
    "beside": KIND_COUNT * KIND_COUNT,
    "file": 16 * 17,
}
_OFFSETS = np.cumsum([0, *TEMPLATES.values()])
FEATURES = int(_OFFSETS[-1])


@dataclass
class Tokens:
    """Tokens of several texts: runs of letters and digits, or of one sign."""

    start: np.ndarray  # in the joined text
    end: np.ndarray
    text: np.ndarray  # number of the text
    letters: np.ndarray  # which of lower, upper, digit, other occur; 16 for a sign
    length: np.ndarray
    changes: np.ndarray
    hexadecimal: np.ndarray
    vowels: np.ndarray
    sign: np.ndarray
    word: np.ndarray
    file: np.ndarray


def _lex(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of a piece that starts and ends at white space or an end of the text."""
    low = np.minimum(codes, 128)
    kind = _CLASS[low]
    filled, sign = kind != SPACE, kind == SIGN
    starts = filled.copy()
    starts[1:] &= (kind[:-1] == SPACE) | (sign[1:] != sign[:-1]) | (sign[1:] & (codes[1:] != codes[:-1]))
    ends = filled.copy()
    ends[:-1] &= ~filled[1:] | starts[1:]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(start):
        none = np.empty(0, np.int64)
        names = ("start", "end", "letters", "length", "changes", "hexadecimal", "vowels", "sign", "word", "digits")
        return dict.fromkeys(names, none)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, start, dtype=np.int32)

    size = end - start
    counts = [count(kind == k) for k in (LOWER, UPPER, DIGIT, OTHER)]
    is_sign = sign[start]
    letters = sum((c > 0) << i for i, c in enumerate(counts))
    changed = np.zeros(len(codes), bool)
    changed[1:] = (kind[1:] != kind[:-1]) & filled[1:] & ~starts[1:]
    not_hex = count(filled & ~_HEX[low]) > 0
    alphabetic = size - counts[2]
    hexadecimal = np.where(not_hex, 0, np.where(alphabetic == 0, 1, np.where(counts[2] == 0, 2, 3)))
    place = np.arange(len(codes)) - start[np.maximum(np.cumsum(starts) - 1, 0)]
    folded = codes.astype(np.uint64) + np.where(kind == UPPER, 33, 1).astype(np.uint64)
    folded *= _POWERS[np.clip(place, 0, 63)]
    folded[~filled] = 0
    word = (np.add.reduceat(folded, start) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)
    return {
        "start": start,
        "end": end,
        "letters": np.where(is_sign, 16, letters),
        "length": np.searchsorted(_LENGTHS, size, "right"),
        "changes": np.searchsorted(_CHANGES, count(changed), "right"),
        "hexadecimal": hexadecimal,
        "vowels": np.minimum(count(_VOWEL[low]) * 5 // size, 4),
        "sign": np.where(is_sign, low[start], 0),
        # Long tokens are known by their shape alone.
        "word": np.where(is_sign | (size > 24), 0, 1 + word.astype(np.int64) % WORDS),
        "digits": counts[2],
    }


def tokens_of(texts: list[str]) -> Tokens:
    """Tokens of the texts as they stand joined by line ends."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    parts, at = [], 0
    while at < len(codes):
        # Pieces end behind white space; memory is bounded but for a longer word.
        stop = at + PIECE
        if stop < len(codes):
            gaps = codes[stop:] <= 32
            stop += int(gaps.argmax()) + 1 if gaps.any() else len(codes) - stop
        part = _lex(codes[at:stop])
        part["start"], part["end"] = part["start"] + at, part["end"] + at
        parts.append({k: v if k in ("start", "end") else v.astype(np.int32) for k, v in part.items()})
        at = min(stop, len(codes))
    names = parts[0] if parts else _lex(codes)
    found = {name: np.concatenate([p[name] for p in parts]) if parts else names[name] for name in names}
    text = np.searchsorted(begins, found["start"], "right") - 1
    # Figures of a file: its shares of digits and of signs, in four steps each.
    size = np.maximum(np.bincount(text, found["end"] - found["start"], len(texts)), 1)
    digits = np.bincount(text, found.pop("digits"), len(texts)) / size
    signs = np.bincount(text, np.where(found["sign"] > 0, found["end"] - found["start"], 0), len(texts)) / size
    file = np.searchsorted([0.005, 0.03, 0.15], digits) * 4 + np.searchsorted([0.03, 0.08, 0.2], signs)
    return Tokens(text=text, file=file[text], **found)


def _beside(tokens: Tokens) -> dict[str, np.ndarray]:
    """For each token the words and the kinds of tokens beside it, 0 beyond its text."""
    count = len(tokens.start)
    at = np.arange(count)
    is_word = tokens.sign == 0

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(count, np.int64)
        if by > 0:
            out[by:] = np.where(tokens.text[by:] == tokens.text[:-by], values[:-by], 0)
        else:
            out[:by] = np.where(tokens.text[:by] == tokens.text[-by:], values[-by:], 0)
        return out

    def taken(places: np.ndarray, reach: int) -> np.ndarray:
        safe = np.clip(places, 0, max(count - 1, 0))
        good = (places >= 0) & (places < count) & (np.abs(places - at) <= reach)
        return np.where(good & (tokens.text[safe] == tokens.text), tokens.word[safe], 0)

    # The nearest words, signs skipped, at most five tokens away.
    last = np.maximum.accumulate(np.where(is_word, at, -1))
    before = np.concatenate([[-1], last[:-1]])[:count]
    second = np.where(before >= 1, np.concatenate([[-1], last])[np.maximum(before, 0)], -1)
    following = np.minimum.accumulate(np.where(is_word, at, count)[::-1])[::-1]
    behind = np.concatenate([following[1:], [count]])[:count]
    kind = np.where(tokens.sign > 0, 16 + tokens.sign, tokens.letters)
    open_before = np.concatenate([[True], tokens.start[1:] > tokens.end[:-1]])[:count]
    open_behind = np.concatenate([open_before[1:], [True]])[:count]
    return {
        "word_before": taken(before, 5),
        "word_behind": taken(behind, 5),
        "second_before": taken(second, 9),
        "beside": shifted(kind, 1) * KIND_COUNT + shifted(kind, -1),
        "open": open_before * 2 + open_behind,
    }


def features(tokens: Tokens) -> list[np.ndarray]:
    """Per template the row of the weights for each token."""
    near = _beside(tokens)
    own = {
        "letters": tokens.letters * 12 + tokens.length,
        "changes": tokens.changes * 12 + tokens.length,
        "hex": tokens.hexadecimal * 12 + tokens.length,
        "vowels": tokens.vowels * 12 + tokens.length,
        "sign": tokens.sign * 4 + near["open"],
        "word": tokens.word,
        "word_before": near["word_before"],
        "word_behind": near["word_behind"],
        "second_before": near["second_before"],
        "beside": near["beside"],
        "file": tokens.file * 17 + tokens.letters,
    }
    return [own[name] + offset for name, offset in zip(TEMPLATES, _OFFSETS, strict=False)]


# ---- the random field ----

OUTSIDE, BEGIN, INSIDE = range(3)


@dataclass(frozen=True)
class Field:
    """Weights by feature and tag, and of one tag following another; before and
    behind a text stands an outside tag."""

    weights: np.ndarray  # (FEATURES, 3)
    follow: np.ndarray  # (3, 3), from and to

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        count = len(rows[0])
        out = np.empty((count, 3))
        for at in range(0, count, BLOCK):
            out[at : at + BLOCK] = sum(self.weights[r[at : at + BLOCK]] for r in rows)
        return out

    def slack(self) -> float:
        """The most that transitions can gain from a tag that is not outside."""
        t = self.follow
        return max(
            t[a, y] + t[y, b] - t[a, OUTSIDE] - t[OUTSIDE, b] for a in range(3) for b in range(3) for y in (BEGIN, INSIDE)
        )

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best tags of each text; among equal paths, any one."""
        tags = np.zeros(len(scores), np.int8)
        unsure = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= max(self.slack(), 0.0) + 1e-6
        places = np.flatnonzero(unsure)
        if not len(places):
            return tags
        first = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(text[places]) > 0)])
        begins = np.flatnonzero(first)
        size = np.diff(np.concatenate([begins, [len(places)]]))
        order = np.argsort(-size, kind="stable")
        begins, size = begins[order], size[order]
        own = scores[places]
        back = np.zeros((len(places), 3), np.int8)
        best = self.follow[OUTSIDE] + own[begins]
        # Stretches in falling order of length, so those still running come first.
        running = [int(n) for n in np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")]
        for step in range(1, len(running)):
            n = running[step]
            ways = best[:n, :, None] + self.follow
            back[begins[:n] + step] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + own[begins[:n] + step]
        now = (best + self.follow[:, OUTSIDE]).argmax(axis=1)
        for step in range(len(running) - 1, -1, -1):
            n = running[step]
            at = begins[:n] + step
            tags[places[at]] = now[:n]
            now[:n] = back[at, now[:n]]
        return tags

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Secrets of each text by the best tags."""
        tokens = tokens_of(texts)
        out: list[list[Span]] = [[] for _ in texts]
        if not len(tokens.start):
            return out
        tags = self.decode(self.scores(features(tokens)), tokens.text)
        held = np.flatnonzero(tags)
        if not len(held):
            return out
        fresh = (tags[held] == BEGIN) | np.concatenate([[True], (np.diff(held) > 1) | (np.diff(tokens.text[held]) > 0)])
        begins = np.flatnonzero(fresh)
        lasts = np.concatenate([begins[1:], [len(held)]]) - 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for lo, hi in zip(held[begins].tolist(), held[lasts].tolist(), strict=True):
            number = int(tokens.text[lo])
            base = int(offsets[number])
            out[number].append((int(tokens.start[lo]) - base, int(tokens.end[hi]) - base))
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(samples: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all samples at once."""
    tokens = tokens_of([text for text, _ in samples])
    short = np.bincount(tokens.text, minlength=len(samples)) <= WINDOW_TOKENS
    if not short.all():
        samples = [sample for sample, fits in zip(samples, short, strict=True) if fits]
        tokens = tokens_of([text for text, _ in samples])
    offsets = np.cumsum([0, *(len(t) + 1 for t, _ in samples)])
    gold = np.zeros(len(tokens.start), np.int64)
    for number, (_, found) in enumerate(samples):
        for lo, hi in found:
            a, b = np.searchsorted(tokens.start, [offsets[number] + lo, offsets[number] + hi])
            if a < b:
                gold[a], gold[a + 1 : b] = BEGIN, INSIDE
    rows = np.stack(features(tokens))
    counts = np.bincount(tokens.text, minlength=len(samples))
    width = int(counts.max(initial=1))
    starts = np.cumsum(counts) - counts
    # Samples as lines of a table of equal width; what is beyond a sample is outside for sure.
    place = tokens.text * width + np.arange(len(gold)) - starts[tokens.text]
    weights, follow = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    seen = np.zeros((FEATURES, 3))
    for r in rows:
        for tag in range(3):
            seen[:, tag] += np.bincount(r[gold == tag], minlength=FEATURES)
    padded = np.zeros(len(samples) * width, np.int64)
    padded[place] = gold
    padded = np.pad(padded.reshape(-1, width), ((0, 0), (1, 1)))
    seen_follow = np.zeros((3, 3))
    np.add.at(seen_follow, (padded[:, :-1].ravel(), padded[:, 1:].ravel()), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))]
    scale = 1.0 / max(len(samples), 1)
    for step in range(1, rounds + 1):
        table_ = np.full((len(samples) * width, 3), [0.0, -50.0, -50.0])
        table_[place] = sum(weights[r] for r in rows)
        own = table_.reshape(len(samples), width, 3)
        forward, backward = np.empty_like(own), np.empty_like(own)
        forward[:, 0] = follow[OUTSIDE] + own[:, 0]
        for t in range(1, width):
            forward[:, t] = own[:, t] + _log_sum(forward[:, t - 1, :, None] + follow, 1)
        backward[:, -1] = follow[:, OUTSIDE]
        for t in range(width - 2, -1, -1):
            backward[:, t] = _log_sum(follow + (own[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        whole = _log_sum(forward[:, -1] + follow[:, OUTSIDE], 1)
        share = np.exp(forward + backward - whole[:, None, None]).reshape(-1, 3)[place]
        pairs = forward[:, :-1, :, None] + follow + (own + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected_follow = np.exp(pairs).sum(axis=(0, 1))
        expected_follow[OUTSIDE] += np.exp(forward[:, 0] + backward[:, 0] - whole[:, None]).sum(axis=0)
        expected_follow[:, OUTSIDE] += np.exp(forward[:, -1] + backward[:, -1] - whole[:, None]).sum(axis=0)
        expected = np.zeros((FEATURES, 3))
        for r in rows:
            for tag in range(3):
                expected[:, tag] += np.bincount(r, share[:, tag], FEATURES)
        for value, grad, mean, square in (
            (weights, (expected - seen) * scale + decay * weights, moments[0], moments[1]),
            (follow, (expected_follow - seen_follow) * scale + decay * follow, moments[2], moments[3]),
        ):
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad * grad
            value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return Field(weights, follow)


# ---- training samples ----

# Names that stand before secrets, and before other things as well.
NAMES = (
    "password", "passwd", "pwd", "passphrase", "secret", "client_secret", "token", "access_token", "auth_token", "api_key",
    "apikey", "api-key", "private_key", "access_key", "auth", "authorization", "bearer", "credential", "credentials", "key",
)
SIGNS = (" = ", "=", ": ", ":", " => ", ' = "', '="', '": "', ": '", " is ", " ", " := ", " -> ", "|")
# Openings of published key formats.
OPENINGS = ("sk_live_", "sk-", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AIza", "SG.", "ya29.", "eyJ", "npm_", "hf_", "AKIA")
_LETTERS = string.ascii_letters + string.digits


def _made_up(rng: random.Random) -> str:
    """A value that looks drawn at random."""
    way = rng.randrange(7)
    if way == 0:
        return "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 24, 32, 40, 64])))
    if way == 1:
        return "".join(rng.choices(_LETTERS, k=rng.randint(12, 48)))
    if way == 2:
        return "".join(rng.choices(_LETTERS + "+/", k=rng.randint(20, 60))) + "=" * rng.randrange(3)
    if way == 3:
        return rng.choice(OPENINGS) + "".join(rng.choices(_LETTERS, k=rng.randint(16, 40)))
    if way == 4:
        return "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))
    if way == 5:
        return ".".join("".join(rng.choices(_LETTERS + "-_", k=rng.randint(12, 30))) for _ in range(3))
    return "".join(rng.choices(_LETTERS + "!@#$%^&*", k=rng.randint(10, 20)))


def _harmless(rng: random.Random, words: list[str]) -> str:
    """What looks like a secret, or stands where one might, and is none."""
    way = rng.randrange(12)
    word = rng.choice(words)
    if way == 0:
        return f"{rng.choice(NAMES)}{rng.choice(SIGNS)}{word}"
    if way == 1:
        return "".join(rng.choices(string.digits, k=rng.randint(3, 19)))
    if way == 2:
        return f"https://{word}.example.org/{rng.choice(words)}/{rng.choice(words)}?id={rng.randrange(100000)}"
    if way == 3:
        return f"{word}.{rng.choice(words)}{rng.randrange(100)}@{rng.choice(words)}.example.com"
    if way == 4:
        return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randrange(24):02}:{rng.randrange(60):02}:00Z"
    if way == 5:
        return "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(2, 5)))
    if way == 6:
        return "_".join(rng.choices(words, k=rng.randint(2, 5)))
    if way == 7:
        return "".join(rng.choices(words, k=rng.randint(2, 6)))
    if way == 8:
        return f"/{'/'.join(rng.choices(words, k=3))}.{rng.choice(['txt', 'py', 'html'])}"
    if way == 9:
        return f"+{rng.randrange(1, 99)} ({rng.randrange(1000)}) {rng.randrange(1000)}-{rng.randrange(10000):04}"
    if way == 10:
        return f"v{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}-{rng.choice(['rc1', 'beta', word])}"
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def samples_of(texts: list[str]) -> list[tuple[str, list[Span]]]:
    """Labelled windows of the texts, plain and with things written into them."""
    rng = random.Random(20)
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]{2,14}", t)[:200]}) or ["value", "name", "the", "example", "of"]
    windows = []
    for text in texts:
        found = values(text)
        middle = rng.choice(found)[0] if found else rng.randrange(len(text) + 1)
        lo = max(0, middle - rng.randrange(WINDOW))
        windows.append(text[lo : lo + WINDOW])
    # Without texts, and beside them, lines of words alone.
    windows += [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    out = []
    for window in windows:
        out.append((window, values(window)))
        cut = window.find(" ", rng.randrange(len(window) + 1)) + 1
        head, tail = window[:cut], window[cut:]
        tail = tail if not tail or rng.random() < 0.5 else " " + tail
        if rng.random() < 0.5:
            name = rng.choice(NAMES) if rng.random() < 0.8 else rng.choice(words)
            name = rng.choice([name, name.upper(), name.capitalize()])
            secret = _made_up(rng)
            opening = f"{name}{rng.choice(SIGNS)}" if rng.random() < 0.85 else rng.choice(["", '"', "("])
            at = len(head) + len(opening)
            closing = '"' if opening.endswith('"') else "'" if opening.endswith("'") else ""
            text = head + opening + secret + closing + (tail if tail.startswith(" ") or not tail else " " + tail)
            out.append((text, sorted({s for s in values(text) if s[1] <= at or s[0] >= at + len(secret)} | {(at, at + len(secret))})))
        else:
            text = f"{head}{_harmless(rng, words)} {tail}"
            out.append((text, values(text)))
    return out


def fit(docs: DataFrame, text: str = "text") -> Field:
    """A random field for the corpus, from at most SAMPLE_DOCS of its texts."""
    plain = docs.select(F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    marked = plain.withColumn("digest", F.xxhash64("text"))
    least = marked.select("digest").distinct().orderBy("digest").limit(SAMPLE_DOCS)
    chosen = marked.join(F.broadcast(least), "digest").groupBy("digest").agg(F.min("text").alias("text"))
    return train(samples_of([r.text for r in sorted(chosen.collect())]))


def search(texts: list[str | None], field: Field) -> list[tuple[dict[str, list[Span]], list[Span]]]:
    """Per text its patterns' spans by kind, and those the random field adds."""
    plain = [t or "" for t in texts]
    out = []
    for text, found in zip(plain, field.spans(plain), strict=True):
        base = base_spans(text)
        taken, at, added = sorted(s for spans in base.values() for s in spans), 0, []
        reach = 0
        for lo, hi in found:
            while at < len(taken) and taken[at][0] < hi:
                reach = max(reach, taken[at][1])
                at += 1
            if hi - lo >= LEAST and reach <= lo:
                added.append((lo, hi))
        out.append((base, added))
    return out


def listed(found: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by start, then in the order of the kinds."""
    rows = sorted((lo, i, hi, kind) for i, (kind, spans) in enumerate(found.items()) for lo, hi in spans)
    return ",".join(f"{kind}:{lo}:{hi}" for lo, _, hi, kind in rows)


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """Columns ``keep``, the patterns' spans counted by kind, the digest of their
    list, all spans as a list, and the number of those the random field adds."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))
    schema = docs.select(*keep).schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = search(batch.column(len(keep)).to_pylist(), sent.value)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS]
            columns += [
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([listed(base | {"crf": added}) for base, added in found], pa.string()),
                pa.array([len(added) for _, added in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


@query("op12_secrets")
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
