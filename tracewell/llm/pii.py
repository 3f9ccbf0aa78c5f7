"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then segments what is left: a segment is up to LONGEST tokens of one type, scored as a
whole (how its digits are grouped, Luhn sum, octets, spelled-out or bracketed marks, what stands before and after), and a dynamic programme
chooses boundaries and types together. Only runs of chunks with a digit, an at sign or a spelled-out mark, and for the latter two the chunks
beside them, can hold an entity, so the programme runs on these islands alone, each as a whole; everything between them is outside with certainty.

The field is trained on a bounded, hash-chosen sample of islands labelled by the base patterns, on made-up entities in forms that the patterns
miss (addresses with spelled or bracketed marks, phone numbers without plus sign or country code, cards and octets with other
marks), and on numbers that are none: dates, versions, prices, tables, book numbers, ranges. One in FOLD of all of them is held back; the least
log-odds an added span needs is set on it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, materialise, to_python

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LONGEST = 14
#: The sample: documents looked at, islands taken from one, islands that come to the driver, islands trained on (as many without an entity), tokens in one.
SAMPLE_DOCS, PER_DOC, SAMPLE_ISLANDS, TRAIN_ISLANDS, TRAIN_TOKENS = 20_000, 10, 2000, 200, 32
#: Made-up islands with an entity, and as many without; one in FOLD of all islands is held back.
MADE, FOLD = 450, 5
EPOCHS, RATE, L2 = 70, 0.4, 1e-3
#: Tokens of an island whose features are held at a time.
PIECE = 512
#: Of the spans found on the held-back islands at most this share may be false; log-odds are tried up to MOST_MARGIN.
FALSE_SHARE, MOST_MARGIN = 0.01, 12.0
#: Chunks before and after an at sign or a spelled-out mark that its island takes in.
LEAD, TRAIL = 3, 2

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
NUMBER = re.compile("[0-9]+")
ODD = re.compile(r"[^\w\s().+@/:-]|_")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOT = re.compile(r"[0-9]|@|[\[({<]\s?(?:at|dot|\.)\s?[\])}>]|(?<=\s)dot(?=\s)|(?<=\s)at(?=\s+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b)", re.IGNORECASE)
#: A bare "at" before a host counts after a word with a mark or a digit inside, as names of mailboxes have.
AT, NAME_BEFORE = ("at", "AT", "At"), re.compile(r"[A-Za-z0-9](?:[._+-][A-Za-z0-9]|[0-9])[A-Za-z0-9._%+-]*\s{1,4}\Z")
AFTER = re.compile(rf"\S*(?:\s+\S+){{0,{TRAIL}}}")
CHUNK = re.compile(r"\S*")
OPENING = re.compile(r"(?:^|\s)([+(]\s{1,4})$")
BETWEEN = re.compile(r"\s*(?:[-+./()]\s+)?")
# Last labels of hosts.
HOST_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "eu", "ru", "cn", "jp", "br", "us")
HOST_END = re.compile(rf"(?:[.\s\])}}>])(?:{'|'.join(HOST_ENDS)})$", re.IGNORECASE)
TOKEN = re.compile(r"\s?[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]\s?|\s(?:at|dot)(?=\s)\s|\s+|[0-9]+|[^\W\d_]+|.", re.DOTALL | re.IGNORECASE)
OCTETS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
AT_MARK = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s+at\s+|\s*@\s*)"
DOT_MARK = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\.)"
SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+(?:{DOT_MARK}[A-Za-z0-9_%+-]+)*{AT_MARK}[A-Za-z0-9-]+(?:{DOT_MARK}[A-Za-z0-9-]+)+", re.IGNORECASE)
MARKED = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|\s(?:at|dot)\s", re.IGNORECASE)
SPACED_OCTETS = re.compile(rf"[0-9]{{1,3}}(?:(?:{DOT_MARK}|\s\.\s)[0-9]{{1,3}}){{3}}", re.IGNORECASE)
DATE = re.compile(r"(?:[12][0-9]{3}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][12][0-9]{3})\b")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches, but each at sign is looked at once, however long the runs before it are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (done := m.end())
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each kind, in code points; failing matches are dropped without a retry."""
    out: list[list[Span]] = [list(emails(text)) if "@" in text else [], [], [], []]
    if DIGIT.search(text):
        out[1] = [m.span() for m in NUMBERS.finditer(text) if m[1] and all(map(octet, m[0].split(".")))]
        out[2] = [m.span() for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


NAMES = [
    "bias", "address", "spelled address", "spelled address of a known host end", "marked", "octets", "octets ok", "spaced octets ok", "plus", "double zero", "bracket first", "bracket pair", "digit first", "digit last", "letters", "space", "wide space", "hyphen", "dot", "slash", "other mark",
    "colon", "at", "luhn", "luhn fails", "date", "3-3-4", "3-4", "fours", "one mark", "line break", *[f"digits {x}" for x in ("0", "1-6", "7", "8-9", "10-11", "12-15", "16-19", "20-")], *[f"before {x}" for x in ("edge", "space", "word", "mark")],
    *[f"after {x}" for x in ("edge", "space", "word", "mark")], "digit before", "digit after", "one group", "2-3 groups", "4-5 groups", "more groups",
]
FIRST_OF = {x: NAMES.index(x) for x in ("digits 0", "before edge", "after edge", "digit before", "one group")}


def side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def features(s: str, before: str, after: str) -> np.ndarray:
    """What a whole candidate segment looks like, and the two characters on each side of it."""
    groups = NUMBER.findall(s)
    digits = "".join(groups)
    n, sizes = len(digits), [len(g) for g in groups]
    kind = 0 if not n else 1 if n < 7 else 2 if n == 7 else 3 if n < 10 else 4 if n < 12 else 5 if n < 16 else 6 if n < 20 else 7
    four = bool(OCTETS.fullmatch(s))
    spaced = not four and len(groups) == 4 and bool(SPACED_OCTETS.fullmatch(s))
    small = (four or spaced) and all(map(octet, groups))
    sums = 12 <= n < 20 and luhn(digits)
    letters, at = any(map(str.isalpha, s)), "@" in s or bool(MARKED.search(s))
    spelled = at and letters and bool(SPELLED.fullmatch(s))
    x = np.zeros(len(NAMES), np.float32)
    x[: FIRST_OF["digits 0"]] = (
        1, bool(ADDRESS.fullmatch(s)), spelled, spelled and bool(HOST_END.search(s)), bool(MARKED.search(s)), four, four and small, spaced and small, s[0] == "+", s.startswith("00"), s[0] == "(", "(" in s and ")" in s, s[0].isdigit(), s[-1].isdigit(), letters, " " in s, "  " in s or "\t" in s, "-" in s, "." in s, "/" in s, bool(ODD.search(s)),
        ":" in s, "@" in s, sums, n >= 12 and not sums, bool(DATE.search(s)), sizes[-3:] == [3, 3, 4], sizes[-2:] == [3, 4], len(sizes) > 2 and set(sizes[:-1]) == {4}, len(set(NUMBER.sub("", s))) == 1, "\n" in s,
    )
    x[FIRST_OF["digits 0"] + kind] = x[FIRST_OF["before edge"] + side(before[-1:])] = x[FIRST_OF["after edge"] + side(after[:1])] = 1
    x[FIRST_OF["digit before"]], x[FIRST_OF["digit before"] + 1] = before[-2:].strip()[-1:].isdigit(), after[:2].strip()[:1].isdigit()
    x[FIRST_OF["one group"] + (0 if len(groups) < 2 else 1 if len(groups) < 4 else 2 if len(groups) < 6 else 3)] = 1
    return x


def islands(text: str) -> Iterator[Span]:
    """Runs of chunks that can hold an entity. Each character is passed over a bounded number of times, however long the runs."""
    at, start, stop, floor = 0, -1, -1, 0
    while m := HOT.search(text, at):
        if m[0] in AT and not NAME_BEFORE.search(text, max(0, m.start() - 80), m.start()):
            at = m.end()  # "look at example.org" is no address
            continue
        lo, lead = m.start(), 0 if m[0].isdigit() else LEAD
        for k in range(lead + 1):
            edge = lo
            while k and edge > floor and text[edge - 1].isspace():
                edge -= 1
            while edge > floor and not text[edge - 1].isspace():
                edge -= 1
            lo = edge
        while lo < m.start() and text[lo].isspace():
            lo += 1
        if not lead and (mark := OPENING.search(text, max(floor, lo - 8), lo)):
            lo = mark.start(1)
        hi = (AFTER if lead else CHUNK).match(text, m.end()).end()
        if start >= 0 and (lo <= stop or BETWEEN.fullmatch(text, stop, lo)):
            start, stop = min(start, lo), max(stop, hi)
        else:
            if start >= 0:
                yield start, stop
                floor = stop
            start, stop = max(lo, floor), hi
        at = CHUNK.match(text, m.end()).end()
    if start >= 0:
        yield start, stop


def tokens(island: str) -> list[int]:
    """Where tokens begin, and the end."""
    return [*(m.start() for m in TOKEN.finditer(island)), len(island)]


def segment_features(text: str, cuts: list[int], before: str, after: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """[end - 1 - first, length - 1, feature] of all candidate segments that end after token ``first`` and by token ``last``."""
    n = len(cuts) - 1
    last = n if last is None else last
    out = np.zeros((last - first, min(LONGEST, n), len(NAMES)), np.float32)
    for end in range(first + 1, last + 1):
        for length in range(1, min(LONGEST, end) + 1):
            a, b = cuts[end - length], cuts[end]
            if length > 1 and (text[a].isspace() or text[b - 1].isspace()):
                continue  # entities neither begin nor end with white space
            out[end - 1 - first, length - 1] = features(text[a:b], text[a - 2 : a] if a > 1 else (before + text[:a])[-2:], text[b : b + 2] if b + 1 < len(text) else (text[b:] + after)[:2])
    return out


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class SemiCrf:
    """Weights of segment types and of transitions between them. Outside segments are one token long."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(NAMES), OUTSIDE + 1))
        self.moves = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        self.margin = 0.0

    def scores(self, phi: np.ndarray) -> np.ndarray:
        real = phi[..., 0] != 0  # every candidate has the bias
        s = np.full((*phi.shape[:-1], OUTSIDE + 1), -np.inf)
        s[real] = phi[real] @ self.weights.astype(np.float32)
        s[..., 1:, OUTSIDE] = -np.inf
        return s

    def ahead(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all segmentations that end at a token with a segment of a type, the log of their summed scores; and the same with the move to the next type."""
        b, n, longest, kinds = s.shape
        ends, moved = np.full((b, n + 1, kinds), -np.inf), np.full((b, n + 1, kinds), -np.inf)
        ends[:, 0, OUTSIDE] = 0
        for end in range(n + 1):
            if end:
                k = min(longest, end)
                ends[:, end] = logsum(s[:, end - 1, :k] + moved[:, end - k : end][:, ::-1], 1)
            moved[:, end] = logsum(ends[:, end, :, None] + self.moves, 1)
        return ends, moved

    def expected(self, phi: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition function of each island, and the expected features and moves of all."""
        b, n, longest, _ = phi.shape
        s = self.scores(phi)
        ends, moved = self.ahead(s)
        total = logsum(ends[np.arange(b), size], 1)
        behind = np.full((b, n + 1, OUTSIDE + 1), -np.inf)  # of what follows a segment of this type that ends here
        share, moves = np.zeros_like(s), np.zeros_like(self.moves)
        with np.errstate(invalid="ignore"):
            for start in range(n, -1, -1):
                k = min(longest, n - start)
                here = np.full((b, OUTSIDE + 1), -np.inf)
                if k:
                    rest = np.stack([s[:, start + j, j] + behind[:, start + j + 1] for j in range(k)], 1)
                    step = logsum(rest, 1)
                    for j in range(k):
                        share[:, start + j, j] = np.nan_to_num(np.exp(moved[:, start] + rest[:, j] - total[:, None]))
                    moves += np.nan_to_num(np.exp(ends[:, start, :, None] + self.moves + step[:, None, :] - total[:, None, None])).sum(0)
                    here = logsum(self.moves[None] + step[:, None, :], 2)
                behind[:, start] = np.where((size == start)[:, None], 0.0, here)
        real = phi[..., 0] != 0
        return total, (phi[real].T @ share[real].astype(np.float32)).astype(np.float64), moves

    def fit(self, islands: list[tuple[np.ndarray, list[tuple[int, int, int]]]]) -> SemiCrf:
        """islands: segment features and the true segments (end, length, type). Maximises the conditional log-likelihood by AdaGrad; all islands are padded to one length and go through the recursions together."""
        if not islands:
            return self
        phi, size, true, true_moves = stacked(islands)
        push, push_moves = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(EPOCHS):
            _, want, want_moves = self.expected(phi, size)
            for w, g, push_ in ((self.weights, (true - want) / len(size) - L2 * self.weights, push), (self.moves, (true_moves - want_moves) / len(size) - L2 * self.moves, push_moves)):
                push_ += g * g
                w += RATE * g / np.sqrt(push_)
        return self

    def decode(self, parts: Iterable[np.ndarray], n: int) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: first token, end, type, and the log-odds against leaving those tokens outside. parts: segment features of all n tokens, some tokens at a time."""
        best, moved = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
        length, came = np.zeros((n + 1, OUTSIDE + 1), np.int16), np.zeros((n + 1, OUTSIDE + 1), np.int8)  # of the segment that ends here; the type before the one that starts here
        gain, alone = np.zeros((n + 1, OUTSIDE + 1)), np.zeros(n)
        kinds = np.arange(OUTSIDE + 1)
        best[0, OUTSIDE] = 0
        to = best[0][:, None] + self.moves
        moved[0], came[0] = to.max(0), to.argmax(0)
        end = 0
        for phi in parts:
            s = self.scores(phi)
            alone[end : end + len(s)] = s[:, 0, OUTSIDE]
            for row in s:
                end += 1
                k = min(LONGEST, end, len(row))
                score = row[:k] + moved[end - k : end][::-1]
                pick = score.argmax(0)
                best[end], gain[end], length[end] = score[pick, kinds], row[pick, kinds], pick + 1
                to = best[end][:, None] + self.moves
                moved[end], came[end] = to.max(0), to.argmax(0)
        found, end, kind = [], n, int(best[n].argmax())
        while end > 0:
            k = int(length[end, kind])
            last = int(came[end - k, kind])
            if kind != OUTSIDE:
                out = alone[end - k : end].sum() + self.moves[last, OUTSIDE] + (k - 1) * self.moves[OUTSIDE, OUTSIDE]
                found.append((end - k, end, kind, float(gain[end, kind] + self.moves[last, kind] - out)))
            end, kind = end - k, last
        return found[::-1]


def stacked(islands: list[tuple[np.ndarray, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all islands, padded; their sizes; features and moves of the true segments."""
    b, n = len(islands), max(len(phi) for phi, _ in islands)
    phi = np.zeros((b, n, min(LONGEST, n), len(NAMES)), np.float32)
    true, moves = np.zeros((len(NAMES), OUTSIDE + 1)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    for i, (x, gold) in enumerate(islands):
        phi[i, : x.shape[0], : x.shape[1]] = x
        last = OUTSIDE
        for end, length, kind in gold:
            true[:, kind] += x[end - 1, length - 1]
            moves[last, kind] += 1
            last = kind
    return phi, np.array([len(x) for x, _ in islands]), true, moves


def gold(cuts: list[int], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """Spans (start, end, type) as segments over tokens; None if they overlap, cut tokens or are too long."""
    at, out, done = {c: i for i, c in enumerate(cuts)}, [], 0
    for start, end, kind in sorted(spans):
        if start not in at or end not in at or at[start] < done or at[end] - at[start] > LONGEST:
            return None
        out += [(i + 1, 1, OUTSIDE) for i in range(done, at[start])]
        out.append((at[end], at[end] - at[start], kind))
        done = at[end]
    return out + [(i + 1, 1, OUTSIDE) for i in range(done, len(cuts) - 1)]


CONSONANTS, VOWELS = "bcdfghklmnprstvw", "aeiou"


def made_word(r: random.Random) -> str:
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randint(1, 3)))


def number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def made_entity(r: random.Random) -> tuple[str, int]:
    """An entity in a form that the patterns miss."""
    kind = r.randrange(len(KINDS))
    if KINDS[kind] == "email":
        name = r.choice([made_word(r), f"{made_word(r)}.{made_word(r)}", f"{made_word(r)}{r.randint(1, 99)}", f"{made_word(r)}.{r.randint(1, 99)}"])
        host = [f"{r.choice(['mail', made_word(r)])}{r.choice(['', str(r.randint(1, 9))])}"] + [made_word(r)] * r.randint(0, 1) + [r.choice(["com", "org", "net", "de", "fr", "io", "co"])]
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("(at)", " dot "), ("@", "[.]"), ("{at}", "{dot}"), (" AT ", " DOT ")])
        return name + at + dot.join(host), kind
    if KINDS[kind] == "ip":
        parts = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice(["[.]", "(.)", " . ", "[dot]", "(dot)", " dot "]).join(parts), kind
    if KINDS[kind] == "card":
        digits = number(r, 15)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return r.choice([".", "  ", "\t", "/", "_", " - ", ". "]).join(digits[i : i + 4] for i in range(0, 16, 4)), kind
    a, b, c = number(r, 3), number(r, 3), number(r, 4)
    code = r.choice(["1", "44", "49", "33"])
    form = r.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "({0}){1}-{2}", "({0})  {1}-{2}", "({0})\n{1}-{2}", "00{3} {0} {1} {2}", "00{3}-{0}-{1}-{2}", "{3} ({0}) {1}-{2}", "{3}-{0}-{1}-{2}", "({0}) {1} {2}", "({0}) {1}.{2}", "+ {3} {0} {1} {2}", "+{3}/{0}/{1}{2}", "{0}/{1}-{2}", "({0})\t{1}-{2}"])
    return form.format(a, b, c, code), kind


def made_number(r: random.Random) -> str:
    """What looks like an entity and is none."""
    y, m, d, h = r.randint(1950, 2030), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23)
    n = lambda k: number(r, k)
    forms = [
        f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{y}-{m:02d}-{d:02d} {h:02d}:{r.randint(0, 59):02d}", f"{y}-{m:02d}-{d:02d}T{h:02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"{y}-{y + r.randint(1, 9)}", f"{y}", f"{n(1)}", f"{n(2)}", f"{n(3)}", f"{n(6)}", f"{n(9)}", f"{n(13)}", f"{n(16)}",
        " ".join([n(1)] * r.randint(3, 12)), " ".join(n(r.randint(1, 3)) for _ in range(r.randint(3, 10))), "\n".join(n(r.randint(1, 5)) for _ in range(r.randint(2, 5))), "\t".join(n(r.randint(1, 4)) for _ in range(r.randint(2, 6))), ", ".join(n(r.randint(1, 4)) for _ in range(r.randint(2, 5))), "  ".join(n(4) for _ in range(r.randint(2, 3))),
        f"{n(1)}.{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}", f"{n(3)}.{n(2)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}", f"${n(3)}.{n(2)}", f"{n(2)}%", f"{n(2)} %", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"978-{n(10)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(2)}-{n(7)}", f"#{n(5)}", f"{n(4)}-{n(4)}", f"{n(2)}.{n(4)}, {n(1)}.{n(4)}", f"{h}:{r.randint(0, 59):02d}",
        f"pp. {n(2)}-{n(3)}", f"{n(3)} x {n(3)}", f"({n(1)})", f"({n(4)})", f"[{n(2)}]", f"{n(1)}/{n(2)}", f"{n(3)} {n(3)}", f"{n(1)} {n(3)} {n(3)}", f"@{made_word(r)}", f"{made_word(r)}{n(2)}", f"{made_word(r)}@{made_word(r)}", f"at {n(2)} {made_word(r)}", f"{made_word(r)} at the dot on {made_word(r)}", f"{made_word(r)} at {made_word(r)} dot {made_word(r)}", f"{made_word(r)} dot {made_word(r)}", f"{made_word(r)} at {made_word(r)} {n(3)}",
        f"{n(1)}.{n(1)}.{n(1)}-{n(2)}", f"{n(3)}.{n(3)}.{n(3)},{n(2)}", f"{n(4)} {n(4)}", f"{n(2)}/{n(4)}/{n(3)}", f"{n(8)}-{n(4)}-{n(4)}", f"{r.randint(0, 1 << 40):x}", f"({n(3)})", f"({n(3)}) {made_word(r)}", f"{n(3)}-{n(3)}", f"{n(3)}, {n(3)}, {n(4)}", f"{n(3)} + {n(3)} = {n(4)}",
    ]
    return r.choice(forms)


def made(r: random.Random, entity: bool) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text and its entity."""
    few = lambda: made_word(r) if r.random() < 0.95 else number(r, r.randint(1, 2))
    lead = " ".join(few() for _ in range(r.randint(0, 4))) + r.choice(["", ",", ":", ""])
    tail = r.choice(["", ".", ",", "", ""]) + "".join(" " + few() for _ in range(r.randint(0, 4)))
    s, kind = made_entity(r) if entity else (made_number(r), -1)
    start = len(lead) + 1 if lead else 0
    return (lead + " " if lead else "") + s + tail, [(start, start + len(s), kind)] if entity else []


def cut_out(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, str, str, list[tuple[int, int, int]]]]:
    """Islands of a text with the two characters on each side and the spans that lie within."""
    for a, b in islands(text):
        yield text[a:b], text[max(0, a - 2) : a], text[b : b + 2], [(x - a, y - a, k) for x, y, k in spans if a <= x and y <= b]


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> SemiCrf:
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    order = F.xxhash64(F.col(id_col), F.lit("pii"))
    sample = docs.where(F.col(text).isNotNull() & (F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))).select(order.alias("order"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            rows = []
            for order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans, taken = [(a, b, k) for k, found in enumerate(base_spans(text)) for a, b in found], 0
                for island, before, after, inside in cut_out(text, spans):
                    if len(island) < 400 and (inside or taken < PER_DOC):
                        taken += not inside
                        rows.append((order, island, before, after, [list(x) for x in inside][:8]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32()))))], ["order", "island", "before", "after", "spans"])

    found = to_python(sample).mapInArrow(run, "order long, island string, before string, after string, spans array<array<int>>")
    found = materialise(found, "islands")
    rows = [r for some in ("size(spans) > 0", "size(spans) = 0") for r in found.where(some).orderBy("order", "island").limit(SAMPLE_ISLANDS // 2).collect()]
    labelled, left = [], {True: TRAIN_ISLANDS, False: TRAIN_ISLANDS}
    for r in rows:
        if left[bool(r.spans)] > 0:
            left[bool(r.spans)] -= 1
            labelled.append((r.island, r.before, r.after, [tuple(x) for x in r.spans]))
    return trained(labelled)


def trained(labelled: list[tuple[str, str, str, list[tuple[int, int, int]]]], seed: int = 0) -> SemiCrf:
    """A field fitted to labelled islands and to made-up ones, with its margin set on those held back."""
    r = random.Random(seed)
    for i in range(2 * MADE):
        labelled = labelled + list(cut_out(*made(r, i % 2 == 0)))
    fit, held = [], []
    for i, (island, before, after, spans) in enumerate(labelled):
        cuts = tokens(island)
        true = gold(cuts, spans)
        if true is not None and len(cuts) <= TRAIN_TOKENS + 1:
            phi = segment_features(island, cuts, before, after)
            (held if i % FOLD == 0 else fit).append((phi, true))
    model = SemiCrf().fit(fit)
    odds = []
    for phi, true in held:
        real = {(end - length, end, kind) for end, length, kind in true if kind != OUTSIDE}
        odds += [(gain, (first, end, kind) in real) for first, end, kind, gain in model.decode([phi], len(phi))]
    for margin in np.arange(0.0, MOST_MARGIN + 0.5, 0.5):
        kept = [good for gain, good in odds if gain > margin]
        model.margin = float(margin)
        if kept.count(False) <= FALSE_SHARE * len(kept):
            break
    return model


def added_spans(text: str, base: list[list[Span]], model: SemiCrf) -> list[list[Span]]:
    """Spans that the field finds beside the base ones."""
    taken = sorted(s for found in base for s in found)
    out: list[list[Span]] = [[] for _ in KINDS]
    at = 0
    for a, b in islands(text):
        island = text[a:b]
        cuts = tokens(island)
        n = len(cuts) - 1
        before, after = text[max(0, a - 2) : a], text[b : b + 2]
        # features of PIECE tokens at a time, however long the island; scores run on from one to the next
        parts = (segment_features(island, cuts, before, after, first, min(n, first + PIECE)) for first in range(0, n, PIECE))
        for first, end, kind, gain in model.decode(parts, n):
            if gain <= model.margin:
                continue
            s, e = a + cuts[first], a + cuts[end]
            while at and (at >= len(taken) or taken[at][0] >= s):
                at -= 1
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at >= len(taken) or taken[at][0] >= e:
                out[kind].append((s, e))
    return out


def listed(spans: list[list[Span]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, found in enumerate(spans) for a, b in sorted(found))


def find_pii(docs: DataFrame, model: SemiCrf, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, base (the base spans), spans (those and the field's), both as kind:start:end by kind and start, and n_email, n_ip, n_card, n_phone of the base.

    A null text is empty and has no spans. Texts of any length are read whole; repeated rows are rows like others, other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = kept.value
        for batch in frugal(batches):
            base, spans, counts = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                found = base_spans(text)
                more = added_spans(text, found, crf)
                base.append(listed(found))
                spans.append(listed([a + b for a, b in zip(found, more, strict=True)]))
                counts.append([len(f) for f in found])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return to_python(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
