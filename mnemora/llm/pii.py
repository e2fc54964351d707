"""Personal data in texts: fixed base patterns, and a semi-Markov conditional random field that adds spans.

Whole-span features score candidate segments of at most `LONGEST` atoms; dynamic programming over boundaries and
types picks the best segmentation of the whole text. Where neither a segment nor the three atoms before it hold any
evidence no label can win (`Field.needs_evidence` makes sure of it when the field is trained), so only the stretches
around evidence are decoded. The field is trained here, on the driver, on generated sentences; its weights
(a few KB) go to the tasks with the function. Spans of the base patterns always stay; a span of the field is
added where it overlaps none of them.

Defined cases: a null text is an empty text without spans; texts are searched whole; base patterns are found in
linear time whatever the text; repeated rows are searched each; an empty table gives an empty table; columns
other than the text are carried or left out, whatever their names: results get underscores before theirs until these
are free. Very long texts and words are decoded along their atoms, in time in
proportion to their length; of a long text only places of atoms and decisions not yet settled are held.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_text

#: Kinds in the order of the contract, then those that only the field finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[int, int, str]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            after = m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return out


def numbers(text: str) -> list[Span]:
    """IP addresses and cards, from the chains of digit runs."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    out: list[Span] = []
    i, n = 0, len(runs)
    while i + 3 < n:
        dotted = 0
        while dotted < 3 and runs[i + dotted + 1][0] == runs[i + dotted][1] + 1 and text[runs[i + dotted][1]] == ".":
            dotted += 1
        if dotted < 3:
            i += dotted + 1
            continue
        four = runs[i : i + 4]
        if all(b - a < 4 or not text[a:b].lstrip("0")[3:] for a, b in four) and all(int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
            out.append((four[0][0], four[3][1], "ip"))
        i += 4
    i = 0
    while i < n:
        j, size = i, runs[i][1] - runs[i][0]
        while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            size += runs[j][1] - runs[j][0]
        if 14 <= size <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append((runs[i][0], runs[j][1], "card"))
        i = j + 1
    return out


def phones(text: str) -> list[Span]:
    return [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    return sorted([*emails(text), *numbers(text), *phones(text)], key=lambda s: (s[0], ORDER[s[2]]))


# --- the field ---------------------------------------------------------------------------------------------

#: Groups of four after the country and its check digits in the longest account number, and the most atoms of one
#: segment, which is such a number written with spaces: its head, its groups and a shorter one. Characters are not bounded.
IBAN_GROUPS = 7
LONGEST = IBAN_GROUPS + 2
LABELS = ("out", *KINDS)
COLUMNS = np.arange(len(LABELS))
ATOM = re.compile(r"[^\s\"'<>,;|()=\[\]{}]+|[\"'<>,;|()=\[\]{}]")
TOKEN = re.compile(r"\S+")
#: Segments of several atoms hold one of these.
MARK = re.compile(r"[0-9@]")
#: Words that announce a kind, up to three atoms before it.
CUES = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "mail": "email", "email": "email", "contact": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip", "ssn": "ssn", "social": "ssn", "iban": "iban", "account": "iban", "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "apikey": "secret"}
#: What a segment must hold, or follow, to have evidence for a label: a mark, a shape that needs none, or a cue.
EVIDENCE = tuple(re.compile(p) for p in (r"[0-9@]", r"[-_][A-Za-z_-]{16}", r"\.[A-Za-z_-]{6}[^\s.]*\.[A-Za-z_-]{6}", r"(?<![a-f])[a-f]{25}"))
CUE = re.compile(rf"\b(?:{'|'.join(CUES)})\b", re.I)
SHAPES = {
    "email": re.compile(r"[\w.%+-]+\s?@\s?[\w-]+(?:\.[\w-]+)+", re.A),
    "ip": re.compile(r"(?:\d{1,3}\.){3}\d{1,3}", re.A),
    "phone": re.compile(r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}", re.A),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}", re.A),
    "iban": re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,{IBAN_GROUPS}}}(?: ?[A-Z0-9]{{1,3}})?", re.A),
    "secret": re.compile(r"[0-9a-f]{32,}|[A-Za-z]{2,5}[-_][A-Za-z0-9_-]{16,}|(?=[A-Za-z0-9_]*\d)(?=[A-Za-z0-9_]*[A-Z])[A-Za-z0-9_]{20,}|(?=[\w.-]*[0-9A-Z])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{6,}){2}", re.A),
    "date": re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}", re.A),
    "plain": re.compile(r"[\d.,]+", re.A),
    "code": re.compile(r"(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{8,}", re.A),
    "mixed": re.compile(r"(?=[A-Za-z]*[a-z][A-Z])[A-Za-z]{8,}", re.A),
}
FEATURES = ["bias", *(f"shape_{k}" for k in SHAPES), *(f"cue_{k}" for k in KINDS), *(f"shape_cue_{k}" for k in KINDS), "digits_0", "digits_1_6", "digits_7_9", "digits_10_13", "digits_14_19", "digits_20", "luhn", "luhn_cue_card", "code_cue_secret", "mixed_cue_secret", "atoms", "space_inside", "edge_punctuation", "letters", "hex"]
AT = {f: i for i, f in enumerate(FEATURES)}
#: A text's outline: the features but that of the check digit ask only which characters are digits, letters a to f, other letters.
OUTLINE = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")})
#: Outlines whose scores a task remembers, and the characters of those that are too long to remember.
MEMO, LONG_OUTLINE = 50_000, 48
ANY_DIGIT = re.compile(r"[0-9]")


def segment_features(s: str, atoms: int, cues: frozenset[str]) -> list[int]:
    """Places of the features that hold for a segment `s`."""
    digits = "".join(ANY_DIGIT.findall(s))
    n = len(digits)
    out = [0, AT["digits_0" if not n else "digits_1_6" if n < 7 else "digits_7_9" if n < 10 else "digits_10_13" if n < 14 else "digits_14_19" if n < 20 else "digits_20"]]
    for k, p in SHAPES.items():
        if p.fullmatch(s):
            out.append(AT[f"shape_{k}"])
            if k in cues:
                out.append(AT[f"shape_cue_{k}"])
            if k in ("code", "mixed") and "secret" in cues:
                out.append(AT[f"{k}_cue_secret"])
    out += [AT[f"cue_{k}"] for k in sorted(cues)]
    if 14 <= n <= 19 and luhn(digits):
        out.append(AT["luhn"])
        if "card" in cues:
            out.append(AT["luhn_cue_card"])
    if atoms > 1:
        out.append(AT["atoms"])
    if any(c.isspace() for c in s):
        out.append(AT["space_inside"])
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        out.append(AT["edge_punctuation"])
    if n * 2 < len(s):
        out.append(AT["letters"])
    if len(s) > 24 and re.fullmatch("[0-9a-f]+", s):
        out.append(AT["hex"])
    return out


def atoms_in(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Atoms of text[start:end]; marks at the end of a sentence are atoms of their own."""
    for m in ATOM.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        e = b
        while e > a + 1 and text[e - 1] in ".:!?":
            e -= 1
        yield a, e
        for k in range(e, b):
            yield k, k + 1


class Ways:
    """Back-pointers of a decoding: for each atom and label the atoms of the segment that ends there, and the label before."""

    SETTLE = 1024

    def __init__(self):
        self.base, self.n, self.root = 0, 0, 0  # atoms that are settled, atoms in all, label at the settled place
        self.back: list[tuple[list[int], list[int]]] = []
        self.atoms: list[tuple[int, int]] = []

    def add(self, atom: tuple[int, int], size: list[int], label: list[int]) -> None:
        self.atoms.append(atom)
        self.back.append((size, label))
        self.n += 1

    def before(self, j: int, y: int) -> tuple[int, int]:
        size, label = self.back[j - self.base - 1]
        return j - size[y], label[y]

    def spans(self, j: int, y: int) -> list[Span]:
        """Spans on the way to label `y` at place `j`, from the settled place on."""
        out = []
        while j > self.base:
            i, p = self.before(j, y)
            if y:
                out.append((self.atoms[i - self.base][0], self.atoms[j - self.base - 1][1], LABELS[y]))
            j, y = i, p
        return out[::-1]

    def due(self) -> bool:
        return len(self.back) % self.SETTLE == 0

    def settle(self) -> list[Span]:
        """Spans up to the last place through which all ways that may go on have come; what is before it is dropped."""
        live = {(j, y) for j in range(max(self.base, self.n - LONGEST), self.n + 1) for y in range(len(LABELS)) if j > self.base} or {(self.base, self.root)}
        while len(live) > 1:
            j = max(live)[0]
            if j == self.base:
                return []
            live = {s for s in live if s[0] < j} | {self.before(*s) for s in live if s[0] == j}
        j, y = live.pop()
        out = self.spans(j, y)
        del self.back[: j - self.base], self.atoms[: j - self.base]
        self.base, self.root = j, y
        return out


def cue_of(atom: str) -> str | None:
    """The kind that an atom announces."""
    return CUES.get(atom.lower().strip(":="))


class Field:
    """Weights of the labels' features and of the transitions between labels; a text is entered and left outside."""

    def __init__(self):
        self.w = np.zeros((len(LABELS), len(FEATURES)))
        self.t = np.zeros((len(LABELS), len(LABELS)))
        self.memo: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def needs_evidence(self) -> bool:
        """Whether, between any two labels, an atom without evidence scores best as outside.

        Of several atoms only those with a mark are segments, so such an atom is alone; it has no digit, it may be
        of mixed case or a mark, and nothing else.
        """
        always = [AT[f] for f in ("bias", "digits_0", "letters")]
        for some in ([], ["edge_punctuation"], ["shape_mixed"], ["shape_mixed", "edge_punctuation"], ["shape_plain", "edge_punctuation"]):
            own = self.w[:, always + [AT[f] for f in some]].sum(axis=1)
            gain = (own - own[0])[None, :, None] + self.t[:, :, None] + self.t[None, :, :] - self.t[:, :1, None] - self.t[None, :1, :]
            if (gain[:, 1:, :] >= 0).any():
                return False
        return True

    def segments(self, text: str, atoms: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
        """Features of each candidate segment: single atoms, and runs that hold a digit or an at sign."""
        out = {}
        for i, (a, _) in enumerate(atoms):
            cues = frozenset(c for x, y in atoms[max(0, i - 3) : i] if (c := cue_of(text[x:y])))
            for j in range(i + 1, min(i + LONGEST, len(atoms)) + 1):
                b = atoms[j - 1][1]
                if j == i + 1 or MARK.search(text, a, b):
                    out[i, j] = segment_features(text[a:b], j - i, cues)
        return out

    def vector(self, features: list[int], atoms: int) -> np.ndarray:
        s = self.w[:, features].sum(axis=1)
        if atoms > 1:
            s[0] = -np.inf  # outside segments are single atoms
        return s

    def scores(self, segments) -> dict[tuple[int, int], np.ndarray]:
        return {(i, j): self.vector(f, j - i) for (i, j), f in segments.items()}

    def segment_score(self, s: str, atoms: int, cues: frozenset[str]) -> np.ndarray:
        """Score of a segment by label; those of short outlines are remembered."""
        if len(s) > LONG_OUTLINE:
            return self.vector(segment_features(s, atoms, cues), atoms)
        outline = s.translate(OUTLINE)
        n = outline.count("0")
        key = outline, atoms, cues, 14 <= n <= 19 and luhn("".join(ANY_DIGIT.findall(s)))
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[key] = self.vector(segment_features(s, atoms, cues), atoms)
        return got

    def best(self, text: str, start: int = 0, end: int | None = None) -> Iterator[Span]:
        """The best segmentation of text[start:end], in order.

        Decoding goes along the atoms and keeps the last `LONGEST` columns; back-pointers are dropped up to the last
        place through which all ways go.
        """
        last: deque[tuple[int, int]] = deque(maxlen=LONGEST)
        enter: deque[tuple[np.ndarray, np.ndarray, frozenset]] = deque(maxlen=LONGEST)  # by atom: best score by label, the label before, cues
        said: deque[str | None] = deque(maxlen=3)
        value, ways = np.array([0.0, *[-np.inf] * (len(LABELS) - 1)]), Ways()
        for a, b in atoms_in(text, start, end):
            way = value[:, None] + self.t
            came = way.argmax(axis=0)
            enter.append((way[came, COLUMNS], came, frozenset(filter(None, said))))
            last.append((a, b))
            said.append(cue_of(text[a:b]))
            value, size, label = np.full(len(LABELS), -np.inf), np.zeros(len(LABELS), int), np.zeros(len(LABELS), int)
            marked = False
            for k in range(1, len(last) + 1):
                first, first_end = last[-k]
                marked = marked or MARK.search(text, first, first_end) is not None
                if k > 1 and not marked:
                    continue
                before, came, cues = enter[-k]
                got = before + self.segment_score(text[first:b], k, cues)
                better = got > value
                value = np.where(better, got, value)
                size, label = np.where(better, k, size), np.where(better, came, label)
            ways.add((a, b), size.tolist(), label.tolist())
            if ways.due():
                yield from ways.settle()
        yield from ways.spans(ways.n, int((value + self.t[:, 0]).argmax()))

    def learn(self, text: str, spans: list[Span], gw: np.ndarray, gt: np.ndarray) -> float:
        """Add the gradient of the log-likelihood of one sentence; return the log-likelihood."""
        atoms = list(atoms_in(text))
        n, m = len(atoms), len(LABELS)
        segments = self.segments(text, atoms)
        scores = self.scores(segments)
        first, last = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
        gold, i = [], 0
        entity = {first[a]: (last[b], LABELS.index(k)) for a, b, k in spans}
        while i < n:
            j, y = entity.get(i, (i + 1, 0))
            gold.append((i, j, y))
            i = j
        fwd, bwd = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        fwd[0, 0], bwd[n] = 0, self.t[:, 0]
        by_end: list[list] = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            by_end[j].append((i, s))
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        entry = {}
        for j in range(1, n + 1):
            for i, s in by_end[j]:
                if i not in entry:
                    entry[i] = lse(fwd[i][:, None] + self.t, 0)
                fwd[j] = np.logaddexp(fwd[j], entry[i] + s)
        total = lse(fwd[n] + self.t[:, 0], 0)
        gt[:, 0] -= np.exp(fwd[n] + self.t[:, 0] - total)
        for j in range(n, 0, -1):
            for i, s in by_end[j]:
                bwd[i] = np.logaddexp(bwd[i], lse(self.t + (s + bwd[j])[None, :], 1))
        for (i, j), s in scores.items():
            p = np.exp(entry[i] + s + bwd[j] - total)
            np.add.at(gw, (slice(None), segments[i, j]), -p[:, None])
            gt -= np.exp(fwd[i][:, None] + self.t + (s + bwd[j])[None, :] - total)
        like, before = 0.0, 0
        for i, j, y in gold:
            gw[y, segments[i, j]] += 1
            gt[before, y] += 1
            like += scores[i, j][y] + self.t[before, y]
            before = y
        gt[before, 0] += 1
        return like + self.t[before, 0] - total


def sentence(rnd: random.Random) -> tuple[str, list[Span]]:
    """A generated sentence and its spans."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(("an", "er", "tion", "la", "de", "ou", "sch", "ing", "o", "th", "ci", "é")) for _ in range(rnd.randint(1, 4)))

    letters = lambda n: "".join(rnd.choice("abcdefghijABCDEFGHIJ0123456789_-") for _ in range(n))

    def card() -> str:
        d = rnd.choice("3456") + digits(rnd.choice((13, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rnd.choice(("", "", " ", "-"))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def iban() -> str:
        """A country's length, from the shortest layout to the longest, with a bank's letters or all digits, spaced or not."""
        space, n, mixed = rnd.choice((" ", " ", "")), rnd.randint(11, 30), rnd.random() < 0.6
        account = rnd.choice((n, n, rnd.randint(6, n)))  # from here on letters may stand among the digits
        capitals = "ABCDEFGHIJKLMNOPRSTUVW"
        rest = "".join(rnd.choice(capitals) if mixed and k < 4 else rnd.choice(capitals + 2 * "0123456789") if mixed and k >= account else digits(1) for k in range(n))
        return space.join([letters(2).upper() + digits(2), *(rest[k : k + 4] for k in range(0, n, 4))])

    make = {
        "email": lambda: f"{word().replace('é', 'e')}{rnd.choice(('', '.', '_'))}{digits(rnd.randint(0, 2))}{rnd.choice(('@', '@', ' @ '))}{word().replace('é', 'e')}.{rnd.choice(('com', 'org', 'net', 'example.com'))}",
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rnd.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(4)}")),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": iban,
        "secret": lambda: rnd.choice((lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((32, 40, 64)))), lambda: rnd.choice(("sk-", "ghp_", "AKIA_")) + "".join(rnd.choice("abcdefABCDEF0123456789") for _ in range(24)), lambda: letters(rnd.randint(18, 40)) + "." + letters(rnd.randint(20, 60)) + "." + letters(rnd.randint(12, 43))))(),
        "short secret": lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(10, 24))),
        "spelt secret": lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(4, 12))) + "".join(rnd.choice("ABCDEFGHIJ") for _ in range(rnd.randint(2, 6))) + "".join(rnd.choice("mnopq") for _ in range(rnd.randint(0, 6))),
    }
    plain = (lambda: str(rnd.randint(1900, 2030)), lambda: f"{digits(4)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: f"{rnd.randint(1, 12)}.{rnd.randint(1, 28)}.{digits(4)}", lambda: digits(rnd.randint(1, 9)), lambda: digits(rnd.choice((15, 16, 17, 22))), lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(3)} {digits(3)}", lambda: word() + digits(2), lambda: "@" + word(), lambda: f"{digits(1)}-{digits(1)}", lambda: rnd.choice(tuple(CUES)) + " " + word(), make["spelt secret"], make["spelt secret"], lambda: digits(2) + "abcdef"[rnd.randint(0, 5)] + digits(rnd.randint(4, 9)), lambda: word().replace("é", "e") + rnd.choice(("X", "QL", "Net")) + rnd.choice(("", ".")), lambda: f"{word()}.{word()}.{word()}")
    text, spans = "", []
    for _ in range(rnd.randint(1, 3)):
        text += " ".join(word() for _ in range(rnd.randint(1, 4))) + " "
        if rnd.random() < 0.45:
            text += rnd.choice(plain)()
        else:
            k = rnd.choice(KINDS)
            kind = rnd.choice((k, k, "short secret", "spelt secret")) if k == "secret" else k  # secrets by their cue only
            if kind != k or rnd.random() < 0.4:
                text += rnd.choice([c for c, x in CUES.items() if x == k]) + rnd.choice((" ", ": ", " = ", "="))
            quote = '"' if k == "secret" and rnd.random() < 0.6 else ""
            x = make[kind]()
            spans.append((len(text + quote), len(text + quote + x), k))
            text += quote + x + quote
        text += rnd.choice((" ", ". ", ", ")) + word() + " "
    edges = {p for a in atoms_in(text) for p in a}
    return (text, spans) if all(a in edges and b in edges for a, b, _ in spans) else sentence(rnd)


@functools.lru_cache(maxsize=2)
def trained(sentences: int = 220, rounds: int = 7, seed: int = 7) -> Field:
    """A field fitted by stochastic gradient steps on generated sentences."""
    rnd, field = random.Random(seed), Field()
    data = [sentence(rnd) for _ in range(sentences)]
    sw, st = np.full_like(field.w, 1e-2), np.full_like(field.t, 1e-2)
    for _ in range(rounds):
        for at in range(0, len(data), 10):
            gw, gt = -0.02 * field.w, -0.02 * field.t
            for text, spans in data[at : at + 10]:
                field.learn(text, spans, gw, gt)
            sw += gw * gw
            st += gt * gt
            field.w += 0.6 * gw / np.sqrt(sw)
            field.t += 0.6 * gt / np.sqrt(st)
    if not field.needs_evidence():
        raise ValueError("an atom without evidence may be labelled: other weights are needed")
    return field


def evidence(text: str) -> np.ndarray:
    """Places of all evidence, unordered."""
    found = [np.fromiter((m.start() for m in p.finditer(text)), np.int64) for p in EVIDENCE]
    low = text.lower()
    if len(low) != len(text) or any(c in low for c in CUES):  # a plain search first: few texts hold a cue
        found.append(np.fromiter((m.start() for m in CUE.finditer(text)), np.int64))
    return np.concatenate(found)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of `LONGEST` words on both sides of all evidence, joined where they meet."""
    places = evidence(text)
    if not len(places):
        return []
    starts = np.fromiter((m.start() for m in TOKEN.finditer(text)), np.int64)
    words = np.unique(np.searchsorted(starts, places, "right") - 1)  # evidence lies within a word
    first = np.flatnonzero(np.r_[True, np.diff(words) > 2 * LONGEST + 1])
    last = np.r_[first[1:] - 1, len(words) - 1]
    ends = np.r_[starts, len(text)]
    return list(zip(starts[np.maximum(words[first] - LONGEST, 0)].tolist(), ends[np.minimum(words[last] + LONGEST + 1, len(starts))].tolist()))


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start, then kind."""
    around = windows(text)
    if not around:
        return [], []
    base = base_spans(text)
    more = [span for a, b in around for span in field.best(text, a, b)]
    added, i, reach = [], 0, 0
    ends = sorted((s, e) for s, e, _ in base)
    for s, e, k in more:
        while i < len(ends) and ends[i][0] < e:
            reach = max(reach, ends[i][1])
            i += 1
        if reach <= s:
            added.append((s, e, k))
    return base, sorted(base + added, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def _mapped(df: DataFrame, text: str, keep, result, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    field = trained()

    def found(texts: pa.Array) -> list[pa.Array]:
        rows = [result(t, *find(t, field)) for t in (x.as_py() for x in texts)]
        return [pa.array(x, f[1]) for x, f in zip(zip(*rows), fields)]

    return map_text(df, text, keep, found, [(n, d) for n, _, d in fields], lambda: field.memo.clear())


def find_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns `keep` and `spans`, an array of kind, begin, end and whether a base pattern found it."""
    kind = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def result(_, base, spans):
        own = set(base)
        return ([{"kind": k, "begin": s, "end": e, "base": (s, e, k) in own} for s, e, k in spans],)

    return _mapped(df, text, keep, result, [("spans", pa.list_(kind), "array<struct<kind:string,begin:long,end:long,base:boolean>>")])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with each span of its text replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    rest = tuple(c for c in df.columns if c != text)

    def result(t, _, spans):
        out, at = [], 0
        for s, e, k in spans:
            if s >= at:
                out += (t[at:s], f"<{k}>")
            at = max(at, e)
        return ("".join(out) + t[at:],)

    clean = free_name(df, "clean")
    done = _mapped(df, text, rest, result, [(clean, pa.string(), "string")])
    return done.select(*(F.col(clean).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def spans_digest(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns `keep`, the number of base spans by kind, a digest of them, and all spans as text and number."""

    def result(_, base, spans):
        return (*(sum(k == x for _, _, k in base) for x in BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans))

    fields = [(f"n_{k}", pa.int64(), "long") for k in BASE_KINDS] + [("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_spans", pa.int64(), "long")]
    return _mapped(df, text, keep, result, fields)
