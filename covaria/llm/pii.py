"""Personal data: base patterns and a semi-Markov conditional random field.

The base patterns find email addresses, IP addresses, payment cards and telephone numbers.  The random field adds what they miss:
it scores whole candidate spans of up to MAX_PIECES pieces by features of the span as such (its shape, digits, length,
checksum, the words before it), and a dynamic programme over all segmentations chooses boundaries and types together.
Only pieces that hold a digit or an at sign, the bank code inside an account number, and what is assigned to a word such as
``password`` can belong to a span; any other piece is outside with score 0, so that the best segmentation of a text is
that of its runs of such pieces, each on its own.  Beside the base kinds the field knows bank accounts (iban), hardware and
IPv6 addresses (mac, ipv6), national identity numbers of three-two-four digits (national_id) and secrets.

The field is trained here, by gradient ascent on the conditional likelihood of examples that are generated from
templates with a fixed seed; it takes a few seconds, needs no labelled data and gives the same weights each time.

Defined results: a null or empty text has no spans; a span of the field that touches a base span is dropped, base spans
stay even where they overlap; repeated rows give equal results; texts are read whole and in linear time; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from covaria.llm.common import extend, scan

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "mac", "ipv6", "national_id", "secret")
OUTSIDE = "outside"
#: An account number of 34 characters has nine groups.
MAX_PIECES = 9
SEED = 7
EXAMPLES = 1400
PASSES = 4
#: A field's span must be this much likelier than being outside.
LEAST_MARGIN = 1.0

# Each pattern is the contract's, made linear: a repeated class that cannot meet what follows it is possessive, and a run of digits is tried from its start only.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ \-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9\-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns, by kind as listed in BASE, then start."""
    if not text or not _RUN.search(text):
        return []
    out: list[Span] = list(_emails(text))
    if _DIGIT.search(text):
        # a part with more than three digits after its leading zeros is over 255
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = _digits(m.group())
                if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return out


# ---- the random field -------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"[^\s\"'`=,;<>{}\[\]|*&$#]+")
_TRAIL = ".:!?)…"
_BEFORE = re.compile(r"[^\W\d_]+")
# Words that announce a kind.
CUES = {
    "card": "card visa mastercard amex",
    "email": "email mail contact write",
    "iban": "iban account konto",
    "ip": "ip address host server",
    "ipv6": "ipv6",
    "mac": "mac hardware ethernet",
    "national_id": "ssn social security",
    "phone": "phone tel telephone mobile call fax",
    "secret": "password passwd pwd token secret key apikey credential auth bearer",
}
# Words that are assigned to a secret's name without being one.
PLAIN_VALUES = frozenset("none null true false required optional string hidden empty invalid expired missing forgotten change changed reset unknown default example value".split())
_CUE = {w: kind for kind, words in CUES.items() for w in words.split()}


#: A value that is assigned to a word for secrets; it may hold no digit at all.
_ASSIGNED = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key)[\"']?[ ]?[:=][ ]?[\"']?([^\s\"'`=,;<>{}\[\]|]{4,})")
_BANK_CODE = re.compile(r"[A-Z]{4}")
_COUNTRY = re.compile(r"[A-Z]{2}[0-9]{2}")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")
_IPV6 = re.compile(r"[0-9A-Fa-f:]{3,39}")


def account(span: str) -> bool:
    """Do the check digits of an international bank account number hold?"""
    plain = span.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def sixth(span: str) -> bool:
    """Is it an IPv6 address?"""
    import ipaddress

    if span.count(":") < 2 or not _IPV6.fullmatch(span):
        return False
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def assigned(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Values without digits that are assigned to a word for secrets, as runs of one piece."""
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in _TRAIL:
            b -= 1
        if b > a and not _RUN.search(text, a, b):
            yield [(a, b)], text[max(0, a - 24) : a]


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Runs of neighbouring pieces that hold a digit or an at sign, and the words just before each run."""
    at = 0
    while found := _RUN.search(text, at):
        start = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop, pieces = start, []
        while True:
            end = stop
            while end < len(text) and not text[end].isspace():
                end += 1
            token = text[stop:end]
            if not _RUN.search(token):
                # letters go on where an account number has its bank code
                if _BANK_CODE.fullmatch(token) and pieces and pieces[-1][1] == stop - 1 and _COUNTRY.fullmatch(text[slice(*pieces[-1])]) and text[end : end + 1] == " ":
                    pieces.append((stop, end))
                    stop = end + 1
                    continue
                break
            for m in _PIECE.finditer(token):
                a, b = stop + m.start(), stop + m.end()
                while b > a and text[b - 1] in _TRAIL and not (text[b - 1] == ")" and "(" in text[a:b]):
                    b -= 1
                if b > a and _RUN.search(text, a, b):
                    pieces.append((a, b))
            stop = end
            if end < len(text) and text[end] == " ":
                stop = end + 1
            else:
                break
        if pieces:
            yield pieces, text[max(0, pieces[0][0] - 24) : pieces[0][0]]
        at = max(stop, found.end())


def shape(text: str) -> str:
    """Classes of characters, each run once: 9 digits, h hexadecimal mixtures, a small, A capital letters."""
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", text)))
    return re.sub(r"(?:[aA]*9[aA]+|[aA]+9[aA]*){2,}[9aA]*", "h", s)[:24]


def span_features(text: str, pieces: list[tuple[int, int]], i: int, j: int, before: str) -> list[str]:
    """Features of the candidate made of pieces i to j - 1 as a whole."""
    a, b = pieces[i][0], pieces[j - 1][1]
    span = text[a:b]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    words = [w.lower() for w in _BEFORE.findall(before if i == 0 else text[max(0, a - 24) : a])][-2:]
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:], strict=False))
    out = [
        f"shape {shape(span)}", f"pieces {j - i}", f"digits {min(digits, 20)}", f"length {min(len(span).bit_length(), 8)}",
        f"letters {min(letters.bit_length(), 6)}", f"changes {min(changes.bit_length(), 5)}", f"spaces {' ' in span}",
    ]
    if letters == 0 and 13 <= digits <= 19:
        out.append(f"luhn {luhn(_digits(span))}")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span):
        out.append(f"hex {min(len(span) // 8, 5)}")
    if re.fullmatch(r"[A-Za-z0-9_\-+/.]{16,}", span) and digits and letters:
        out.append(f"mixed {min(len(span) // 8, 5)} {changes >= 4}")
    if re.fullmatch(r"[A-Z]{4}[A-Z0-9]{16}", span):
        out.append("access key")
    if "A" <= span[0] <= "Z" and digits >= 8:
        out.append(f"account {account(span)}")
    if ":" in span or span.count("-") == 5:
        out.append(f"mac {bool(_MAC.fullmatch(span))}")
        out.append(f"sixth {sixth(span)}")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span):
        out.append("three two four")
    if not digits and "@" not in span and j - i == 1:
        out.append(f"no digit {min(len(span) // 4, 4)} {span.lower() in PLAIN_VALUES}")
    if "@" in span:
        out.append(f"at {bool(re.fullmatch(r'[^@]+@[^@]+[.][^@.]+', span))}")
    if quad := re.fullmatch(r"([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)", span):
        out.append(f"quad {all(int(p[-4:]) <= 255 for p in quad.groups())}")
    return out + [f"cue {_CUE[w]}" for w in words if w in _CUE]


class Field:
    """Weights of (kind, feature) and of neighbouring kinds."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def _ending(self, text: str, pieces: list[tuple[int, int]], before: str, j: int) -> Iterator[tuple[int, str, float, list[str]]]:
        """The candidates that end before piece j: (start, kind, score, features)."""
        for i in range(j - 1, max(j - MAX_PIECES, 0) - 1, -1):
            if i < j - 1 and not 0 <= pieces[i + 1][0] - pieces[i][1] <= 3:
                break
            f = span_features(text, pieces, i, j, before)
            for kind in (*KINDS, OUTSIDE) if i == j - 1 else KINDS:
                yield i, kind, sum(self.w.get((kind, x), 0.0) for x in f), f

    def _lattice(self, text: str, pieces: list[tuple[int, int]], before: str) -> list[list[tuple[int, str, float, list[str]]]]:
        return [[], *(list(self._ending(text, pieces, before, j)) for j in range(1, len(pieces) + 1))]

    def _follows(self, a: str, b: str) -> float:
        return self.w.get(("after " + a, b), 0.0)

    def decode(self, text: str, pieces: list[tuple[int, int]], before: str) -> list[Span]:
        """The best segmentation, jointly over boundaries and kinds."""
        best: list[dict[str, tuple[float, int, str]]] = [{OUTSIDE: (0.0, 0, "")}] + [{} for _ in pieces]
        sums = [0.0]
        for j in range(1, len(pieces) + 1):
            ending = [(i, kind, score) for i, kind, score, _ in self._ending(text, pieces, before, j)]
            sums.append(sums[-1] + next(score for _, kind, score in ending if kind == OUTSIDE))
            for i, kind, score in ending:
                if kind != OUTSIDE and score - (sums[j] - sums[i]) < LEAST_MARGIN:
                    continue
                for last, (so_far, _, _) in best[i].items():
                    total = so_far + score + self._follows(last, kind)
                    if kind not in best[j] or total > best[j][kind][0]:
                        best[j][kind] = (total, i, last)
        out, j = [], len(pieces)
        kind = max(best[j], key=lambda k: best[j][k][0])
        while j:
            _, i, last = best[j][kind]
            if kind != OUTSIDE:
                out.append((kind, pieces[i][0], pieces[j - 1][1]))
            j, kind = i, last
        return out[::-1]

    def learn(self, text: str, pieces: list[tuple[int, int]], before: str, truth: list[tuple[int, int, str]], rate: float) -> None:
        """One ascent step on the log-likelihood of the true segmentation: observed minus expected features."""
        ends = self._lattice(text, pieces, before)
        n = len(pieces)
        states = (*KINDS, OUTSIDE)
        alpha = [{s: -np.inf for s in states} for _ in range(n + 1)]
        alpha[0][OUTSIDE] = 0.0
        for j in range(1, n + 1):
            terms: dict[str, list[float]] = {}
            for i, kind, score, _ in ends[j]:
                terms.setdefault(kind, []).extend(alpha[i][s] + score + self._follows(s, kind) for s in states if alpha[i][s] > -np.inf)
            for kind, t in terms.items():
                alpha[j][kind] = float(np.logaddexp.reduce(t))
        beta = [{s: -np.inf for s in states} for _ in range(n + 1)]
        beta[n] = dict.fromkeys(states, 0.0)
        starts: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
        for j, found in enumerate(ends):
            for i, kind, score, _ in found:
                starts[i].append((j, kind, score))
        for i in range(n - 1, -1, -1):
            for s in states:
                t = [self._follows(s, kind) + score + beta[j][kind] for j, kind, score in starts[i]]
                beta[i][s] = float(np.logaddexp.reduce(t)) if t else -np.inf
        total = beta[0][OUTSIDE]
        step: dict[tuple[str, str], float] = {}
        true = {(i, j, kind) for i, j, kind in truth}
        last = {i: kind for i, kind in [(0, OUTSIDE), *((j, kind) for _, j, kind in truth)]}
        for j, found in enumerate(ends):
            for i, kind, score, f in found:
                expected = 0.0
                for s in states:
                    if alpha[i][s] > -np.inf:
                        p = float(np.exp(alpha[i][s] + self._follows(s, kind) + score + beta[j][kind] - total))
                        expected += p
                        step["after " + s, kind] = step.get(("after " + s, kind), 0.0) - p
                gain = ((i, j, kind) in true) - expected
                if (i, j, kind) in true:
                    step["after " + last[i], kind] = step.get(("after " + last[i], kind), 0.0) + 1
                if abs(gain) > 1e-4:
                    for x in f:
                        step[kind, x] = step.get((kind, x), 0.0) + gain
        for key, g in step.items():
            self.w[key] = self.w.get(key, 0.0) * (1 - rate * 1e-3) + rate * g


_NO_DIGITS = str.maketrans("0123456789", "abcdefghij")


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A short text with private data or look-alikes, and its spans."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 8)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    caps = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    mix = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + n(rng.choice((14, 14, 14, 13)))
        check = next(c for c in "0123456789" if luhn(body + c))
        full, gap = body + check, rng.choice(("", "", " ", "-"))
        return gap.join(full[k : k + 4] for k in range(0, len(full), 4))

    def iban() -> str:
        country, bank = rng.choice((("DE", n(18)), ("GB", "".join(rng.choice("ABCDEFGHKLMNRSTW") for _ in range(4)) + n(14)), ("FR", n(11) + rng.choice((n(1), caps(1))) + n(11)), ("FR", n(23)), ("NL", "".join(rng.choice("ABINRS") for _ in range(4)) + n(10)), ("ES", n(20))))
        check = next(f"{c:02}" for c in range(2, 99) if account(f"{country}{c:02}{bank}"))
        full = country + check + bank
        return rng.choice((full, " ".join(full[k : k + 4] for k in range(0, len(full), 4))))

    private = {
        "email": lambda: f"{name()}{rng.choice(('', '.' + n(2), '_' + name()))}@{name()}{rng.choice(('', n(1)))}.{rng.choice(('com', 'org', 'example.com', 'de', 'fr'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(2)} {n(4)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(7)}", f"{n(3)}.{n(3)}.{n(4)}")),
        "iban": iban,
        "mac": lambda: rng.choice((":", "-")).join(rng.choice((str.upper, str.lower))(hexa(2)) for _ in range(6)),
        "ipv6": lambda: rng.choice((":".join(hexa(4) for _ in range(8)), f"2001:db8::{hexa(4)}", f"fe80::{hexa(4)}:{hexa(3)}:{hexa(4)}:{hexa(4)}", f"2a0{n(1)}:{hexa(4)}:{n(1)}::{n(1)}")),
        "national_id": lambda: f"{n(3)}-{n(2)}-{n(4)}",
        "secret": lambda: rng.choice((hexa(18), hexa(32), hexa(40), caps(4) + caps(16), "AKIA" + caps(16), "sk-" + mix(32), "ghp_" + mix(36), mix(24))),
    }
    clean = (
        lambda: str(rng.randint(1, 40)), lambda: str(rng.randint(1000, 2100)), lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1, 99)},{n(3)}", lambda: f"20{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(0, 23)}:{n(2)}", lambda: f"v{n(1)}.{n(1)}.{n(1)}", lambda: f"{name()}{n(1)}", lambda: f"{n(2)}%", lambda: f"{n(1)}th", lambda: f"{n(2)}-{n(2)}", lambda: f"19{n(2)}-19{n(2)}", lambda: n(5), lambda: n(7), lambda: f"§{n(3)}",
        lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.20{n(2)}", lambda: f"{n(3)} {n(3)}", lambda: f"@{name()}", lambda: f"{n(1)}.{n(1)}.{n(1)}", lambda: f"{caps(2)}-{n(3)}", lambda: f"{rng.randint(10, 23)}:{n(2)}:{n(2)}", lambda: f"{caps(2)}{n(2)} {n(4)}", lambda: f"{n(2)}-{n(2)}-{n(4)}", lambda: f"{n(1)}:{n(1)}", lambda: f"{n(3)}{rng.choice(('kg', 'cm', 'mm', 'px'))}", lambda: f"{name()}-{n(2)}",
    )
    text, spans = f"{name()} {name()}", []
    if rng.random() < 0.15:  # a value without digits
        lead = rng.choice(("password", "passwd", "secret", "token", "pwd")) + rng.choice((": ", "=", ' = "'))
        plain = rng.random() < 0.4
        made = rng.choice(sorted(PLAIN_VALUES)) if plain else rng.choice((name() + name() + name(), mix(12).translate(_NO_DIGITS), name() + "-" + name() + "-" + name()))
        if len(made) >= 4:
            text += " " + lead
            if not plain:
                spans.append(("secret", len(text), len(text) + len(made)))
            text += made + ('"' if lead.endswith('"') else "")
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            made = private[kind]()
            lead = " "
            if rng.random() < 0.5:
                cue = rng.choice(CUES[kind].split())
                lead = rng.choice((f" {cue} ", f" {cue}: ", f" {cue}=", f' {cue} = "')) if kind == "secret" else rng.choice((f" {cue} ", f" {cue}: "))
            elif kind == "secret" and not made.startswith(("AKIA", "sk-", "ghp_")) and len(made) < 32:
                lead = " key "
            text += lead
            spans.append((kind, len(text), len(text) + len(made)))
            text += made + ('"' if lead.endswith('"') else rng.choice(("", "", ".", ",")))
        else:
            text += " " + rng.choice(clean)()
        if rng.random() < 0.7:
            text += f" {name()} {name()}"
    return text, spans


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    """The random field, trained on generated examples."""
    rng = random.Random(SEED)
    field = Field()
    examples = []
    for _ in range(EXAMPLES):
        text, spans = _example(rng)
        for pieces, before in (*runs(text), *assigned(text)):
            truth, i = [], 0
            while i < len(pieces):
                hit = next((s for s in spans if s[1] == pieces[i][0]), None)
                j = next((j for j in range(i + 1, len(pieces) + 1) if hit and pieces[j - 1][1] == hit[2]), None)
                truth.append((i, j, hit[0]) if hit and j and j - i <= MAX_PIECES else (i, i + 1, OUTSIDE))
                i = truth[-1][1]
            examples.append((text, pieces, before, truth))
    for k in range(PASSES):
        rng.shuffle(examples)
        for x in examples:
            field.learn(*x, rate=0.2 / (1 + k))
    return field


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the field's additions, by kind as listed, then start."""
    base = base_spans(text)
    if not text:
        return base, base
    starts, stops = _merged(base)
    added = []
    for pieces, before in (*runs(text), *assigned(text)):
        for s in field.decode(text, pieces, before):
            k = bisect.bisect_left(starts, s[2])
            if not k or stops[k - 1] <= s[1]:
                added.append(s)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover."""
    starts: list[int] = []
    stops: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one, by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, base spans by kind counted, base_sha256, spans."""
    field = trained()

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        found = [all_spans(t, field) for t in batch.column(1).to_pylist()]
        count = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in BASE}
        return {id_col: batch.column(0)} | count | {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], "spans": [joined(every) for _, every in found]}

    return scan(docs.select(id_col, text_col), kernel, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with private data replaced in the texts; the length column, if any, follows."""
    field = trained()
    chars = [f for f in docs.schema.fields if f.name == chars_col]

    def kernel(batch: pa.RecordBatch) -> tuple[None, dict[str, list]]:
        texts = [None if t is None else redact(t, all_spans(t, field)[1]) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return None, {text_col: texts, chars_col: [None if t is None else len(t) for t in texts]}

    return extend(docs, kernel, f"{text_col} string" + "".join(f", {chars_col} {f.dataType.simpleString()}" for f in chars))
