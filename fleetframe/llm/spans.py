"""Exact base patterns of personal data and secrets, and the text form of spans.

A span is (kind, start, end) in code points, the end exclusive. Base spans are the leftmost
non-overlapping matches of a kind; a match that fails its check is dropped and not tried again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

Span = tuple[str, int, int]

PII_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

# Fixed patterns. Where a run of one character class has to be followed by something that is not in it,
# only the run's own start can match, so the runs are taken whole.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A card of 19 digits with a mark between any two.
_LONGEST_CARD = 37


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds exactly one at sign after a run of name characters, so the signs lead to all."""
    found, free, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            free = domain.end()
            found.append((start, free))
        sign = text.find("@", max(sign + 1, free))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _IP.finditer(text)
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split("."))
    ]


def is_card(text: str) -> bool:
    digits = only_digits(text) if len(text) <= _LONGEST_CARD else ""
    return 12 <= len(digits) <= 19 and luhn(digits)


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if is_card(m[0])]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]


def base_pii(text: str) -> list[Span]:
    """Base spans by start, then by kind in the order of PII_KINDS."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    return in_order(found, PII_KINDS)


def base_secrets(text: str) -> list[Span]:
    """Base spans by start, then by kind in the order of SECRET_KINDS."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(found, SECRET_KINDS)


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


class Taken:
    """Parts of a text that are taken, as sorted ranges without overlap."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def is_free(self, span: Span) -> bool:
        """Whether a span shares no character with what is taken."""
        at = bisect_left(self.starts, span[2])
        return not at or self.ends[at - 1] <= span[1]

    def take(self, span: Span) -> None:
        """Add a free span."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def without_overlap(base: list[Span], scored: list[tuple[float, Span]], kinds: tuple[str, ...]) -> list[Span]:
    """The base spans, and further ones by falling score that overlap none taken before.

    Of equal scores the one that starts first goes first, then the longer one, then the kind listed first.
    """
    taken, kept = Taken(base), list(base)
    for _, span in sorted(scored, key=lambda x: (-x[0], x[1][1], -x[1][2], kinds.index(x[1][0]))):
        if taken.is_free(span):
            taken.take(span)
            kept.append(span)
    return in_order(kept, kinds)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    parts, free = [], 0
    for kind, start, end in spans:
        if start >= free:
            parts += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join([*parts, text[free:]])
