"""Personal data that plain patterns find, in time linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match ends where its last run of digits ends, so none starts within a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double, less 9 above 9."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        # The leftmost match takes all letters of a local part before the sign.
        local = _LOCAL.match(text[low:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by start, then kind: leftmost matches of each kind, without those that fail its test."""
    found = [("email", a, b) for a, b in _emails(text)]
    for match in _IP.finditer(text):
        if all(map(is_octet, match[0].split("."))):
            found.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = "".join(_DIGIT.findall(match[0])) if match.end() - match.start() < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", match.start(), match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(match[0])) <= 15:
            found.append(("phone", match.start(), match.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))
