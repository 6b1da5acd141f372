"""A semi-Markov conditional random field over candidate segments of short text regions."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from bellwether.llm.span_patterns import KINDS, Span, base_spans, is_octet, luhn

LONGEST = 32  # atoms of an entity, at most
DIGITS, NUMBERS = 19, 8  # digits of an entity and numbers they make, at most
AROUND = 48  # letters that a region has on both sides of what makes it one, at most
ROUNDS, STEP, SHRINK = 80, 0.2, 0.02

_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
# Four or more digits with at most three other signs between two of them.
_CHAIN = re.compile(r"[+(]?[0-9](?:[ ()./_,\[\]{}\t-]{0,3}[0-9]){3,}+")
_AT = re.compile(r"@|[\[({]\s{0,2}at\s{0,2}[\])}]|(?<=\s)at(?=\s)", re.I)
_BRACKET_AT = re.compile(r"[\[({]\s{0,2}at\s{0,2}[\])}]", re.I)
_DOT_WORD = re.compile(r"\bdot\b", re.I)
_OPEN, _CLOSE = frozenset("[({"), frozenset("])}")


def regions(text: str) -> list[tuple[int, int]]:
    """Bounds of the stretches around chains of digits and signs or words for "at"; nothing else can hold an entity."""
    seeds = [m.span() for m in _CHAIN.finditer(text) if m.end() - m.start() > 6]
    if "@" in text or _BRACKET_AT.search(text) or _DOT_WORD.search(text):
        seeds += [m.span() for m in _AT.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(seeds):
        a, b = max(0, a - AROUND), min(len(text), b + 2 * AROUND)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def atoms_of(region: str) -> list[str]:
    return _ATOM.findall(region)


def _is_number(atom: str) -> bool:
    return "0" <= atom[0] <= "9"


def _class(atom: str | None) -> str:
    if atom is None:
        return "edge"
    if _is_number(atom):
        return "digit"
    if atom[0].isalpha():
        return "letter"
    return "space" if atom.isspace() else atom


def _digit_features(span: list[str]) -> list[str]:
    numbers = [a for a in span if _is_number(a)]
    digits, between, last = "".join(numbers), [], ""
    for atom in span[span.index(numbers[0]) + 1 :]:
        if _is_number(atom):
            between.append(last)
            last = ""
        else:
            last += "_" if atom.isspace() else atom
    shape = "-".join(str(len(n)) for n in numbers[:9])
    seps = "".join(sorted(set("".join(between))))
    one = "one" if len(set(between)) == 1 else "none" if not between else "many"
    octets = len(numbers) == 4 and all(map(is_octet, numbers))
    checked = 12 <= len(digits) <= DIGITS and luhn(digits)
    lead = span[0] if span[0] in "+(" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "1"
    return [
        f"shape {shape}",
        f"shape {shape} {seps}",
        f"digits {len(digits)}",
        f"numbers {len(numbers)} octets {octets}",
        f"octets {octets} {seps} {one}",
        f"luhn {checked}",
        f"luhn {checked} {one} {seps}",
        f"lead {lead}",
        f"lead {lead} digits {len(digits)}",
        f"seps {seps} {one}",
        f"even {len({len(n) for n in numbers}) == 1} luhn {checked}",
        f"brackets {span.count('(') == span.count(')')}",
        "digits only",
    ]


def _mail_features(span: list[str], at: int) -> list[str] | None:
    """Features of a segment with one sign or word for "at"; None if no name can be before or no domain behind it."""
    word = span[at] != "@"
    before, after = span[:at], span[at + 1 :]
    bracketed = False
    while before and (before[-1].isspace() or before[-1] in _OPEN):
        bracketed |= before[-1] in _OPEN
        before = before[:-1]
    while after and (after[0].isspace() or after[0] in _CLOSE):
        after = after[1:]
    if not before or any(a.isspace() for a in before):
        return None
    # Labels and marks take turns; only a mark may have white space or brackets around it.
    marks, labels, gap, spacing = 0, 0, "", set()
    for k, atom in enumerate(after):
        if atom == "." or atom.lower() == "dot":
            behind = "".join(after[k + 1 : k + 2])
            spacing.add((atom == ".", bool(gap), behind.isspace() or behind in _CLOSE))
            if not labels:
                return None
            marks, labels, gap = marks + 1, 0, ""
        elif atom.isspace() or atom in _OPEN or atom in _CLOSE:
            gap += atom
        elif atom[0].isalnum() and not (labels and gap):
            labels, gap = labels + 1, ""
        elif atom != "-":
            return None
    if not marks or not labels or gap:
        return None
    # A bare word for "at" needs a bare word for the dot.
    if word and not bracketed and any(dot for dot, _, _ in spacing):
        return None
    end = after[-1] if after[-1].isalpha() else "number"
    form = f"{'word' if word else 'sign'} {bracketed} {sorted(spacing)}"
    return [
        f"mail {form}",
        f"mail {form} {span[at].isupper()}",
        f"mail end {min(len(end), 7)} {end.islower()} {end.isupper()}",
        f"mail end {form} {min(len(end), 7)}",
        f"mail dots {min(marks, 4)}",
        f"mail odd {any(not (a[0].isalnum() or a in '._%+-') for a in before)}",
        f"mail name {min(len(before), 4)} {form}",
    ]


def _beside(atoms: list[str], at: int, step: int) -> str:
    """The class of the nearest atom that is not white space."""
    while 0 <= at < len(atoms) and atoms[at].isspace():
        at += step
    return _class(atoms[at] if 0 <= at < len(atoms) else None)


def candidates(atoms: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, features) of every segment that may be an entity."""
    n = len(atoms)
    digit = [_is_number(a) for a in atoms]
    letter = [a[0].isalpha() for a in atoms]
    sign = [a == "@" or a.lower() == "at" for a in atoms]
    for i in range(n):
        if not (digit[i] or letter[i] or (atoms[i] in "+(" and i + 1 < n and (digit[i + 1] or atoms[i + 1] == "("))):
            continue
        left = _class(atoms[i - 1] if i else None)
        digits = letters = numbers = 0
        at = None
        for j in range(i, min(n, i + LONGEST)):
            if sign[j]:
                if at is not None:
                    break
                at = j
            elif letter[j]:
                letters += 1
            if digit[j]:
                digits, numbers = digits + len(atoms[j]), numbers + 1
            if at is None and not letters and (digits > DIGITS or numbers > NUMBERS):
                break
            if not (digit[j] or letter[j]) or (at == j):
                continue
            if at is not None:
                own = _mail_features(atoms[i : j + 1], at - i) if at > i else None
            else:
                # Four parts that may be an address, or the digits of a telephone or a card.
                enough = digits >= 9 or (numbers == 4 and digits >= 4 and any(a in ".," for a in atoms[i:j]))
                own = _digit_features(atoms[i : j + 1]) if enough and not letters else None
            if own:
                right = _class(atoms[j + 1] if j + 1 < n else None)
                kind = "mail" if at is not None else "number"
                near = f"{_beside(atoms, i - 1, -1) == 'digit'} {_beside(atoms, j + 1, 1) == 'digit'}"
                around = [f"{kind} left {left}", f"{kind} right {right}", f"{kind} {left} {right}", f"{kind} near {near}"]
                yield i, j + 1, [*own, *around]


@dataclass
class Model:
    """Weights of features for each kind, and of an entity that touches the one before."""

    places: dict[str, int]
    weights: np.ndarray
    touching: float

    def score(self, features: list[str]) -> np.ndarray:
        known = [self.places[f] for f in features if f in self.places]
        return self.weights[known].sum(axis=0)

    def segments(self, atoms: list[str]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities; an atom outside of them scores nothing."""
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, features in candidates(atoms):
            scores = self.score(features)
            kind = int(np.argmax(scores))
            if scores[kind] > min(0.0, -self.touching):
                ending.setdefault(j, []).append((i, kind, float(scores[kind])))
        if not ending:
            return []
        # Best score where the atom before a place is outside, and where an entity ends there.
        outside, inside = [0.0], [-np.inf]
        back: list[tuple[int, int] | None] = [None]
        for j in range(1, len(atoms) + 1):
            outside.append(max(outside[-1], inside[-1]))
            best, via = -np.inf, None
            for i, kind, score in ending.get(j, ()):
                total = score + max(outside[i], inside[i] + self.touching)
                if total > best:
                    best, via = total, (i, kind)
            inside.append(best)
            back.append(via)
        found, j, entity = [], len(atoms), inside[-1] > outside[-1]
        while j:
            if entity:
                i, kind = back[j]
                found.append((i, j, KINDS[kind]))
                entity = inside[i] + self.touching > outside[i]
                j = i
            else:
                j -= 1
                entity = inside[j] > outside[j]
        return found[::-1]

    def spans(self, text: str) -> list[Span]:
        found = []
        for low, high in regions(text):
            atoms = atoms_of(text[low:high])
            ends = np.concatenate(([0], np.cumsum([len(a) for a in atoms]))) + low
            found += [(kind, int(ends[i]), int(ends[j])) for i, j, kind in self.segments(atoms)]
        return found


class _Lattice:
    """All candidate segments of the training regions, by end."""

    def __init__(self, examples: list[tuple[str, list[Span]]]):
        self.places: dict[str, int] = {}
        rows, firsts, ends, feats, gold = [], [], [], [], []
        self.lengths = []
        for text, spans in examples:
            for low, high in regions(text):
                atoms = atoms_of(text[low:high])
                at = dict(zip((np.concatenate(([0], np.cumsum([len(a) for a in atoms]))) + low).tolist(), range(len(atoms) + 1), strict=True))
                wanted = {(at.get(a), at.get(b)): KINDS.index(k) for k, a, b in spans if low <= a and b <= high}
                for i, j, features in candidates(atoms):
                    rows.append(len(self.lengths))
                    firsts.append(i)
                    ends.append(j)
                    feats.append([self.places.setdefault(f, len(self.places)) for f in features])
                    gold.append(wanted.get((i, j), -1))
                self.lengths.append(len(atoms))
        self.row, self.first, self.end = np.array(rows, int), np.array(firsts, int), np.array(ends, int)
        sizes = np.array([len(f) for f in feats], int)
        self.edge, self.starts = np.repeat(np.arange(len(feats)), sizes), np.cumsum(sizes) - sizes
        self.feature = np.array([x for f in feats for x in f], int)
        self.gold = np.array(gold, int)
        longest = max(self.lengths, default=0)
        self.by_end = [np.flatnonzero(self.end == j) for j in range(longest + 1)]
        self.by_first = [np.flatnonzero(self.first == i) for i in range(longest + 1)]
        touch = {(r, e) for r, e, g in zip(rows, ends, gold, strict=True) if g >= 0}
        self.touched = sum((r, i) in touch for r, i, g in zip(rows, firsts, gold, strict=True) if g >= 0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.row):
            return np.zeros((0, len(KINDS)))
        return np.add.reduceat(weights[self.feature], self.starts, axis=0)

    def expected(self, scores: np.ndarray, touching: float) -> tuple[np.ndarray, float, float]:
        """(probability of every segment and kind, expected number of touching entities, log of all weights)."""
        regions_, longest = len(self.lengths), max(self.lengths, default=0)
        top = scores.max(axis=1, initial=-700)
        summed = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        by_end, by_first = self.by_end, self.by_first

        def gathered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            most = np.full(regions_, -np.inf)
            np.maximum.at(most, rows, values)
            safe = np.where(np.isfinite(most), most, 0)
            total = np.zeros(regions_)
            np.add.at(total, rows, np.exp(values - safe[rows]))
            with np.errstate(divide="ignore"):
                return safe + np.log(total)

        outside = np.full((longest + 1, regions_), -np.inf)
        inside = np.full((longest + 1, regions_), -np.inf)
        outside[0] = 0
        for j in range(1, longest + 1):
            outside[j] = np.logaddexp(outside[j - 1], inside[j - 1])
            own = by_end[j]
            i, r = self.first[own], self.row[own]
            inside[j] = gathered(r, summed[own] + np.logaddexp(outside[i, r], inside[i, r] + touching))
        # What follows a place, after an atom outside or after an entity.
        after_out = np.full((longest + 1, regions_), -np.inf)
        after_in = np.full((longest + 1, regions_), -np.inf)
        lengths = np.array(self.lengths, int)
        for i in range(longest, -1, -1):
            own = by_first[i]
            onward = gathered(self.row[own], summed[own] + after_in[self.end[own], self.row[own]])
            step = after_out[i + 1] if i < longest else np.full(regions_, -np.inf)
            after_out[i] = np.logaddexp(step, onward)
            after_in[i] = np.logaddexp(step, onward + touching)
            after_out[i, lengths == i] = after_in[i, lengths == i] = 0
        whole = after_out[0] if regions_ else np.zeros(0)
        i, r, j = self.first, self.row, self.end
        rest = after_in[j, r] - whole[r]
        before = np.logaddexp(outside[i, r], inside[i, r] + touching)
        share = np.exp(summed + before + rest)
        each = np.exp(scores - summed[:, None]) * share[:, None]
        touches = np.exp(summed + inside[i, r] + touching + rest).sum()
        return each, float(touches), float(whole.sum())

    def gradient(self, weights: np.ndarray, touching: float) -> tuple[np.ndarray, float, float]:
        """(by weights, by touching, log likelihood) of the examples, without the penalty."""
        scores = self.scores(weights)
        each, touches, whole = self.expected(scores, touching)
        held = self.gold >= 0
        each[held, self.gold[held]] -= 1
        columns = [np.bincount(self.feature, -each[self.edge, k], len(weights)) for k in range(len(KINDS))]
        slope = np.stack(columns, axis=1)
        reached = scores[held, self.gold[held]].sum() + touching * self.touched
        return slope, self.touched - touches, reached - whole


def fitted(examples: list[tuple[str, list[Span]]]) -> Model:
    """The model with the greatest penalised likelihood of the examples' segmentations, by adaptive steps."""
    lattice = _Lattice(examples)
    weights, touching = np.zeros((len(lattice.places), len(KINDS))), 0.0
    flat, first, second = np.zeros(weights.size + 1), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        slope, own, _ = lattice.gradient(flat[:-1].reshape(weights.shape), float(flat[-1]))
        slope = np.concatenate((slope.ravel(), [own])) - SHRINK * flat
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        flat = flat + STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(lattice.places, flat[:-1].reshape(weights.shape), float(flat[-1]))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, right: bool) -> str:
    while True:
        digits = rng.choice("3456") + _digits(rng, 15)
        if luhn(digits) == right:
            return digits


def _entity(rng: random.Random, kind: str) -> str:
    """An entity of the kind, written in one of its usual forms."""
    if kind == "email":
        name = "".join(rng.choice("abcdeiklmnoprstu") for _ in range(rng.randrange(3, 9)))
        name += rng.choice(("", "", "." + _digits(rng, 2), "_" + name[:3], "." + name[:4]))
        labels = rng.choice((["example", "com"], ["mail" + _digits(rng, 1), "example", "com"], ["uni", "example", "org"], ["post", "net"]))
        at, dot = rng.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", " . "), (" AT ", " DOT ")))
        return name + at + dot.join(labels)
    if kind == "ip":
        dot = rng.choice((".", ".", "[.]", "(.)", " . ", "[.]"))
        return dot.join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == "card":
        digits, sep = _card(rng, True), rng.choice(("", "", " ", "-", ".", "_", "/", "  "))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    area, mid, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    area = str(rng.randrange(2, 10)) + area[1:]
    forms = ("+1 ({}) {}-{}", "+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}", "001 {} {} {}", "+1/{}/{}/{}", "+1 {} {} {}", "1 ({}) {}-{}", "+1_{}_{}_{}")
    return rng.choice(forms).format(area, mid, last)


def _other(rng: random.Random) -> str:
    """Numbers and words that look a little like an entity and are none."""
    d = lambda n: _digits(rng, n)
    forms = (
        lambda: d(rng.randrange(5, 21)) if rng.random() < 0.5 else _card(rng, False),
        lambda: rng.choice((" ", "-", ".")).join(_card(rng, False)[i : i + 4] for i in (0, 4, 8, 12)),
        lambda: f"20{d(2)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}",
        lambda: f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.20{d(2)} {rng.randrange(10, 24)}:{rng.randrange(10, 60)}",
        lambda: f"20{d(2)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} {rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}",
        lambda: f"{rng.randrange(1, 20)}.{rng.randrange(0, 40)}.{d(3)}",
        lambda: f"{rng.randrange(256, 999)}.{d(3)}.{rng.randrange(256, 999)}.{rng.randrange(300, 999)}",
        lambda: f"{d(1)}.{d(rng.randrange(5, 14))}",
        lambda: ",".join([str(rng.randrange(1, 999)), d(3), d(3), d(3)][: rng.randrange(2, 5)]),
        lambda: " ".join(str(rng.randrange(1, 10**rng.randrange(1, 6))) for _ in range(rng.randrange(3, 14))),
        lambda: ", ".join(str(rng.randrange(1, 999)) for _ in range(rng.randrange(3, 9))),
        lambda: f"{rng.randrange(1000, 2000)}-{rng.randrange(2000, 3000)}",
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"look at {rng.choice(('the', 'this', 'a'))} dot {rng.choice(('product', 'plot', 'and line'))}",
        lambda: f"meet at {rng.randrange(1, 12)}.{rng.randrange(10, 60)} or dot by dot",
        lambda: f"@{rng.choice(('home', 'all', 'param'))} {rng.choice(('is', 'the'))}. Then",
    )
    return rng.choice(forms)()


def made_examples(words: list[str], count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """`count` short texts of the words around an entity in a usual form, or around what is none."""
    rng = random.Random(seed)
    words = [w for w in words if not any(c.isdigit() or c == "@" for c in w)] or ["word"]
    out = []
    for n in range(count):
        before = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
        after = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
        kind = KINDS[n % 8] if n % 8 < 4 else None
        middle = _entity(rng, kind) if kind else _other(rng)
        start = before + (rng.choice((" ", " ", "\n", " (", ": ")) if before else "")
        text = start + middle + rng.choice((" ", " ", ". ", ", ", "\n", ") ")) + after
        spans = [(kind, len(start), len(start) + len(middle))] if kind else []
        # What the patterns find by itself is an entity too.
        spans += [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in spans)]
        out.append((text, spans))
    return out
