"""Alignment of two tokenizers: groups of tokens between shared byte offsets, and their id pairs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNIT = re.compile(r"(?<=\S)(?= )")  # before a blank that follows no white space

_loaded: dict[tuple[str, str], Pair] = {}


def _byte_of_letter() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, turned round.

    Printable Latin-1 letters stand for themselves, all others for letters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tokens:
    """Bytes of every token of a vocabulary, and its id as text."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.names = pa.array([str(i) for i in range(len(entries))])

    def written(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        return self.flat[spread(self.starts[ids], self.sizes[ids])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Pair:
    """The byte-level vocabulary of one file (A) and the piece model of another (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab, letters = self.first.get_vocab(with_added_tokens=True), _byte_of_letter()
        entries = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            entries[i] = bytes(letters[x] for x in entry) if all(x in letters for x in entry) else entry.encode()
        self.a = _Tokens(entries)
        pieces = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            whole = self.second.is_byte(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if whole else piece.replace("▁", " ").encode())
        self.b = _Tokens(pieces)

    @staticmethod
    def of(path_a: str, path_b: str) -> Pair:
        if (path_a, path_b) not in _loaded:
            _loaded[path_a, path_b] = Pair(path_a, path_b)
        return _loaded[path_a, path_b]

    def encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit); every unit is a blank and one of `units`."""
        found = self.first.encode_batch_fast([" " + u for u in units], add_special_tokens=False) if units else []
        lists = [e.ids for e in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int64, int(sizes.sum())), sizes

    def encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the piece model, which puts the blank itself."""
        found = self.second.encode(units, num_threads=1) if units else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum())), sizes


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(unit numbers of all texts in order, start of each text and end, distinct units without their first blank).

    A blank and the text are cut before every blank that follows no white space and does
    not end the text, so both tokenizers encode each unit as if it stood alone. Null and
    empty texts have no units.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    odd = np.array([not w or w[-1].isspace() for w in names], bool)
    odd_texts = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(odd[codes] if len(codes) else codes)))[starts]))
    if not len(odd_texts):
        return codes, starts, names
    places = {w: i for i, w in enumerate(names)}
    parts, sizes, last = [], np.diff(starts), 0
    for row in odd_texts.tolist():
        text = texts[row].as_py()
        units = _UNIT.split(" " + text) if text else []
        if len(units) > 1 and units[-1].isspace():
            units[-2:] = [units[-2] + units[-1]]
        own = [places.setdefault(u[1:], len(places)) for u in units]
        parts += [codes[last : starts[row]], np.array(own, np.int64)]
        sizes[row], last = len(own), starts[row + 1]
    codes = np.concatenate([*parts, codes[last:]])
    used, codes = np.unique(codes, return_inverse=True)
    names = list(places)
    return codes, np.concatenate(([0], np.cumsum(sizes))), [names[i] for i in used.tolist()]


class Aligned:
    """Tokens, groups and links of distinct units.

    ok tells whose bytes both vocabularies give back; all figures of the others are 0.
    Unit i has groups group_starts[i] to group_starts[i + 1], and links of pair numbers
    links[link_starts[i] : link_starts[i + 1]] into pairs (A's id times 2^32 plus B's).
    """

    def __init__(self, pair: Pair, units: list[str]):
        raw = [(" " + u).encode() for u in units]
        sizes = np.array([len(x) for x in raw], np.int64)
        ids_a, per_a = pair.encode_a(units)
        ids_b, per_b = pair.encode_b(units)
        self.ok = _lossless(pair.a, ids_a, per_a, raw, sizes) & _lossless(pair.b, ids_b, per_b, raw, sizes)
        self.n_a, self.n_b = np.where(self.ok, per_a, 0), np.where(self.ok, per_b, 0)
        ids_a, ids_b = ids_a[np.repeat(self.ok, per_a)], ids_b[np.repeat(self.ok, per_b)]
        ends_a, ends_b = np.cumsum(pair.a.sizes[ids_a]), np.cumsum(pair.b.sizes[ids_b])
        shared = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        edges_a = np.concatenate(([0], np.searchsorted(ends_a, shared, "right")))
        edges_b = np.concatenate(([0], np.searchsorted(ends_b, shared, "right")))
        own_a, own_b = np.diff(edges_a), np.diff(edges_b)
        unit_ends = np.cumsum(np.where(self.ok, sizes, 0))
        self.group_starts = np.concatenate(([0], np.searchsorted(shared, unit_ends, "right")))
        self.link_starts = np.concatenate(([0], np.cumsum(own_a * own_b)))[self.group_starts]
        group = np.repeat(np.arange(len(shared)), own_a * own_b)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(own_a * own_b) - own_a * own_b, own_a * own_b)
        link = (ids_a[edges_a[group] + nth // own_b[group]] << 32) | ids_b[edges_b[group] + nth % own_b[group]]
        self.pairs, self.links = np.unique(link, return_inverse=True)
        lists = [
            pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), names.take(pa.array(ids))), ",")
            for edges, names, ids in ((edges_a, pair.a.names, ids_a), (edges_b, pair.b.names, ids_b))
        ]
        groups = pc.binary_join_element_wise(*lists, "|")
        self.shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.group_starts, pa.int32()), groups), ";")


def _lossless(tokens: _Tokens, ids: np.ndarray, per: np.ndarray, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether the ids of each unit give its bytes."""
    ends = np.concatenate(([0], np.cumsum(tokens.sizes[ids])))[np.concatenate(([0], np.cumsum(per)))]
    ok = np.diff(ends) == sizes
    given = tokens.written(ids[np.repeat(ok, per)])
    wanted = np.frombuffer(b"".join([x for x, same in zip(raw, ok.tolist(), strict=True) if same]), np.uint8)
    wrong = np.concatenate(([0], np.cumsum(given != wanted)))
    bounds = np.concatenate(([0], np.cumsum(np.where(ok, sizes, 0))))
    return ok & (np.diff(wrong[bounds]) == 0)
