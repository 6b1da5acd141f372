"""Known names in texts by a word trie, one pass per text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.operators import entities
from bellwether.sources.steps import stored

HELD = 200_000  # names that one worker holds as a trie; longer lists meet the texts by a join
_WORD = re.compile(r"\w+")
_END = ""  # the key of a node's names, as no word is empty


class Trie:
    """Names by their words; a name stands where its words follow one another and its letters are all there."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for number, name in enumerate(names):
            low, node = name.lower(), self.root
            words = _WORD.findall(low)
            if not words:
                continue
            for word in words:
                node = node.setdefault(word, {})
            # Letters before the first word, as in "(apple)".
            node.setdefault(_END, []).append((low.find(words[0]), low, number))

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number) of every name that stands in the lower-case text between word edges."""
        tokens = [(m[0], m.start()) for m in _WORD.finditer(text)]
        for first, (_, at) in enumerate(tokens):
            node = self.root
            for word, _ in tokens[first:]:
                node = node.get(word)
                if node is None:
                    break
                for before, low, number in node.get(_END, ()):
                    start = at - before
                    if start >= 0 and text.startswith(low, start) and _bounded(text, low, start):
                        yield start, start + len(low), number


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    inside = [0 <= i < len(text) and (text[i].isalnum() or text[i] == "_") for i in (at - 1, at)]
    return inside[0] != inside[1]


def _bounded(text: str, low: str, start: int) -> bool:
    return _edge(text, start) and _edge(text, start + len(low))


def longest_first(text: str, names: list[tuple[str, str]]) -> list[str]:
    """Of names (lower-case form, name) in a text, those left when longer ones are removed before shorter ones are tried."""
    if len(names) == 1:
        return [names[0][1]]
    rest, found = text, []
    for low, name in sorted(names, key=lambda n: (-len(n[1]), n[1])):
        at = rest.find(low)
        while at >= 0 and not _bounded(rest, low, at):
            at = rest.find(low, at + 1)
        if at >= 0:
            found.append(name)
            rest = rest.replace(low, "")
    return found


def known_names(known: DataFrame, name: str) -> list[str] | None:
    """The different names, in order; None where there are more than HELD."""
    distinct = known.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    rows = distinct.limit(HELD + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= HELD else None


def names_in_texts(
    texts: DataFrame, known: DataFrame, key: str = "question_id", text: str = "question", name: str = "company"
) -> DataFrame:
    """Known names in each text, as (key, name): whole words, in any case, longest first.

    A name that is found is removed from the text before shorter ones are tried. Texts of short
    lists are read once, where they are; for more than HELD names, names and texts meet
    on words instead, with the same result. A text without a known name has no row.
    """
    # The list is written once: it is read by the count and by either way.
    listed = stored(known.select(name).distinct(), "names")
    names = known_names(listed, name)
    if names is None:
        return entities.gazetteer_match(texts, listed, key, text, name)
    trie = Trie(names)
    lows = [n.lower() for n in names]
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, raw in enumerate(batch.column(text).to_pylist()):
                low = (raw or "").lower()
                numbers = {n for _, _, n in trie.hits(low)}
                if numbers:
                    own = longest_first(low, [(lows[n], names[n]) for n in numbers])
                    rows += [row] * len(own)
                    found += own
            keys = batch.column(key).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string())], [key, name])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{name}` string")


def earliest_names(
    headlines: DataFrame, names: DataFrame, key: str, headline: str = "headline"
) -> DataFrame:
    """(key, spelling): the known spelling that stands first in each headline, the longer one at one place.

    names has (spelling, as_written, ticker); as_written spellings count in their own case only.
    Of spellings that differ in case only, the first as such. A headline without one has no row.
    More than HELD spellings meet the headlines by a join on words, with the same result.
    """
    listed = stored(names.select("spelling", "as_written").filter("spelling <> ''").distinct(), "spelt")
    rows = sorted(tuple(r) for r in listed.limit(HELD + 1).collect())
    if len(rows) > HELD:
        return entities.earliest_spelling(headlines, listed, key, headline)
    trie, kind = Trie([r[0] for r in rows]), dict(headlines.dtypes)[key]

    def first(raw: str) -> str | None:
        low = raw.lower()
        places = [
            (start, start - end, rows[n][0])
            for start, end, n in trie.hits(low)
            if not rows[n][1] or (len(low) == len(raw) and raw.startswith(rows[n][0], start))
        ]
        return min(places)[2] if places else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first(x) if x else None for x in batch.column(headline).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], [key, "spelling"])

    return headlines.select(key, headline).mapInArrow(run, f"`{key}` {kind}, spelling string").filter(
        "spelling is not null"
    )


def resolved_companies(
    headlines: DataFrame, company_dim: DataFrame, aliases: DataFrame, key: str, headline: str = "headline"
) -> DataFrame:
    """(key, spelling, company): the first known name of each headline, resolved like any other name.

    company is "" for a name that the resolver does not know.
    """
    names = entities.name_list(company_dim, aliases)
    found = stored(earliest_names(headlines, names, key, headline), "spellings")
    resolved = entities.resolve_names(found, company_dim, aliases, "spelling")
    return found.join(resolved, "spelling").select(key, "spelling", "company")
