"""Periodic runs of words by recursive frequency splitting and a lag scan of what survives."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches
from bellwether.llm.words import mixed, seed, slices, split_words

SHORTEST, TIMES = 24, 3  # words of a run at least, and periods of it at least
WINDOW = 8  # words that a probe of the lag scan compares at once
ROUNDS = 200  # splitting only narrows what the lag scan reads, so ending it early loses nothing
SLICE = 1 << 20  # bytes of texts that a worker holds as word numbers at once
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(first, end) of every segment that can hold a run; words are numbers, starts the bounds of the texts.

    A run has every word of it at least TIMES times, so a word that is rarer
    within its segment splits the segment. What is left is counted anew, segment by
    segment, until none splits; segments of fewer than SHORTEST words go.
    """
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    done = [np.zeros((0, 2), np.int64)]
    for _ in range(ROUNDS):
        if not len(at):
            break
        # Rows of equal (segment, word) lie together after the sort.
        order = np.lexsort((words[at], segment))
        w, s = words[at][order], segment[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
        first = np.flatnonzero(new)
        times = np.diff(np.concatenate((first, [len(w)])))
        frequent = np.empty(len(at), bool)
        frequent[order] = np.repeat(times >= TIMES, times)
        _, inverse = np.unique(segment, return_inverse=True)
        split = np.bincount(inverse, weights=~frequent) > 0
        whole = ~split[inverse]
        done.append(_bounds(at[whole], segment[whole]))
        kept = ~whole & frequent
        at, segment = at[kept], segment[kept]
        if len(at):
            gap = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(segment) != 0)))
            segment = np.cumsum(gap) - 1
            long = np.bincount(segment) >= SHORTEST
            at, segment = at[long[segment]], segment[long[segment]]
    done.append(_bounds(at, segment))
    found = np.concatenate(done)
    found = found[found[:, 1] - found[:, 0] >= SHORTEST]
    return found[np.argsort(found[:, 0])]


def _bounds(at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros((0, 2), np.int64)
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    last = np.concatenate((edge[1:], [len(at)])) - 1
    return np.stack((at[edge], at[last] + 1), axis=1)


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch of places around `at`, which equals at + lag, that all equal the place one lag on."""

    def reach(step: int, room: int) -> int:
        gone, size = 0, 64
        while gone < room:
            size = min(size, room - gone)
            a = at + step * (gone + 1) if step > 0 else at - gone - size
            same = words[a : a + size] == words[a + lag : a + lag + size]
            if not same.all():
                return gone + int(np.argmin(same if step > 0 else same[::-1]))
            gone, size = gone + size, 2 * size
        return gone

    return at - reach(-1, at), at + reach(1, len(words) - lag - 1 - at) + 1


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by start and period.

    At a run's period, at least max(2 periods, SHORTEST - period) places in a row equal the
    place one period on. So it is enough to compare windows of WINDOW words at places that far
    apart, which makes n log n comparisons over all lags; only windows that agree are
    extended. Lags go upwards, so a stretch is first met at its smallest period,
    and its multiples within a known run are passed over.
    """
    n = len(words)
    if n < SHORTEST:
        return []
    prints = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        prints = prints * np.uint64(0x9E3779B97F4A7C15) + mixed(words[j : j + len(prints)].astype(np.uint64) + seed(1))
    found: dict[tuple[int, int], int] = {}
    cover = np.zeros(n, np.int64)  # one more than the number of the last run found at a place
    starts, ends, periods = [], [], []
    low = 1
    while low <= n // TIMES:
        lags = np.arange(low, min(2 * low, n // TIMES + 1))
        apart = np.maximum((TIMES - 1) * lags, SHORTEST - lags) - WINDOW + 1
        counts = np.maximum(0, (len(prints) - lags - 1) // apart + 1)
        lag = np.repeat(lags, counts)
        place = np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)
        place *= np.repeat(apart, counts)
        hit = prints[place] == prints[place + lag]
        place, lag = place[hit], lag[hit]
        if periods:
            run = cover[place] - 1
            known = (run >= 0) & (lag % np.array(periods)[run] == 0) & (place + lag + WINDOW <= np.array(ends)[run])
            place, lag = place[~known], lag[~known]
        for i, q in zip(place.tolist(), lag.tolist(), strict=True):
            run = int(cover[i]) - 1
            if run >= 0 and q % periods[run] == 0 and i + q + WINDOW <= ends[run]:
                continue
            if words[i] != words[i + q]:
                continue  # equal prints of different windows
            a, b = _stretch(words, i, q)
            if b - a + q >= max(SHORTEST, TIMES * q) and (a, b + q) not in found:
                found[a, b + q] = q
                starts.append(a)
                ends.append(b + q)
                periods.append(q)
                cover[a : b + q] = len(periods)
        low *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(text, runs) of every text that has runs; run starts count from the text's first word."""
    segments = surviving(words, starts)
    texts = np.searchsorted(starts, segments[:, 0], "right") - 1
    for text in np.unique(texts).tolist():
        runs = []
        for a, b in segments[texts == text].tolist():
            runs += [(start + a - int(starts[text]), n, q) for start, n, q in lag_scan(words[a:b])]
        if runs:
            yield text, sorted(runs, key=lambda r: (r[0], r[2]))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of periodic_runs() of batches with doc_id and text, SLICE bytes of texts at a time."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words, starts, names = split_words(part.column("text"))
            kept = np.ones(len(words), bool)
            rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for text, runs in runs_of(words, starts):
                for start, length, period in runs:
                    first = int(starts[text]) + start
                    kept[first + period : first + length] = False
                rows[text] = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            ends = np.concatenate(([0], np.cumsum(kept)))[starts]
            left = names.take(pa.array(words[kept])).cast(pa.string())
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left), " ")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(starts)),
                    pa.array(rows, RUNS),
                    texts,
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs(doc_id, text).

    Words are maximal stretches without ASCII white space. A run is a stretch of consecutive words
    with smallest period q and at least max(SHORTEST, TIMES * q) words that no
    neighbouring word prolongs; runs has (start, length, period) of all of them, by start, then
    period. collapsed has the words, one blank apart, without those that a run holds after its
    first q words.

    Every row is judged by its own text, also where doc_id is null or repeated. Null and empty
    texts and texts without a word have no runs and an empty collapsed text. Very long
    texts are read whole: the scan needs n log n comparisons of a segment's n words. Other columns
    are ignored, whatever their names; an empty table gives no rows. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)

    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as with_repeats() has them, SLICE bytes of texts at a time."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            texts = part.column("text").to_pylist()
            for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                words = _WORD.findall(texts[row] or "") if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[row] = " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), the texts of every tenth id (by h = crc32 of the decimal id) made periodic.

    With g = h // 10 and n words, words from place a = g % n on repeat the first
    p = 1 + (n - a) // (3 + g % 8) of them. Texts without a word and rows without an id stay as they are.
    """
    bounded_batches(docs.sparkSession)

    return docs.select("doc_id", "text").mapInArrow(repeated, "doc_id long, text string")


def run_report(found: DataFrame) -> DataFrame:
    """The row of periodic_runs() with its best run and digests in place of lists and texts.

    The best run has the greatest length / period, then the smallest start, then the smallest period.
    """
    runs = F.col("runs")
    best = F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x),
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
