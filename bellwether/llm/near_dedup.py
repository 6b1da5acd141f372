"""Near-duplicate documents by fast similarity sketches, banding and exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.buckets import bucket_components
from bellwether.llm.membership import possible
from bellwether.llm.scratch import bounded_batches, dropped, written
from bellwether.llm.words import hashed, mixed, seed, shingle_hashes, slices, split_words

BINS, ROWS = 96, 4  # 24 bands of 4 coordinates
RARE = 64  # holders of a rare item, at most
MARKS = 8  # longs in which a set marks its items, a bit each
_EMPTY = np.uint64(2**64 - 1)
_BIN = seed(1 << 20)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashed items.

    In round i every item is thrown into one bin with a value of that round; a
    bin keeps the smallest value of the first round that reached it. After
    `bins` rounds, round bins + j throws all items into bin j, so every
    coordinate is filled. Two sets agree in a coordinate with the probability of
    their Jaccard similarity; large sets need one or two rounds.
    """
    kept = np.full(bins, _EMPTY)
    for i in range(bins):
        value = mixed(items ^ seed(i))
        fresh = np.full(bins, _EMPTY)
        np.minimum.at(fresh, (mixed(value + _BIN) % np.uint64(bins)).astype(np.intp), value)
        empty = kept == _EMPTY
        kept[empty] = fresh[empty]
        if not (kept == _EMPTY).any():
            return kept
    for j in np.flatnonzero(kept == _EMPTY):
        kept[j] = mixed(items ^ seed(bins + int(j))).min()
    return kept


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hashed key per band of `rows` coordinates; bands have keys of their own."""
    table = coordinates.reshape(-1, rows)
    keys = np.arange(len(table), dtype=np.uint64) * seed(7) + seed(11)
    for column in table.T:
        keys = mixed(keys * seed(5) + column)
    return keys.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            codes, starts, words = split_words(pc.ascii_lower(part.column("text")))
            of_word = hashed(words)[codes] if len(codes) else np.zeros(0, np.uint64)
            yield (
                part,
                [np.unique(shingle_hashes(of_word[a:b], k)) for a, b in zip(starts, starts[1:], strict=False)],
            )


def _signed(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tid, n, d1, d2, bands): hash of the text, set size, 128-bit digest of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            first = [int(mixed(s ^ seed(1)).sum(dtype=np.uint64)) for s in sets]
            second = [int(np.bitwise_xor.reduce(mixed(s ^ seed(2)))) for s in sets]
            bands = [band_keys(sketch(s)).view(np.uint64) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("tid"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    _signed(bands),
                ],
                ["doc_id", "tid", "n", "d1", "d2", "bands"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(
        run, "doc_id long, tid long, n long, d1 long, d2 long, bands array<long>"
    )


def marks(items: np.ndarray) -> np.ndarray:
    """MARKS longs with the bit of every item set. Bits that only one of two sets has stand for different items."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(items % np.uint64(64 * MARKS)).astype(np.intp)] = 1
    return np.packbits(bits).view(np.int64)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, items, marks): the hashed shingle set of every document and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            table = np.array([marks(s) for s in sets], np.int64).reshape(-1, MARKS)
            columns = [pa.array(np.ascontiguousarray(column)) for column in table.T]
            bits = pa.StructArray.from_arrays(columns, [f"m{i}" for i in range(MARKS)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _signed(sets), bits], ["id", "items", "marks"])

    kind = ", ".join(f"m{i}: long" for i in range(MARKS))
    return docs.select("doc_id", "text").mapInArrow(run, f"id long, items array<long>, marks struct<{kind}>")


def _missing(a: str, b: str) -> Column:
    """Items of a that b lacks, at least: the bits of a that b has not; 0 where nothing is known."""
    bits = [F.bit_count(F.col(f"{a}.m{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.m{i}")))) for i in range(MARKS)]
    return F.coalesce(reduce(lambda x, y: x + y, bits), F.lit(0))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs(a, b, ...) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("shared", F.size(F.array_intersect("x", "y")))
        .filter(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared")))
        .select(*pairs.columns)
    )


def _rare(
    ids: DataFrame, sets: DataFrame, percent: int, marked: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(id, own, alone), and buckets (key, id, n, own) of the ids that share a rare item, with marks if marked has them.

    An item is rare if at most RARE of these ids hold it. All pairs that meet in none of the
    buckets share none of their rare items; an id that has too few others is alone among
    those. Items that the same ids hold make one bucket, told by two sums of hashed ids.
    """
    held = sets.join(ids, "id").select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    digest = F.xxhash64("id")
    holders = held.groupBy("item").agg(
        F.count("*").alias("holders"), F.bit_xor(digest).alias("x"), F.sum(F.shiftright(digest, 20)).alias("s")
    )
    few = holders.filter(F.col("holders") <= RARE)
    counts = written(held.join(few.select("item"), "item").groupBy("id", "n").agg(F.count("*").alias("own")), "rare")
    keys = few.filter("holders > 1").groupBy("holders", "x", "s").agg(F.min("item").alias("item"))
    none = F.lit(0).cast("long").alias("own")
    shared = held.join(keys.select("item"), "item").select(F.col("item").alias("key"), "id", F.col("n").cast("long"), none)
    alone = 100 * (F.col("n") - F.col("own")) < percent * F.col("n")
    if marked is not None:
        shared = shared.join(marked, "id", "left")
    return counts.select("id", "own", alone.alias("alone")), written(shared, "shared")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, tid, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    Documents link when their sets of distinct k-word shingles (A-Z lower-cased)
    have 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable over links, and kept says that it is the row's own. tid is a
    hash of the text.

    Equal sets are one class before anything is paired. Classes that share a
    band key form a bucket, and bucket_components() decides all candidates, on
    the full sets, whatever the size of a bucket. Members of large buckets that share
    a rare item are compared directly; what is not rare bounds what others can share.
    Pairs whose marks alone tell that they differ too much never fetch their sets.

    Null and empty texts and texts without a word have no shingles, link with
    nothing and stay. A null doc_id cannot be linked: component_id is null and
    the row is kept. Rows that repeat a doc_id are each judged by their own text.
    Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    table = written(sketches(docs, k), "sketches")
    known = table.filter("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = written(classes.select("n", "d1", "d2", F.col("least.doc_id").alias("id"), "least.bands"), "classes")
    keyed = classes.select("id", "n", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    own = F.lit(0).cast("long").alias("own")
    met = written(keyed.join(shared, "key").select("key", "id", "n", own), "met")
    wanted = written(met.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    near_docs = possible(docs.select("doc_id", "text"), ["doc_id"], wanted)
    sets = written(shingle_sets(near_docs.join(wanted, "doc_id", "left_semi"), k), "sets")
    # Of an id with several texts the marks tell nothing.
    same = F.when(F.min("marks") == F.max("marks"), F.min("marks"))
    marked = written(sets.groupBy("id").agg(same.alias("marks")), "marks")
    buckets = written(met.join(marked, "id", "left").select("key", "id", "n", "own", "marks"), "buckets")
    dropped(met)

    n, n_2 = F.col("n"), F.col("n_2")
    most = F.least(
        n - F.col("own"), n_2 - F.col("own_2"), n - _missing("marks", "marks_2"), n_2 - _missing("marks_2", "marks")
    )
    label = bucket_components(
        buckets,
        (100 + percent) * most >= percent * (n + n_2),
        lambda pairs: _linked(pairs, sets, percent),
        lambda ids: _rare(ids, sets, percent, marked),
    )
    for done in (buckets, wanted, sets, marked):
        dropped(done)
    heads = classes.select("n", "d1", "d2", F.col("id").alias("head"))
    found = table.join(heads, ["n", "d1", "d2"], "left")
    found = found.join(label.select(F.col("id").alias("head"), "component"), "head", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head", "doc_id"))
    return found.select(
        "doc_id",
        "tid",
        F.col("n").alias("n_shingles"),
        whole.alias("component_id"),
        F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"),
    )
