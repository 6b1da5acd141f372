"""Cross-tokenizer alignment: inverted bitmaps of linked id pairs, and the scores their postings return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.cross_tokens import Aligned, Pair, spread, units_of
from bellwether.llm.scratch import bounded_batches, written
from bellwether.llm.words import slices

SHARD_BYTES, SHARD_ROWS = 4 << 20, 1 << 16  # texts of one shard of the index; places in it have 16 bits
SLICE = 2_000_000  # links whose documents are sorted at once
_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("place", pa.int32())]
    + [(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("pair", pa.int64())]
    + [(name, pa.int32()) for name in ("plane", "holders", "documents")]
    + [("bits", pa.binary())]
)
_ROW = (
    "shard long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pair long, plane int, holders int, documents int, bits binary"
)
_DOC_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_INDEX_NAMES = ["pair", "plane", "holders", "documents", "bits"]


def _words_of(documents: np.ndarray) -> np.ndarray:
    """16-bit words of a bitmap over so many documents."""
    return (documents + 15) // 16


def packed(row: np.ndarray, place: np.ndarray, rows: int, documents: int) -> tuple[np.ndarray, pa.Array]:
    """(holders, bits) of bitmaps given by (row, place), sorted and each once.

    A bitmap is a list of 16-bit places or a plain bitmap over the shard's documents,
    whichever is shorter.
    """
    holders = np.bincount(row, minlength=rows)
    dense = holders > _words_of(documents)
    sizes = np.where(dense, _words_of(documents), holders)
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint16)
    listed = ~dense[row]
    nth = np.arange(len(row)) - (np.cumsum(holders) - holders)[row]
    data[(starts[row] + nth)[listed]] = place[listed]
    row, place = row[~listed], place[~listed]
    # Every (row, place) is there once, so adding a bit sets it.
    np.add.at(data, starts[row] + (place >> 4), (np.uint16(1) << (place & 15).astype(np.uint16)).astype(np.uint16))
    ends = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
    return holders, pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(holders: np.ndarray, documents: np.ndarray, bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every document in the bitmaps."""
    data = np.frombuffer(b"".join(bits.to_pylist()), np.uint16)
    dense = holders > _words_of(documents)
    sizes = np.where(dense, _words_of(documents), holders)
    starts = np.cumsum(sizes) - sizes
    lists, plain = np.flatnonzero(~dense), np.flatnonzero(dense)
    rows, places = [np.repeat(lists, sizes[lists])], [data[spread(starts[lists], sizes[lists])].astype(np.int64)]
    word_row = np.repeat(plain, sizes[plain])
    word_no = spread(np.zeros(len(plain), np.int64), sizes[plain])
    words = data[spread(starts[plain], sizes[plain])]
    for bit in range(16):
        held = (words >> np.uint16(bit)) & np.uint16(1) == 1
        rows.append(word_row[held])
        places.append(word_no[held] * 16 + bit)
    return np.concatenate(rows), np.concatenate(places)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, times) of all parts, equal codes of different parts added up: the OR of their bitmaps."""
    code = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
    times = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(times, first) if len(first) else times


def _shard(pair: Pair, ids: pa.Array, texts: pa.Array) -> tuple[list[pa.Array], list[pa.Array]]:
    """The columns of the shard's documents and of its part of the index."""
    codes, starts, units = units_of(texts)
    aligned = Aligned(pair, units)
    documents = len(ids)
    doc = np.repeat(np.arange(documents), np.diff(starts))
    # A text with a unit that is not given back has no tokens at all.
    lost = np.bincount(doc, weights=~aligned.ok[codes], minlength=documents) > 0
    kept = ~lost[doc]
    codes, doc = codes[kept], doc[kept]
    starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=documents))))

    def per_document(of_unit: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate(([0], np.cumsum(of_unit[codes])))[starts]).astype(np.int64))

    per_unit = np.diff(aligned.link_starts)
    shown = aligned.shown.take(pa.array(codes))
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), shown), ";")
    figures = [per_document(x) for x in (aligned.n_a, aligned.n_b, np.diff(aligned.group_starts), per_unit)]

    parts = []
    sizes = per_unit[codes]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for own_codes, own_doc in zip(np.split(codes, cuts), np.split(doc, cuts), strict=True):
        own = per_unit[own_codes]
        link = aligned.links[spread(aligned.link_starts[own_codes], own)]
        parts.append(np.unique(link * SHARD_ROWS + np.repeat(own_doc, own), return_counts=True))
    code, times = _merged(parts)
    further = times - 1
    # Plane 0 has all documents; plane k those whose further links have bit k - 1.
    planes = [np.ones(len(code), bool)]
    planes += [(further >> k) & 1 == 1 for k in range(int(further.max(initial=0)).bit_length())]
    pairs, holders, bits = [], [], []
    for held in planes:
        present, row = np.unique(code[held] // SHARD_ROWS, return_inverse=True)
        count, data = packed(row, code[held] % SHARD_ROWS, len(present), documents)
        pairs.append(aligned.pairs[present])
        holders.append(count)
        bits.append(data)
    rows = sum(map(len, pairs))
    index = [
        pa.array(np.concatenate(pairs)),
        pa.array(np.repeat(np.arange(len(planes)), list(map(len, pairs))).astype(np.int32)),
        pa.array(np.concatenate(holders).astype(np.int32)),
        pa.array(np.full(rows, documents, np.int32)),
        pa.concat_arrays(bits),
    ]
    return [ids, *figures, groups], index


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and (size + own > SHARD_BYTES or rows + part.num_rows > SHARD_ROWS):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
            held.append(part)
            size, rows = size + own, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, columns: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, index) of docs(doc_id, text) under a byte-level vocabulary A and a piece model B.

    A encodes a blank and the text, B the text, to which it adds the blank itself. Offsets where
    tokens of both end cut the tokens into groups; every A token and every B token of a group are linked.

    documents has (shard, place, doc_id, n_a, n_b, n_groups, n_links) and the given columns, by
    default groups: the ids of each group as a1,a2|b1, groups joined by semicolons. index has,
    for each pair of linked ids (pair: A's times 2^32 plus B's) of a shard, a compressed
    bitmap of the shard's documents that hold the link (plane 0), and bitmaps of those
    whose number of further links has bit k - 1 set (plane k).

    Texts that are null or empty, or that either vocabulary does not give back byte by byte,
    have no tokens: zeros, and an empty groups column. Rows are documents, also
    where doc_id is null or repeated. A very long text is a shard of its own. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = Pair.of(path_a, path_b), TaskContext.get().partitionId() << 32
        for table in _shards(batches):
            text = table.column("text").combine_chunks()
            documents, index = _shard(pair, table.column("doc_id").combine_chunks(), text)
            for names, own, place in ((_DOC_NAMES, documents, True), (_INDEX_NAMES, index, False)):
                rows = len(own[0])
                given = {"shard": pa.array(np.full(rows, number)), **dict(zip(names, own, strict=True))}
                if place:
                    given["place"] = pa.array(np.arange(rows, dtype=np.int32))
                arrays = [given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in _SCHEMA]
                for first in range(0, rows, 4096):
                    yield pa.RecordBatch.from_arrays([x.slice(first, 4096) for x in arrays], schema=_SCHEMA)
            number += 1

    found = docs.select("doc_id", "text").mapInArrow(run, _ROW)
    columns = {"groups": F.col("groups")} if columns is None else columns
    kept = [F.when(F.col("pair").isNull(), value).alias(name) for name, value in columns.items()]
    table = written(found.select("shard", "place", *_DOC_NAMES[:-1], *kept, *_INDEX_NAMES), "aligned")
    documents = table.filter("pair is null").drop(*_INDEX_NAMES)
    return documents, table.filter("pair is not null").select("shard", *_INDEX_NAMES)


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best) of every linked pair of ids, from the bitmaps' sizes.

    documents is how many hold the pair linked, links how often, best whether no other
    pair of its A id is in more. Shards hold different documents, so the sizes of their
    bitmaps add up.
    """
    whole = F.when(F.col("plane") == 0, F.col("holders").cast("long")).otherwise(0)
    times = F.when(F.col("plane") == 0, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("plane") - 1))
    counts = index.groupBy("pair").agg(F.sum(whole).alias("documents"), F.sum(F.col("holders") * times).alias("links"))
    named = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    named = written(named.select("pair", "a", "b", "documents", "links"), "pairs")
    # One row for each id of vocabulary A at most.
    most = F.broadcast(named.groupBy("a").agg(F.max("documents").alias("most")))
    return named.join(most, "a").select(*named.columns, (F.col("documents") == F.col("most")).alias("best"))


def scores(documents: DataFrame, index: DataFrame, counts: DataFrame) -> DataFrame:
    """documents plus n_best (its links whose pair is best) and count_sum (sum of documents over its links).

    The counts of a shard's pairs come back to the shard, whose postings hand them on
    to its documents, plane by plane.
    """
    wanted = index.filter("plane = 0").select("shard", "pair")
    told = wanted.join(counts.select("pair", F.col("documents").alias("count"), "best"), "pair")
    told = told.toDF("told_pair", "told_shard", "count", "best")

    def run(postings: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by("told_pair")
        at = np.searchsorted(given["told_pair"].to_numpy(), postings["pair"].to_numpy())
        times = np.int64(1) << np.maximum(postings["plane"].to_numpy().astype(np.int64) - 1, 0)
        size = postings["documents"].to_numpy().astype(np.int64)
        bits = postings["bits"].combine_chunks()
        row, place = unpacked(postings["holders"].to_numpy().astype(np.int64), size, bits)
        sums = []
        for value in (given["best"].to_numpy().astype(np.int64), given["count"].to_numpy()):
            sums.append(np.zeros(int(size[0]), np.int64))
            np.add.at(sums[-1], place, (value[at] * times)[row])
        shard = pa.array(np.full(len(sums[0]), postings["shard"][0].as_py()))
        places = pa.array(np.arange(len(sums[0]), dtype=np.int32))
        return pa.Table.from_arrays([shard, places, *map(pa.array, sums)], ["shard", "place", "n_best", "count_sum"])

    found = (
        index.groupBy("shard")
        .cogroup(told.groupBy("told_shard"))
        .applyInArrow(run, "shard long, place int, n_best long, count_sum long")
    )
    zero = F.lit(0).cast("long")
    joined = documents.join(found, ["shard", "place"], "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
