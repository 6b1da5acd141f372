"""Removal of byte passages that occur elsewhere, by suffix arrays over shards of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.membership import possible
from bellwether.llm.scratch import bounded_batches, written
from bellwether.llm.suffixes import SEPARATOR, repeated_windows
from bellwether.llm.words import mixed, seed

LENGTH = 200  # bytes of a passage that counts
GRAM = 48  # bytes of an anchor; every window of LENGTH bytes holds one
PIECE = 1 << 20  # bytes hashed at a time
SHARD = 2 << 20  # bytes of a suffix array, about
GROUP = 1 << 20  # bytes of one anchor's segments that share a shard, about
MERGED = 1 << 20  # window digests that one task merges, about
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = 34  # low bits of a packed hash that hold its place


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of the base and of its inverse modulo 2**64."""
    size = PIECE + 4 * LENGTH
    steps = np.full(size, _BASE, np.uint64)
    steps[0] = 1
    back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return mixed(np.arange(256, dtype=np.uint64) + seed(40)), np.cumprod(steps), np.cumprod(back)


VALUES, POWERS, INVERSES = _constants()


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[data] * POWERS[: len(data)])))


def _span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[begin]) * INVERSES[begin])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    table[:n] = values
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, lo, count, anchor, key) of all segments of the texts that end at `ends` in data.

    A window of LENGTH bytes is anchored at its gram with the least hash, the
    leftmost of equals, so equal windows have equal anchors. Neighbouring windows
    with one anchor make a segment: `count` starts from lo on. anchor hashes the gram,
    key all the segment's bytes.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    prefix = _prefix_hashes(data)
    grams = _span_hashes(prefix, np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    place = np.arange(len(grams), dtype=np.uint64)
    packed = ((grams >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | place
    least = _sliding_min(packed, LENGTH - GRAM + 1)
    at = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begins)[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[text])
    if not len(valid):
        return none, none, none, none, none
    at, text = at[valid], text[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    lo, hi = valid[first], valid[last]
    count = hi - lo + 1
    key = mixed(_span_hashes(prefix, lo, hi + LENGTH) + count.astype(np.uint64) * seed(41))
    return text[first], lo - begins[text[first]], count, grams[at[first]].view(np.int64), key.view(np.int64)


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of every text; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _pieces(texts: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], list[int], list[int]]]:
    """Texts in groups of about PIECE bytes; a longer text comes in parts that share all windows out."""
    parts, owners, bases, size = [], [], [], 0
    for i, data in enumerate(texts):
        for base in range(0, max(1, len(data)), PIECE):
            part = data[base : base + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size and size + len(part) > PIECE + 2 * LENGTH:
                yield parts, owners, bases
                parts, owners, bases, size = [], [], [], 0
            parts.append(part)
            owners.append(i)
            bases.append(base)
            size += len(part)
    if parts:
        yield parts, owners, bases


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _bytes(batch.column("text"))
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for parts, owners, bases in _pieces(texts):
            text, lo, count, anchor, key = segments(np.concatenate(parts), np.cumsum([len(p) for p in parts]))
            owner, base = np.array(owners, np.int64), np.array(bases, np.int64)
            for column, values in zip(found, (owner[text], lo + base[text], count, anchor, key), strict=True):
                column.append(values)
        owner, *columns = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found)
        edges = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        lo, count, anchor, key = columns
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("tid"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.ListArray.from_arrays(edges, pa.array(anchor)),
                pa.ListArray.from_arrays(edges, pa.array(key)),
                pa.ListArray.from_arrays(edges, pa.array(lo)),
                pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int32))),
            ],
            ["doc_id", "tid", "n_bytes", "sha", "anchor", "key", "lo", "count"],
        )


_SEGMENTED = (
    "doc_id long, tid long, n_bytes long, sha string, anchor array<long>, key array<long>, "
    "lo array<long>, count array<int>"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of every text."""
    for batch in batches:
        out: dict[str, list] = {"anchor": [], "key": [], "part": [], "parts": [], "data": []}
        for data, wanted in zip(_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                for name in ("anchor", "key", "part", "parts"):
                    out[name].append(w[name])
                out["data"].append(data[w["lo"] : w["lo"] + w["count"] + LENGTH - 1].tobytes())
        yield pa.RecordBatch.from_pydict(out, _CUT)


_CUT = pa.schema(
    [("anchor", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("data", pa.binary())]
)


def _runs(places: np.ndarray) -> list[dict[str, int]]:
    """Runs of neighbouring places as {s, e}, both included."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return [
        {"s": int(a), "e": int(b)}
        for a, b in zip(places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)], strict=True)
    ]


def _shard(rows: pa.Table) -> pa.Table:
    """Per segment the runs of windows found twice in the shard; digests of windows to merge with other shards."""
    rows = rows.sort_by([("anchor", "ascending"), ("key", "ascending")])
    anchor, key = rows.column("anchor").to_numpy(), rows.column("key").to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
    rows = rows.filter(pa.array(new))
    anchor, key = anchor[new], key[new]
    texts = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column("data")]
    stop = np.array([SEPARATOR], np.uint8)
    data = np.concatenate([x for t in texts for x in (t, stop)])
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[owner] + offset
    twice, number = repeated_windows(data, starts, LENGTH)
    split = rows.column("parts").to_numpy()[owner] > 1
    # One window of every class can meet its equals in other shards.
    _, shown = np.unique(np.where(split, number, -1), return_index=True)
    shown = shown[split[shown]]
    digest = np.zeros(len(starts), np.int64)
    for i in np.unique(owner[shown]).tolist():
        mine = shown[owner[shown] == i]
        prefix = _prefix_hashes(texts[i])
        digest[mine] = _span_hashes(prefix, offset[mine], offset[mine] + LENGTH).view(np.int64)
    edges, shown = np.searchsorted(owner, np.arange(len(texts) + 1)), np.sort(shown)
    shown_edges = np.searchsorted(shown, edges)
    runs, open_at, open_digest = [], [], []
    for a, b, c, d in zip(edges, edges[1:], shown_edges, shown_edges[1:], strict=False):
        runs.append(_runs(offset[a:b][twice[a:b]]))
        open_at.append(offset[shown[c:d]])
        open_digest.append(digest[shown[c:d]])
    return pa.table(
        {
            "anchor": pa.array(anchor),
            "key": pa.array(key),
            "runs": pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
            "places": pa.array(open_at, pa.list_(pa.int64())),
            "digests": pa.array(open_digest, pa.list_(pa.int64())),
        }
    )


_SHARD = "anchor long, key long, runs array<struct<s: int, e: int>>, places array<long>, digests array<long>"


def _merge(rows: pa.Table) -> pa.Table:
    """Windows of split anchors that another shard shows too: binary search of each in the merged order."""
    digest, anchor = rows.column("digest").to_numpy(), rows.column("anchor").to_numpy()
    both = mixed(digest.view(np.uint64) ^ mixed(anchor.view(np.uint64)))
    merged = np.sort(both, kind="stable")
    times = np.searchsorted(merged, both, "right") - np.searchsorted(merged, both, "left")
    return rows.select(["anchor", "key", "place"]).filter(pa.array(times > 1))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        spans = batch.column("spans").to_pylist()
        for doc_id, data, own in zip(batch.column("doc_id"), _bytes(batch.column("text")), spans, strict=True):
            own = sorted((s["s"], s["e"]) for s in own)
            joined: list[list[int]] = []
            for s, e in own:
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(e, joined[-1][1])
                else:
                    joined.append([s, e])
            kept, last = hashlib.sha256(), 0
            for s, e in joined:
                kept.update(data[last:s])
                last = e
            kept.update(data[last:])
            out["doc_id"].append(doc_id.as_py())
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(e - s for s, e in joined))
            out["n_spans"].append(len(joined))
            out["kept_sha256"].append(kept.hexdigest())
            out["spans"].append([{"s": s, "e": e} for s, e in joined])
        yield pa.RecordBatch.from_pydict(out, _REMOVED_SCHEMA)


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
_REMOVED_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", _SPANS),
    ]
)
_REMOVED = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<s: bigint, e: bigint>>"
)


def _with_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found(of, of_tid, ...) with the rows(doc_id, tid, text) it is about; others are not moved."""
    near = possible(rows, ["doc_id", "tid"], found.select("of", "of_tid"))
    return near.join(found, near["doc_id"].eqNullSafe(F.col("of")) & (near["tid"] == F.col("of_tid")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs(doc_id, text).

    A byte is removed if a string of LENGTH bytes that covers it starts anywhere else
    too, in the same document or another; strings never cross documents and are judged on the
    input. spans are the maximal removed runs, [s, e); the hash is that of the bytes left.

    Every window of LENGTH bytes belongs to the segment of its anchor, a gram that
    depends on the window alone, so equal windows meet under one anchor. Anchors
    that occur once are settled; segments that are equal as a whole are repeated as
    a whole. The different segments of an anchor go to a shard with bounded bytes,
    whose suffix array and common prefixes show the equal windows. An anchor with
    more segments than a shard holds is spread over several, and their windows are
    merged by binary search in sorted digests.

    Null and empty texts and texts shorter than LENGTH lose nothing. Rows that repeat doc_id
    and text count as two places, and lose all if they are long enough; a null doc_id is an id
    like any other. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    cut = rows.mapInArrow(_segmented, _SEGMENTED).withColumn("rid", F.monotonically_increasing_id())
    table = written(cut, "segments", compression="zstd")
    each = table.select("rid", F.inline(F.arrays_zip("anchor", "key", "lo", "count")))
    several = each.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    found = written(each.join(several, "anchor"), "repeated", compression="zstd")

    kinds = found.groupBy("anchor", "key").agg(
        F.count("*").alias("times"), F.min(F.struct("rid", "lo")).alias("first"), F.first("count").alias("count")
    )
    kinds = written(kinds, "kinds", compression="zstd")
    size = F.sum(F.col("count") + F.lit(LENGTH - 1))
    unlike = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), size.alias("bytes")).filter("kinds > 1")
    total = unlike.agg(F.sum("bytes")).first()[0] or 0
    parts = F.ceil(F.col("bytes") / GROUP)
    wanted = kinds.join(unlike, "anchor").select(
        F.col("first.rid").alias("rid"),
        F.struct(
            "anchor",
            "key",
            F.col("first.lo").alias("lo"),
            "count",
            F.pmod(F.xxhash64("key"), parts).alias("part"),
            parts.alias("parts"),
        ).alias("w"),
    )
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    wanted = wanted.join(table.select("rid", F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")), "rid")
    wanted = written(wanted.drop("rid"), "wanted", compression="zstd")
    data = _with_rows(rows, wanted).select("text", "wanted").mapInArrow(
        _cut, "anchor long, key long, part long, parts long, data binary"
    )
    shards = max(1, -(-total // SHARD))
    shown = (
        data.withColumn("shard", F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_shard, _SHARD)
    )
    shown = written(shown, "shown", compression="zstd")
    digests = shown.select("anchor", "key", F.inline(F.arrays_zip("places", "digests"))).toDF(
        "anchor", "key", "place", "digest"
    )
    buckets = max(1, -(-digests.count() // MERGED))
    across = (
        digests.withColumn("bucket", F.pmod("digest", F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_merge, "anchor long, key long, place long")
    )
    run = F.struct(F.col("place").cast("int").alias("s"), F.col("place").cast("int").alias("e"))
    alone = (
        shown.select("anchor", "key", F.explode("runs").alias("run"))
        .unionByName(across.select("anchor", "key", run.alias("run")))
        .join(kinds.filter("times > 1").select("anchor", "key"), ["anchor", "key"], "left_anti")
    )
    whole = kinds.filter("times > 1").select(
        "anchor", "key", F.struct(F.lit(0).alias("s"), (F.col("count") - 1).alias("e")).alias("run")
    )
    runs = alone.unionByName(whole).groupBy("anchor", "key").agg(F.collect_list("run").alias("runs"))
    spans = (
        found.join(runs, ["anchor", "key"])
        .select("rid", "lo", F.explode("runs").alias("run"))
        .select(
            "rid",
            F.struct(
                (F.col("lo") + F.col("run.s")).alias("s"), (F.col("lo") + F.col("run.e") + LENGTH).alias("e")
            ).alias("span"),
        )
        .groupBy("rid")
        .agg(F.collect_list("span").alias("spans"))
    )
    ids = table.select("rid", F.col("doc_id").alias("of"), F.col("tid").alias("of_tid"))
    hit = spans.join(ids, "rid").groupBy("of", "of_tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hit = written(hit, "spans", compression="zstd")
    cut = _with_rows(rows, hit).select("doc_id", "text", "spans").mapInArrow(_removed, _REMOVED)
    whole_texts = table.join(
        hit, table["doc_id"].eqNullSafe(hit["of"]) & (table["tid"] == hit["of_tid"]), "left_anti"
    ).select(
        "doc_id",
        "n_bytes",
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"),
        F.array().cast("array<struct<s: bigint, e: bigint>>").alias("spans"),
    )
    return cut.unionByName(whole_texts)
