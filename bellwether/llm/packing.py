"""Best-fit packing of documents into bins whose members must not conflict."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.mixing import word_count
from bellwether.llm.scratch import bounded_batches, written

CAPACITY = 2048  # words in a bin
SHARD_PIECES = 4096  # pieces that one task packs together, about
MANY_COPIES = 64  # rows of one document beyond which they are dealt one by one


def cluster_key(text: Column | str) -> Column:
    """Equal for texts that differ in letter case and white space only; null for none."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def best_fit(
    sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY
) -> list[int]:
    """The bin of every piece; pieces are placed in the given order.

    Open bins are ordered by what they have left. A piece looks up the first bin
    that holds it and goes on to the successors until it finds one without its
    source and its cluster; that is the tightest compatible bin. Without one it
    opens a bin. A source or cluster is a bit, set in the bitmap of its bins;
    None conflicts with nothing. A full bin is closed.
    """
    times = Counter(c for c in clusters if c is not None)
    bits: dict = {}
    masks = []
    for source, cluster in zip(sources, clusters, strict=True):
        mask = 0
        if source is not None:
            mask |= 1 << bits.setdefault(("source", source), len(bits))
        if times[cluster] > 1:
            mask |= 1 << bits.setdefault(("cluster", cluster), len(bits))
        masks.append(mask)
    order: list[tuple[int, int]] = []  # (left, bin) of the open bins
    taken: list[int] = []  # bitmap of each bin
    places = []
    for size, mask in zip(sizes, masks, strict=True):
        at = bisect_left(order, (size, -1))
        while at < len(order) and taken[order[at][1]] & mask:
            at += 1
        if at < len(order):
            left, bin_no = order.pop(at)
        else:
            left, bin_no = capacity, len(taken)
            taken.append(0)
        taken[bin_no] |= mask
        if left > size:
            insort(order, (left - size, bin_no))
        places.append(bin_no)
    return places


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, copy, piece, first_word, n_words, source, cluster) of docs(doc_id, size, source, cluster).

    A document longer than a bin is cut into full pieces and a rest; each row
    of a repeated doc_id is a copy of its own.
    """
    n = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("long")
    cut = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    first = F.col("piece") * capacity
    return cut.withColumns(
        {"first_word": first, "n_words": F.least(F.lit(capacity).cast("long"), F.col("size") - first)}
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = True) -> DataFrame:
    """(doc_id, piece, first_word, n_words, source, shard, bin, place) of every piece of docs.

    docs holds (doc_id, size, source, cluster). No bin holds more than `capacity` words, two
    documents of one cluster, two copies of a document or, with by_source, two
    documents of one source. Pieces are dealt to shards by a hash of their
    document and copy, so that a source or cluster with very many documents is
    spread evenly, and every shard is packed by itself, the largest piece first; what is
    packed together is bounded, and each shard leaves at most a few bins that could be fuller.

    Documents of size 0 take a place of 0 words. Null source, cluster and doc_id conflict
    with nothing; a full piece has a bin of its own. An empty table gives no rows. Reruns agree:
    rows of a shard are sorted before they are packed.
    """
    bounded_batches(docs.sparkSession)
    cut = pieces(docs.select("doc_id", "size", "source", "cluster"), capacity)
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    # A document with very many rows is spread by row; all others by what they are.
    many = cut.groupBy("doc_id", "piece").agg(F.count("*").alias("copies")).filter(F.col("copies") > MANY_COPIES)
    many = many.select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), F.lit(1).alias("many"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p"))
    apart = F.when(F.col("many") == 1, F.col("row")).otherwise(F.lit(0))
    sharded = cut.join(many, same, "left").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", apart), F.lit(shards))
    )
    sharded = sharded.select("doc_id", "size", "source", "cluster", "piece", "first_word", "n_words", "shard")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(
            [("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending")]
        )
        doc, cluster = rows.column("doc_id").to_pylist(), rows.column("cluster").to_pylist()
        source = rows.column("source").to_pylist() if by_source else [None] * rows.num_rows
        # A document without a cluster is one by itself, so its copies part.
        own = [("doc", d) if c is None and d is not None else c for d, c in zip(doc, cluster, strict=True)]
        bins = best_fit(rows.column("n_words").to_pylist(), source, own, capacity)
        used: dict[int, int] = {}
        place = []
        for b in bins:
            place.append(used.get(b, 0))
            used[b] = place[-1] + 1
        return rows.drop_columns(["cluster", "size"]).append_column("bin", pa.array(bins, pa.int64())).append_column(
            "place", pa.array(place, pa.int64())
        )

    return sharded.groupBy("shard").applyInArrow(
        pack,
        "doc_id long, source string, piece long, first_word long, n_words long, shard long, bin long, place long",
    )


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = True) -> DataFrame:
    """packed() of docs(doc_id, text, source): sizes in words of whole texts, clusters of equal plain texts."""
    return packed(
        docs.select("doc_id", word_count("text").alias("size"), "source", cluster_key("text").alias("cluster")),
        capacity,
        by_source,
    )
