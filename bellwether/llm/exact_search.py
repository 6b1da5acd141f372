"""Exact k best inner products by a Voronoi join of query blocks and data cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches, written

PIVOTS = 64  # vectors that the driver holds, whatever the input
CELL_ROWS = 4096  # data vectors in a cell, about
BLOCK_ROWS = 256  # queries in a block, about
CHUNK_BLOCKS = 32  # blocks that one task holds with a cell, about
_EXACT = 2.0**53
_LOWEST = -(2**63)


def quantised(vector: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(finite, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; doubles are used only where they are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, least: int, k: int) -> np.ndarray:
    """Places of the k best of one query among scores >= least; ties to the smaller id."""
    places = np.flatnonzero(scores >= least)
    if len(places) > k:
        cut = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= cut]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds g, the nearest pivot, and far, the distance to it."""
    dim, norms = pivots.shape[1], (pivots.astype(float) ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim).astype(float)
            square = (v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T.astype(float) + norms
            g = square.argmin(axis=1)
            far = np.sqrt(((v - pivots[g]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(g.astype(np.int32)), pa.array(far)],
                ["vec_id", "v", "g", "far"],
            )

    return vectors.mapInArrow(run, "vec_id long, v array<long>, g int, far double")


def _blocks(queries: DataFrame) -> DataFrame:
    """One row per block of queries of one group: block, g, ids, flat vectors."""
    counts = queries.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    parted = queries.join(counts, "g").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    row = F.struct("vec_id", "v")
    grouped = parted.groupBy("g", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select(
        F.xxhash64("g", "part").alias("block"), "g", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vectors")
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of every query.

    vectors holds (vec_id, v) with v an array of long, for instance from
    quantised(); is_query picks the queries by vec_id. Candidates are all rows
    of another vec_id, fewer than k are all returned, ties go to the smaller
    vec_id. Rows with a null id or vector take no part; rows that repeat id and
    vector count once; a shorter vector counts as filled up with zeros. No
    query, or no vector, gives no rows. Other columns are ignored.

    Data and queries belong to the nearest of a bounded number of pivots. A block
    of queries meets one cell of its own group first, which gives each query a
    k-th best score. Another group is needed only if query * pivot + length of
    the query * radius of the group reaches it; blocks and cells meet only
    there, and only scores that reach it come back. Of equal vectors, the k + 1
    smallest ids are enough for any query. Groups are cut into cells and blocks
    of bounded size; nothing is approximate.
    """
    bounded_batches(vectors.sparkSession)
    valid = vectors.select("vec_id", "v").filter("vec_id is not null and v is not null").distinct()
    valid = written(valid, "vectors")
    dim = valid.agg(F.max(F.size("v"))).first()[0] or 0
    picked = valid.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    centres = np.zeros((max(1, len(picked)), max(1, dim)), np.int64)
    for i, row in enumerate(picked):
        centres[i, : len(row.v)] = row.v
    dim = centres.shape[1]
    assigned = written(_assigned(valid, centres), "assigned")

    equal = Window.partitionBy("g", "v").orderBy("vec_id")
    data = assigned.withColumn("copy", F.row_number().over(equal)).filter(F.col("copy") <= k + 1)
    counts = data.groupBy("g").agg(F.ceil(F.count("*") / CELL_ROWS).alias("salts"), F.max("far").alias("radius"))
    counts = written(counts, "groups")  # a row per pivot
    salted = data.join(counts.drop("radius"), "g").select(
        "vec_id", "v", "g", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt")
    )
    cells = written(salted, "cells")
    radius = {row.g: row.radius for row in counts.collect()}
    groups = np.array(sorted(radius), np.int32)
    radii = np.array([radius[g] for g in groups.tolist()])
    middle = centres[groups] if len(groups) else centres[:0]

    def scored(block_ids, block_vectors, cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = cell.column("vec_id").to_numpy()
        scores = products(block_vectors, _matrix(cell.column("v"), dim))
        scores[block_ids[:, None] == ids] = _LOWEST
        return scores, ids

    def own(blocks: pa.Table, cell: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            ids = np.array(block["ids"], np.int64)
            v = _matrix(pa.array(block["vectors"], pa.list_(pa.int64())), dim)
            scores, data_ids = scored(ids, v, cell)
            best = [_best(s, data_ids, _LOWEST + 1, k) for s in scores]
            floor = [int(s[b[-1]]) if len(b) == k else _LOWEST + 1 for s, b in zip(scores, best, strict=True)]
            reach = products(v, middle) + np.sqrt((v.astype(float) ** 2).sum(axis=1))[:, None] * radii
            # One unit and a part per million more than the bound, for rounding.
            needed = (reach + 1 + 1e-6 * np.abs(reach) >= np.array(floor, float)[:, None]).any(axis=0)
            found = [
                {"query_id": int(q), "vec_id": int(data_ids[i]), "score": int(s[i])}
                for q, s, b in zip(ids, scores, best, strict=True)
                for i in b
            ]
            out.append(
                {**{c: block[c] for c in ("block", "g", "ids", "vectors")}, "floors": floor, "needed": groups[needed].tolist(), "found": found}
            )
        return pa.Table.from_pylist(out, solved_schema)

    long_list = pa.list_(pa.int64())
    solved_schema = pa.schema(
        [
            ("block", pa.int64()),
            ("g", pa.int32()),
            ("ids", long_list),
            ("vectors", pa.list_(long_list)),
            ("floors", long_list),
            ("needed", pa.list_(pa.int32())),
            ("found", pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))),
        ]
    )
    found_type = "struct<query_id: bigint, vec_id: bigint, score: bigint>"
    blocks = _blocks(assigned.filter(is_query))
    first = cells.filter("salt = 0").groupBy("g")
    solved = blocks.groupBy("g").cogroup(first).applyInArrow(
        own,
        "block long, g int, ids array<long>, vectors array<array<long>>, floors array<long>, "
        f"needed array<int>, found array<{found_type}>",
    )
    solved = written(solved, "solved")

    def other(blocks: pa.Table, cell: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if cell.num_rows:
            for block in blocks.to_pylist():
                ids = np.array(block["ids"], np.int64)
                v = _matrix(pa.array(block["vectors"], long_list), dim)
                scores, data_ids = scored(ids, v, cell)
                floors = np.array(block["floors"], np.int64)
                for i in np.flatnonzero((scores >= floors[:, None]).any(axis=1)).tolist():
                    best = _best(scores[i], data_ids, floors[i], k)
                    out["query_id"] += [int(ids[i])] * len(best)
                    out["vec_id"] += data_ids[best].tolist()
                    out["score"] += scores[i][best].tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    chunks = max(1, -(-solved.count() // CHUNK_BLOCKS))
    salts = counts.select(F.col("g").alias("to"), F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
    sent = (
        solved.withColumn("to", F.explode("needed"))
        .join(salts, "to")
        .filter("not (g = to and salt = 0)")
        .select(
            F.col("to").alias("g"),
            "salt",
            F.pmod(F.col("block"), F.lit(chunks)).alias("chunk"),
            "ids",
            "vectors",
            "floors",
        )
    )
    asked = sent.select(
        F.col("g").alias("to_g"), F.col("salt").alias("to_salt"), F.col("chunk").alias("to_chunk")
    ).distinct()
    copies = cells.join(asked, (F.col("g") == F.col("to_g")) & (F.col("salt") == F.col("to_salt")))
    copies = copies.select("vec_id", "v", "g", "salt", F.col("to_chunk").alias("chunk"))
    met = (
        sent.groupBy("g", "salt", "chunk")
        .cogroup(copies.groupBy("g", "salt", "chunk"))
        .applyInArrow(other, "query_id long, vec_id long, score long")
    )
    partial = solved.select(F.inline("found")).unionByName(met)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
