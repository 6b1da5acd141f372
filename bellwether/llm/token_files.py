"""Token ids in Parquet list columns, in document order, and reads of parts of them."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches
from bellwether.llm.words import slices, split_words

# Ids repeat, so their pages are dictionary-encoded; document numbers and counts
# ascend or vary little, so theirs are delta-encoded. A page holds few documents
# and the column index lets a read skip pages; a row group is one unit of work.
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "compression": "zstd",
}
COLUMNS = "doc_id long, part int, place long, before long, n_tokens int, ids array<int>"
WORDS_HELD = 400_000  # words whose ids a worker remembers, whatever the input

# Words of these letters and a tail of these signs are two pieces of the tokenizer for sure: letters
# that lower-case to one of themselves, and signs other than the apostrophe, which begins short forms.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"

_memories: dict[str, _Memory] = {}


def _spelt() -> dict[int, str]:
    """How a byte-level vocabulary spells the letters beyond ASCII: a letter for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {code: "".join(letter[b] for b in chr(code).encode()) for code in range(0xC0, 0x100)}


_SPELT = _spelt()


def _pieces(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(piece numbers of all words in order, start of each word and end, distinct pieces, whether letters only).

    A word of plain letters and signs is its letters in lower case and, if there are any, its
    signs; any other word is one piece.
    """
    plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+[{_SIGNS}]*$")
    letters = pc.utf8_lower(pc.replace_substring_regex(words, f"[{_SIGNS}]*$", ""))
    signs = pc.replace_substring_regex(words, f"^[{_LETTERS}]+", "")
    tailed = pc.and_(plain, pc.not_equal(signs, "")).to_numpy(zero_copy_only=False)
    firsts = pc.if_else(plain, letters, words)
    both = pa.chunked_array([firsts, signs.filter(pa.array(tailed))]).combine_chunks().dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(1 + tailed)))
    order = np.empty(len(codes), np.int64)
    order[starts[:-1]] = codes[: len(words)]
    order[starts[1:][tailed] - 1] = codes[len(words) :]
    kinds = pc.match_substring_regex(both.dictionary, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
    return order, starts, both.dictionary, kinds


class _Memory:
    """Ids of words seen so far, in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.places: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _encode(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words; plain ones are lower-case letters, which the vocabulary's model takes as they are."""
        found: list[list[int]] = [[]] * len(words)
        tokenize = self.tokenizer.model.tokenize
        for i in np.flatnonzero(plain).tolist():
            found[i] = [token.id for token in tokenize(words[i].translate(_SPELT))]
        rest = np.flatnonzero(~plain).tolist()
        encoded_rest = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, encoded_rest, strict=True):
            found[i] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
        return sizes, flat

    def lookup(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of every word's ids in the returned flat array."""
        get = self.places.get
        places = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        sizes, flat = self._encode([words[i] for i in missing.tolist()], plain[missing])
        ends = self.starts[-1] + np.cumsum(sizes)
        all_starts = np.concatenate((self.starts, ends))
        all_flat = np.concatenate((self.flat, flat))
        held = len(self.places)
        places[missing] = held + np.arange(len(missing))
        room = max(0, WORDS_HELD - held)
        if room and len(missing):
            for i in missing[:room].tolist():
                self.places[words[i]] = len(self.places)
            kept = len(self.places)
            self.starts = all_starts[: kept + 1].copy()
            self.flat = all_flat[: self.starts[-1]].copy()
        return all_starts[places], all_starts[places + 1] - all_starts[places], all_flat


def _memory(path: str) -> _Memory:
    if path not in _memories:
        _memories[path] = _Memory(path)
    return _memories[path]


def encoded(texts: pa.Array, path: str, end_id: int) -> pa.ListArray:
    """Ids of every whole text and the end id; white space must separate the tokenizer's words.

    Each distinct piece of a word is encoded once: the tokenizer drops ASCII white space,
    never joins across it nor across letters and signs, so a text's ids are its pieces' ids in order.
    """
    words_at, starts, words = split_words(texts)
    pieces, bounds, names, plain = _pieces(words)
    own = np.diff(bounds)[words_at]
    ends = np.concatenate(([0], np.cumsum(own)))
    codes = pieces[np.repeat(bounds[:-1][words_at] - ends[:-1], own) + np.arange(ends[-1])]
    starts = ends[starts]
    memory = _memory(path)
    first, size, flat = memory.lookup(names.to_pylist(), plain)
    lengths = size[codes]
    before = np.concatenate(([0], np.cumsum(lengths)))
    taken = np.repeat(first[codes] - before[:-1], lengths) + np.arange(before[-1])
    ends = before[starts] + np.arange(len(starts))  # one end id per earlier text
    ids = np.empty(ends[-1], np.int32)
    own = np.ones(len(ids), bool)
    own[ends[1:] - 1] = False
    ids[own] = flat[taken]
    ids[~own] = end_id
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> None:
    """Write the ids of docs(doc_id, text) to folder, documents in ascending order.

    File part numbers and places within a part follow doc_id (null first, then by
    a hash of the text where ids repeat). Null texts are empty: the end id alone.
    Other columns are ignored; an empty table writes no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                ids = encoded(rows.column("text"), path, end_id)
                sizes = np.diff(ids.offsets.to_numpy())
                ends = before + np.cumsum(sizes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(place + np.arange(len(sizes))),
                        pa.array(ends - sizes),
                        pa.array(sizes.astype(np.int32)),
                        ids,
                    ],
                    ["doc_id", "part", "place", "before", "n_tokens", "ids"],
                )
                place, before = place + len(sizes), int(ends[-1])

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(run, COLUMNS).write.options(**FORMAT).parquet(folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The written rows; select and filter to read only some columns and pages."""
    return spark.read.schema(COLUMNS).parquet(folder)


def positions(files: DataFrame) -> DataFrame:
    """(part, offset): ids in all earlier parts, from the counts alone; one row per file part."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            data = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    batch.column("before"),
                    pc.cast(pa.array(np.diff(edges)), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    read = files.select("doc_id", "part", "before", "ids").mapInArrow(
        run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long"
    )
    return read.join(positions(files), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
