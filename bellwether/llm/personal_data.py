"""Personal data in whole texts: plain patterns, and what a segment model adds to them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches
from bellwether.llm.span_model import Model, fitted, made_examples, regions
from bellwether.llm.span_patterns import KINDS, Span, base_spans

SAMPLE, SAMPLE_LETTERS = 1000, 20_000  # texts the model is fitted on, and letters of each, at most
MADE = 3000  # made examples around words of the sample
_SPANS = "array<struct<kind: string, start: int, end: int>>"
_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def examples_from(texts: list[str], made: int = MADE) -> list[tuple[str, list[Span]]]:
    """Regions of the texts with what the patterns find in them, and made examples around the texts' words."""
    found, words = [], []
    for text in texts:
        words += text.split()[:50]
        spans = base_spans(text)
        for low, high in regions(text):
            own: list[Span] = []
            for kind, a, b in spans:
                if low <= a and b <= high and not any(a < y and x < b for _, x, y in own):
                    own.append((kind, a - low, b - low))
            found.append((text[low:high], own))
    return found[: 2 * made] + made_examples(words, made, seed=len(KINDS))


def span_model(docs: DataFrame) -> Model:
    """The model fitted on at most SAMPLE different texts of docs, those with the smallest hashes.

    Longer texts than SAMPLE_LETTERS are not in the sample; they are searched like all others.
    Rows are first thinned by hash to about four times SAMPLE, whatever the table's size.
    """
    short = docs.select("text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_LETTERS))
    part = 4 * SAMPLE / max(1, docs.count())
    rows = short.withColumn("hash", F.xxhash64(F.lit(len(KINDS)), "text"))
    rows = rows.filter(F.pmod("hash", F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30))))
    chosen = rows.dropDuplicates(["hash"]).orderBy("hash").limit(SAMPLE)
    return fitted(examples_from([r.text for r in chosen.collect()]))


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans) by start, then kind: the model's are added where they meet no other."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for kind, a, b in model.spans(text):
        if not any(x < b and a < y for x, y in taken):
            added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans) of every row of docs(doc_id, text), each an array of (kind, start, end).

    base has the leftmost matches of each kind's pattern, without those that fail its test;
    spans has these and the entities of the best segmentation of the rest under the model,
    both by start, then kind in the order of KINDS. Offsets are code points, end exclusive.
    Without a model, one is fitted on a sample of docs.

    Every row is searched by its own whole text, also where doc_id is null or repeated. Null and
    empty texts have no spans. Very long texts take time in proportion to their length. Other
    columns are ignored, whatever their names; an empty table gives no rows. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    model = model or span_model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for text in batch.column("text").to_pylist():
                for column, spans in zip(columns, spans_of(text or "", model), strict=True):
                    column.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            lists = [pa.array(column, _LIST) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def masked(text: Column | str, spans: Column | str) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap, the first stays whole."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        mark = F.when(span["start"] >= state["at"], F.concat(F.lit("<"), span["kind"], F.lit(">"))).otherwise("")
        return F.struct(
            F.concat(state["done"], between, mark).alias("done"), F.greatest(state["at"], span["end"]).alias("at")
        )

    # The first length of the text is its whole rest.
    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text)))
    )


def span_report(found: DataFrame) -> DataFrame:
    """The rows of personal_data() with counts and a digest of the patterns' spans, and all spans as text."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
