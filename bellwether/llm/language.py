"""Language of texts: text likelihoods, declared markup, address suffix and host priors in one posterior."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.scratch import bounded_batches, written
from bellwether.llm.words import slices

SAMPLE_ROWS = 20_000  # declared documents of each language that the letter model reads, about, at most
BUCKETS = 1 << 15  # hashed letter triples
TEXT_GRAMS = 100  # a text counts at most like so many independent triples
OWN_WEIGHT = 20.0  # documents of the parent that a host's own counts are smoothed with
MIN_POSTERIOR = 0.65
UNKNOWN = "und"


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, markup, host) of pages(url, html): the declared language and the address.

    The number in the path names the document. Of several pages of a document the
    first by address counts. Pages without a number give no row.
    """
    number = F.regexp_extract("url", r"^\w+://[^/?#]+(?:/[^/?#]*)*?/(\d{1,18})(?:[/?#]|$)", 1)
    host = F.lower(F.regexp_extract("url", r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1))
    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    found = pages.select(
        F.when(number != "", number.cast("long")).alias("doc_id"),
        F.struct("url", F.nullif(markup, F.lit("")).alias("markup"), F.nullif(host, F.lit("")).alias("host")).alias("page"),
    )
    first = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("page").alias("page"))
    return first.select("doc_id", "page.markup", "page.host")


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte triple, start of each text's triples and end); blanks run together."""
    texts = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[\s\d]+", " ")
    ends = texts.offsets.to_numpy() if hasattr(texts, "offsets") else None
    if ends is None:
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
    ends = ends.astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    ends = ends - ends[0]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    buckets = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
    inside = np.ones(len(codes), bool)  # triples that do not reach into the next text
    for back in (1, 2):
        cut = ends[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    seen = np.concatenate(([0], np.cumsum(inside)))
    return buckets[inside], seen[np.minimum(ends, len(inside))]


def letter_counts(sample: DataFrame) -> DataFrame:
    """(declared, bucket, n): letter triples of sample(declared, text), summed over all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                buckets, starts = _triples(part.column("text"))
                for i, name in enumerate(part.column("declared").to_pylist()):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(buckets[starts[i] : starts[i + 1]], minlength=BUCKETS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])],
                ["declared", "bucket", "n"],
            )

    found = sample.select("declared", "text").mapInArrow(run, "declared string, bucket long, n long")
    return found.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(items: DataFrame, table: np.ndarray) -> DataFrame:
    """items without its text, plus n_triples and ll, the text's log likelihood per row of table."""
    columns = [c for c in items.columns if c != "text"]
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                buckets, starts = _triples(part.column("text"))
                total = np.zeros((len(table), part.num_rows))
                for row, logs in zip(total, table, strict=True):
                    sums = np.concatenate(([0.0], np.cumsum(logs[buckets])))
                    row[:] = sums[starts[1:]] - sums[starts[:-1]]
                n = np.diff(starts)
                scaled = total * np.minimum(1.0, TEXT_GRAMS / np.maximum(1, n))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(n), pa.array(list(scaled.T.round(6)), pa.list_(pa.float64()))],
                    [*columns, "n_triples", "ll"],
                )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_triples long, ll array<double>"
    return items.select(*columns, "text").mapInArrow(run, schema)


def _parent(host: Column) -> Column:
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)


def _counts(rows: DataFrame, key: str, languages: int) -> DataFrame:
    """(key, n): how often each language was the best by text, per value of key."""
    each = rows.filter(F.col(key).isNotNull()).groupBy(key, F.col("best").cast("int").alias("best"))
    found = each.agg(F.sum("times").cast("double").alias("n")).groupBy(key)
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("found"))
    places = F.sequence(F.lit(0), F.lit(languages - 1))
    return found.select(key, F.transform(places, lambda i: F.coalesce(F.col("found")[i], F.lit(0.0))).alias("n"))


def _smoothed(own: Column, parent: Column) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, parent, lambda n, p: (n + OWN_WEIGHT * p) / (total + OWN_WEIGHT))


def identify(docs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(doc_id, tid, language, posterior, kept) of every row of docs(doc_id, text, lang, source).

    tid is a hash of the text.

    lang is the language the data declares, evidence (doc_id, markup, host) what
    pages declare; a document without a page has its source as host. All in one
    posterior: the likelihood of the letters (a text counts like TEXT_GRAMS independent
    triples at most), the chance of the declared languages and of the address
    suffix given a language, and the prior of the host, smoothed with that of its
    parent domain and of all documents. These tables are counts of the best
    languages by text, grouped over all rows. The letter model reads a sample of
    each declared language by hash of doc_id: all documents of up to SAMPLE_ROWS,
    about so many of more. Every declared language whose texts hold a letter triple is
    told apart, at 256 KB of driver memory each; one without any is no class.

    "und" is a language of its own under which all triples are equally likely.
    kept is false for it, for a posterior under MIN_POSTERIOR and for a text without
    letters (null, empty, digits only). Missing declarations are no evidence; a null
    doc_id is rated without pages, repeated rows alike. No declared language at all
    leaves only "und"; an empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    declared = F.lower(F.nullif(F.trim(F.col("lang")), F.lit(""))).alias("declared")
    items = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text", F.col("source").alias("own_host"), declared, letters)

    named = docs.select("doc_id", declared, "text", letters).filter("letters and doc_id is not null")
    named = named.filter((F.col("declared") != UNKNOWN) & F.col("declared").isNotNull())
    each = named.select("doc_id", "declared").distinct().groupBy("declared").agg(F.count("*").alias("n"))
    parts = each.select(F.col("declared").alias("of"), (F.lit(float(SAMPLE_ROWS << 30)) / F.col("n")).alias("part"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("part")
    # A row per language, each of which costs the driver 256 KB below: the texts stay where they are.
    sample = named.join(F.broadcast(parts), F.col("declared") == F.col("of")).filter(drawn)
    counted = letter_counts(sample).toArrow().combine_chunks()
    names = sorted(pc.unique(counted.column("declared")).to_pylist())
    table = np.full((len(names) + 1, BUCKETS), 0.5)
    if names:
        rows = pc.index_in(counted.column("declared"), pa.array(names, counted.column("declared").type))
        table[rows.to_numpy(), counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    table[-1] = 1.0
    table = np.log(table / table.sum(axis=1, keepdims=True))
    names.append(UNKNOWN)
    size = len(names)

    # The texts are read for the likelihoods only; what pages declare joins the narrow rows.
    rated = likelihoods(items, table)
    if evidence is not None:
        pages = evidence.select(F.col("doc_id").alias("page_of"), "markup", F.col("host").alias("page_host"))
        rated = rated.join(pages, F.col("doc_id") == F.col("page_of"), "left").drop("page_of")
    else:
        rated = rated.withColumns({"markup": F.lit(None).cast("string"), "page_host": F.lit(None).cast("string")})
    best = F.array_position("ll", F.array_max("ll")) - 1
    host = F.coalesce("page_host", "own_host")
    rated = rated.withColumns({"best": best, "host": host}).withColumns(
        {"parent": _parent(F.col("host")), "suffix": F.regexp_extract("page_host", r"([^.]+)$", 1)}
    )
    rated = written(rated.withColumn("suffix", F.nullif("suffix", F.lit(""))), "likelihoods")

    # One small table of counts; every evidence is a sum over it.
    keys = ["declared", "markup", "suffix", "host", "parent"]
    seen = written(rated.groupBy(*keys, "best").agg(F.count("*").alias("times")), "evidence")
    everyone = {r.best: r.n for r in seen.groupBy("best").agg(F.sum("times").alias("n")).collect()}
    total = sum(everyone.values())
    base = [(everyone.get(i, 0) + 1.0) / (total + size) for i in range(size)]
    overall = F.array(*[F.lit(p) for p in base])
    parents = _counts(seen, "parent", size).select("parent", _smoothed(F.col("n"), overall).alias("of_parent"))
    hosts = (
        _counts(seen, "host", size)
        .withColumn("up", _parent(F.col("host")))
        .join(parents.withColumnRenamed("parent", "up"), "up", "left")
        .select("host", _smoothed(F.col("n"), F.coalesce("of_parent", overall)).alias("prior"))
    )
    joined = rated.join(hosts, "host", "left").withColumn("prior", F.coalesce("prior", overall))
    logs = [F.transform("prior", lambda p: F.ln(p)), F.col("ll")]
    for key in ("declared", "markup", "suffix"):
        kinds = _counts(seen, key, size)
        values = kinds.count() + 1
        totals = F.array(*[F.lit(float(everyone.get(i, 0) + values)) for i in range(size)])
        chance = F.zip_with("n", totals, lambda n, t: F.log((n + 1) / t))
        joined = joined.join(kinds.select(key, chance.alias(f"by_{key}")), key, "left")
        logs.append(F.coalesce(f"by_{key}", F.array(*[F.lit(0.0)] * size)))
    score = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), logs)
    scored = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    spread = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.array(*[F.lit(n) for n in names])[F.array_position("score", F.col("top")).cast("int") - 1]
    return scored.select(
        "doc_id",
        "tid",
        language.alias("language"),
        (1 / spread).alias("posterior"),
        (
            F.col("letters") & (language != UNKNOWN) & (1 / spread >= MIN_POSTERIOR)
        ).alias("kept"),
    )
