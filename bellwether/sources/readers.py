"""Table scans: typed, lenient, with fallback, optional."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.functions.labels import graded_label_score
from bellwether.functions.values import blank_to_null, to_number
from bellwether.schemas import require_columns

# Other spellings of the mention columns.
MENTION_ALIASES = {
    "Company": "company",
    "Sentiment": "sentiment",
    "Sentiment_Score": "sentiment_score",
    "Timestamp": "timestamp",
    "Date": "timestamp",
    "Text": "text",
    "Source": "source",
}

# Names a company column goes by, the first present one counts.
COMPANY_COLUMNS = ("company", "name", "company_name", "Company", "Name")
HEADLINE_COMPANY_COLUMNS = ("company", "ticker", "symbol", "name")

# The company list used when no list can be read.
FALLBACK_COMPANIES = [
    ("Apple Inc.", "AAPL"),
    ("Microsoft Corporation", "MSFT"),
    ("Amazon.com Inc.", "AMZN"),
    ("Alphabet Inc.", "GOOGL"),
    ("Meta Platforms Inc.", "META"),
    ("Tesla Inc.", "TSLA"),
]

# Latin-1 decodes any bytes, so no encoding after it would ever be tried.
ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = (",", ";", "\t")

_OVERFLOW = "_overflow"
_NEVER = "\u0000"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV with a header row and a fixed schema; empty cells become NULL."""
    reader = spark.read.schema(schema).option("header", True)
    return blank_to_null(reader.options(**options).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def repair_columns(df: DataFrame, aliases: dict[str, str] = MENTION_ALIASES) -> DataFrame:
    """Rename known aliases; a name already present or taken is left alone."""
    taken = set(df.columns)
    renames = {}
    for found in df.columns:
        wanted = aliases.get(found)
        if wanted and wanted not in taken:
            renames[found] = wanted
            taken.add(wanted)
    return df.withColumnsRenamed(renames)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def company_and_symbol(df: DataFrame) -> DataFrame:
    """First two columns, whatever their names, as (company, symbol)."""
    if len(df.columns) < 2:
        raise ValueError("a company list needs at least two columns")
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:2]]).toDF("company", "symbol")


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _keep_fitting(df: DataFrame) -> DataFrame:
    # A row with more fields than the header fills the overflow column; a short
    # row is kept with NULLs.
    return blank_to_null(df.filter(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW))


def parse_csv_lines(
    lines: DataFrame, column: str, columns: Sequence[str], separator: str = ","
) -> DataFrame:
    """Parse one CSV record per row; records with too many fields are skipped."""
    ddl = ", ".join(f"`{name}` string" for name in [*columns, _OVERFLOW])
    record = F.from_csv(
        F.col(column), F.lit(ddl), {"sep": separator, "nullValue": _NEVER}
    )
    return _keep_fitting(lines.select(record.alias("r")).select("r.*"))


def read_lenient(
    spark: SparkSession,
    path: str,
    required: Iterable[str],
    aliases: dict[str, str] = MENTION_ALIASES,
    multi_line: bool = False,
) -> DataFrame:
    """CSV as text columns, rows with too many fields skipped.

    Dialects are tried in order (plain, unquoted per encoding, other separators)
    until the header, after alias repair, has the required columns. Only headers
    are read to choose. multi_line allows line breaks inside quoted cells, which
    makes one file the unit of parallelism.
    """
    required = list(required)
    dialects = [{"sep": ","}]
    dialects += [{"sep": ",", "encoding": e, "quote": ""} for e in ENCODINGS]
    dialects += [{"sep": s} for s in SEPARATORS[1:]]
    found: list[str] = []
    for dialect in dialects:
        options = {**dialect, "header": True, "multiLine": multi_line, "escape": '"'}
        header = spark.read.options(**options).csv(path).columns
        df = (
            spark.read.schema(_text_schema([*header, _OVERFLOW]))
            .options(**options, nullValue=_NEVER, enforceSchema=True)
            .csv(path)
        )
        repaired = repair_columns(_keep_fitting(df), aliases)
        if all(c in repaired.columns for c in required):
            return repaired
        found = found or repaired.columns
    raise ValueError(f"no dialect gives columns {required}, first read gave {found}")


def detect_dialect(
    header: str, required: Iterable[str], aliases: dict[str, str] = MENTION_ALIASES
) -> tuple[dict[str, str], list[str]]:
    """(options, columns) of the first dialect under which a header line has the required columns.

    Separators are tried with quotes first, then without. Raises ValueError if none fits.
    """
    required = set(required)
    for quote in ('"', ""):
        for separator in SEPARATORS:
            cells = next(csv.reader([header], delimiter=separator, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE))
            names = [c.strip() for c in cells]
            if required <= {aliases.get(c, c) for c in names} and len(set(names)) == len(names):
                return {"sep": separator, "quote": quote or _NEVER}, names
    raise ValueError(f"no dialect gives columns {sorted(required)} in {header!r}")


def scan_lines(
    spark: SparkSession, path: str, required: Iterable[str], aliases: dict[str, str] = MENTION_ALIASES
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows of the text files of a path, each of which begins with one header line.

    The dialect follows from the header. kept has text columns, named by the header after alias
    repair, empty cells NULL, short rows filled with NULL. rejected has (line, fields): the rows with
    more fields than the header, as they stand in the file. Lines equal to the header and
    blank ones are in neither. Both read the files once each, line by line, in any number of tasks.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    first = lines.filter(F.trim("line") != "").first()
    if first is None:
        raise ValueError(f"no header in {path}")
    options, columns = detect_dialect(first.line, required, aliases)
    body = lines.filter((F.trim("line") != "") & (F.col("line") != F.lit(first.line)))
    # One cell more than the header has tells the rows that are too long; the rest of them follows in "line".
    ddl = ", ".join(f"`{name}` string" for name in [*columns, _OVERFLOW])
    record = F.from_csv("line", F.lit(ddl), {**options, "nullValue": _NEVER, "escape": '"'}).alias("r")
    parsed = body.select("line", record)
    longer = F.col(f"r.{_OVERFLOW}").isNotNull()
    kept = blank_to_null(parsed.filter(~longer).select(*[F.col(f"r.`{c}`") for c in columns]))
    cells = F.size(F.split("line", "\\Q" + options["sep"] + "\\E"))
    return repair_columns(kept, aliases), parsed.filter(longer).select("line", cells.alias("fields"))


# Conditions under which a source counts as missing.
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_or_else(
    primary: Callable[[], DataFrame], *others: Callable[[], DataFrame]
) -> DataFrame:
    """First source that is there and fits; the last failure is raised.

    Only a missing path, a file without a schema and a header without the wanted
    columns (ValueError) go on to the next source.
    """
    sources = (primary, *others)
    for position, source in enumerate(sources):
        try:
            return source()
        except (AnalysisException, ValueError) as error:
            absent = not isinstance(error, AnalysisException) or error.getCondition() in _ABSENT
            if position == len(sources) - 1 or not absent:
                raise
    raise AssertionError("unreachable")


def literal_rows(spark: SparkSession, rows: Iterable[tuple], columns: Sequence[str]) -> DataFrame:
    """A small table written in code; its size is known, so Spark broadcasts it."""
    structs = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def fallback_companies(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, FALLBACK_COMPANIES, ["company", "symbol"])


def read_or_empty(
    spark: SparkSession, source: Callable[[], DataFrame], schema: T.StructType
) -> DataFrame:
    """Optional source: an empty frame of the schema when its path does not exist."""
    try:
        return source()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def column_or_null(df: DataFrame, name: str, data_type: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(data_type)


def mention_scores(df: DataFrame) -> DataFrame:
    """Make sure a numeric sentiment_score exists, from labels if it must."""
    if "sentiment_score" not in df.columns and "sentiment" in df.columns:
        df = df.withColumn("sentiment_score", graded_label_score(F.col("sentiment")))
    require_columns(df, ["company", "sentiment_score", "timestamp"])
    return df.withColumn("sentiment_score", to_number(F.col("sentiment_score")))
