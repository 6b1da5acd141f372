"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [names]."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from bellwether.session import build_session  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if value != value:
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    spark_seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spark_seconds:.1f}s"
    started = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    want = cursor.fetchall()
    sql_seconds = time.time() - started
    times = f"{len(got)} rows, spark {spark_seconds:.1f}s, sql {sql_seconds:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left == right:
        odd = [f"{k}:{v}" for k, v in kinds.items() if "HUGEINT" in v or "DECIMAL" in v]
        return True, times + (f"  TYPES {odd}" if odd else "")
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    shown = "\n    ".join(str(x)[:600] for x in (["spark"] + only_left + ["sql"] + only_right))
    return False, f"{times}, {len(left)} vs {len(right)} rows\n    {shown}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare",
        "local[8]",
        8,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name in wanted:
        try:
            same, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            same, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(("ok   " if same else "FAIL ") + f"{name}: {note}", flush=True)
        if not same:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
