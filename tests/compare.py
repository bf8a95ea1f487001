"""Run registered queries next to their SQL and compare columns, types and rows.

    python tests/compare.py SF [--hot] [name ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Types of the same width in both engines.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE",
}


def local_session(name: str = "chatledger", **conf: str) -> SparkSession:
    """A local session with small shuffles."""
    builder = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="chatledger-wh-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the input tables as views."""
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def mismatch(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result, or None."""
    cursor = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    expected_rows = cursor.fetchall()
    names = sorted(df.columns)
    if names != sorted(kinds):
        return f"columns {names} != {sorted(kinds)}"
    wrong = [
        (c, t, kinds[c]) for c, t in df.dtypes if SAME_TYPE.get(t, t) != kinds[c].upper()
        and not kinds[c].upper().startswith(SAME_TYPE.get(t, t))
    ]
    place = {name: i for i, name in enumerate(kinds)}
    expected = Counter(tuple(row[place[n]] for n in names) for row in expected_rows)
    actual = Counter(tuple(row) for row in df.select(*names).collect())
    if actual != expected:
        return f"rows: {sum(actual.values())} vs {sum(expected.values())}; " \
               f"only Spark {list((actual - expected).items())[:4]}; only SQL {list((expected - actual).items())[:4]}"
    return f"types {wrong}" if wrong else None


def main() -> None:
    import __spark_entry__ as entry

    arguments = sys.argv[1:]
    conf = {}
    if "--hot" in arguments:
        arguments.remove("--hot")
        conf = {"spark__chatledger__hotRows": "40", "spark__chatledger__spanWidth": "3000"}
    scale, names = arguments[0], arguments[1:]
    sf_dir = f"/root/testdata/sf{scale}"
    spark, con = local_session(**conf), connect(sf_dir)
    oracle, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = mismatch(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
