"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (input folder), ``BENCH_CPUS`` (local cores), ``BENCH_QUERIES`` (comma list).
The first entry, ``log_build``, derives, encodes, decodes and stores the log; the others read it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from chatledger.queries import REGISTERED, store

HEADLINE = [
    "log_scan", "log_export", "log_import", "events_decode", "events_ordered", "message_table", "chat_participant",
    "chat_user_view", "unread_view", "chat_list_all", "cmd_message_delete", "read_admission", "replay_full",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("chatledger-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="chatledger-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.time()
    store(spark, sf_dir)
    times["log_build"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
