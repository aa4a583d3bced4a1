"""Headline queries, timed end to end from the given tables.

Prints one JSON line. Every query starts from the parquet files and writes all
its rows to the no-op sink; nothing is reused from one query to the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import queries  # noqa: E402
from feedloom.session import build_session  # noqa: E402

HEADLINE = """
    base_events posts weighted_posts thread_events number_posts weekly_feedback post_summary
    number_posts_heavy_groups text_parts_heavy_groups sentiment_series bot_post_counts weekly_digest
    message_deletes reaction_removals merge_incremental incremental_base lexicon_sentiment
    large_lexicon_sentiment stream_base stream_weekly_sentiment
""".split()


def run(name, spark, folder):
    start = time.perf_counter()
    queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "feedloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run("capitalise", spark, folder)  # start-up of the session is not part of any query
    seconds = {name: run(name, spark, folder) for name in names}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
