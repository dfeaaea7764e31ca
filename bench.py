"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "agg_01_source_summary", "win_04_balanced_latest", "win_03_round_robin", "win_05_prune_excess",
    "win_07_dedup_titles", "win_01_feed_window", "join_01_match_existing", "join_03_new_items",
    "upd_01_plan_fetch", "upd_02_apply_fetch", "upd_10_read_state", "upd_15_integrity_job",
    "src_01_read_feeds", "set_06_search", "agg_07_directory_report", "ext_01_parse_elements",
    "ext_33_clean_feed_html", "ext_36_page_signals", "ext_34_extract_standard", "fn_22_add_paragraphs",
    "agg_12_word_count", "str_04_user_actions",
)


def main() -> None:
    from feedloom import build_session
    from feedloom.catalog import load_all

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = build_session(
        "feedloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
