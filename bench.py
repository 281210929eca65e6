"""Times the headline queries over whole tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from storyframe.session import build_session
from workload.runs import REGISTRY

QUERIES = [
    "subtitle_parse", "timecode_format", "label_value", "region_pivot", "scene_project", "scene_dialogues",
    "scene_highlights", "scene_cues", "interval_bucketed", "chapter_rollup", "timeline_linear", "timeline_branches",
    "script_build", "blueprint_scenes", "ingest_plan", "catalog_list", "asset_actions", "status_changes", "status_stamps", "status_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # The first query pays for starting the session.
    run(spark, sf_dir, "workflow_state")
    times = {name: run(spark, sf_dir, name) for name in QUERIES}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


if __name__ == "__main__":
    main()
