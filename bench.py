"""Headline timings: one JSON line. Best of ``BENCH_RUNS`` runs per query (the first one compiles)."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from checks.queries import LINK, QUERIES  # noqa: E402
from tubelens.operators import link as L  # noqa: E402
from tubelens.plans import froc as FR  # noqa: E402
from tubelens.plans.fixtures import Fixtures  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = {
    "linking": "g1", "slice_matching": "j1", "froc": "e2", "average_precision": "w3", "recall_at_budgets": "w4",
    "link_edges": "j4", "nms_2d": "g7", "containment": "g2", "nms_3d": "g3", "distance_dedup": "g4",
    "single_linkage": "g5", "floor_sweep": "e7", "candidates": "e5", "knob_sweep": "e4", "threshold_sweep": "e18",
    "folds": "w7", "slice_cap": "w9", "breakdown": "a9", "slice_labels": "g8",
}


def bootstrap_1000(spark, sf):
    fx = Fixtures(spark, sf)
    return FR.bootstrap_cpm(fx.gt_boxes(), fx.pred(), 1000, 0)


def hot_volume(spark, sf):
    """All detections of the table put into one volume: 1e5 boxes at sf0.1."""
    d = Fixtures(spark, sf).det().withColumns({
        "slice_z": F.col("slice_z") + 12 * (F.col("volume_id") % 30), "volume_id": F.lit(1).cast("long")})
    return L.link_tubes(d.where(F.col("score") >= LINK.op_score), LINK)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: QUERIES[key] for name, key in HEADLINE.items()}
    todo.update({"bootstrap_1000": bootstrap_1000, "linking_hot_volume": hot_volume})
    times = {}
    for name, fn in todo.items():
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_best_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
