"""Headline queries: one JSON line with the median seconds per query.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pixelweave.plans.registry import load_all
from pixelweave.session import local_session

HEADLINE = (
    "stack_weighted_coverage",  # calibrate, weigh, stack, coverage
    "reject_sigma_clip",  # windows over the pixel key
    "channel_stats",  # robust statistics
    "background_node_values",  # node boxes
    "triangle_matches",  # triangle range join
    "warp_and_stack",  # resampling and stack
    "ncc_best_shift",  # shift search
    "sharpness_laplacian",  # neighbourhood pass
    "star_detection",  # maxima, centroids, FWHM
    "rejection_bursts",  # trailing windows over events
    "timeout_streaks",  # running values over events
    "objects_within_radius",  # cone join
)
# pixels or rows a query reads, for the rate report on stderr
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def run(q, spark, sf_dir: str) -> float:
    t0 = time.perf_counter()
    q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = load_all()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        times = [run(queries[name], spark, sf_dir) for _ in range(REPEATS)]
        # the first run also compiles; it counts only when it is the only one
        seconds[name] = round(statistics.median(times[1:] if len(times) > 1 else times), 3)
        print(f"{name}: {[round(t, 2) for t in times]}", file=sys.stderr, flush=True)
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    total = round(sum(seconds.values()), 3)
    out = {
        "metric": "pixelweave_headline_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "repeats": REPEATS,
        "spark": spark.version,
        "frames": frames,
        "pixels": frames * 64,
        "stack_pixels_per_sec": round(frames * 64 / seconds["stack_weighted_coverage"]) if "stack_weighted_coverage" in seconds else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
