"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query is built and written to a sink that keeps nothing, so planning, size checks and
execution all count.
"""

from __future__ import annotations

import json
import os
import sys
import time

from surveyspark import session
from surveyspark.plans import catalog

HEADLINE = (
    "track_dynamics",
    "segment_visits",
    "track_qc",
    "evidence_audit",
    "verify_intervals",
    "label_intervals",
    "label_outcomes",
    "dedupe_events",
    "event_fields",
    "asof_weather",
    "slope_relief",
    "segment_lines",
    "map_match",
    "event_nearest_road",
    "nearest_context",
    "bio_counts",
    "rank_segments",
    "average_precision",
    "src_field_log",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build("bench", os.environ.get("BENCH_CPUS", "8"))
    # The first job of a session pays for its start-up; it is not part of any query.
    catalog.QUERIES["op_night"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begun = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
