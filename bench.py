"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and cores. Each query runs over its whole input and its rows are consumed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from paideon.plans import all_queries
from paideon.session import local_session

HEADLINE = [
    "learner_summary", "grade_attempts", "attempt_answers", "bump_mastery", "course_quizzes",
    "course_certificate_eligibility", "certification_eligibility", "quiz_history", "learner_detail",
    "upsert_users", "heading_lines", "section_bodies", "visual_lines", "section_tree",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "paideon-bench")
    queries, times = all_queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores),
    }))


if __name__ == "__main__":
    main()
