"""Per-stage task statistics of registered queries, from Spark's event log.

Runs the named queries (default: all) with the event log written to a fresh
scratch folder, then prints for each stage the number of tasks, the median
and maximum task time and shuffle-read size, and flags stages where one task
takes far longer or reads far more than the median (skew).

Usage: python scripts/stage_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citeweave.plans.catalog import QUERIES  # noqa: E402
from citeweave.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or list(QUERIES)
    log_dir = tempfile.mkdtemp(prefix="citeweave-eventlog-")
    spark = build_session("local[8]", 16, app_name="citeweave-stages",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    for name in names:
        sc.setJobGroup(name, name)
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    tasks: dict[tuple[int, int], list[tuple[float, int]]] = {}
    group_of_job, job_of_stage = {}, {}
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus")]
    for path in sorted(paths):
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    group_of_job[ev["Job ID"]] = props.get("spark.jobGroup.id", "?")
                    for sid in ev.get("Stage IDs", []):
                        job_of_stage[sid] = ev["Job ID"]
                elif kind == "SparkListenerTaskEnd" and ev.get("Task Info"):
                    info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
                    dur = info["Finish Time"] - info["Launch Time"]
                    sr = metrics.get("Shuffle Read Metrics") or {}
                    read = sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                    tasks.setdefault((ev["Stage ID"], ev["Stage Attempt ID"]), []).append((dur, read))
    flagged = 0
    print(f"{'query':22s} {'stage':>5s} {'tasks':>5s} {'med ms':>7s} {'max ms':>7s} {'med KB':>8s} {'max KB':>8s}")
    for (sid, _), ts in sorted(tasks.items()):
        durs, reads = [t[0] for t in ts], [t[1] for t in ts]
        med_d, max_d = statistics.median(durs), max(durs)
        med_r, max_r = statistics.median(reads), max(reads)
        skew = len(ts) > 2 and ((max_d > 4 * med_d and max_d > 500) or (max_r > 4 * med_r and max_r > 1 << 20))
        flagged += skew
        q = group_of_job.get(job_of_stage.get(sid), "?")
        print(f"{q:22s} {sid:5d} {len(ts):5d} {med_d:7.0f} {max_d:7.0f} {med_r / 1024:8.0f} {max_r / 1024:8.0f}"
              f"{'  <- skew' if skew else ''}")
    print(f"stages flagged: {flagged}; event log: {log_dir}")


if __name__ == "__main__":
    main()
