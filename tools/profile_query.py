"""Per-job timing of registered queries from Spark's event log.

Usage: python tools/profile_query.py SF_DIR KEY [KEY ...]
The event log goes to a fresh scratch folder; the UI stays off.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from surfacewx.plans.registry import QUERIES  # noqa: E402
from surfacewx.session import ensure_checkpoint_dir  # noqa: E402


def main() -> None:
    sf_dir, keys = sys.argv[1], sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="run-evlog-")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    marks = []
    for k in keys:
        for rep in range(2):
            spark.sparkContext.setJobDescription(f"{k}#{rep}")
            t0 = time.time()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            marks.append((k, rep, time.time() - t0))
    spark.stop()
    jobs = {}
    for f in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        for line in open(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                desc = e.get("Properties", {}).get("spark.job.description", "")
                jobs[e["Job ID"]] = {"desc": desc, "start": e["Submission Time"], "stages": len(e["Stage Infos"]),
                                     "tasks": sum(s["Number of Tasks"] for s in e["Stage Infos"]),
                                     "sql": e.get("Properties", {}).get("spark.sql.execution.id")}
            elif ev == "SparkListenerJobEnd":
                jobs[e["Job ID"]]["ms"] = e["Completion Time"] - jobs[e["Job ID"]]["start"]
    if os.environ.get("PROFILE_SQL"):
        for f in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
            for line in open(f):
                e = json.loads(line)
                if e.get("Event", "").endswith("SparkListenerSQLExecutionStart"):
                    plan = e.get("physicalPlanDescription", "").splitlines()
                    print("SQL", e["executionId"], e.get("description", "")[:60], "|", " / ".join(l.strip() for l in plan[1:5])[:300])
        for jid, j in sorted(jobs.items()):
            print("job", jid, "sql", j["sql"], j.get("ms"), "ms", j["desc"])
    for k, rep, sec in marks:
        js = [j for j in jobs.values() if j["desc"] == f"{k}#{rep}"]
        print(f"{k} run{rep}: {sec:.3f}s, {len(js)} jobs: " + ", ".join(f"{j.get('ms', '?')}ms/{j['stages']}st/{j['tasks']}t" for j in js))


if __name__ == "__main__":
    main()
