"""Stage-level timing of one ingestion run, from Spark's event log.

Usage: python tools/stage_report.py [sf_dir] > docs/STAGES.md
The event log goes to a fresh scratch folder; no UI or server is started.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="sluice-eventlog-")
    from pyspark.sql import SparkSession

    from sluice.session import ENGINE_SETTINGS, work_root

    b = (SparkSession.builder.master("local[8]").appName("stage-report").config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
         .config("spark.eventLog.compress", "false")
         .config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g"))
    for k, v in ENGINE_SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_root(spark)
    from sluice.plans.ingest import Layout, run_source
    from sluice.plans.standin_files import RUN_DATE, orders_csv_config, write_orders_feed
    from sluice.plans.standins import rates_frame
    from sluice.session import scratch_path

    root = scratch_path(spark, "stagereport")
    cfg = orders_csv_config(root)
    write_orders_feed(spark, sf_dir, cfg.raw_path_for(RUN_DATE))
    spark.sparkContext.setJobGroup("ingest", "ingest run")
    res = run_source(spark, cfg, RUN_DATE, Layout(root), run_id="stage-report", rates=rates_frame(spark))
    spark.stop()

    (path,) = glob.glob(os.path.join(logdir, "*"))
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    lines = [ln for f in files for ln in open(f)]
    jobs, stages = {}, []
    for line in lines:
        ev = json.loads(line)
        if ev["Event"] == "SparkListenerJobStart":
            props = ev.get("Properties") or {}
            for sid in ev.get("Stage IDs", []):
                jobs[sid] = props.get("spark.jobGroup.id")
        if ev["Event"] == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
            dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
            stages.append((info["Stage ID"], info["Stage Name"].split(" at ")[0], info["Number of Tasks"], dur,
                           int(acc.get("internal.metrics.shuffle.write.bytesWritten") or 0),
                           int(acc.get("internal.metrics.shuffle.read.localBytesRead") or 0)
                           + int(acc.get("internal.metrics.shuffle.read.remoteBytesRead") or 0),
                           int(acc.get("internal.metrics.diskBytesSpilled") or 0)))
    mine = [s for s in stages if jobs.get(s[0]) == "ingest"]
    print(f"# Stages of one ingestion run (`tools/stage_report.py {sf_dir}`)\n")
    print(f"Source `{cfg.source_id}`: {res.rows_read} rows read, {res.rows_written} written, {res.rows_rejected} rejected, "
          f"status {res.status}. local[8]; times from the event log.\n")
    print("| stage | operation | tasks | seconds | shuffle write | shuffle read | spilled |")
    print("|---|---|---|---|---|---|---|")
    for sid, name, tasks, dur, sw, sr, sp in mine:
        print(f"| {sid} | {name} | {tasks} | {dur:.2f} | {sw:,} | {sr:,} | {sp:,} |")
    total = sum(s[3] for s in mine)
    print(f"\n{len(mine)} stages, {total:.2f} s of stage time in total; the rest of the wall time is driver-side "
          "planning and job scheduling.")


if __name__ == "__main__":
    main()
