"""Event logs read as task metrics."""

import json

import pytest

from rightsize.operators import calibrate as K
from rightsize.sources.eventlog import read_task_metrics


def event(task, stage=1, finish=1010, failed=False):
    return json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0,
                       "Task Info": {"Task ID": task, "Attempt": 0, "Launch Time": 1000, "Finish Time": finish, "Failed": failed,
                                     "Killed": False, "Speculative": False, "Executor ID": "1"},
                       "Task Metrics": {"Executor Run Time": 9, "JVM GC Time": 0, "Memory Bytes Spilled": 0, "Disk Bytes Spilled": 0}})


@pytest.mark.parametrize(("file", "app"), [
    ("app-logs/application_1_0001", "application_1_0001"), ("local_logs/spark-0f3a", "spark-0f3a"),
    ("app-logs/local-17.inprogress", "local-17"), ("logs/application_1_0002_1.zstd.json", "application_1_0002_1"),
    ("app-logs/eventlog_v2_spark-77/events_1_spark-77", "spark-77")])
def test_application_ids(spark, tmp_path, file, app):
    path = tmp_path / file
    path.parent.mkdir(parents=True)
    path.write_text(event(1) + "\n" + json.dumps({"Event": "Other"}) + "\n" + event(2, finish=1030) + "\n")
    rows = read_task_metrics(spark, str(tmp_path)).collect()
    assert {(r.app_id, r.task_id, r.duration_ms) for r in rows} == {(app, 1, 10), (app, 2, 30)}
    assert K.stage_summary(read_task_metrics(spark, str(tmp_path))).count() == 1
