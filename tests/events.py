"""Short-hands for hand-written events."""

SQL = "org.apache.spark.sql.execution.ui."
FINAL = "AdaptiveSparkPlan isFinalPlan=true"


def exec_start(i, description="q", time=1_700_000_000_000, **more):
    return {
        "Event": SQL + "SparkListenerSQLExecutionStart",
        "executionId": i,
        "rootExecutionId": i,
        "description": description,
        "time": time,
        **more,
    }


def exec_end(i, time=1_700_000_001_000):
    return {"Event": SQL + "SparkListenerSQLExecutionEnd", "executionId": i, "time": time}


def job_start(i, stage_ids, execution=0, submitted=1000, **props):
    properties = {"spark.sql.execution.id": str(execution)} if execution is not None else {}
    return {
        "Event": "SparkListenerJobStart",
        "Job ID": i,
        "Submission Time": submitted,
        "Stage IDs": stage_ids,
        "Properties": {**properties, **props},
    }


def job_end(i, completed=5000, result="JobSucceeded"):
    return {
        "Event": "SparkListenerJobEnd",
        "Job ID": i,
        "Completion Time": completed,
        "Job Result": {"Result": result},
    }


def submitted(stage, attempt=0, time=1000, rdds=(), **more):
    return {
        "Event": "SparkListenerStageSubmitted",
        "Stage Info": {
            "Stage ID": stage,
            "Stage Attempt ID": attempt,
            "Stage Name": f"stage {stage}",
            "Number of Tasks": 4,
            "Submission Time": time,
            "RDD Info": list(rdds),
            **more,
        },
    }


def completed(stage, attempt=0, start=1000, end=3000, accumulables=()):
    info = {
        "Stage ID": stage,
        "Stage Attempt ID": attempt,
        "Completion Time": end,
        "Accumulables": list(accumulables),
    }
    if start is not None:
        info["Submission Time"] = start
    return {"Event": "SparkListenerStageCompleted", "Stage Info": info}


def task_start(task, stage=0, launch=1000, **info):
    return {
        "Event": "SparkListenerTaskStart",
        "Stage ID": stage,
        "Stage Attempt ID": 0,
        "Task Info": {"Task ID": task, "Attempt": 0, "Launch Time": launch, **info},
    }


def task_end(task, stage=0, launch=1000, finish=2000, metrics=None, accumulables=(), **info):
    return {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Stage Attempt ID": 0,
        "Task Type": "ResultTask",
        "Task End Reason": {"Reason": "Success"},
        "Task Info": {
            "Task ID": task,
            "Attempt": 0,
            "Launch Time": launch,
            "Finish Time": finish,
            "Accumulables": list(accumulables),
            **info,
        },
        **({"Task Metrics": metrics} if metrics is not None else {}),
    }


def node(name, *children, metrics=(), location=None, simple=None):
    out = {
        "nodeName": name,
        "simpleString": simple or name,
        "metadata": {"Location": location} if location else {},
        "metrics": [
            {"name": n, "accumulatorId": acc, "metricType": "sum"} for n, acc in metrics
        ],
        "children": list(children),
    }
    return out


def final_plan(execution, *children, simple=FINAL):
    return {
        "Event": SQL + "SparkListenerSQLAdaptiveExecutionUpdate",
        "executionId": execution,
        "sparkPlanInfo": node("AdaptiveSparkPlan", *children, simple=simple),
    }


ROWS = "number of output rows"


def skew_log(durations, stage=0):
    """A complete one-stage log with tasks of the given durations (None: not ended)."""
    events = [exec_start(0), job_start(0, [stage]), submitted(stage)]
    for i, d in enumerate(durations):
        events.append(task_start(i, stage, **{"Partition ID": i}))
        if d is not None:
            events.append(task_end(i, stage, finish=1000 + d))
    return events
