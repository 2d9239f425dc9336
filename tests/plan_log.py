"""Executed plans out of Spark's event log, also of jobs that ran while a
query's plan was being built (checkpoints, scratch tables, counts)."""

import json
import re
from pathlib import Path

# columns with a handful of values: a key of theirs alone puts many rows in few tasks
FEW_VALUES = {"checkpoint", "event_type", "suite", "comparison", "task_type", "lang", "role", "split", "source"}


class PlanLog:
    def __init__(self, folder, spark):
        self.path = Path(folder) / spark.sparkContext.applicationId
        if not self.path.exists():
            self.path = Path(f"{self.path}.inprogress")
        self.spark, self.at = spark, 0

    def new(self) -> list:
        """Plans that were logged since the last call, the last version of each."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self.path.open() as f:
            f.seek(self.at)
            lines = f.readlines()
            self.at = f.tell()
        plans = {}
        for line in lines:
            if "sparkPlanInfo" in line:
                e = json.loads(line)
                plans[e["executionId"]] = e["sparkPlanInfo"]
        return list(plans.values())


def below(node):
    """The first node under this one that does something to rows."""
    while node["children"] and re.match(
            r"Project|Filter|Sort$|WholeStageCodegen|InputAdapter|AQEShuffleRead|ShuffleQueryStage|Exchange|"
            r"AdaptiveSparkPlan|Reused", node["nodeName"]):
        node = node["children"][0]
    return node


def small(node) -> bool:
    """Aggregated, limited or written out by the driver, or joined of such."""
    if "Join" in node["nodeName"]:
        return all(small(below(c)) for c in node["children"])
    return bool(re.search(r"Aggregate|Limit|Window|LocalTableScan|ExistingRDD|RDDScan|TakeOrdered|BroadcastExchange|"
                          r"BroadcastQueryStage", node["nodeName"]))


def nodes(node):
    yield node
    for c in node["children"]:
        yield from nodes(c)


def faults(plan) -> list:
    """What must not be in a plan: all-pairs joins, and exchanges of rows that
    are not aggregated or limited to one task or by a key of few values."""
    out = []
    for n in nodes(plan):
        if n["nodeName"].startswith("CartesianProduct"):
            out.append(n["simpleString"][:200])
        if n["nodeName"] != "Exchange":
            continue
        child = below(n["children"][0])
        keys = re.search(r"hashpartitioning\((.*), \d+\)", n["simpleString"])
        names = {re.sub(r"#\d+L?$", "", k) for k in keys[1].split(", ")} if keys else set()
        if not small(child) and ("SinglePartition" in n["simpleString"] or names and names <= FEW_VALUES):
            out.append(f"{n['simpleString'][:160]} over {child['simpleString'][:160]}")
    return out
