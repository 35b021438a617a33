"""What a query read: Spark's own counters in place of a page cache's."""

from __future__ import annotations

from pyspark.sql import DataFrame

NAMES = ("numFiles", "filesSize", "numOutputRows", "numPartitions", "scanTime", "metadataTime")


def scan_metrics(df: DataFrame) -> list[dict[str, int]]:
    """Runs df and returns the counters of each file scan of the plan that ran."""
    jvm = df.sparkSession._jvm
    df._jdf.queryExecution().toRdd().count()
    found: list[dict[str, int]] = []

    def walk(plan) -> None:
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            walk(plan.executedPlan())
        elif name.endswith("QueryStage"):
            walk(plan.plan())
        elif "Scan " in name:
            metrics = plan.metrics()
            found.append({k: int(metrics.apply(k).value()) for k in NAMES if metrics.contains(k)})
        else:
            for child in jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.children()):
                walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found
