"""Spark sessions for local use; on a cluster the submitted session is taken as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "fieldloom", cores: int | str = "*", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(name).master(f"local[{cores}]").config(map=settings | conf).getOrCreate()
