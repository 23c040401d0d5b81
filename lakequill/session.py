"""The session every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on; everything else is left to the cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
}


def build_session(master: str | None = None, app: str = "lakequill", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's semantics; ``conf`` adds to or overrides the settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SEMANTICS | (conf or {})).getOrCreate()


def local_session(cpus: int = 8, conf: dict[str, str] | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    local = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    return build_session(f"local[{cpus}]", conf=local | (conf or {}))
