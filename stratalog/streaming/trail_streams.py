"""The audit operators over streams: stateless rules as they are, and windows with watermarks where state is needed."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import TRAIL, duck
from ..operators import trail

DELAY = "1 hour"


def shared_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="stratalog-")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as a file stream, with the columns of ``adapters.TRAIL``."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event[s].parquet")
    name = f"stream_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(name)
    return spark.sql(TRAIL.replace("$events", name)).withColumn("event_time", F.col("event_time").cast("timestamp"))


def alerts(events: DataFrame) -> DataFrame:
    return trail.alerts(events)


def dedupe(events: DataFrame) -> DataFrame:
    """Each event id once; the state holds ids no longer than the watermark's delay."""
    return events.withWatermark("event_time", DELAY).dropDuplicatesWithinWatermark(["event_id"])


def denied_bursts(events: DataFrame, least: int = 3) -> DataFrame:
    """Many denied calls of one actor inside a sliding window."""
    hit = events.where(F.lower(F.coalesce("error_code", F.lit(""))).rlike(trail.DENIED)).withWatermark("event_time", DELAY)
    return hit.groupBy(F.window("event_time", "12 hours", "6 hours").alias("w"), trail.who().alias("who")).agg(F.count("*").alias("calls")).where(F.col("calls") >= least).select(F.col("w.start").alias("start"), "who", "calls")


def login_failures(events: DataFrame) -> DataFrame:
    """Runs of failed sign-ins of one actor with gaps under a day."""
    hit = events.where("event_name = 'ConsoleLogin' AND login_result <> 'Success'").withWatermark("event_time", DELAY)
    return hit.groupBy(F.session_window("event_time", "1 day").alias("w"), trail.who().alias("who")).agg(F.count("*").alias("tries")).select(F.col("w.start").alias("start"), "who", "tries")


def key_use(events: DataFrame) -> DataFrame:
    return events.groupBy(trail.who().alias("who")).agg(F.max("event_time").alias("last_use"), F.count("*").alias("calls"))


def finished(build: Callable[[DataFrame], DataFrame], mode: str = "append") -> Callable[[SparkSession, str], DataFrame]:
    """Run a stream over all that is there and return its rows; a complete result is that of its last batch."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
        out = build(source(spark, sf_dir))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={number}")

        out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch=*")

    return run


QUERIES = {
    "stream_trail_alerts": finished(alerts),
    "stream_dedupe": finished(lambda e: dedupe(e.unionByName(e.where("event_id % 4 = 0"))).select("event_id", "event_name")),
    "stream_denied_burst": finished(denied_bursts, "append"),
    "stream_login_failures": finished(login_failures, "append"),
    "stream_key_use": finished(key_use, "complete"),
}
_T = trail._T
_LATE = "(SELECT max(event_time) - INTERVAL 1 HOUR AS mark FROM t WHERE {test})"
ORACLES = {
    "stream_trail_alerts": trail.ORACLES["trail_alerts"],
    "stream_dedupe": f"SELECT event_id, event_name FROM ({duck(TRAIL)})",
    "stream_key_use": _T + "SELECT who, max(event_time) AS last_use, count(*) AS calls FROM t GROUP BY who",
    "stream_denied_burst": _T + f", h AS (SELECT event_time, who FROM t WHERE regexp_matches(lower(error_code), '{trail.DENIED}')), x AS (SELECT who, time_bucket(INTERVAL 6 HOURS, event_time, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOURS AS start FROM h, (VALUES (0), (1)) AS v(k)) SELECT start, who, count(*) AS calls FROM x WHERE start + INTERVAL 12 HOURS <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM h) GROUP BY ALL HAVING count(*) >= 3",
    "stream_login_failures": _T + ", h AS (SELECT event_time, who FROM t WHERE event_name = 'ConsoleLogin' AND login_result <> 'Success'), g AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS n FROM h WINDOW w AS (PARTITION BY who ORDER BY event_time)), s AS (SELECT *, sum(n) OVER (PARTITION BY who ORDER BY event_time) AS k FROM g) SELECT min(event_time) AS start, who, count(*) AS tries FROM s GROUP BY who, k HAVING max(event_time) + INTERVAL 1 DAY <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM h)",
}
