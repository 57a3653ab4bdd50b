"""Daily purchase revenue and user sessions from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cartlight.functions.money import money_sum
from cartlight.functions.ranking import top_k_per
from cartlight.session import prepare

DAYS = "purchases bigint, revenue double, day date"
SESSIONS = """user_id bigint, session_start timestamp, last_event timestamp, events bigint, purchases bigint,
    revenue double"""
# A session ends when its user does nothing for so long; events and repeats may come so much late.
GAP, DELAY = "30 minutes", "1 hour"


def read_events(
    spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None, state_partitions: int = 8
) -> DataFrame:
    """A stream over the Parquet files that arrive in ``folder``, all that are there in one batch unless capped.

    The state is one row per day, so few state partitions do. They are set in a session of the stream's own; a query
    keeps the number it was first started with.
    """
    own = prepare(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    reader = own.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_revenue(events: DataFrame) -> DataFrame:
    """Purchases and revenue per UTC day, for a batch or a stream.

    A stream keeps one row of state per day and no watermark: an event counts however late it comes.
    """
    day = F.to_date(F.col("ts").cast("timestamp")).alias("day")
    bought = events.filter(F.col("event_type") == "purchase").select(day, "value")
    return bought.groupBy("day").agg(
        F.count(F.lit(1)).alias("purchases"), F.coalesce(money_sum(F.col("value")), F.lit(0.0)).alias("revenue")
    )


def write_daily_revenue(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` up to date, a partition per day, working through all files present, then stopping.

    The offsets and state in ``checkpoint`` make a restarted query continue without loss or repeats.
    """

    def replace(days: DataFrame, batch: int) -> None:
        days.select("purchases", "revenue", "day").repartition("day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(target)

    return (
        daily_revenue(events).writeStream.outputMode("update").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_days(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(DAYS).parquet(target).select("day", "purchases", "revenue")


def distinct_events(events: DataFrame) -> DataFrame:
    """Every event_id once, for a batch or a stream: the first that arrives, in a batch the earliest.

    Deliveries repeat events. A stream remembers all ids it has seen, without a watermark, so that a repeat is known
    however late it comes; the state grows by one id per event, so let a long stream use the RocksDB state store. Events
    without an id are not told apart from one another, and one of them is kept.
    """
    if events.isStreaming:
        return events.dropDuplicates(["event_id"])
    order = [F.asc("ts"), *[F.asc(c) for c in events.columns if c not in ("event_id", "ts")]]
    return top_k_per(events, "event_id", 1, order, "_rank").drop("_rank")


def user_sessions(events: DataFrame, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """Sessions of every user: events less than ``gap`` apart, without repeated events.

    A batch gives all sessions. A stream gives a session once, when its watermark, the latest event less ``delay``, has
    passed its end (``gap`` after its last event); until then it is state. Events that come later than that are
    left out, and so are repeats that come within ``delay`` of each other. Events without user or time form no session.
    """
    timed = events.filter("user_id is not null and ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = distinct_events(timed)
    bought = F.col("event_type") == "purchase"
    return once.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(
        F.min("at").alias("session_start"), F.max("at").alias("last_event"), F.count(F.lit(1)).alias("events"),
        F.count_if(bought).alias("purchases"),
        F.coalesce(money_sum(F.when(bought, F.col("value"))), F.lit(0.0)).alias("revenue"),
    ).drop("s")


def write_sessions(sessions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append finished sessions to ``target``, working through all files present, then stopping.

    A session is written once: the file sink's log and the state in ``checkpoint`` agree after a restart.
    """
    return (
        sessions.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_sessions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SESSIONS).parquet(target)
