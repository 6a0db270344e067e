"""Streaming forms of the batch jobs.

Sources are file or message streams with an event-time column ``ts`` (cast to a zoned timestamp, as
watermarks need).  Late rows beyond the watermark are dropped.  Sinks are idempotent: a micro-batch
writes to a path of its own number, so a batch that is run again replaces its own output.  A run
that is given a folder keeps its checkpoint and output there and goes on from them when it is
started again; without one it is a bounded run of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight.functions.scalar import micros
from fleetsight.operators.depth import edges
from fleetsight.session import scratch
from fleetsight.sources import buckets
from fleetsight.streaming.ordered import frames

LATE = "10 seconds"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table, with the declared schema of the batch table."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def event_time(df: DataFrame, late: str = LATE) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_to_end(df: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Process everything that is there and return what the stream wrote (parquet in the shared folder)."""
    spark = df.sparkSession
    base = at or scratch(spark, name)
    q = (df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/cp")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def written(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the micro-batches that have output in a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def each_batch(df: DataFrame, name: str, work: Callable[[DataFrame, int, str], DataFrame], mode: str = "append",
               at: str | None = None) -> str:
    """Apply ``work(batch, number, folder)`` to every micro-batch and return the run's folder; batch ``n``
    owns ``out/batch=n`` in it."""
    spark = df.sparkSession
    base = at or scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        work(batch, number, base).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q: StreamingQuery = (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/cp")
                         .trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def last_batch(spark: SparkSession, base: str) -> DataFrame:
    """Output of the newest micro-batch."""
    return spark.read.parquet(f"{base}/out/batch={written(spark, f'{base}/out')[-1]}")


def run_complete(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """A bounded run whose result has all groups of an aggregation without event time."""
    return last_batch(df.sparkSession, each_batch(df, name, lambda b, n, base: b, "complete", at))


def stateful(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_closed(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str, at: str | None = None,
               end: bool = True, close_at: str = "2200-01-01") -> DataFrame:
    """Run ``plan`` on a stream in append mode, so that state holds only what is still open, and return what it wrote.

    With ``end`` one row far in the future follows the data: the watermark passes every window, session and timer, and
    all of them are written.  Without it the run goes on later from the same folder ``at``.
    """
    spark = stream.sparkSession
    base = at or scratch(spark, name)
    stateful(spark)
    mark = f"{base}/end"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(mark)
    both = lambda: plan(stream.unionByName(spark.readStream.schema(stream.schema).parquet(mark)))
    out = run_to_end(both(), name, at=base)
    if end:
        row = [F.lit(close_at).cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes]
        spark.range(1).select(*row).write.mode("append").parquet(mark)
        out = run_to_end(both(), name, at=base)
    return out


def frame_edges(pixels: DataFrame, width: int, height: int, name: str = "edges", at: str | None = None) -> DataFrame:
    """Edge pixels of frames whose pixels (``frame_key, ts, v, u, depth_raw``) may come in several files.

    Pixels wait as state of their frame and leave it when the frame is complete, so a micro-batch computes the frames it
    completes and never reads an earlier one.
    """
    spark = pixels.sparkSession
    stateful(spark)
    whole = frames(pixels.select("frame_key", "ts", "v", "u", F.col("depth_raw").alias("x")), width, height)

    def work(batch: DataFrame, number: int, base: str) -> DataFrame:
        rows = batch.filter("complete").select("frame_key", "v", F.col("x").alias("depth_raw"))
        return edges(rows, height, whole_rows=True).groupBy("frame_key").agg(F.count(F.lit(1)).alias("edge_pixels"))

    return spark.read.parquet(f"{each_batch(whole, name, work, at=at)}/out").drop("batch")


def upkeep(changes: DataFrame, start: DataFrame, name: str = "objects", at: str | None = None,
           number: int = buckets.BUCKETS) -> DataFrame:
    """Objects after a stream of changes: each micro-batch is saved into the buckets it touches.

    A micro-batch that is run again saves the same versions, so the table is right after any restart.
    """
    spark = changes.sparkSession
    base = at or scratch(spark, name)
    if not buckets.exists(spark, f"{base}/table"):
        buckets.create(start, f"{base}/table", buckets=number)

    def write(batch: DataFrame, _: int) -> None:
        buckets.save(batch, f"{base}/table", buckets=number)

    (changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True)
     .start().awaitTermination())
    return buckets.read(spark, f"{base}/table", start)


def frame_masks(events: DataFrame, per_frame: int) -> DataFrame:
    """Masks per frame, kept as state by frame, so a frame may come in several files."""
    return events.groupBy(F.floor(F.col("event_id") / per_frame).alias("frame_key")).agg(
        F.count(F.lit(1)).alias("masks"), F.count_if(F.col("event_id") % 3 == 0).alias("fastsam"))


def windowed_metrics(events: DataFrame, width: str = "2 seconds", late: str = LATE) -> DataFrame:
    """Count, mean and extremes per metric and tumbling window."""
    return event_time(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high")).select(
        "event_type", micros(F.col("w.start")).alias("window_start"), "n", "mean", "low", "high")


def rolling_accuracy(feedback: DataFrame, width: str = "24 hours", step: str = "1 hour", below: float = 0.7,
                     late: str = LATE) -> DataFrame:
    """Accuracy and alert over sliding windows."""
    f = feedback.withColumn("ts", F.col("timestamp"))
    n, ok = F.count(F.lit(1)), F.count_if("was_correct")
    return event_time(f, late).groupBy(F.window("ts", width, step).alias("w")).agg(
        n.alias("total_reviewed"), ok.alias("correct")).select(
        micros(F.col("w.end")).alias("window_end"), "total_reviewed", "correct",
        (F.col("correct") / F.col("total_reviewed") < below).alias("alert"))


def sighting_sessions(events: DataFrame, gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """Stretches in which an object keeps being seen."""
    return event_time(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("sightings"), F.max("value").alias("best")).select(
        "user_id", micros(F.col("w.start")).alias("first_seen"), "sightings", "best")


def feedback_from_decisions(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Decision stream joined with the queue: one feedback row per submitted review."""
    q = queue.select(F.col("id").alias("review_id"), "object_id", F.col("provisional_class").alias("original_class"),
                     F.col("confidence").alias("original_confidence"), "image_path")
    j = decisions.filter(F.col("action") == "submit").join(q, "review_id")
    return j.withColumn("was_correct", F.col("original_class") == F.col("human_class"))


def outgoing_events(routed: DataFrame) -> DataFrame:
    """One event per stage output: name, time and JSON payload."""
    def event(name: str, cond, *cols: str) -> DataFrame:
        return routed.filter(cond).select(
            F.lit(name).alias("event"), F.col("ts").alias("timestamp"), F.to_json(F.struct(*cols)).alias("data"))

    low = F.col("status") == "needs_review"
    return (event("object_detected", F.lit(True), "det_id", "class_name", "confidence")
            .unionByName(event("review_needed", low, "det_id", "class_name", "reason"))
            .unionByName(event("alert", low & (F.col("confidence") < 0.05), "det_id", "confidence")))
