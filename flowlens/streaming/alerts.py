"""Alerts of all detectors on a stream of packets.

The detectors are those of batches; what they keep by key is state here (state.py). Settings in cfg["stream"]: ttl (of what has been told once), idle (after which a flow closes), late (how far packets may lie behind, in event time) and
buckets (of flows, each one value of state)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators import alerts as A
from flowlens.streaming import state
from flowlens.tables import shared


ROWS_A_FILE = 100_000


def start(packets: DataFrame, cfg: dict, folder: str, checkpoint: str, detectors: dict | None = None, **trigger) -> StreamingQuery:
    """Append the alerts of a stream of packets as Parquet: those by packets with the packet, those of whole flows as flows close. A
    micro-batch has a folder of its own that a second try overwrites, so alerts come exactly once over restarts from the checkpoint."""
    spark, schema = packets.sparkSession, packets.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")  # all of one source: where few packets are asked for, others tell the time
    watch = state.Watch()
    A.union(packets, cfg | {"watch": watch}, detectors)

    def report(told: DataFrame, batch: int) -> None:
        """State first, by all of its tasks: fewer tasks that write would else take the state's work into theirs."""
        told = told.persist()
        files = 1 + told.count() // ROWS_A_FILE
        nothing = told.sparkSession.createDataFrame([], schema)
        A.union(nothing, cfg | {"watch": state.Watch(told)}, detectors).repartition(files).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        told.unpersist()

    stream = watch.stream(state.setting(cfg, "ttl"), state.setting(cfg, "late")).writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
    return stream.outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def replay(packets: DataFrame, cfg: dict, cuts: list[int], detectors: dict | None = None) -> DataFrame:
    """Alerts of packets that come as a stream in order of seq, cut where seq reaches each of cuts; the stream is stopped at each cut
    and started again from its checkpoint. A last packet far in the future, which comes with the last part, closes all flows."""
    spark = packets.sparkSession
    base = f"{shared(spark)}/replay-{uuid.uuid4().hex}"
    bounds = [None, *cuts, None]
    end = packets.agg(F.max("ts_us").alias("ts_us")).withColumn("ts_us", F.coalesce("ts_us", F.lit(0)) + 1000 * (state.millis(state.setting(cfg, "late")) + state.millis(state.setting(cfg, "idle")) + 1000))
    marker = packets.limit(1).drop("ts_us").crossJoin(end).select(*packets.columns).withColumn("capture_id", F.lit("end of stream"))  # one row each
    parts = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = packets if low is None else packets.where(F.col("seq") >= low)
        parts.append(part if high is None else part.where(F.col("seq") < high))
    parts[-1] = parts[-1].unionByName(marker)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/packets")
        stream = spark.readStream.schema(packets.schema).parquet(f"{base}/packets")
        start(stream, cfg, f"{base}/alerts", f"{base}/checkpoint", detectors, availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/alerts").drop("batch").where("capture_id <> 'end of stream'")
