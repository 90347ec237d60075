"""New images as a stream: blocked against what is known, components kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.blocking import distinct_words, near_words
from kindred.operators.graph import components_with_nodes


class HashClusters:
    """Hashes and labels in tables under ``path``; each batch adds its rows and ties them to the known ones.

    A batch is written under its own number, so one that is run again after a failure replaces itself.
    """

    def __init__(self, path: str, distance: int, bits: int = 64):
        self.path, self.distance, self.bits = path, distance, bits

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` has id and word."""
        spark = batch.sparkSession
        new = batch.select(F.col("id").cast("long"), F.col("word").cast("long"), F.lit(batch_id).alias("batch"))
        new.write.mode("overwrite").parquet(f"{self.path}/hashes/b={batch_id}")
        known = spark.read.parquet(f"{self.path}/hashes").filter(F.col("batch") <= batch_id)
        words = distinct_words(new, "word")
        least = known.groupBy(F.col("word").alias("w")).agg(F.min("id").alias("least"))
        near = near_words(words, self.distance, self.bits, others=least.select("w"))  # new words meet the known ones only
        ends = [least.select(F.col("w").alias(w), F.col("least").alias(x)) for w, x in (("wa", "a"), ("wb", "b"))]
        equal = known.join(words, known["word"] == words["w"], "left_semi").join(least, known["word"] == least["w"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
        edges = near.join(ends[0], "wa").join(ends[1], "wb").select("a", "b").unionByName(equal)
        if batch_id:
            old = spark.read.parquet(f"{self.path}/labels/b={batch_id - 1}")
            edges = edges.unionByName(old.select(F.col("id").alias("a"), F.col("label").alias("b")))
        components_with_nodes(known, edges).write.mode("overwrite").parquet(f"{self.path}/labels/b={batch_id}")
        self.last = batch_id

    def labels(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/labels/b={self.last}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream with id and word."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def attempts_by_window(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Attempts and successes by source in event-time windows, late rows up to the watermark included."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "ok")
    )
