"""A stream of file changes put into the store, and windowed counts of a change feed. An extension of batch indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame) -> DataFrame:
    """Of each source and path the last change by version; repeated deliveries count once."""
    w = Window.partitionBy("source", "path").orderBy(F.desc("version"))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def newer(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Changes of a version that is above what is known of their source and path."""
    known = versions.select("source", "path", F.col("version").alias("_known"))
    return changes.join(known, ["source", "path"], "left").where(F.col("_known").isNull() | (F.col("version") > F.col("_known"))).drop("_known")


def ingest(changes: DataFrame, engine, checkpoint: str, trigger: dict | None = None, horizon: int | None = None) -> StreamingQuery:
    """Indexes a stream (source, path, content, version); null content deletes. Each micro-batch is one commit a source.

    The last version of each source and path is kept in the store, deletions too, and committed with what it brought: so
    deliveries in any order, in any batches and again give the store of the newest versions. With a horizon, deletions
    that lie further below the newest version of a batch are forgotten.
    """

    def put(batch: DataFrame, _: int) -> None:
        last = newer(latest(batch), engine.store.table("versions")).persist()
        try:
            for r in last.groupBy("source").agg(F.max("version").alias("top")).collect():  # sources of a micro-batch
                mine = last.where(F.col("source") == r.source)
                versions = mine.select("path", "version", F.col("content").isNull().alias("gone"))
                engine.index_changes(r.source, mine.where("content is not null").select("path", "content"), mine.select("path"), versions=versions)
                if horizon is not None:
                    engine.forget_versions(r.top - horizon)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of a change feed (ts, event_type, value) in tumbling windows, with a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
