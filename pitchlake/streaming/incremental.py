"""Incremental loading: windows from watermarks, idempotent upserts, and a stream of event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_start(schedule: DataFrame) -> DataFrame:
    """schedule with start: the watermark less the overlap; null before the first run."""
    return schedule.withColumn("start", F.col("watermark") - F.make_interval(hours=F.col("overlap_hours")))


def since_filter(matches: DataFrame, schedule: DataFrame) -> DataFrame:
    """Matches of each schedule's season from its start on; all where it has none."""
    starts = window_start(schedule).select("schedule_id", "season_id", "start")
    return matches.join(starts, "season_id").where(F.col("start").isNull() | (F.col("kickoff_at") >= F.col("start"))).drop("start")


def advance_watermark(schedule: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """schedule with the newest stored kickoff since its start as watermark, where the run was clean. runs: schedule_id, status."""
    newest = since_filter(stored, schedule).groupBy("schedule_id").agg(F.max("kickoff_at").alias("_newest"))
    rows = schedule.join(newest, "schedule_id", "left").join(runs.select("schedule_id", F.col("status").alias("_status")), "schedule_id", "left")
    moved = F.when(F.col("_status") == "COMPLETED", F.coalesce("_newest", "watermark")).otherwise(F.col("watermark"))
    return rows.withColumns({"watermark": moved, "last_status": F.coalesce("_status", "last_status")}).select(schedule.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """existing with the rows of incoming in place of those with equal keys; of several incoming ones the last by `order`."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        incoming = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        incoming = incoming.dropDuplicates(keys)
    return existing.join(incoming.select(*keys), keys, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


#: Buckets of a keyed table, and keys of incoming rows that are broadcast at once at most.
BUCKETS, KEYS = 256, 1_000_000


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


def write_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table by buckets of its keys, for upsert_keyed()."""
    rows.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def kept_of(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a target that incoming ones don't replace. The incoming keys go to the target, which stays where it is."""
    return target.join(F.broadcast(incoming.select(*keys)), keys, "left_anti")


def upsert_keyed(path: str, incoming: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS, most: int = KEYS) -> list[int]:
    """upsert() into a table of write_keyed(): only the buckets that incoming rows fall into are read and rewritten; these are returned.

    Buckets are taken together as long as their incoming keys are `most` at most, and these keys are broadcast; the table's own
    rows aren't moved. A bucket that alone has more keys is joined by a shuffle of that bucket.
    """
    spark = incoming.sparkSession
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        incoming = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        incoming = incoming.dropDuplicates(keys)
    incoming = incoming.withColumn("_bucket", bucket_of(keys, buckets)).persist()
    try:
        sizes = {r["_bucket"]: r["count"] for r in incoming.groupBy("_bucket").count().collect()}  # of the buckets
        groups: list[list[int]] = []
        room = 0
        for bucket in sorted(sizes):
            if not groups or sizes[bucket] > room:
                groups.append([])
                room = most
            groups[-1].append(bucket)
            room -= sizes[bucket]
        table = spark.read.parquet(path)
        for group in groups:
            own = lambda df: df.where(F.col("_bucket").isin(group))
            new = own(incoming)
            large = sum(sizes[b] for b in group) > most
            kept = own(table).join(new.select(*keys), keys, "left_anti") if large else kept_of(own(table), new, keys)
            rows = kept.select(*table.columns).unionByName(new.select(*table.columns).repartition("_bucket"))
            write_partitions(rows, path, ["_bucket"])
        return sorted(sizes)
    finally:
        incoming.unpersist()


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stream_events(spark: SparkSession, path: str, schema, overlap: str = "24 hours", time: str = "ts", keys: tuple[str, ...] = ("provider_id", "provider_event_id"), format: str = "json", **options) -> DataFrame:
    """Arriving event files as a stream, each event once: repeats within the overlap are dropped, by state that the watermark bounds."""
    arrived = spark.readStream.format(format).schema(schema).options(**options).load(path)
    return arrived.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, overlap).dropDuplicatesWithinWatermark(list(keys))


#: Partitions of a target that a micro-batch names at most before it looks at all of them.
NAMED = 1000


def load_stream(
    events: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("provider_id", "provider_event_id"), prepare=None, partition: str | None = None
) -> StreamingQuery:
    """Appends what arrived to a Parquet table in micro-batches. A batch that is run again writes only what is missing.

    partition: a column that equal keys share, such as the match or the day. The table is partitioned by it, and a batch
    is held only against the partitions that it has rows for.
    """

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = prepare(batch) if prepare else batch
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            stored = spark.read.schema(rows.schema).parquet(target)
            if partition:
                own = [r[0] for r in rows.select(partition).distinct().limit(NAMED + 1).collect()]
                stored = stored.where(F.col(partition).isin(own)) if len(own) <= NAMED else stored
            rows = rows.join(stored.select(*keys), list(keys), "left_anti")
        if partition:  # moved to it first, or each task leaves a file in each partition
            rows.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(target)
        else:
            rows.write.mode("append").parquet(target)

    return events.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_provider_events(raw: DataFrame, system: str, target: str, checkpoint: str, mapping: DataFrame | None = None) -> StreamingQuery:
    """A stream of a reader's events, made canonical and appended by match, each event once. mapping: as for canonical_events()."""
    from ..sources.canonical import canonical_events

    def prepare(batch: DataFrame) -> DataFrame:
        return canonical_events(batch, system, mapping).dropDuplicates(["match_external_id", "provider_event_id"])

    return load_stream(raw, target, checkpoint, ("match_external_id", "provider_event_id"), prepare, "match_external_id")
