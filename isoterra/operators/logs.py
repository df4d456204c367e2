"""Tile-cache and run-log tables: statistics, expiry, eviction, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.spread import in_order, running_total

# Cache life time, cache size limit.
LIFETIME_HOURS = 24
CACHE_LIMIT_BYTES = 500 * 1024 * 1024


def cache_stats(log: DataFrame) -> DataFrame:
    """Requests, hits, misses, downloads, hit rate and mean download time of a log (hit, ms).

    A miss whose `ms` is NULL was not downloaded.
    """
    miss = ~F.col("hit")
    return log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("hit")).alias("hits"),
        F.count_if(miss).alias("misses"),
        F.count(F.when(miss, F.col("ms"))).alias("downloads"),
        F.sum(F.when(miss, F.col("ms"))).alias("_ms"),
    ).select(
        "requests",
        "hits",
        "misses",
        "downloads",
        F.coalesce(F.try_divide(F.col("hits"), F.col("requests")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.try_divide(F.col("_ms"), F.col("downloads")), F.lit(0.0)).alias("mean_download_ms"),
    )


def cache_key(url: Column) -> Column:
    """Key of a cached tile."""
    return F.md5(url)


def cache_path(url: Column) -> Column:
    """File of a cached tile below the cache folder, `aa/<key>.tile`."""
    key = cache_key(url)
    return F.concat(F.substring(key, 1, 2), F.lit("/"), key, F.lit(".tile"))


def expired(entries: DataFrame, now: Column, hours: int = LIFETIME_HOURS) -> DataFrame:
    """Entries past their life time (or `expire_time`, if the table has one) or without a file."""
    end = F.col("cache_time") + F.expr(f"interval {hours} hours")
    if "expire_time" in entries.columns:
        end = F.coalesce(F.col("expire_time"), end)
    return entries.where((now > end) | ~F.col("present"))


def eviction_plan(entries: DataFrame, limit: int = CACHE_LIMIT_BYTES) -> DataFrame:
    """Entries to delete, oldest first (ties by key), until the rest fits the limit.

    The running total is taken per range partition with offsets from partition totals, so entries
    that share one timestamp still spread over tasks; the whole size is one extra aggregate.
    """
    order = ["cache_time", "cache_key"]
    ranged = in_order(entries, order)
    freed = running_total(ranged, order, F.col("bytes"), "freed_before", ranged=True)
    total = ranged.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    return (
        freed.join(F.broadcast(total), F.lit(True))
        .where(F.col("total_bytes") - F.col("freed_before") > limit)
        .drop("total_bytes")
    )


def run_summary(files: DataFrame, stages: DataFrame) -> DataFrame:
    """Per run: files ok and total, bytes of good files, stages complete and total, stage time, open stage.

    `files` is (run_id, ok, bytes); `stages` is (run_id, stage, start_time, end_time, completed). The
    current stage is the latest one, and only while it is open.
    """
    by_file = files.groupBy("run_id").agg(
        F.count_if("ok").alias("files_ok"),
        F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    # A difference of timestamps needs no time zone, whichever timestamp type the log has.
    seconds = F.expr("cast(cast(end_time - start_time as interval second) as decimal(24, 6))")
    took = (seconds * 1000).cast("long")
    by_stage = stages.groupBy("run_id").agg(
        F.count_if("completed").alias("stages_complete"),
        F.count(F.lit(1)).alias("stages_total"),
        F.coalesce(F.sum(F.when(F.col("completed"), took)), F.lit(0)).alias("stage_ms"),
        F.max_by(
            F.when(~F.col("completed"), F.col("stage")), F.struct("start_time", "stage")
        ).alias("current_stage"),
    )
    counted = by_file.join(by_stage, "run_id", "full")
    zeros = {c: 0 for c in ("files_ok", "files_total", "bytes", "stages_complete", "stages_total", "stage_ms")}
    return counted.fillna(zeros)
