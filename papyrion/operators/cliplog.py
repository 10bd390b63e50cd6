"""The clip log: filter, sort and limit; lookup by address; upsert; activity; page state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.hashing import compare_fingerprint
from papyrion.functions.urls import comparable_url, hostname


def list_clips(clips: DataFrame, since: Column | None = None, clip_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Clips newest first (null times last, ties by id), from ``since`` on, of one type, at most ``limit``."""
    out = clips
    if since is not None:
        out = out.where(F.col("clipped") >= since)
    if clip_type is not None:
        out = out.where(F.col("clip_type") == clip_type)
    out = out.orderBy(F.col("clipped").desc_nulls_last(), "clip_id")
    return out.limit(limit) if limit is not None else out


def latest_by_url(clips: DataFrame) -> DataFrame:
    """The newest clip of each address, whatever its fragment: url_key and the clip's columns."""
    keyed = clips.withColumn("url_key", comparable_url(F.col("url"))).where("url_key is not null")
    newest = F.struct(F.col("clipped").isNotNull(), F.col("clipped"), -F.col("clip_id"))
    row = F.max_by(F.struct(*clips.columns), newest).alias("clip")
    return keyed.groupBy("url_key").agg(row).select("url_key", "clip.*")


def find_clips(pages: DataFrame, clips: DataFrame) -> DataFrame:
    """Pages (with url) with the id, path and fingerprint of their newest clip, null where there is none."""
    found = latest_by_url(clips).select("url_key", "clip_id", "clip_path", "content_fingerprint", "preview_fingerprint")
    return pages.withColumn("url_key", comparable_url(F.col("url"))).join(found, "url_key", "left").drop("url_key")


def first_deliveries(clips: DataFrame, key: str, delivered: str) -> DataFrame:
    """The earliest delivery of each record."""
    return clips.groupBy(key).agg(F.min_by(F.struct(*clips.columns), delivered).alias("r")).select("r.*")


def upsert_clips(stored: DataFrame, delivered: DataFrame) -> DataFrame:
    """The log after new clips: one address is one record, and a re-clip keeps id, path and first time.

    ``delivered`` has the log's columns with updated_at; of several clips of an address the latest counts. A delivered
    null leaves what is stored.
    """
    kept = ["clip_id", "clip_path", "clipped"]
    new = latest_by_url(delivered)
    old = stored.withColumn("url_key", comparable_url(F.col("url")))
    newest = old.groupBy("url_key").agg(F.max_by("clip_id", F.struct(F.col("clipped").isNotNull(), F.col("clipped"), -F.col("clip_id"))).alias("target"))
    fresh = new.select(F.col("url_key"), *[F.col(c).alias(f"n_{c}") for c in stored.columns]).withColumn("_new", F.lit(True))
    # Only the newest record of an address is refreshed; older records of it stay as they are.
    joined = old.join(newest, "url_key", "left").withColumn("_hit", F.col("clip_id") == F.col("target")).join(fresh, "url_key", "full_outer")
    value = lambda c: F.when(F.col("url").isNull() & F.col("_new"), F.col(f"n_{c}")).when(F.col("_hit") & F.col("_new"), F.coalesce(*([F.col(c), F.col(f"n_{c}")] if c in kept else [F.col(f"n_{c}"), F.col(c)]))).otherwise(F.col(c)).alias(c)
    return joined.select([value(c) for c in stored.columns])


def delete_clips(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("clip_id").distinct(), "clip_id", "left_anti")


def get_clips(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The clips of some ids."""
    return stored.join(ids.select("clip_id").distinct(), "clip_id", "left_semi")


def clear_clips(stored: DataFrame) -> DataFrame:
    """The log without clips."""
    return stored.limit(0)


def new_clip_id(url: Column, clipped: Column) -> Column:
    """An id for a new clip: its time in milliseconds and six characters of a hash of time and address, so that a task that is run again gives the same."""
    millis = F.unix_millis(clipped).cast("string")
    return F.concat(F.lit("clip-"), millis, F.lit("-"), F.left(F.sha2(F.concat_ws("\n", millis, url), 256), F.lit(6)))


def clip_types(clips: DataFrame) -> DataFrame:
    return clips.select("clip_type").where("clip_type <> ''").distinct().orderBy("clip_type")


def activity(clips: DataFrame, collections: DataFrame) -> DataFrame:
    """One row: clips, source_sites, collections, last_clipped (ISO text, empty without any)."""
    log = clips.agg(F.count("*").alias("clips"), F.countDistinct(hostname(F.col("url"))).alias("source_sites"), F.max("clipped").alias("last"))
    saved = collections.agg(F.count("*").alias("collections"))
    last = F.coalesce(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("last_clipped")
    # Two rows of one: a product of aggregates, not of tables.
    return log.withColumn("_one", F.lit(1)).join(saved.withColumn("_one", F.lit(1)), "_one").select("clips", "source_sites", "collections", last)


def page_state(pages: DataFrame, library: DataFrame, clips: DataFrame) -> DataFrame:
    """Pages (url, fingerprint) with their state: current or changed against the clip, stored in a library, known, or unknown."""
    keyed = pages.withColumn("url_key", comparable_url(F.col("url")))
    stored = library.select(comparable_url(F.col("url")).alias("url_key"), F.lit(True).alias("_stored")).distinct()
    clip = latest_by_url(clips).select("url_key", F.coalesce(F.nullif("preview_fingerprint", F.lit("")), "content_fingerprint").alias("_print"), F.lit(True).alias("_clip"))
    joined = keyed.join(stored, "url_key", "left").join(clip, "url_key", "left")
    against = compare_fingerprint(F.col("_print"), F.col("fingerprint"))
    state = F.when(F.col("_clip") & (against != "unknown"), against).when(F.col("_stored"), "stored").when(F.col("_clip"), "known").otherwise("unknown")
    return joined.withColumn("state", state).drop("url_key", "_stored", "_print", "_clip")
