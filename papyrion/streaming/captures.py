"""Continuous capture: pages arrive in a folder, each batch is captured and merged into the clip table.

The table is laid out in buckets by a hash of the address. A batch writes the buckets that it touches anew and then moves
a pointer that names the version of every bucket, so that a batch that is run again after a failure starts from the same
versions and ends with the same table. All files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrion.functions.hashing import compare_fingerprint, fingerprint_markdown
from papyrion.functions.urls import comparable_url
from papyrion.operators.capture import capture_pages
from papyrion.session import file_system, materialize, names_in, read_text, write_text

CLIPS = "url_key string, clip_id string, url string, title string, path string, clipped timestamp, updated_at timestamp, content_fingerprint string, byte_length long"
#: Parts that the table is laid out in.
BUCKETS = 64


class ClipTable:
    """Buckets of the clip table in a shared folder; ``_current.json`` names each bucket's version and the last batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, str(root).rstrip("/"), buckets

    def _pointer(self) -> dict:
        text = read_text(self.spark, f"{self.root}/_current.json")
        if text is None:
            # A move that broke off between its two steps left the new pointer beside the old one's place.
            parts = [n for n in names_in(self.spark, self.root) if n.startswith("_current-")]
            text = read_text(self.spark, f"{self.root}/{parts[-1]}") if parts else None
        return json.loads(text) if text else {"batch": -1, "buckets": self.buckets, "versions": {}}

    def _move(self, pointer: dict) -> None:
        part = f"{self.root}/_current-{pointer['batch']:012d}.json"
        write_text(self.spark, part, json.dumps(pointer))
        fs, target = file_system(self.spark, f"{self.root}/_current.json")
        fs.delete(target, False)
        fs.rename(file_system(self.spark, part)[1], target)

    def _read(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        by_version: dict[str, list[int]] = {}
        for b, version in pointer["versions"].items():
            if buckets is None or int(b) in buckets:
                by_version.setdefault(version, []).append(int(b))
        parts = [self.spark.read.schema(f"{CLIPS}, bucket int").parquet(f"{self.root}/{v}").where(F.col("bucket").isin(bs)) for v, bs in sorted(by_version.items())]
        return reduce(DataFrame.unionByName, parts).drop("bucket") if parts else self.spark.createDataFrame([], CLIPS)

    def read(self) -> DataFrame:
        return self._read(self._pointer())

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merges captures (url, title, markdown, captured_at): one address is one clip; id, path and first time stay."""
        pointer = self._pointer()
        if batch_id <= pointer["batch"]:
            return
        bucket = F.pmod(F.xxhash64("url_key"), F.lit(pointer["buckets"])).cast("int")
        new = batch.where("error is null").withColumn("url_key", comparable_url(F.col("url"))).where("url_key is not null")
        new = new.groupBy("url_key").agg(F.max_by(F.struct("url", "title", "markdown", "captured_at"), F.struct("captured_at", "url")).alias("n"))
        # Read twice below, and captured only once.
        new = materialize(new.select("url_key", "n.*").withColumn("print", fingerprint_markdown(F.col("markdown"))).withColumn("length", F.octet_length(F.coalesce("markdown", F.lit(""))).cast("long")).drop("markdown"))
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        joined = self._read(pointer, touched).withColumnRenamed("url", "o_url").withColumnRenamed("title", "o_title").join(new, "url_key", "full_outer")
        changed = F.col("print").isNotNull() & (compare_fingerprint(F.col("content_fingerprint"), F.col("print")) != "current")
        rows = joined.select(
            "url_key",
            F.coalesce("clip_id", F.sha2("url_key", 256)).alias("clip_id"),
            F.coalesce("o_url", "url").alias("url"),
            F.coalesce("title", "o_title").alias("title"),
            F.coalesce("path", F.concat(F.sha2("url_key", 256), F.lit(".md"))).alias("path"),
            F.coalesce("clipped", "captured_at").alias("clipped"),
            F.when(changed, F.col("captured_at")).otherwise(F.col("updated_at")).alias("updated_at"),
            F.coalesce("print", "content_fingerprint").alias("content_fingerprint"),
            F.coalesce("length", "byte_length").alias("byte_length"),
        )
        version = f"batch-{batch_id:012d}"
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{version}")
        versions = pointer["versions"] | {str(b): version for b in touched}
        self._move({"batch": batch_id, "buckets": pointer["buckets"], "versions": versions})
        # A version goes when no bucket is read from it, neither now nor by those who read the table before this batch.
        used = {*versions.values(), *pointer["versions"].values(), version}
        for name in names_in(self.spark, self.root):
            if name.startswith("batch-") and name not in used:
                fs, target = file_system(self.spark, f"{self.root}/{name}")
                fs.delete(target, True)


def classify_batch(captures: DataFrame, clips: DataFrame) -> DataFrame:
    """url and state (new, changed, unchanged) of captured pages against the clips."""
    known = clips.select("url_key", "content_fingerprint", F.lit(True).alias("_known"))
    joined = captures.withColumn("url_key", comparable_url(F.col("url"))).join(known, "url_key", "left")
    against = compare_fingerprint(F.col("content_fingerprint"), fingerprint_markdown(F.col("markdown")))
    return joined.select("url", F.when(F.col("_known").isNull(), "new").when(against == "current", "unchanged").otherwise("changed").alias("state"))


def stream_captures(spark: SparkSession, source: str, table: ClipTable, checkpoint: str, max_files: int = 100, interval: str | None = None) -> StreamingQuery:
    """Starts the capture of pages (url, html, captured_at) that arrive as Parquet files; one query for a checkpoint.

    Without an interval what has arrived is captured and the query ends; it goes on where it ended when started again.
    Stopping the query pauses the job.
    """
    pages = spark.readStream.schema("url string, html string, captured_at timestamp").option("maxFilesPerTrigger", max_files).parquet(source)

    def batch(df: DataFrame, batch_id: int) -> None:
        captured = capture_pages(df.dropDuplicates(["url", "captured_at"]))
        times = df.groupBy("url").agg(F.max("captured_at").alias("captured_at"))
        table.merge(captured.join(times, "url"), batch_id)

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
