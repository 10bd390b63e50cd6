"""Crawl jobs: states, results and bodies, statistics, logs, retries and the sync queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions.scalars import progress

# Which state follows which message.
TRANSITIONS = {("queued", "start"): "running", ("running", "pause"): "paused", ("paused", "resume"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("failed", "retry"): "running", ("done", "retry"): "running", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("paused", "cancel"): "cancelled"}
#: Lines of a job's log that are kept.
LOG_LINES = 300


def transition(status: str, message: str) -> str:
    """The state after a message; one that doesn't fit changes nothing."""
    return TRANSITIONS.get((status, message), status)


def to_resume(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'running'")


def result_meta(pages: DataFrame) -> DataFrame:
    """job_id, url, title, path and UTF-8 byte_length: what is kept apart from the bodies."""
    return pages.select("job_id", "url", "title", "path", F.octet_length(F.coalesce("markdown", F.lit(""))).cast("long").alias("byte_length"))


def with_bodies(results: DataFrame, bodies: DataFrame) -> DataFrame:
    """Results (job_id, url, ord) with their bodies (job_id, url, markdown), in the order of capture; results without one are left out."""
    return results.join(bodies, ["job_id", "url"]).orderBy("job_id", "ord")


def missing_bodies(results: DataFrame, bodies: DataFrame) -> DataFrame:
    """job_id, n_results and n_missing."""
    has = bodies.select("job_id", "url", F.lit(True).alias("_has")).distinct()
    return results.join(has, ["job_id", "url"], "left").groupBy("job_id").agg(F.count("*").alias("n_results"), F.count_if(F.col("_has").isNull()).alias("n_missing"))


def job_stats(captures: DataFrame) -> DataFrame:
    """job_id, n_captured and n_failed of capture results (job_id, error)."""
    return captures.groupBy("job_id").agg(F.count_if(F.col("error").isNull()).alias("n_captured"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))


def job_progress(jobs: DataFrame) -> DataFrame:
    """Adds progress to jobs (status, n_captured, n_failed, n_queued, max_pages, elapsed_ms)."""
    return jobs.withColumn("progress", progress(*[F.col(c) for c in ("status", "n_captured", "n_failed", "n_queued", "max_pages", "elapsed_ms")]))


def failed_urls(captures: DataFrame) -> DataFrame:
    """job_id and url of the pages to try again, once each."""
    return captures.where("error is not null").select("job_id", "url").distinct()


def append_log(log: DataFrame, lines: DataFrame, keep: int = LOG_LINES) -> DataFrame:
    """A log (job_id, lines) with new lines (job_id, lines) at its end, the last ``keep`` of them."""
    new = lines.select("job_id", F.col("lines").alias("_new"))
    nothing = F.array().cast("array<string>")
    both = F.concat(F.coalesce("lines", nothing), F.coalesce("_new", nothing))
    return log.join(new, "job_id", "full_outer").select("job_id", F.slice(both, F.greatest(F.size(both) - keep + 1, F.lit(1)), F.lit(keep)).alias("lines"))


def upsert(stored: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of delivered keys replaced."""
    return stored.join(delivered.select(*keys).distinct(), keys, "left_anti").unionByName(delivered, allowMissingColumns=True)


class SyncQueue:
    """The queue of a sync of all collections: ordered ids that a restart goes on with, if the same ids are asked for."""

    def __init__(self, ids: list[str], remaining: list[str] | None = None) -> None:
        self.ids = list(dict.fromkeys(ids))
        self.remaining = list(self.ids if remaining is None else remaining)

    @classmethod
    def restore(cls, saved: dict | None, ids: list[str]) -> SyncQueue:
        same = saved is not None and saved.get("ids") == list(dict.fromkeys(ids)) and saved.get("remaining")
        return cls(ids, saved["remaining"] if same else None)

    def saved(self) -> dict | None:
        return {"ids": self.ids, "remaining": self.remaining} if self.remaining else None

    def current(self) -> str | None:
        return self.remaining[0] if self.remaining else None

    def advance(self) -> str | None:
        self.remaining = self.remaining[1:]
        return self.current()
