"""Link crawl over stored pages: a breadth-first frontier, level by level, with checkpoints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions.urls import comparable_url, hostname, same_host
from papyrion.operators.tags import valid_patterns
from papyrion.session import materialize


@dataclass
class CrawlOptions:
    max_pages: int = 25
    max_depth: int = 20
    follow_links: bool = False
    same_host_only: bool = True
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()


@dataclass
class CrawlState:
    """A crawl's tables between levels: captured and failed pages, the frontier, and what was seen. Each level is written, so a crawl goes on where it ended."""

    pages: DataFrame
    frontier: DataFrame
    seen: DataFrame
    depth: int = 0
    warnings: list[str] = field(default_factory=list)


def patterns(text: str) -> list[str]:
    """Patterns of a settings text: one a line, blank lines dropped."""
    return [p.strip() for p in (text or "").splitlines() if p.strip()]


def capture_concurrency(urls: Sequence[str], follow_links: bool, requested: int) -> int:
    """How many pages a live capture may open at once: one when links are followed or for the REST platform, else two at most."""
    return 1 if follow_links or any(".sharepoint.com" in u.lower() for u in urls) else max(1, min(requested, 2))


def _allowed(df: DataFrame, options: CrawlOptions, depth: int, seeds: bool) -> tuple[DataFrame, list[str]]:
    exclude, bad = valid_patterns(df.sparkSession, list(options.exclude))
    include, worse = valid_patterns(df.sparkSession, list(options.include))
    out = df if depth <= options.max_depth else df.where("false")
    for p in exclude:
        out = out.where(~F.col("url").rlike(p))
    if include and not seeds:
        out = out.where(F.array_contains(F.array(*[F.col("url").rlike(p) for p in include]), True))
    return out, [f"Ignoring invalid pattern: {p}" for p in [*bad, *worse]]


def start(seeds: DataFrame, options: CrawlOptions) -> CrawlState:
    """The state before the first level. ``seeds`` has url and ord; seeds pass the exclude patterns only and are seen once."""
    rows = seeds.withColumn("k", comparable_url(F.col("url"))).where("k is not null").groupBy("k").agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord"))
    rows, warnings = _allowed(rows, options, 0, True)
    frontier = materialize(rows.select("k", "url", "ord", F.lit(0).alias("depth")))
    nothing = frontier.where("false").select("url", "depth", "ord", F.lit(None).cast("string").alias("error"))
    return CrawlState(nothing, frontier, frontier.select("k"), 0, warnings)


def advance(state: CrawlState, site: DataFrame, options: CrawlOptions, origin: str) -> CrawlState:
    """One level: captures the frontier (in order, up to the page cap) and makes the next frontier of the pages' links.

    ``site`` has url, links (array) and error: the stored pages; a frontier address that it lacks is a failed page.
    Failed pages don't count toward the cap.
    """
    room = options.max_pages - state.pages.where("error is null").count()
    known = site.withColumn("k", comparable_url(F.col("url"))).groupBy("k").agg(F.first("links").alias("links"), F.first("error").alias("error"), F.lit(True).alias("found"))
    visited = state.frontier.join(known, "k", "left").withColumn("error", F.when(F.col("found").isNull(), "page not found").otherwise(F.col("error")))
    # Up to the page that fills the cap: the place of the last of the first ``room`` readable pages, however long the frontier.
    visited = materialize(visited)
    last = visited.where("error is null").select("ord").orderBy("ord").limit(room).agg(F.count("*").alias("n"), F.max("ord").alias("ord")).first()
    if last["n"] >= room:
        visited = visited.where(F.col("ord") <= (last["ord"] if room > 0 else -1))
    visited = materialize(visited.select("k", "url", "depth", "ord", "links", "error"))
    pages = state.pages.unionByName(visited.select("url", "depth", "ord", "error"))
    room -= visited.where("error is null").count()
    following, warnings = visited.where("false").select("k", "url", "ord", "depth"), []
    if options.follow_links and room > 0:
        links = visited.where("error is null").select("ord", "depth", F.posexplode("links").alias("at", "url"))
        if options.same_host_only:
            links = links.where(same_host(F.col("url"), F.lit(origin)))
        links, warnings = _allowed(links, options, state.depth + 1, False)
        links = links.withColumn("k", comparable_url(F.col("url"))).where("k is not null").groupBy("k").agg(F.min(F.struct("ord", "at", "url")).alias("s")).join(state.seen, "k", "left_anti")
        # At most as many as the cap, so numbering them is the sort of a few rows.
        capped = links.orderBy("s.ord", "s.at").limit(room)
        base = (state.depth + 1) * 1_000_000_000
        following = materialize(capped.select("k", F.col("s.url").alias("url"), (F.row_number().over(_links_in_order()) + base).cast("long").alias("ord"), F.lit(state.depth + 1).alias("depth")))
    seen = materialize(state.seen.unionByName(following.select("k")))
    return CrawlState(pages, following, seen, state.depth + 1, [*state.warnings, *warnings])


def _links_in_order():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy("s.ord", "s.at")


def crawl_site(seeds: DataFrame, site: DataFrame, options: CrawlOptions, origin: str, should_pause=lambda: False) -> CrawlState:  # noqa: ANN001
    """Crawls level by level until nothing is left, the cap is reached, or ``should_pause`` says so; the state can be gone on with."""
    state = start(seeds, options)
    while not should_pause() and not state.frontier.isEmpty() and state.pages.where("error is null").count() < options.max_pages:
        state = advance(state, site, options, origin)
    return state


def link_distances(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """url_key and depth of every page within ``max_depth`` links (src, dst) of the seeds (url): an anti join per level."""
    links = materialize(edges.select(comparable_url(F.col("src")).alias("s"), comparable_url(F.col("dst")).alias("d")).where("s is not null and d is not null").distinct())
    level = materialize(seeds.select(comparable_url(F.col("url")).alias("url_key")).where("url_key is not null").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        level = links.join(level, links["s"] == level["url_key"], "left_semi").select(F.col("d").alias("url_key")).distinct().join(seen, "url_key", "left_anti").withColumn("depth", F.lit(depth))
        level = materialize(level)
        if level.isEmpty():
            break
        seen = materialize(seen.unionByName(level))
    return seen


def permitted(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """Pages whose host is among the permitted ones (host)."""
    return pages.withColumn("_h", hostname(F.col("url"))).join(origins.select(F.lower("host").alias("_h")).distinct(), "_h", "left_semi").drop("_h")
