"""What changed between consecutive full snapshots (problem 4).

The pages of all snapshots are rows, range-partitioned and sorted by (snapshot, key), so that a snapshot of any size
spreads over many tasks. One scan cuts each partition into content-defined chunks: a chunk begins where a hash of the key
says so, so one inserted or removed row moves the border of one chunk only. Chunks whose digest occurs in both snapshots
are dropped unread; the rows of the others are grouped by key, which tells added, removed and changed rows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import js_trim, non_blank, parse_moment
from papyrion.operators.ordered import with_previous
from papyrion.session import materialize

#: Mean number of rows in a chunk.
CHUNK_ROWS = 16


def page_identity(page: Column) -> Column:
    """``path:`` with file_ref, else ``guid:`` with guid, else ``url:`` with url; null where all three are blank."""
    part = lambda prefix, f: F.concat(F.lit(prefix), F.lower(non_blank(page[f])))
    return F.coalesce(part("path:", "file_ref"), part("guid:", "guid"), part("url:", "url"))


def page_content(page: Column) -> Column:
    """What makes a page changed: trimmed title, url without case, the moment of modified."""
    moment = F.coalesce(F.unix_micros(parse_moment(page["modified"])).cast("string"), js_trim(page["modified"]))
    return F.to_json(F.array(F.coalesce(js_trim(page["title"]), F.lit("")), F.coalesce(F.lower(page["url"]), F.lit("")), moment))


def snapshot_rows(snaps: DataFrame) -> DataFrame:
    """inventory_id, k, h (a hash of the content) and border: one row for each page of each snapshot, the first of its key.

    The page's fields are read in one projection after the explode; repeats of a key are pre-aggregated before the shuffle.
    """
    pages = snaps.select("inventory_id", F.posexplode("pages").alias("pos", "page")).where("page is not null")
    rows = pages.select("inventory_id", page_identity(F.col("page")).alias("k"), F.struct("pos", F.unhex(F.md5(page_content(F.col("page")))).alias("h")).alias("first")).where("k is not null")
    return rows.groupBy("inventory_id", "k").agg(F.min("first")["h"].alias("h"))


def _chunk_scan() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scans sorted rows (inventory_id, k, h, border) and gives one row for each chunk: its snapshot, digest and rows."""

    def closed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The chunks of ``rows``, which begin at ``starts``."""
        ids, keys, contents = (rows.column(c).combine_chunks() for c in ("inventory_id", "k", "h"))
        ends = [*starts[1:].tolist(), len(keys)]
        listed_keys, listed_contents = keys.to_pylist(), contents.to_pylist()
        digests = []
        for a, b in zip(starts.tolist(), ends, strict=True):
            digest = hashlib.sha256()
            for k, h in zip(listed_keys[a:b], listed_contents[a:b], strict=True):
                digest.update(k.encode("utf-8", "surrogatepass"))
                digest.update(b"\0")
                digest.update(h)
            digests.append(digest.digest())
        offsets = pa.array([*starts.tolist(), len(keys)], pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, contents)], names=["inventory_id", "digest", "ks", "hs"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            fresh = pa.Table.from_batches([b])
            rows = fresh if rest is None else pa.concat_tables([rest, fresh])
            ids = rows.column("inventory_id").to_numpy()
            begins = rows.column("border").to_numpy(zero_copy_only=False).copy()
            begins[0] = True
            begins[1:] |= ids[1:] != ids[:-1]
            starts = np.flatnonzero(begins)
            # The last chunk may go on in the next batch.
            if len(starts) > 1:
                yield closed(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield closed(rest, np.zeros(1, dtype=np.int64))

    return scan


def snapshot_chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """inventory_id, digest, ks and hs: the content-defined chunks of snapshots, one after the other in the order of keys.

    A chunk also ends where a partition does; at most one chunk of each partition is then told apart needlessly, and its
    rows are compared one by one.
    """
    spread = rows.repartitionByRange("inventory_id", "k").sortWithinPartitions("inventory_id", "k")
    kind = rows.schema["inventory_id"].dataType
    marked = spread.withColumn("border", F.pmod(F.xxhash64("k"), F.lit(chunk_rows)) == 0)
    return marked.mapInArrow(_chunk_scan(), f"inventory_id {kind.simpleString()}, digest binary, ks array<string>, hs array<binary>")


def snapshot_changes(inventories: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Changes of each snapshot against the one before of the same collection.

    ``inventories`` has inventory_id, collection_id, last_refreshed_at and pages; other columns are ignored. Returns
    inventory_id (the later snapshot's), page_key, change_kind.

    Defined cases: rows with null pages, last_refreshed_at, collection_id or inventory_id are no snapshots; an id that
    is delivered twice counts once; an empty list is a snapshot without pages; of two snapshots of one moment the one
    with the smaller id is the earlier; a null page, and a page with all identities blank, is skipped; of pages with one
    key the first in the list counts; null and empty titles and addresses are alike; an empty table gives no rows.
    """
    snaps = inventories.select("inventory_id", "collection_id", "last_refreshed_at", "pages").where("inventory_id is not null and collection_id is not null and last_refreshed_at is not null and pages is not null")
    links = with_previous(snaps.select("inventory_id", "collection_id", "last_refreshed_at").distinct(), "collection_id", ["last_refreshed_at", "inventory_id"], "inventory_id", "previous_id")
    links = links.select("inventory_id", "previous_id").where("previous_id is not null")
    # Written once before the range partitioning, which samples its input, and once after, since the chunks are read twice.
    chunks = materialize(snapshot_chunks(materialize(snapshot_rows(snaps)), chunk_rows))
    roles = links.select(F.col("inventory_id").alias("pair_id"), F.explode(F.array(F.struct(F.lit("cur").alias("role"), F.col("inventory_id").alias("inventory_id")), F.struct(F.lit("prev").alias("role"), F.col("previous_id").alias("inventory_id")))).alias("r")).select("pair_id", "r.*")
    digests = chunks.select("inventory_id", "digest").join(roles, "inventory_id").groupBy("pair_id", "digest").agg(F.min("role").alias("role"), F.max("role").alias("other"))
    open_ = digests.where("role = other").drop("other").join(roles, ["pair_id", "role"])
    left = chunks.join(open_, ["inventory_id", "digest"]).select("pair_id", "role", F.explode(F.arrays_zip("ks", "hs")).alias("r"))
    cur, prev = F.max(F.when(F.col("role") == "cur", F.col("r.hs"))), F.max(F.when(F.col("role") == "prev", F.col("r.hs")))
    both = left.groupBy("pair_id", F.col("r.ks").alias("page_key")).agg(cur.alias("cur"), prev.alias("prev"))
    kind = F.when(F.col("prev").isNull(), "added").when(F.col("cur").isNull(), "removed").when(F.col("cur") != F.col("prev"), "changed")
    return both.select(F.col("pair_id").alias("inventory_id"), "page_key", kind.alias("change_kind")).where("change_kind is not null")


def p4_found(spark, sf_dir: str) -> DataFrame:
    from papyrion.session import read_table

    return snapshot_changes(read_table(spark, sf_dir, "site_inventories"))


P4_SQL = r"""
WITH raw AS (
  SELECT DISTINCT ON (inventory_id) inventory_id, collection_id, last_refreshed_at, pages FROM site_inventories
  WHERE pages IS NOT NULL AND last_refreshed_at IS NOT NULL AND collection_id IS NOT NULL ORDER BY inventory_id
), linked AS (
  SELECT *, lag(inventory_id) OVER (PARTITION BY collection_id ORDER BY last_refreshed_at, inventory_id) AS previous_id FROM raw
), un AS (
  SELECT inventory_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS pos FROM raw
), keyed AS (
  SELECT inventory_id, pos, trim(coalesce(p.title, ''), E' \t\r\n') AS title, lower(coalesce(p.url, '')) AS url,
    coalesce('path:' || lower(nullif(trim(p.file_ref, E' \t\r\n'), '')), 'guid:' || lower(nullif(trim(p.guid, E' \t\r\n'), '')), 'url:' || lower(nullif(trim(p.url, E' \t\r\n'), ''))) AS page_key,
    CASE WHEN regexp_matches(p.modified, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN epoch_us(CAST(p.modified AS TIMESTAMPTZ)) ELSE epoch_us(CAST(p.modified AS TIMESTAMP)) END AS moment
  FROM un WHERE p IS NOT NULL
), page AS (
  SELECT * FROM keyed WHERE page_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY inventory_id, page_key ORDER BY pos) = 1
), cur AS (
  SELECT l.inventory_id AS pair_id, page.* EXCLUDE (inventory_id) FROM linked l JOIN page ON page.inventory_id = l.inventory_id WHERE l.previous_id IS NOT NULL
), prev AS (
  SELECT l.inventory_id AS pair_id, page.* EXCLUDE (inventory_id) FROM linked l JOIN page ON page.inventory_id = l.previous_id
)
SELECT coalesce(c.pair_id, p.pair_id) AS inventory_id, coalesce(c.page_key, p.page_key) AS page_key,
  CASE WHEN p.pair_id IS NULL THEN 'added' WHEN c.pair_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.pair_id = p.pair_id AND c.page_key = p.page_key
WHERE p.pair_id IS NULL OR c.pair_id IS NULL OR c.title <> p.title OR c.url <> p.url OR c.moment IS DISTINCT FROM p.moment
"""
