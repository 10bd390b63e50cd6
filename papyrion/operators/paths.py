"""File paths that are unique within an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.urls import hostname, relative_markdown_path, sanitize_path_segment, slugify
from papyrion.operators.ordered import with_rank
from papyrion.session import materialize

#: A path's stem, number and extension; a generated number has no leading zero.
_NUMBERED = r"(?s)^(.*)-([1-9][0-9]{0,17})(\.[^./]*)?$"
_PARTS = r"(?s)^(.*?)(\.[^./]*)?$"


def _meetings(ranked: DataFrame, path: str, order: list[str], scope: str | None) -> DataFrame | None:
    """Where a generated path could meet a page's own: _parent (the repeated path's key), _child (the numbered path's key), _c (its number), _rows (the parent's rows) and _before (those before the child's first row). None where there is no such place."""
    own = ranked.where(F.col("_n") == 1).where(F.col(path).rlike(_NUMBERED))
    parent = F.concat(F.regexp_extract(path, _NUMBERED, 1), F.regexp_extract(path, _NUMBERED, 3))
    children = own.select(_key(scope, parent).alias("_parent"), F.col("_key").alias("_child"), F.regexp_extract(path, _NUMBERED, 2).cast("long").alias("_c"), *order)
    rows = ranked.groupBy(F.col("_key").alias("_parent")).agg(F.count("*").alias("_rows"))
    children = materialize(children.join(rows, "_parent"))
    if children.isEmpty():
        return None
    # How many of the parent's rows come before the child: its rank among both less its rank among the children.
    events = children.select("_parent", "_child", *order)
    parents = ranked.select(F.col("_key").alias("_parent"), F.lit(None).cast("string").alias("_child"), *order).join(children.select("_parent").distinct(), "_parent", "left_semi")
    among_both = with_rank(events.unionByName(parents), "_parent", order, "_u").where("_child is not null").select("_child", "_u")
    among_children = with_rank(events, "_parent", order, "_v").select("_child", "_v")
    found = children.join(among_both, "_child").join(among_children, "_child")
    return materialize(found.select("_parent", "_child", "_c", "_rows", (F.col("_u") - F.col("_v")).alias("_before")))


def _key(scope: str | None, path: Column) -> Column:
    return F.concat_ws("\u0001", *([F.col(scope)] if scope else []), path)


def _resolve(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_key of the paths whose own name was taken before their first row; _key and _skips of the paths that passed over numbers).

    Level by level from the paths that no other could take: a repeated path's j-th further row lands on number j plus the
    numbers passed over so far. If a child stands there already the number is passed over; if the child comes later, its
    name is taken, and all its rows are further rows of its own path.
    """
    none = met.where("false")
    moved, skips = none.select(F.col("_child").alias("_key")), none.select(F.col("_parent").alias("_key"), F.array().cast("array<bigint>").alias("_skips"))
    level = met.join(met.select(F.col("_child").alias("_parent")).distinct(), "_parent", "left_anti").select("_parent").distinct().withColumn("_moved", F.lit(False))
    level = materialize(level)
    start = F.struct(F.array().cast("array<bigint>").alias("skips"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, child: Column) -> Column:
        lands = child["_c"] - F.size(state["skips"])
        further, before = F.when(child["_moved"], child["_rows"]).otherwise(child["_rows"] - 1), F.when(child["_moved"], child["_before"]).otherwise(F.greatest(child["_before"] - 1, F.lit(0)))
        skips = F.when((lands <= further) & (lands > before), F.concat(state["skips"], F.array(lands))).otherwise(state["skips"])
        taken = F.when((lands <= further) & (lands <= before), F.concat(state["taken"], F.array(child["_child"]))).otherwise(state["taken"])
        return F.struct(skips.alias("skips"), taken.alias("taken"))

    while not level.isEmpty():
        # Only the numbered paths of one path come together, never the rows.
        folded = met.join(level, "_parent").groupBy("_parent").agg(F.array_sort(F.collect_list(F.struct("_c", "_child", "_rows", "_before", "_moved"))).alias("children"))
        folded = materialize(folded.select("_parent", F.aggregate("children", start, step).alias("s"), F.transform("children", lambda c: c["_child"]).alias("names")))
        taken = folded.select(F.explode("s.taken").alias("_key"))
        moved = moved.unionByName(taken)
        skips = skips.unionByName(folded.select(F.col("_parent").alias("_key"), F.col("s.skips").alias("_skips")).where("size(_skips) > 0"))
        below = folded.select(F.explode("names").alias("_parent")).join(met.select("_parent").distinct(), "_parent", "left_semi")
        level = materialize(below.join(taken.select(F.col("_key").alias("_parent"), F.lit(True).alias("_hit")), "_parent", "left").select("_parent", F.col("_hit").isNotNull().alias("_moved")))
    return moved, skips


def unique_paths(df: DataFrame, path: str, order: list[str], name: str = "unique_path", scope: str | None = None) -> DataFrame:
    """Adds ``name``: the path, with ``-1``, ``-2`` … before its extension for every later row of the same path.

    Rows take their names one after the other by ``order`` (total): a number that a page's own path has taken before is
    passed over, and a page whose own path was taken by a number before gets a number itself (``a``, ``a``, ``a-1``).
    ``scope`` (a folder, a collection) keeps uniqueness to rows of one value. Null paths stay null.

    No task holds the rows of a path: they are ranked over many, and only the paths that are numbered themselves are
    looked at for the numbers they block.
    """
    key = F.when(F.col(path).isNotNull(), _key(scope, F.col(path)))
    # Paths and keys are made once: ranking samples its input, and reads it again.
    ranked = with_rank(materialize(df.withColumn("_key", key)), "_key", order, "_n")
    met = _meetings(ranked.where("_key is not null"), path, order, scope)
    if met is None:
        named = ranked.withColumn("_number", F.col("_n") - 1)
    else:
        moved, skips = _resolve(met)
        named = ranked.join(moved.withColumn("_moved", F.lit(1)), "_key", "left").join(skips, "_key", "left")
        named = named.withColumn("_j", F.col("_n") - 1 + F.coalesce("_moved", F.lit(0)))
        passed = F.size(F.filter(F.coalesce("_skips", F.array().cast("array<bigint>")), lambda x: x <= F.col("_j")))
        named = named.withColumn("_number", F.col("_j") + F.when(F.col("_j") > 0, passed).otherwise(0))
    stem, extension = F.regexp_extract(path, _PARTS, 1), F.regexp_extract(path, _PARTS, 2)
    unique = F.when(F.col("_number") == 0, F.col(path)).otherwise(F.concat(stem, F.lit("-"), F.col("_number").cast("string"), extension))
    return named.withColumn(name, unique).select(*df.columns, name)


def page_paths(pages: DataFrame, order: list[str], scope: str | None = None) -> DataFrame:
    """Adds path: each page's unique Markdown path by its address, in the order of capture."""
    natural = pages.withColumn("_natural", F.coalesce(relative_markdown_path(F.col("url")), F.concat(slugify(F.col("title")), F.lit(".md"))))
    return unique_paths(natural, "_natural", order, "path", scope).drop("_natural")


def library_paths(pages: DataFrame, collection: str, kind: str, order: list[str]) -> DataFrame:
    """As ``page_paths`` for library collections: custom ones with two or more hosts get a folder for each host."""
    hosts = pages.groupBy(collection).agg(F.countDistinct(F.coalesce(hostname(F.col("url")), F.lit("unknown-host"))).alias("_hosts"))
    folder = F.when((F.col(kind) == "custom") & (F.col("_hosts") > 1), F.concat(sanitize_path_segment(F.coalesce(hostname(F.col("url")), F.lit("unknown-host")), "unknown-host"), F.lit("/"))).otherwise("")
    rows = pages.join(hosts, collection).withColumn("_folder", folder).withColumn("_scope", F.concat_ws("\u0002", F.col(collection), F.col("_folder"))).drop("_hosts")
    return page_paths(rows, order, "_scope").withColumn("path", F.concat("_folder", "path")).drop("_folder", "_scope")
