"""Duplicates hidden by formatting differences (problem 2).

Every record gets a canonical form in which layout is gone: letters and digits in lower case, metadata lines and JSON
fields in sorted order. The canonical records are range-partitioned and sorted by (digest, record id), and each sorted
partition is scanned once: neighbours with equal digests are compared in full, and each run gives its representative, the
smallest id, and its exact number of copies. Since the id is part of the range key, a run of any length spreads over as
many partitions as it needs; a run that crosses a partition's border is put together from its parts, of which there are
no more than partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.session import materialize, read_table

#: What isn't a letter, a digit or a mark on one.
_LAYOUT = r"[^\p{L}\p{N}\p{M}]+"
_LAYOUT_RE = regex.compile(_LAYOUT)


def letters_and_digits(c: Column) -> Column:
    """The letters and digits as stored, in lower case."""
    return F.lower(F.regexp_replace(c, _LAYOUT, ""))


def markdown_canonical(df: DataFrame, markdown: str, name: str) -> DataFrame:
    """Adds ``name``: the letters and digits of Markdown, the lines of a leading metadata block sorted.

    Null where the Markdown is null or has no letter or digit. A block is what stands between two ``---`` lines at the
    very top, or the first lines as far as they begin with ``- **``.
    """
    block = F.regexp_extract(markdown, r"\A(---[ \t]*\r?\n(?:(?!---[ \t]*\r?(?:\n|\z))[^\n]*\n)*?---[ \t]*\r?(?:\n|\z)|(?:- \*\*[^\n]*(?:\n|\z))+)", 0)
    df = df.withColumn("__md_block", block)
    lines = F.array_sort(F.transform(F.split("__md_block", "\n"), letters_and_digits))
    rest = letters_and_digits(F.expr(f"substring(`{markdown}`, length(__md_block) + 1)"))
    return df.withColumn(name, F.nullif(F.when(F.col("__md_block") == "", letters_and_digits(F.col(markdown))).otherwise(F.concat(F.array_join(lines, ""), rest)), F.lit(""))).drop("__md_block")


def _json_form(value: object) -> str:
    """One text for all layouts of a JSON value; keys and values are marked with their kinds."""
    if isinstance(value, dict):
        return "{" + ",".join(sorted(f"{_bare(k)}:{_json_form(v)}" for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json_form, value)) + "]"
    if isinstance(value, str):
        return "s" + _bare(value)
    if isinstance(value, bool) or value is None:
        return f"k{value}"
    if isinstance(value, float) and not value.is_integer():
        return f"n{value!r}"
    return f"n{int(value)}"


def _bare(text: str) -> str:
    return _LAYOUT_RE.sub("", text).lower()


def _no_constant(name: str) -> None:
    raise ValueError(name)


def json_canonical(df: DataFrame, record: str, name: str) -> DataFrame:
    """Adds ``name``: one text for all layouts of a JSON object; null where the record isn't one whole JSON object.

    Of a field named twice in one record the last counts, as JSON readers have it; names that differ in layout only are
    fields of their own.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(record).to_pylist():
                try:
                    value = json.loads(text, parse_constant=_no_constant) if text is not None else None
                    out.append(_json_form(value) if isinstance(value, dict) else None)
                except (ValueError, RecursionError, OverflowError):
                    out.append(None)
            yield b.append_column(name, pa.array(out, pa.string()))

    return df.mapInArrow(parse, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


_RUNS = T.StructType().add("record_set", "string").add("digest", "binary").add("head_id", "long").add("copy_id", "long").add("run_rows", "long").add("at_edge", "boolean")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans sorted records for runs of equal neighbours.

    Gives a row for each record that isn't the first of its run (copy_id), and one at the end of each run (run_rows),
    which says whether the run is this partition's first or last.
    """
    last: tuple | None = None  # record_set, digest, canonical, record_id of the row before
    head, n, runs = 0, 0, 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_RUNS.names)

    for b in batches:
        if not b.num_rows:
            continue
        sets, digests, ids = b.column("record_set").to_pylist(), b.column("digest").to_pylist(), b.column("record_id").to_pylist()
        text = b.column("canonical")
        # Neighbours with equal digests are compared in full.
        same = [False, *pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_pylist()]
        if last is not None:
            same[0] = text[0].as_py() == last[2]
        rows = []
        for k in range(b.num_rows):
            before = (sets[k - 1], digests[k - 1], ids[k - 1]) if k else last and (last[0], last[1], last[3])
            if before and same[k] and digests[k] == before[1] and sets[k] == before[0]:
                if ids[k] != before[2]:
                    n += 1
                    rows.append((sets[k], digests[k], head, ids[k], None, None))
                continue
            if before:
                rows.append((before[0], before[1], head, None, n, runs == 0))
                runs += 1
            head, n = ids[k], 1
        last = (sets[-1], digests[-1], text[len(text) - 1].as_py(), ids[-1])
        yield out(rows)
    if last is not None:
        yield out([(last[0], last[1], head, None, n, True)])


def copy_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of copies of records: (groups, copies).

    ``records`` has record_set, record_id and canonical; other columns are ignored. ``groups`` has one row per group:
    record_set, keep_id (its smallest id) and n_copies (its number of records). ``copies`` has one row per other record
    of a group: record_set, keep_id, copy_id. Defined cases: null canonical forms and null ids take no part; an id given
    twice in one form counts once, with two forms it is a record of two groups; a record without copies is a group of
    one; an empty table gives no rows. Texts are compared whole.
    """
    rows = records.select("record_set", "record_id", "canonical").where("canonical is not null and record_id is not null")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\u0001", "record_set", "canonical"), 256)))
    keys = ["digest", "record_id"]
    # Written once, since the range partitioning samples its input: the canonical forms would be made twice.
    rows = materialize(rows)
    runs = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_scan, _RUNS))
    ends, copies = runs.where("run_rows is not null"), runs.where("copy_id is not null")
    # Only runs at a partition's border can have several parts, so these are no more than partitions.
    split = ends.where("at_edge").groupBy("record_set", "digest").agg(F.min("head_id").alias("keep_id"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    split = materialize(split)
    keep = F.coalesce("keep_id", "head_id").alias("keep_id")
    ends = ends.join(F.broadcast(split), ["record_set", "digest"], "left")
    groups = ends.groupBy("record_set", keep).agg(F.sum("run_rows").alias("n_copies"))
    inner = copies.join(F.broadcast(split), ["record_set", "digest"], "left").select("record_set", keep, "copy_id")
    heads = ends.where("keep_id < head_id").select("record_set", "keep_id", F.col("head_id").alias("copy_id"))
    return groups, inner.unionByName(heads)


def canonical_records(captures: DataFrame, clip_log: DataFrame, clip_raw: DataFrame) -> DataFrame:
    """The canonical records of the three tables: record_set, record_id, canonical."""
    page = markdown_canonical(captures.select(F.lit("captures").alias("record_set"), F.col("capture_id").alias("record_id"), "markdown"), "markdown", "canonical")
    parts = [letters_and_digits(F.col(c)) for c in ("url", "title", "preview_fingerprint")]
    clip = clip_log.select(F.lit("clip_log").alias("record_set"), F.col("clip_id").alias("record_id"), F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]).alias("canonical"))
    raw = json_canonical(clip_raw.select(F.lit("clip_raw").alias("record_set"), F.col("raw_id").alias("record_id"), "record"), "record", "canonical")
    columns = ["record_set", "record_id", "canonical"]
    return page.select(columns).unionByName(clip.select(columns)).unionByName(raw.select(columns))


def p2_found(spark, sf_dir: str) -> DataFrame:
    _, copies = copy_groups(canonical_records(*(read_table(spark, sf_dir, t) for t in ("captures", "clip_log", "clip_raw"))))
    return copies


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """One row per group of copies, with the exact number of copies."""
    groups, _ = copy_groups(canonical_records(*(read_table(spark, sf_dir, t) for t in ("captures", "clip_log", "clip_raw"))))
    return groups.where("n_copies > 1")


def p2_layouts(spark, sf_dir: str) -> DataFrame:
    """Groups of copies in captures and clip_log: record_set, keep_id and n_copies. These SQL can tell too; JSON of any layout it can't."""
    groups, _ = copy_groups(canonical_records(read_table(spark, sf_dir, "captures"), read_table(spark, sf_dir, "clip_log"), read_table(spark, sf_dir, "clip_raw").where("false")))
    return groups.where("n_copies > 1")


_BARE = r"lower(regexp_replace({c}, '[^\pL\pN\pM]+', '', 'g'))"
P2_LAYOUTS_SQL = rf"""
WITH b AS (
  SELECT DISTINCT capture_id, markdown, regexp_extract(markdown, '\A(?:---[ \t]*\r?\n(?:[^\n]*\n)*?---[ \t]*\r?(?:\n|\z)|(?:- \*\*[^\n]*(?:\n|\z))+)', 0) AS block FROM captures WHERE markdown IS NOT NULL
), r AS (
  SELECT 'captures' AS record_set, capture_id AS id, CASE WHEN block = '' THEN {_BARE.format(c='markdown')}
    ELSE array_to_string(list_sort(list_transform(string_split(block, chr(10)), lambda x: {_BARE.format(c='x')})), '') || {_BARE.format(c='substring(markdown, length(block) + 1)')} END AS form FROM b
  UNION SELECT 'clip_log', clip_id, {_BARE.format(c='url')} || '|' || {_BARE.format(c='title')} || '|' || {_BARE.format(c='preview_fingerprint')} FROM clip_log
)
SELECT record_set, min(id) AS keep_id, count(*) AS n_copies FROM r WHERE form <> '' GROUP BY record_set, form HAVING count(*) > 1
"""
