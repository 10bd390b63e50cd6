"""Filling fixed-capacity containers with items (problem 9).

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each into the packs that are
shortest so far, and only the counts of packing patterns are kept, so the work depends on the number of lengths, not of
documents. Then every document gets its rank among those of its length, and the patterns' slots, which are ranges of
ranks, name its container.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.bpe import encode_batches, vocabulary
from papyrion.session import materialize, read_table

#: Tokens a container holds.
CAPACITY = 2048
#: Items of one length are ranked in parts of about so many, so that a frequent length isn't one task.
PART_ITEMS = 100_000


def shortest_pack_first(histogram: dict[int, int], capacity: int, fill: bool = False) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths) that hold ``histogram`` (length -> number of items).

    Where no pack has room, a new one begins with one item and leaves its space to shorter lengths or, with ``fill``, takes as many
    items of the length as it holds.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    done: list[tuple[int, tuple[int, ...]]] = []
    spaces: list[int] = []  # most space first: the shortest packs

    def keep(count: int, pattern: tuple[int, ...], space: int) -> None:
        if count == 0:
            return
        if space == 0:
            done.append((count, pattern))
            return
        if not open_packs[space]:
            heapq.heappush(spaces, -space)
        open_packs[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        opened: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            space = -spaces[0] if spaces else 0
            if space < length:
                # No open pack has room.
                each = capacity // length if fill else 1
                opened.append((left // each, (length,) * each, capacity - length * each))
                if left % each:
                    opened.append((1, (length,) * (left % each), capacity - length * (left % each)))
                break
            count, pattern = open_packs[space].pop()
            if not open_packs[space]:
                heapq.heappop(spaces)
            used = min(count, left)
            if count > used:
                keep(count - used, pattern, space)
            left -= used
            # Kept aside until the length is placed once around: the shortest packs come first, not the newest.
            opened.append((used, (*pattern, length), space - length))
            if not spaces and left:
                for item in opened:
                    keep(*item)
                opened = []
        for item in opened:
            keep(*item)
    return done + [pack for packs in open_packs.values() for pack in packs]


def merge_open_packs(packs: list[tuple[int, tuple[int, ...]]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Puts packs that are left half empty together: their totals are packed like lengths, until nothing is saved."""
    while True:
        by_total: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for count, pattern in packs:
            by_total[sum(pattern)].append((count, pattern))
        merged = []
        for count, totals in shortest_pack_first({t: sum(c for c, _ in v) for t, v in by_total.items()}, capacity, fill=True):
            while count:
                # As many containers at once as the last pattern of each total has left.
                used: dict[int, int] = defaultdict(int)
                for t in totals:
                    used[t] += 1
                n = min(count, *(max(1, by_total[t][-1][0] // k) for t, k in used.items()))
                whole: tuple[int, ...] = ()
                for t, k in used.items():
                    need = n * k
                    if n == 1:
                        for _ in range(k):
                            c, pattern = by_total[t].pop()
                            whole += pattern
                            if c > 1:
                                by_total[t].append((c - 1, pattern))
                    else:
                        c, pattern = by_total[t].pop()
                        whole += pattern * k
                        if c > need:
                            by_total[t].append((c - need, pattern))
                merged.append((n, whole))
                count -= n
        if sum(c for c, _ in merged) >= sum(c for c, _ in packs):
            return packs
        packs = merged


def token_pieces(documents: DataFrame, id_column: str, text_column: str, capacity: int, path: str) -> DataFrame:
    """doc_id, part_no, first_token, n_tokens: one row a document, or for one above the capacity one for each full part and one for the rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in encode_batches(batches, path):
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            parts = np.maximum(1, -(-lengths // capacity))
            at = np.repeat(np.arange(len(lengths)), parts)
            part_no = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = part_no * capacity
            n = np.minimum(lengths[at] - first, capacity)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(part_no + 1), pa.array(first), pa.array(n)], names=["doc_id", "part_no", "first_token", "n_tokens"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(pieces, f"doc_id {kind}, part_no long, first_token long, n_tokens long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """Adds container_id to pieces (doc_id, part_no, first_token, n_tokens): no container holds more than ``capacity`` tokens.

    The driver holds a row for each length and for each ``part_items`` items; workers get the packing slots, whose number
    depends on the lengths and not on the items (each length splits at most one pattern and begins one).

    Defined cases: a piece without tokens takes no room and has a null container; equal and repeated rows each take room;
    an empty table gives no rows; other columns are dropped.
    """
    columns = ["doc_id", "part_no", "first_token", "n_tokens"]
    spark = pieces.sparkSession
    pieces = materialize(pieces.select(*columns))
    # As many parts for a length as its items need: at most capacity + items / part_items rows in all.
    parts = {n: -(-count // part_items) for n, count in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    sizes = spark.createDataFrame(sorted(parts.items()), "n_tokens long, n_parts long")
    pieces = pieces.join(F.broadcast(sizes), "n_tokens", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "part_no"), F.col("n_parts")), F.lit(0))).drop("n_parts")
    counts = pieces.where("n_tokens > 0").groupBy("n_tokens", "salt").count().collect()
    by_length: dict[int, np.ndarray] = {n: np.zeros(k + 1, dtype=np.int64) for n, k in parts.items()}
    for n_tokens, salt, count in counts:
        by_length[n_tokens][salt + 1] = count
    before = {n: np.cumsum(v) for n, v in by_length.items()}
    patterns = merge_open_packs(shortest_pack_first({n: int(v[-1]) for n, v in before.items()}, capacity), capacity)
    # Slots: from which rank of a length on which container; containers of a pattern are numbered on.
    slots: dict[int, list[tuple[int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for count, pattern in patterns:
        for length in pattern:
            slots[length].append((taken[length], base))
            taken[length] += count
        base += count
    found = {n: (np.array([r for r, _ in v], dtype=np.int64), np.array([c for _, c in v], dtype=np.int64)) for n, v in slots.items()}
    offsets = {n: v[:-1] for n, v in before.items()}
    shared = spark.sparkContext.broadcast((found, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of, offset_of = shared.value
        for b in batches:
            n, salt, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "salt", "rank"))
            container = np.full(len(n), -1, dtype=np.int64)
            for length in np.unique(n[n > 0]):
                at = np.flatnonzero(n == length)
                r = rank[at] - 1 + offset_of[length][salt[at]]
                starts, bases = slots_of[length]
                slot = np.searchsorted(starts, r, side="right") - 1
                container[at] = bases[slot] + r - starts[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(container, mask=container < 0)], names=[*columns, "container_id"])

    rank = F.expr("row_number() over (partition by n_tokens, salt order by doc_id, part_no)").cast("long")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = pieces.select(*columns, "salt").withColumn("rank", rank)
    return ranked.mapInArrow(place, f"doc_id {kind}, part_no long, first_token long, n_tokens long, container_id long")


def p9_containers(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return pack(token_pieces(documents, "doc_id", "text", CAPACITY, vocabulary()))


def p9_checks(spark, sf_dir: str) -> DataFrame:
    """What must hold of the containers: documents and tokens in them, and the containers over their capacity. One row."""
    placed = p9_containers(spark, sf_dir)
    loads = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    over = loads.agg(F.count_if(F.col("load") > CAPACITY).alias("n_over"), F.count_if(F.col("load") <= 0).alias("n_empty"))
    documents = placed.agg(F.countDistinct("doc_id").alias("n_documents"), F.count_if((F.col("n_tokens") > 0) & F.col("container_id").isNull()).alias("n_unplaced"))
    # One row beside one row.
    return documents.withColumn("_one", F.lit(1)).join(over.withColumn("_one", F.lit(1)), "_one").drop("_one")


P9_CHECKS_SQL = "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_unplaced, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_empty FROM documents"
