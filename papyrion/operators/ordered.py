"""Previous row in a global order, without one task for a group.

A window over a hot group is sorted in one task. Here the rows are range-partitioned by (group, order), so that a hot
group spreads over many partitions, each partition looks one row back, and only the last row of each partition (as many
rows as partitions) crosses to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.session import materialize


def with_previous(df: DataFrame, group: str, order: list[str], carry: str, name: str) -> DataFrame:
    """Adds ``name``: the value of ``carry`` in the row before within ``group`` by ``order``, null for the first.

    ``order`` must be total within a group (add an id). Null groups form one group.
    """
    kind = df.schema[carry].dataType
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind), T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.StringType())])

    def look_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            if not len(b):
                continue
            b = b.copy()
            g, v = b[group].astype(object).tolist(), b[carry].tolist()
            out = [None] * len(b)
            for i in range(len(b)):
                before = (g[i - 1], v[i - 1]) if i else last
                if before is not None and (before[0] == g[i] or (pd.isna(before[0]) and pd.isna(g[i]))):
                    out[i] = before[1]
            last = (g[-1], v[-1])
            b[name], b["_part"], b["_edge"] = pd.Series(out, index=b.index, dtype="object"), part, None
            if first:
                b.iloc[0, b.columns.get_loc("_edge")] = "first"
                first = False
            yield b
        return

    spread = df.repartitionByRange(F.col(group).asc_nulls_first(), *[F.col(c) for c in order]).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    looked = materialize(spread.mapInPandas(look_back, schema))
    # The last row of each partition: no more rows than partitions, so the driver may hold them.
    ends = looked.groupBy("_part").agg(F.max_by(F.struct(F.col(group).alias("g"), F.col(carry).alias("v")), F.struct(F.struct(F.col(group).isNotNull(), group), *order)).alias("end")).collect()
    ends = sorted(((r["_part"], r["end"]["g"], r["end"]["v"]) for r in ends), key=lambda x: x[0])
    pairs = [(b[0], a[1], a[2]) for a, b in zip(ends, ends[1:])]
    if pairs:
        edge = df.sparkSession.createDataFrame(pairs, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_g", df.schema[group].dataType), T.StructField("_v", kind)]))
        looked = looked.join(F.broadcast(edge), "_part", "left").withColumn(name, F.when((F.col("_edge") == "first") & F.col("_g").eqNullSafe(F.col(group)), F.col("_v")).otherwise(F.col(name)))
    return looked.select(*df.columns, name)


def with_rank(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 1 within ``group`` by ``order``.

    Like ``with_previous`` it spreads a hot group over partitions: each counts its own rows, and the counts of a group's
    rows in the partitions before (at most one group goes on across a border) are added. ``order`` must be total.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("_part", T.IntegerType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), ("no group",), 0
        for b in batches:
            out = []
            for g in b[group].astype(object).where(b[group].notna(), None):
                n = n + 1 if (g,) == last else 1
                last = (g,)
                out.append(n)
            b = b.copy()
            b[name], b["_part"] = pd.Series(out, index=b.index, dtype="int64"), part
            yield b

    keys = [F.col(group).asc_nulls_first(), *[F.col(c) for c in order]]
    numbered = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(number, schema))
    # The groups at each partition's end and begin: two rows a partition.
    last = numbered.groupBy("_part").agg(F.max(F.struct(F.col(group).isNotNull().alias("known"), F.col(group).alias("g"), F.col(name).alias("n"))).alias("end"), F.min(F.struct(F.col(group).isNotNull().alias("known"), F.col(group).alias("g"))).alias("begin")).collect()
    offsets, carried = [], None
    for row in sorted(last, key=lambda r: r["_part"]):
        end, begin = row["end"], row["begin"]
        ahead = carried[1] if carried is not None and carried[0] == begin["g"] else 0
        if ahead:
            offsets.append((row["_part"], begin["g"], ahead))
        carried = (end["g"], end["n"] + (ahead if end["g"] == begin["g"] else 0))
    if offsets:
        add = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_g", df.schema[group].dataType), T.StructField("_add", T.LongType())]))
        numbered = numbered.join(F.broadcast(add), "_part", "left").withColumn(name, F.col(name) + F.when(F.col("_g").eqNullSafe(F.col(group)) & F.col("_add").isNotNull(), F.col("_add")).otherwise(0))
    return numbered.select(*df.columns, name)
