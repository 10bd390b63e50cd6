"""Hashes of the engine: FNV-1a over UTF-16 code units, and CRC-32."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyrion.functions.text import normalize_fingerprint_content


@F.pandas_udf(StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a (32 bits) of each text's UTF-16 code units, as ``fnv1a-`` and eight hexadecimal digits; null stays null.

    The hash is sequential in a text, so the loop runs over positions and each step is taken for all texts of the batch
    that are that long.
    """
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype=np.uint16) if t is not None else None for t in texts]
    order = sorted((k for k, u in enumerate(units) if u is not None), key=lambda k: -len(units[k]))
    h = np.full(len(order), 2166136261, dtype=np.uint32)
    ends = np.array([len(units[k]) for k in order])
    flat = np.concatenate([units[k] for k in order]) if order else np.zeros(0, dtype=np.uint16)
    starts = np.concatenate([[0], np.cumsum(ends)[:-1]]) if order else np.zeros(0, dtype=np.int64)
    alive, prime = len(order), np.uint32(16777619)
    with np.errstate(over="ignore"):
        for at in range(int(ends[0]) if order else 0):
            while alive and ends[alive - 1] <= at:
                alive -= 1
            h[:alive] = (h[:alive] ^ flat[starts[:alive] + at]) * prime
    out: list[str | None] = [None] * len(units)
    for k, value in zip(order, h.tolist(), strict=True):
        out[k] = f"fnv1a-{value:08x}"
    return pd.Series(out, dtype="object")


def fingerprint_markdown(markdown: Column) -> Column:
    """Fingerprint that white space at line ends and blank lines don't change."""
    return fnv1a(normalize_fingerprint_content(markdown))


def content_hash(content: Column) -> Column:
    """Hash of a library file, as it stands."""
    return fnv1a(F.coalesce(content, F.lit("")))


def compare_fingerprint(stored: Column, current: Column) -> Column:
    """``unknown`` without a stored fingerprint, else ``current`` or ``changed``."""
    return F.when(F.coalesce(stored, F.lit("")) == "", "unknown").when(stored == current, "current").otherwise("changed")


def crc32(text: Column) -> Column:
    """CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))
