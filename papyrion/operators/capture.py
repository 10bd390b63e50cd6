"""The capture stage: one Python boundary from pages of HTML to capture results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from papyrion.html.markdown import Override
from papyrion.html.page import ADAPTERS, BUILT_IN, Adapter

_S, _L = T.StringType(), T.ArrayType(T.StringType())
METADATA = T.StructType([T.StructField(n, _L if n == "tags" else _S) for n in ("author", "published", "modified", "page_date", "description", "twitter_description", "site", "tags", "captured_at", "page_type", "space")])
CAPTURE = T.StructType([
    T.StructField("url", _S), T.StructField("title", _S), T.StructField("mode", _S), T.StructField("markdown", _S), T.StructField("metadata", METADATA),
    T.StructField("variables", T.MapType(_S, _S)), T.StructField("stats", T.StructType([T.StructField("characters", T.IntegerType()), T.StructField("root", _S)])),
    T.StructField("links", _L), T.StructField("error", _S),
])


_ARROW = pa.schema([
    ("url", pa.string()), ("title", pa.string()), ("mode", pa.string()), ("markdown", pa.string()),
    ("metadata", pa.struct([(f.name, pa.list_(pa.string()) if f.name == "tags" else pa.string()) for f in METADATA])),
    ("variables", pa.map_(pa.string(), pa.string())), ("stats", pa.struct([("characters", pa.int32()), ("root", pa.string())])),
    ("links", pa.list_(pa.string())), ("error", pa.string()),
])


def capture_pages(pages: DataFrame, mode: str = "auto", captured_at: str = "", selectors: list[str] | None = None, retries: int = 0, adapters: list[Adapter] | None = None, overrides: dict[str, Override] | None = None) -> DataFrame:
    """Capture results of pages (url, html); a page that can't be read has an error and no Markdown.

    Filter pages before: nothing is pushed through the Python stage. ``retries`` is how often a page is tried again.
    ``adapters`` (the registered ones, unless given) and ``overrides`` travel to the workers with the stage.
    """
    adapters = list(ADAPTERS) if adapters is None else adapters
    # What isn't part of this package is no module to the workers: it travels as code.
    shipped = cloudpickle.dumps(([a for a in adapters if a not in BUILT_IN], overrides))
    order = [BUILT_IN.index(a) if a in BUILT_IN else None for a in adapters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from papyrion.html.page import BUILT_IN, extract

        added, over = cloudpickle.loads(shipped)
        own = iter(added)
        used = [BUILT_IN[k] if k is not None else next(own) for k in order]
        for b in batches:
            out = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                row, error = None, None
                for _ in range(retries + 1):
                    try:
                        row, error = (extract(html, url or "", mode, captured_at, selectors, used, over), None) if html is not None else (None, "no content")
                        break
                    except Exception as e:  # noqa: BLE001 - one page must not end the job
                        error = f"{type(e).__name__}: {e}"
                if row is None:
                    row = dict.fromkeys(CAPTURE.names) | {"error": error}
                else:
                    row["metadata"] = {n: row["metadata"].get(n) for n in METADATA.names}
                    row["variables"] = list(row["variables"].items())
                row["url"] = url
                out.append({n: row[n] for n in CAPTURE.names})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return pages.select("url", "html").mapInArrow(run, CAPTURE)
