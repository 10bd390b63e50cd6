"""Spark data sources of discovery files: ``spark.dataSource.register(SitemapSource)``, then ``spark.read.format("sitemap").load(path)``.

Paths are files, folders or patterns; with a scheme (``hdfs://``, ``s3://``, ``file://``) they are read from that file system.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch
from html import unescape
from urllib.parse import urljoin

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):  # noqa: ANN202 - types of an optional library
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The files that a path names: a file itself, those right in a folder, or those of a pattern in its last part."""
    from pyarrow import fs

    system, inner = _open(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) and "://" in path else ""
    folder, _, pattern = inner.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]
    elif system.get_file_info(inner).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    else:
        found = [inner]
    return [scheme + f for f in sorted(found)]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files_of(self.path)]

    def found(self, data: bytes) -> list[tuple[str, str]]:
        """(kind, url) of what a file names."""
        return []

    def read(self, partition: _File) -> Iterator[tuple]:
        system, inner = _open(partition.path)
        with system.open_input_file(inner) as f:
            data = f.read()
        for k, (kind, url) in enumerate(self.found(data)):
            yield partition.path, k, kind, url


class _Source(DataSource):
    def schema(self) -> str:
        return "source string, ord int, kind string, url string"


class _SitemapReader(_Reader):
    def found(self, data: bytes) -> list[tuple[str, str]]:
        text = data.decode("utf-8", "replace")
        kind = "sitemap" if re.search("<sitemapindex", text, re.I) else "page"
        return [(kind, unescape(u)) for u in re.findall(r"<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>", text, re.I | re.S)]


class SitemapSource(_Source):
    """Pages and nested sitemaps of sitemap files."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def reader(self, schema: object) -> DataSourceReader:
        return _SitemapReader(self.options)


class _WorkbookReader(_Reader):
    def found(self, data: bytes) -> list[tuple[str, str]]:
        from papyrion.sources.lists import xlsx_cells

        urls = [re.sub(r"[),.;]+$", "", u) for c in xlsx_cells(data) for u in re.findall(r"https?://[^\s<>\"']+", c, re.I)]
        return [("page", u) for u in dict.fromkeys(urls)]


class WorkbookSource(_Source):
    """Addresses in workbooks."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def reader(self, schema: object) -> DataSourceReader:
        return _WorkbookReader(self.options)


class _LlmsReader(_Reader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.base = options.get("base", "")

    def found(self, data: bytes) -> list[tuple[str, str]]:
        text = data.decode("utf-8", "replace")
        links = re.findall(r"\[[^\]]*\]\(([^\s)]+)(?:\s+[\"'][^\"']*[\"'])?\)", text) + re.findall(r"https?://[^\s<>\"')\]]+", text, re.I)
        out = []
        for link in links:
            try:
                out.append(urljoin(self.base, link))
            except ValueError:
                continue
        return [("page", u) for u in dict.fromkeys(out) if re.match(r"https?://", u, re.I)]


class LlmsSource(_Source):
    """Links of llms.txt files, resolved against the option ``base``."""

    @classmethod
    def name(cls) -> str:
        return "llms"

    def reader(self, schema: object) -> DataSourceReader:
        return _LlmsReader(self.options)
