"""Writers: Markdown files, vaults with fallback, ZIP archives, CSV and text exports, settings backups, library folders."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import Row
from pyspark.sql import functions as F

from papyrion.functions.urls import sanitize_filename, with_markdown_extension

#: The date that every archive entry bears, so that equal content makes equal bytes.
ZIP_DATE = (1980, 1, 1, 0, 0, 0)
MANIFEST = "_manifest.json"


def safe_target(root: str, path: str) -> Path:
    """A path below a folder; one that leaves it is refused."""
    base = Path(root).resolve()
    target = (base / path).resolve()
    if base != target and base not in target.parents:
        raise ValueError(f"{path} leaves the folder")
    return target


def write_files(files: DataFrame, root: str) -> None:
    """Writes files (path, content) below a folder that all executors share. Paths must be unique; a lost task writes its files again."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            target = safe_target(root, r["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.part")
            part.write_text(r["content"], encoding="utf-8", newline="")
            part.replace(target)

    files.select("path", "content").foreachPartition(write)


def write_vault(files: DataFrame, vault: str | None, downloads: str) -> str:
    """Writes to the vault where there is one, else to the downloads; what goes wrong in the vault is raised, not hidden by a fallback."""
    names = files.withColumn("path", with_markdown_extension(sanitize_filename(F.regexp_extract("path", r"([^/]*)$", 1))))
    usable = vault is not None and Path(vault).is_dir()
    write_files(names, vault if usable else downloads)
    return "vault" if usable else "downloads"


class ZipWriter:
    """A store-only archive, entry by entry."""

    def __init__(self, target: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(target, "w", zipfile.ZIP_STORED)

    def add(self, name: str, data: str | bytes) -> None:
        info = zipfile.ZipInfo(name, ZIP_DATE)
        info.external_attr = 0o644 << 16
        self.zip.writestr(info, data)

    def finish(self) -> None:
        self.zip.close()


def write_zip(files: DataFrame, target: BinaryIO, order: list[str]) -> tuple[int, int]:
    """Streams files (path, content) in order into an archive; counts those written and those without content.

    Rows come to the driver one partition at a time, as an archive is one stream.
    """
    out, written, missing = ZipWriter(target), 0, 0
    for r in files.orderBy(*order).select("path", "content").toLocalIterator():
        if r["content"] is None:
            missing += 1
        else:
            out.add(r["path"], r["content"])
            written += 1
    out.finish()
    return written, missing


def write_inventory_csv(rows: DataFrame, path: str) -> None:
    """CSV as spreadsheets read it: quotes doubled, a header, CRLF."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def inventory_csv_lines(rows: DataFrame) -> DataFrame:
    """The CSV line of each row."""
    from papyrion.functions.scalars import csv_cell

    return rows.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in rows.columns]).alias("line"))


def write_urls(urls: DataFrame, path: str) -> None:
    urls.select("url").write.mode("overwrite").text(path)


def export(files: DataFrame, mode: str, root: str, order: list[str], aggregate: str | None = None) -> list[str]:
    """Writes an export: ``folder``, ``zip``, ``aggregate`` (one document) or ``both`` (folder and document). Returns what was written."""
    done = []
    if mode in ("folder", "both"):
        write_files(files, root)
        done.append(root)
    if mode == "zip":
        Path(root).mkdir(parents=True, exist_ok=True)
        with (Path(root) / "export.zip").open("wb") as f:
            write_zip(files, f, order)
        done.append(f"{root}/export.zip")
    if mode in ("aggregate", "both") and aggregate is not None:
        target = safe_target(root, "aggregate.md")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(aggregate, encoding="utf-8")
        done.append(str(target))
    return done


def backup_settings(settings: dict, tag_rules: list[dict]) -> str:
    return json.dumps({"version": 1, "settings": settings, "tagRules": tag_rules}, ensure_ascii=False, indent=2)


def restore_settings(text: str, defaults: dict) -> tuple[dict, list[dict]]:
    """Settings and rules of a backup; unknown keys are dropped, what has the wrong shape is refused."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("settings"), dict):
        raise ValueError("This is no settings backup.")
    rules = data.get("tagRules", [])
    if not isinstance(rules, list):
        raise ValueError("The tag rules of this backup can't be read.")
    return {**defaults, **{k: v for k, v in data["settings"].items() if k in defaults}}, rules


def read_manifest(root: str, folder: str) -> dict | None:
    """A library folder's manifest; None where it is missing or can't be read."""
    try:
        data = json.loads(safe_target(root, f"{folder}/{MANIFEST}").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def write_manifest(root: str, folder: str, manifest: dict) -> None:
    target = safe_target(root, f"{folder}/{MANIFEST}")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(manifest, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def manifest_rows(manifest: dict) -> list[tuple[str, str | None, str | None, str | None]]:
    """path, url, title and content hash of a manifest's files; old manifests have bare paths."""
    return [(f, None, None, None) if isinstance(f, str) else (f.get("path"), f.get("url"), f.get("title"), f.get("contentHash")) for f in manifest.get("files", [])]


def move_folder(root: str, source: str, destination: str) -> int:
    """Moves a library folder: copies, compares, updates the manifest, then deletes. Returns the number of files."""
    if source.lower() == destination.lower():
        raise ValueError("Choose another folder.")
    if destination.lower().startswith(f"{source.lower()}/") or source.lower().startswith(f"{destination.lower()}/"):
        raise ValueError("Choose a folder outside the present one.")
    old, new = safe_target(root, source), safe_target(root, destination)
    if not old.is_dir():
        raise ValueError("The present folder was not found.")
    if new.exists():
        raise ValueError("That folder exists already.")
    try:
        shutil.copytree(old, new)
        files = [p for p in old.rglob("*") if p.is_file()]
        if any((new / p.relative_to(old)).read_bytes() != p.read_bytes() for p in files):
            raise OSError("The copy differs.")
        if (manifest := read_manifest(root, destination)) is not None:
            write_manifest(root, destination, manifest | {"folder": destination})
    except OSError:
        shutil.rmtree(new, ignore_errors=True)
        raise
    shutil.rmtree(old)
    return len(files)


def review_removed(root: str, folder: str, path: str, action: str, day: str) -> int:
    """Archives or deletes a file that awaits review, and notes it. Returns how many still wait."""
    manifest = read_manifest(root, folder)
    if action not in ("archive", "delete"):
        raise ValueError("Choose archive or delete.")
    if manifest is None or path not in manifest.get("removedFromPreviousSync", []):
        raise ValueError("That file does not await review.")
    target = safe_target(root, f"{folder}/{path}")
    if action == "archive":
        kept = safe_target(root, f"{folder}/_archive/{day}/{path}")
        kept.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(target, kept)
    target.unlink(missing_ok=True)
    manifest["removedFromPreviousSync"] = [p for p in manifest["removedFromPreviousSync"] if p != path]
    manifest.setdefault("reviewedRemoved", []).append({"path": path, "action": action, "reviewedAt": day})
    write_manifest(root, folder, manifest)
    return len(manifest["removedFromPreviousSync"])
