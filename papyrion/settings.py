"""Settings: their defaults, limits and schedule. They are a handful of values, so they live on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from papyrion.functions.templates import DEFAULT_FILENAME_TEMPLATE, DEFAULT_TEMPLATE

MODES = ("auto", "article", "full", "selection", "sharepoint", "confluence", "tweet")
# The ranges of numbers, with the value taken for what is no number.
RANGES = {"load_budget_ms": (3000, 45000, 12000), "load_step_ms": (150, 2500, 450), "max_pages": (1, 500, 25), "max_depth": (0, 20, 5), "retries": (0, 10, 2)}
FREQUENCIES = ("off", "weekly", "monthly")


@dataclass
class Settings:
    """What a user can set; unknown values fall back to the defaults."""

    mode: str = "auto"
    metadata_style: str = "frontmatter"
    include_title_heading: bool = True
    knowledge_base_preset: bool = False
    use_template: bool = False
    template: str = DEFAULT_TEMPLATE
    filename_template: str = DEFAULT_FILENAME_TEMPLATE
    output_mode: str = "folder"
    load_budget_ms: int = 12000
    load_step_ms: int = 450
    max_pages: int = 25
    max_depth: int = 5
    retries: int = 2
    frequency: str = "off"

    @classmethod
    def load(cls, stored: dict | None) -> Settings:
        """Defaults under what is stored, with numbers in their ranges and choices among their values."""
        known = {f.name for f in fields(cls)}
        values = asdict(cls()) | {k: v for k, v in (stored or {}).items() if k in known and v is not None}
        for name, (low, high, fallback) in RANGES.items():
            values[name] = clamp(values[name], low, high, fallback)
        for name, choices in (("mode", MODES), ("metadata_style", ("frontmatter", "list", "none")), ("output_mode", ("folder", "zip", "aggregate", "both")), ("frequency", FREQUENCIES)):
            if values[name] not in choices:
                values[name] = getattr(cls(), name)
        return cls(**values)

    def save(self) -> dict:
        return asdict(self)


def clamp(value: object, low: int, high: int, fallback: int) -> int:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return fallback
    return fallback if number != number else int(min(max(number, low), high))


def migrate_collections(stored: dict | None) -> list[dict]:
    """Collections of any stored version: version 1 kept a plain list of sites with ``url`` only."""
    if not stored:
        return []
    if stored.get("version", 1) >= 2:
        return list(stored.get("collections", []))
    return [{"collection_id": s.get("id"), "collection_name": s.get("name"), "collection_type": "sharepoint", "source_mode": "rest", "source_url": s.get("url"), "web_url": s.get("url"), "urls": [], "added_at": s.get("addedAt")} for s in stored.get("sites", [])]


@dataclass
class Schedule:
    """When all collections are synced: how often, and when it was done last (milliseconds, none for never)."""

    frequency: str = "off"
    last_completed_at: int | None = None

    @classmethod
    def load(cls, stored: dict | None) -> Schedule:
        stored = stored or {}
        frequency = stored.get("frequency")
        return cls(frequency if frequency in FREQUENCIES else "off", stored.get("last_completed_at") or None)

    def save(self) -> dict:
        return asdict(self)

    def with_frequency(self, frequency: str) -> Schedule:
        """Another frequency; an unknown one switches the schedule off."""
        return Schedule(frequency if frequency in FREQUENCIES else "off", self.last_completed_at)

    def completed(self, at: int) -> Schedule:
        return Schedule(self.frequency, at)
