"""What an analysis run is asked to do, checked and completed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

# What the fields may hold, and what they hold if nothing is given.
DOMAINS = ("basketball", "football")
SOURCES = ("mock", "hupu_public", "csv", "json", "mediacrawler")
MODES = ("mock", "configured")
PLATFORM, BOARD = "hupu", "nba"
MOST_COMMENTS, MOST_IMAGES = 120, 6
# End of fixed values.


@dataclass(frozen=True)
class AnalysisConfig:
    name: str = ""
    domain: str = "basketball"
    platforms: tuple[str, ...] = (PLATFORM,)
    board: str = BOARD
    match_name: str = ""
    home_team: str = ""
    away_team: str = ""
    match_stage: str = ""
    match_date: str = ""
    keywords: tuple[str, ...] = ()
    thread_urls: tuple[str, ...] = ()
    news_urls: tuple[str, ...] = ()
    news_context: str = ""
    semantic_query: str = ""
    max_comments: int = MOST_COMMENTS
    dedup_threshold: float = 0.86
    enable_insight: bool = True
    mode: str = "mock"
    enable_images: bool = True
    #: Whether clusters by density are tried before k-means.
    density_clusters: bool = False
    max_images: int = MOST_IMAGES
    data_source: str = "mock"
    source_path: str | None = None
    field_mapping: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.domain not in DOMAINS:
            raise ValueError(f"domain is one of {DOMAINS}")
        if self.data_source not in SOURCES:
            raise ValueError(f"data_source is one of {SOURCES}")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if not 1 <= self.max_comments <= 5000:
            raise ValueError("max_comments is from 1 to 5000")
        if not 0 <= self.dedup_threshold <= 1:
            raise ValueError("dedup_threshold is from 0 to 1")
        if not 0 <= self.max_images <= 20:
            raise ValueError("max_images is from 0 to 20")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> AnalysisConfig:
        """Falsy values take their default, an unknown domain or source too; lists lose blanks and repeats, a text splits at commas and lines; the image budget is held to its range."""
        names = {f.name for f in fields(cls)}
        given = {k: v for k, v in values.items() if k in names and v}
        for name, allowed in (("domain", DOMAINS), ("data_source", SOURCES), ("mode", MODES)):
            if given.get(name) not in (*allowed, None):
                given.pop(name)
        for name in ("platforms", "keywords", "thread_urls", "news_urls"):
            if name in given:
                items = split_list(given[name]) if isinstance(given[name], str) else given[name]
                given[name] = tuple(dict.fromkeys(x for x in (str(i).strip() for i in items) if x))
        for name in ("enable_insight", "enable_images", "density_clusters"):
            if values.get(name) is not None:
                given[name] = bool(values[name])
        if values.get("max_images") is not None:
            given["max_images"] = max(0, min(20, int(values["max_images"])))
        return cls(**given)

    @property
    def versus(self) -> str:
        return " vs ".join(t for t in (self.home_team, self.away_team) if t)


def split_list(text: str) -> list[str]:
    """Items of a text field: between commas of either width, or lines."""
    return [x.strip() for x in re.split(r"[,，\n]", text) if x.strip()]
